import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from stridelake.operators import series
from stridelake.session import get_spark


@pytest.fixture(scope="session")
def spark():
    session = get_spark("tests", "local[8]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
    })
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def small_chunks(monkeypatch):
    """Chunks of a few rows, so short fixtures cross many chunk edges."""
    monkeypatch.setattr(series, "CHUNK_ROWS", 7)


def rows(df, *keys):
    return [r.asDict(recursive=True) for r in df.orderBy(*keys).collect()] if keys else [r.asDict(recursive=True) for r in df.collect()]
