"""Drift of stored tables from their footers, beside the columns of every single folder."""

import json
import random
from datetime import date, timedelta

import pytest

from stridelake.sources import footers as D
from stridelake.sources.ledger import Ledger

MSG = "athlete_id string, source_file string, msg_type string, fields string"


def write(spark, base, day, **columns):
    kinds = ", ".join(f"{c} {k}" for c, k in columns.items())
    spark.createDataFrame([(None,) * len(columns)], kinds).coalesce(1).write.mode("append").parquet(f"{base}/dt={day}" if day else str(base))


def by_folder(spark, base):
    """The same, folder by folder and file by file."""
    found = {}
    for folder in sorted(p for p in base.iterdir() if p.name.startswith("dt=")):
        for file in folder.glob("*.parquet"):
            for c in spark.read.parquet(str(file)).dtypes:
                found.setdefault(c, []).append(folder.name[3:])
    return {c: (min(d), max(d)) for c, d in found.items()}


@pytest.mark.parametrize("seed", range(3))
def test_first_and_last_days_are_those_of_the_folders(spark, tmp_path, seed):
    rng = random.Random(seed)
    names = ["stance", "core", "gear", "slope"]
    life = {c: sorted(rng.sample(range(9), 2)) for c in names}
    for k in range(9):
        day = date(2024, 2, 25) + timedelta(days=k)
        own = {c: "double" for c in names if life[c][0] <= k <= life[c][1] and (k in life[c] or rng.random() < 0.5)}
        write(spark, tmp_path, day, power="double" if k < 4 + seed else "string", **own)
    assert D.stored_columns(spark, str(tmp_path)) == by_folder(spark, tmp_path)


def test_files_of_one_folder_may_disagree(spark, tmp_path):
    for kind in ("double", "string", "double", "bigint"):
        write(spark, tmp_path, "2024-01-03", power=kind, **({"core": "int"} if kind == "bigint" else {}))
    write(spark, tmp_path, "2024-01-01", power="double")
    assert D.stored_columns(spark, str(tmp_path)) == by_folder(spark, tmp_path) == {
        ("power", "double"): ("2024-01-01", "2024-01-03"), ("power", "string"): ("2024-01-03",) * 2,
        ("power", "bigint"): ("2024-01-03",) * 2, ("core", "int"): ("2024-01-03",) * 2}


def test_unchanged_folders_cost_one_job(spark, tmp_path):
    for k in range(8):
        write(spark, tmp_path, f"2024-01-0{k + 1}", power="double")
    found = D.Footers(spark, D.day_folders(spark, str(tmp_path)))
    assert found.appearances() == {("power", "double"): 0}
    reads = len(found._known)
    assert reads <= 4  # down to the first folder, nothing to the right of it
    assert found.appearances(last=True) == {("power", "double"): 7} and len(found._known) <= reads + 3


def test_tables_without_days_or_files(spark, tmp_path):
    write(spark, tmp_path / "flat", None, power="double")
    assert D.stored_columns(spark, str(tmp_path / "flat")) == {("power", "double"): (None, None)}
    assert D.stored_columns(spark, str(tmp_path / "none")) == {}
    assert D.stored_drift(spark, {"record_mesgs": str(tmp_path / "none")}).collect() == []


def test_drift_of_a_ledger_reads_no_rows_and_no_uncommitted_file(spark, tmp_path):
    store = Ledger(spark, str(tmp_path))
    assert store.drift().collect() == []
    rows = [("a", "f", "record_mesgs", json.dumps({"timestamp": "2024-05-01 10:00:00", "power": 5, "novel": 1}))]
    store.append(spark.createDataFrame(rows, MSG), "one")
    write(spark, tmp_path / "record_mesgs", "2024-05-02/bucket=0/batch=two", timestamp="timestamp_ntz", strange="int")
    assert store.drift().collect() == []
    write(spark, tmp_path / "record_mesgs", "2024-05-03/bucket=0/batch=one", power="string", strange="int")
    got = store.drift()
    assert "LocalTableScan" in got._jdf.queryExecution().executedPlan().toString() or "ExistingRDD" in got._jdf.queryExecution().executedPlan().toString()
    assert "FileScan" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.column, r.status, r.stored_type, r.first_day) for r in got.collect()) == [
        ("power", "type", "string", "2024-05-03"), ("strange", "undeclared", "int", "2024-05-03")]


def test_declared_columns_that_no_file_holds(spark, tmp_path):
    write(spark, tmp_path, "2024-01-01", timestamp="timestamp_ntz")
    got = D.stored_drift(spark, {"record_mesgs": str(tmp_path)})
    assert {r.status for r in got.collect()} == {"missing"}
    assert "power" in {r.column for r in got.collect()}
