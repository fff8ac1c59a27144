"""Ingestion of new message files as a Structured Streaming job.

The file source's checkpoint remembers which files were read, so a restart neither skips
nor repeats one. A batch appends the rows that the tables do not hold yet, whatever file they
come from: a retried batch adds nothing, and a source that is split over batches loses nothing.
Batches are committed through the ledger (``sources/ledger.py``): a batch reads only the days, and for rows
without a day the buckets, that it has rows of.
"""

from __future__ import annotations

import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources.ledger import Ledger

MESSAGE_SCHEMA = "athlete_id string, source_file string, msg_type string, fields string"


def append_batch(batch: DataFrame, base: str, msg_types: list[str] | None = None, name: str | None = None) -> None:
    """Append a batch's unseen rows to the tables under ``base``; under a ``name`` it is committed once."""
    Ledger(batch.sparkSession, base).append(batch, name or f"batch-{uuid.uuid4().hex}", msg_types, skip_known=False)


def run_available(spark: SparkSession, source: str, base: str, checkpoint: str,
                  msg_types: list[str] | None = None, max_files: int = 1000) -> StreamingQuery:
    """Process every file not seen before, in batches, then stop."""
    stream = (
        spark.readStream.schema(MESSAGE_SCHEMA)
        .option("maxFilesPerTrigger", max_files)
        .json(source)
    )
    of = f"{zlib.crc32(checkpoint.encode()):08x}"  # batch numbers count within a checkpoint
    return (
        stream.writeStream.foreachBatch(lambda batch, k: append_batch(batch, base, msg_types, f"stream-{of}-{k}"))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
