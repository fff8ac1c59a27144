"""Ingestion in committed batches.

A batch writes its rows under ``<type>/dt=<day>/bucket=<b>/batch=<id>``, then one row for each (athlete, source, type,
day, bucket) it holds to ``entries``, and last a single row to ``commits``. Readers see rows of committed batches
only, so a crash between two tables shows nothing of the batch, and a retry under the same id replaces
its own folders. What is stored is known from the entries: no table is read to skip known sources, and a
batch meets the stored rows of its own days and buckets only.

The types of a batch are written side by side. What they wrote is counted into entries once all of them are done: no plan that is kept
reads a path written meanwhile, which would drop it and have it worked out again.

Days spread dated rows; rows without a day (types without one, null times) lie under one date and are spread over
buckets by their content. A rebuild is a batch of the next generation: readers go by the latest one, what came before stays
until its folders are removed.
"""

from __future__ import annotations

from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from datetime import date
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shuffle_width
from . import footers
from . import messages as M

#: Column that gives a row's day; types without one are undated.
DAY_OF = {"record_mesgs": "timestamp", "session_mesgs": "timestamp", "activity_mesgs": "timestamp",
          "split_mesgs": "start_time", "file_id_mesgs": "time_created"}
UNDATED = date(1900, 1, 1)
BUCKETS = 16
PLACE = ["dt", "bucket", "batch"]
SOURCE = ["athlete_id", "source_file"]


def table(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path``, None if there is none yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def placed(rows: DataFrame, msg_type: str) -> DataFrame:
    """``rows`` with their day and bucket; the bucket goes by the content, whatever source it came from."""
    day = F.to_date(DAY_OF[msg_type]) if msg_type in DAY_OF else F.lit(None).cast("date")
    content = F.pmod(F.xxhash64(*[c for c in rows.columns if c != "source_file"]), F.lit(BUCKETS)).cast("int")
    return (rows.withColumn("dt", F.coalesce(day, F.lit(UNDATED)))
            .withColumn("bucket", F.when(F.col("dt") == F.lit(UNDATED), content).otherwise(0)))


def within_places(places: Iterable[tuple[date, int]]) -> Column:
    """Partition filter for the (day, bucket) pairs of a batch: bounds first, then the listed days and buckets."""
    places = list(places)
    days = sorted({d for d, _ in places if d != UNDATED})
    buckets = sorted({b for d, b in places if d == UNDATED})
    dated = F.col("dt").between(F.lit(days[0]), F.lit(days[-1])) & F.col("dt").isin(days) if days else F.lit(False)
    undated = (F.col("dt") == F.lit(UNDATED)) & F.col("bucket").isin(buckets) if buckets else F.lit(False)
    return undated if not days else dated if not buckets else dated | undated


class Ledger:
    """Tables of messages under ``base`` with the record of what is committed."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")

    def commits(self) -> DataFrame | None:
        """(batch, generation) of the batches that count."""
        found = table(self.spark, f"{self.base}/commits")
        if found is None:
            return None
        return found.filter(F.col("generation") == found.select(F.max("generation")).scalar())

    def entries(self) -> DataFrame | None:
        """(athlete_id, source_file, msg_type, dt, bucket, rows, batch) of what is committed."""
        commits, found = self.commits(), table(self.spark, f"{self.base}/entries")
        return None if commits is None or found is None else found.join(commits.select("batch"), "batch", "left_semi")

    def read(self, msg_type: str, places: Iterable[tuple[date, int]] | None = None) -> DataFrame | None:
        """Committed rows of a type, of the given (day, bucket) pairs or all; None before the first commit."""
        stored, commits = table(self.spark, f"{self.base}/{msg_type}"), self.commits()
        if stored is None or commits is None:
            return None
        if places is not None:
            stored = stored.filter(within_places(places))
        return stored.join(commits.select("batch"), "batch", "left_semi")

    def drift(self) -> DataFrame:
        """How the files of committed batches depart from the declared schemas; footers only, no rows are read."""
        commits = self.commits()
        tables = {} if commits is None else {t: f"{self.base}/{t}" for t in M.S.MESSAGE_TYPES}
        return footers.stored_drift(self.spark, tables, commits)

    def unknown(self, messages: DataFrame) -> DataFrame:
        """Messages whose (activity, type) no committed batch holds; only the entries are read."""
        entries = self.entries()
        if entries is None:
            return messages
        return messages.join(entries.select(*SOURCE, "msg_type").distinct(), [*SOURCE, "msg_type"], "left_anti")

    def stage(self, messages: DataFrame, batch: str, msg_types: list[str] | None = None, rebuild: bool = False) -> None:
        """Write a batch's unseen rows and its entries; nothing of it is visible before ``commit``."""
        if not batch[:1].isalpha() or "/" in batch:
            raise ValueError(f"a batch id starts with a letter and names a folder, {batch!r} does not")
        kinds = list(dict.fromkeys(msg_types or M.S.MESSAGE_TYPES))
        # parsing costs far more than its bytes, so messages are dealt over the configured width however their files are cut
        dealt = messages.filter(F.col("msg_type").isin(kinds)).repartition(shuffle_width(messages)).persist()
        try:
            dealt.count()  # once, ahead of the types that read it together
            # a small batch is mostly waiting for the driver, so the types are staged side by side; each thread has properties of its own
            with ThreadPoolExecutor(len(kinds)) as side_by_side:
                staged = {kind: side_by_side.submit(inheritable_thread_target(self.spark)(self._stage_type), dealt, batch, kind, rebuild) for kind in kinds}
            placed_at = {kind: done.result() for kind, done in staged.items()}
        finally:
            dealt.unpersist()
        self._write_entries(batch, {kind: places for kind, places in placed_at.items() if places})

    def _stage_type(self, messages: DataFrame, batch: str, msg_type: str, rebuild: bool) -> list[tuple[date, int]]:
        """Write the unseen rows of a type; the places of all its rows."""
        rows = placed(M.dedup(M.flatten_messages(messages, msg_type).filter(~F.col("_bad")).drop("_bad")), msg_type).persist()
        try:
            # one value for each day of the batch, and the buckets if some rows have none
            places = [(r.dt, r.bucket) for r in rows.select("dt", "bucket").distinct().collect()]
            if places:
                stored = None if rebuild else self.read(msg_type, places)
                new = rows if stored is None else M.without_stored(rows, stored.drop("batch"))
                self._write(new.withColumn("batch", F.lit(batch)), f"{self.base}/{msg_type}")
        finally:
            rows.unpersist()
        return places

    def _write_entries(self, batch: str, places: dict[str, list[tuple[date, int]]]) -> None:
        """One row for each (athlete, source, type, day, bucket) of the batch, counted from two columns of the files just written."""
        found = [(kind, table(self.spark, f"{self.base}/{kind}"), at) for kind, at in places.items()]
        parts = [rows.filter((F.col("batch") == batch) & within_places(at))
                 .select(*SOURCE, "dt", "bucket", "batch", F.lit(kind).alias("msg_type")) for kind, rows, at in found if rows is not None]
        if parts:
            entries = reduce(DataFrame.unionByName, parts).groupBy(*SOURCE, "dt", "bucket", "batch", "msg_type").agg(F.count(F.lit(1)).alias("rows"))
            (entries.write.option("partitionOverwriteMode", "dynamic").mode("overwrite")
             .partitionBy("batch", "msg_type").parquet(f"{self.base}/entries"))

    def _write(self, rows: DataFrame, path: str) -> None:
        order = [c for c in (*SOURCE, "timestamp") if c in rows.columns]
        # a folder's rows together, large folders split and small ones merged by what the shuffle finds
        laid = rows.hint("rebalance", "dt", "bucket").sortWithinPartitions("dt", "bucket", *order)
        laid.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy(*PLACE).parquet(path)

    def commit(self, batch: str, rebuild: bool = False) -> None:
        """Make a staged batch visible: one row in one file."""
        found = table(self.spark, f"{self.base}/commits")
        last = 0 if found is None else found.agg(F.max("generation")).first()[0]
        row = self.spark.createDataFrame([(batch, last + rebuild)], "batch string, generation int")
        row.coalesce(1).write.mode("append").parquet(f"{self.base}/commits")

    def committed(self, batch: str) -> bool:
        found = table(self.spark, f"{self.base}/commits")
        return found is not None and bool(found.filter(F.col("batch") == batch).take(1))

    def append(self, messages: DataFrame, batch: str, msg_types: list[str] | None = None, skip_known: bool = True,
               rebuild: bool = False) -> None:
        """Ingest a batch once, however often it is tried under this id.

        ``skip_known`` leaves out (activity, type) pairs of earlier batches, as for whole files; without it, as for
        sources that come in parts, only rows that are stored already are left out. ``rebuild`` starts over.
        """
        if self.committed(batch):
            return
        fresh = self.unknown(messages) if skip_known and not rebuild else messages
        self.stage(fresh, batch, msg_types, rebuild)
        self.commit(batch, rebuild)
