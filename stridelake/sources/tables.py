"""Readers for stored activity tables: addressing, lookback, projection, sport loads."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timekeys import DEFAULT_TZ, as_date, local_date, to_local
from ..operators.skew import ROWS_PER_TASK, hot_join
from . import schemas as S

# Date column and days kept when a table is read.
LOOKBACK = {
    "session_mesgs": ("timestamp", 4 * 365),
    "record_mesgs": ("timestamp", 182),
    "set_mesgs": ("timestamp", 4 * 365),
    "activity_mesgs": ("timestamp", 4 * 365),
    "split_mesgs": ("start_time", 4 * 365),
    "sleep": ("calendar_date", 4 * 365),
}


class Dataset:
    """Base location of the stored tables. Tenants are rows: filter on ``athlete_id``."""

    def __init__(self, base: str, athlete_id: str | None = None):
        if "://" in base and not base.startswith("file:") and base.count("/") < 3:
            raise ValueError(f"{base!r} names a bucket without a folder")
        if athlete_id is not None and not athlete_id.strip():
            raise ValueError("athlete_id must not be blank")
        self.base = base.rstrip("/")
        self.athlete_id = athlete_id

    def path(self, table: str) -> str:
        return f"{self.base}/{table}"

    def read(self, spark: SparkSession, table: str, as_of: date | str | None = None,
             columns: list[str] | None = None) -> DataFrame:
        df = spark.read.parquet(self.path(table))
        if self.athlete_id is not None:
            df = df.filter(F.col("athlete_id") == self.athlete_id)
        return scan(df, table, as_of, columns)


def within_lookback(df: DataFrame, table: str, as_of: date | str) -> DataFrame:
    """Keep the rows a reader of ``table`` looks at; a table without a rule passes through.

    The comparison is on the bare column so it reaches the parquet reader.
    """
    if table not in LOOKBACK or LOOKBACK[table][0] not in df.columns:
        return df
    column, days = LOOKBACK[table]
    cutoff = F.date_sub(as_date(as_of), days)
    kind = dict(df.dtypes)[column]
    bound = cutoff.cast("string") if kind == "string" else cutoff.cast(kind)
    return df.filter(F.col(column) >= bound)


def within_folders(df: DataFrame, table: str, as_of: date | str) -> DataFrame:
    """Day folders that can hold rows of the lookback; a day earlier, since ``dt`` may be a local day."""
    if table not in LOOKBACK or "dt" not in df.columns:
        return df
    return df.filter(F.col("dt") >= F.date_sub(as_date(as_of), LOOKBACK[table][1] + 1))


def scan(df: DataFrame, table: str, as_of: date | str | None = None,
         columns: list[str] | None = None) -> DataFrame:
    """Projected scan. As in the stored-table contract, the lookback needs its date column
    to be among the projected ones. Then day folders are pruned too, whether or not ``dt`` is."""
    keep = columns
    if keep is None:
        keep = ["athlete_id"] + S.RECORD_READ_COLUMNS if table == "record_mesgs" else df.columns
    keep = [c for c in keep if c in df.columns]
    if as_of is not None and table in LOOKBACK and LOOKBACK[table][0] in keep:
        df = within_folders(df, table, as_of)
    df = df.select(*keep)
    return df if as_of is None else within_lookback(df, table, as_of)


def load_sessions(df: DataFrame | None, sport: str, spark: SparkSession | None = None) -> DataFrame:
    """Sessions of one sport with that sport's schema; no table gives an empty frame."""
    schema = S.session_schema(sport)
    if df is None:
        return (spark or SparkSession.active()).createDataFrame([], schema)
    return S.conform(df.filter(F.col("sport").isin(S.SPORT_VALUES[sport])), schema)


def load_sub_sport(df: DataFrame, sport: str, sub_sport: str, tz: str = DEFAULT_TZ) -> DataFrame:
    """Sessions of any sport and sub-sport pair, with local wall time."""
    picked = df.filter((F.col("sport") == sport) & (F.col("sub_sport") == sub_sport))
    return picked.withColumn("local_timestamp", to_local("timestamp", tz))


def load_local_sessions(df: DataFrame, sport: str, tz: str = DEFAULT_TZ) -> DataFrame:
    """Sessions of one sport with ``local_timestamp`` and ``local_date``."""
    loaded = load_sessions(df, sport)
    return loaded.withColumn("local_timestamp", to_local("timestamp", tz)).withColumn(
        "local_date", local_date("timestamp", tz)
    )


def load_all_sessions(df: DataFrame) -> DataFrame:
    """Sessions of every sport with the three columns the roll-ups need, typed."""
    return S.conform(df, S.REQUIRED_SESSION)


def activity_days(activities: DataFrame, pad_days: int = 1) -> DataFrame:
    """Keys of the activities with the first and last day their rows can lie on (null without a timestamp).

    A session's ``timestamp`` may be its start or its end, so its duration counts both ways; ``pad_days`` covers a
    ``dt`` by local day.
    """
    ts = F.col("timestamp").cast("timestamp")
    lasted = F.make_dt_interval(secs=F.coalesce("total_elapsed_time", F.lit(0.0)).cast("decimal(18,6)")) if "total_elapsed_time" in activities.columns else F.expr("interval '0' second")
    begin = F.least(ts - lasted, F.col("start_time").cast("timestamp")) if "start_time" in activities.columns else ts - lasted
    keys = [c for c in ("athlete_id", "source_file") if c in activities.columns]
    return activities.groupBy(*keys).agg(
        F.when(F.count("*") == F.count("timestamp"), F.date_sub(F.min(F.to_date(begin)), pad_days)).alias("_from"),
        F.when(F.count("*") == F.count("timestamp"), F.date_add(F.max(F.to_date(ts + lasted)), pad_days)).alias("_to"))


def only_activities(df: DataFrame, activities: DataFrame | None, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Rows of the given activities; an activity that holds a large share of them is read by several tasks.

    In a table by day (``dt``) an activity's rows are looked for on its own days, and folders outside all of
    these are not read: the bounds are scalar subqueries on the partition column.
    """
    if activities is None:
        return df
    keys = [c for c in ("athlete_id", "source_file") if c in activities.columns and c in df.columns]
    if "dt" not in df.columns or "timestamp" not in activities.columns:
        return hot_join(df, activities.select(*keys).distinct(), keys, "left_semi", rows_per_task=rows_per_task)
    days = activity_days(activities)
    low = days.select(F.min(F.coalesce("_from", F.lit("0001-01-01").cast("date")))).scalar()
    high = days.select(F.max(F.coalesce("_to", F.lit("9999-12-31").cast("date")))).scalar()
    inside = F.col("_from").isNull() | F.col("dt").between(F.col("_from"), F.col("_to"))
    return hot_join(df.filter((F.col("dt") >= low) & (F.col("dt") <= high)), days, keys, "left_semi", within=inside, rows_per_task=rows_per_task)


def load_records(df: DataFrame, sport: str, activities: DataFrame | None = None,
                 columns: list[str] | None = None) -> DataFrame:
    picked = only_activities(df, activities)
    schema = S.record_schema(sport)
    if columns is not None:
        picked = picked.select(*[c for c in columns if c in picked.columns])
        schema = type(schema)([f for f in schema.fields if f.name in columns])
    return S.conform(picked, schema)


def load_splits(df: DataFrame, activities: DataFrame | None = None) -> DataFrame:
    return S.conform(only_activities(df, activities), S.SPLIT_SCHEMA)


def load_split_summaries(df: DataFrame, activities: DataFrame | None = None) -> DataFrame:
    return S.conform(only_activities(df, activities), S.SPLIT_SUMMARY_SCHEMA)


def recent_records(df: DataFrame, as_of: date | str, days: int = 182) -> DataFrame:
    """Ten-column view of the last ``days`` days, with the day to partition a write by."""
    cutoff = F.date_sub(as_date(as_of), days).cast("timestamp_ntz")
    keep = [c for c in ["athlete_id"] + S.RECORD_VIEW_COLUMNS if c in df.columns]
    return df.filter(F.col("timestamp") >= cutoff).select(*keep).withColumn(
        "dt", F.to_date("timestamp")
    )
