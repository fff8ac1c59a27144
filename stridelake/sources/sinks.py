"""Writers. Layout is chosen so later reads prune and avoid re-sorting."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None,
                mode: str = "append", sort_by: list[str] | None = None, balance: bool = True) -> None:
    """Parquet write; ``mode="overwrite"`` is the full rebuild.

    With ``balance`` a folder's rows come together first: large folders are split, small ones merged.
    """
    if partition_by and balance:
        df = df.hint("rebalance", *partition_by)
    if sort_by:
        df = df.sortWithinPartitions(*(partition_by or []), *sort_by)
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_records(df: DataFrame, path: str, mode: str = "append", per_day: int = 8) -> None:
    """Records by day; each day spreads over ``per_day`` hashed tasks so one busy day or
    athlete is not one task, and rows lie in activity-time order inside a file."""
    from pyspark.sql import functions as F

    spread = F.pmod(F.xxhash64("athlete_id", "source_file", F.date_trunc("hour", "timestamp")), F.lit(per_day))
    placed = df.repartition("dt", spread)
    write_table(placed, path, ["dt"], mode, ["athlete_id", "source_file", "timestamp"], balance=False)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)
