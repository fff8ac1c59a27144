"""Joins whose hot keys are split, and only those.

The rows of the big side are counted by key first: partial counts, of the key columns alone. Keys with more rows
than a task should read get as many salts as it takes; every other key keeps one task and its other side is not
copied. The engine's own skew handling does not apply behind an aggregate or a declared partitioning, this does.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of one key that a task may read.
ROWS_PER_TASK = 1 << 20
#: Keys that are split at most, the largest ones; any other has under a ten-thousandth of the rows.
HOT_KEYS = 10_000


def hot_keys(counts: DataFrame, keys: list[str], rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """(keys, _salts) of the largest keys among ``counts`` (keys, n) with more than ``rows_per_task`` rows.

    At most ``HOT_KEYS`` rows, whatever the input, so the table may be broadcast.
    """
    salts = F.ceil(F.col("n") / rows_per_task).cast("int")
    return counts.filter(F.col("n") > rows_per_task).orderBy(F.col("n").desc(), *keys).limit(HOT_KEYS).select(*keys, salts.alias("_salts"))


def hot_join(big: DataFrame, small: DataFrame, keys: list[str], how: str = "inner", spread: list[str] | None = None,
             within: Column | None = None, counts: DataFrame | None = None, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """``big`` joined with ``small`` on ``keys`` (``how``: inner, left, left_semi or left_anti).

    ``spread`` are columns that vary within a key and deal its rows (default: all others); ``within`` is a further
    condition over columns of both sides; ``counts`` saves the count where (keys, n) is known. Only hot keys' rows of
    ``small`` are copied, once for each salt. Rows with a null key match nothing.
    """
    if counts is None:
        counts = big.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    hot = F.broadcast(hot_keys(counts.select(*keys, "n"), keys, rows_per_task))
    dealt_by = spread or [c for c in big.columns if c not in keys] or keys
    own = F.when(F.col("_salts").isNotNull(), F.pmod(F.xxhash64(*dealt_by), F.col("_salts")).cast("int")).otherwise(0)
    left = big.join(hot, keys, "left").withColumn("_salt", own).drop("_salts")
    every = F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))
    right = small.join(hot, keys, "left").withColumn("_other_salt", every).drop("_salts").withColumnsRenamed({k: f"_other_{k}" for k in keys})
    same = [F.col(k) == F.col(f"_other_{k}") for k in keys] + [F.col("_salt") == F.col("_other_salt")]
    joined = left.join(right, reduce(and_, same if within is None else [*same, within]), how)
    return joined.drop("_salt", "_other_salt", *[f"_other_{k}" for k in keys])
