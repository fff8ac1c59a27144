"""Ordered-series toolkit: row positions, bounded chunks and carries.

A plain ``Window.partitionBy(activity)`` puts a whole activity in one task. One
activity (or one mis-tagged source) may hold a large share of all rows, so the
per-second operators work on *chunks* instead:

1. ``number_rows`` gives every row its 0-based position in its group. Rows are
   sorted only within a time bucket; a table of bucket counts supplies the offset.
2. ``chunked`` cuts the positions into fixed-size chunks. A frame that looks back
   ``halo`` rows gets those rows copied into the next chunk, marked ``own = false``.
3. Results are kept for ``own`` rows only; state that must cross chunks travels in
   a one-row-per-chunk table.

An activity shorter than a chunk, the usual case, has one chunk and no copies.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK_ROWS = 65_536
ACTIVITY = ["athlete_id", "source_file"]


@contextmanager
def chunk_rows(n: int) -> Iterator[None]:
    """Plans made inside cut their series into chunks of ``n`` rows; results are the same for any ``n``."""
    global CHUNK_ROWS
    before, CHUNK_ROWS = CHUNK_ROWS, n
    try:
        yield
    finally:
        CHUNK_ROWS = before


def hour_bucket(ts: str = "timestamp") -> Column:
    """Hour of a timestamp; rows without one sort first."""
    return F.coalesce(F.date_trunc("hour", F.col(ts)), F.lit("0001-01-01").cast("timestamp"))


def number_rows(
    df: DataFrame,
    keys: list[str],
    order: list,
    bucket: Column,
    seq: str = "seq",
    totals: dict[str, Column] | None = None,
    firsts: dict[str, str] | None = None,
    of_group: DataFrame | None = None,
) -> DataFrame:
    """Add ``seq``, the 0-based position of a row within ``keys`` ordered by ``order``.

    ``bucket`` must not decrease along ``order``; keys must not be null. ``totals`` adds whole-group sums of the
    given counting aggregates and ``firsts`` the group's first value of a column, both
    through the table of buckets, without another pass. So do the columns of ``of_group`` (one row for each
    group); groups that it lacks are left out.
    """
    totals, firsts = totals or {}, firsts or {}
    rows = df.withColumn("_bucket", bucket)
    counts = rows.groupBy(*keys, "_bucket").agg(
        F.count(F.lit(1)).alias("_n"), *[c.alias(n) for n, c in totals.items()],
        *[F.min_by(c, F.struct(*order)).alias(n) for n, c in firsts.items()],
    )
    group = Window.partitionBy(*keys)
    whole = group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *keys,
        "_bucket",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
        *[F.sum(n).over(group).alias(n) for n in totals],
        *[F.first(n).over(whole).alias(n) for n in firsts],
    )
    if of_group is not None:
        offsets = offsets.join(of_group, keys)
    local = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    return (
        rows.withColumn("_pos", F.row_number().over(local))
        .join(offsets, [*keys, "_bucket"])
        .withColumn(seq, F.col("_offset") + F.col("_pos") - 1)
        .drop("_bucket", "_offset", "_pos")
    )


def chunk_of(position: Column, rows: int | None = None) -> Column:
    return F.floor(position / (rows or CHUNK_ROWS))


def chunked(df: DataFrame, halo: int = 0, seq: str = "seq", rows: int | None = None) -> DataFrame:
    """Add ``chunk`` and ``own``; rows within ``halo`` of a later chunk are copied into it.

    Chunks have ``rows`` rows (default: the module's). A row gets one copy for every ``rows`` of the halo.
    """
    home = chunk_of(F.col(seq), rows)
    if halo <= 0:
        return df.withColumn("chunk", home).withColumn("own", F.lit(True))
    copies = F.sequence(home, chunk_of(F.col(seq) + halo, rows))
    return df.withColumn("chunk", F.explode(copies)).withColumn(
        "own", F.col("chunk") == chunk_of(F.col(seq), rows)
    )


def chunk_window(keys: list[str], seq: str = "seq"):
    return Window.partitionBy(*keys, "chunk").orderBy(seq)


def before_chunk(keys: list[str]):
    """All earlier chunks of the group, for one-row-per-chunk tables."""
    return Window.partitionBy(*keys).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)


def trailing(keys: list[str], n: int, seq: str = "seq"):
    """The last ``n`` rows up to the current one, inside a chunk."""
    return chunk_window(keys, seq).rowsBetween(-(n - 1), 0)


def fill_forward(df: DataFrame, keys: list[str], columns: list[str], seq: str = "seq") -> DataFrame:
    """Forward fill across the whole group; a chunk inherits the last value before it.

    The input must carry ``seq``. Adds ``rows``, the group's row count, and ``lead``, the
    first position at which every column has a value (null if that never happens).
    """
    parts = chunked(df, 0, seq).drop("own")
    position = {c: F.when(F.col(c).isNotNull(), F.col(seq)) for c in columns}
    known = parts.groupBy(*keys, "chunk").agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.max_by(c, position[c]).alias(f"_last_{c}") for c in columns],
        *[F.min(position[c]).alias(f"_first_{c}") for c in columns],
    )
    before, group = before_chunk(keys), Window.partitionBy(*keys)
    firsts = [F.min(f"_first_{c}").over(group) for c in columns]
    lead = firsts[0] if len(firsts) == 1 else F.greatest(*firsts)
    complete = F.lit(True)
    for f in firsts:
        complete = complete & f.isNotNull()
    carry = known.select(
        *keys, "chunk", F.sum("_n").over(group).alias("rows"), F.when(complete, lead).alias("lead"),
        *[F.last(f"_last_{c}", ignorenulls=True).over(before).alias(f"_in_{c}") for c in columns],
    )
    within = chunk_window(keys, seq).rowsBetween(Window.unboundedPreceding, 0)
    filled = parts.select(
        "*", *[F.last(c, ignorenulls=True).over(within).alias(f"_fill_{c}") for c in columns]
    ).join(carry, [*keys, "chunk"])
    kept = [c for c in df.columns if c not in columns]
    return filled.select(
        *kept, *[F.coalesce(f"_fill_{c}", f"_in_{c}").alias(c) for c in columns], "rows", "lead"
    )


def salted_join(big: DataFrame, small: DataFrame, keys: list[str], spread: Column, salts: int = 16) -> DataFrame:
    """Equi join whose hot keys in ``big`` spread over ``salts`` tasks; ``small`` has one row
    per key and is repeated per salt. ``spread`` varies within a key."""
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)))
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
    return salted.join(copies, [*keys, "_salt"]).drop("_salt")
