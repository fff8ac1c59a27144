"""Per-second power: repair, peaks, mean-maximal curves, histogram, zones."""

from __future__ import annotations

from datetime import date

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import exact, rint
from ..functions.timekeys import as_date, near_days, utc_date
from ..session import shuffle_width
from . import series
from .series import ACTIVITY
from .skew import hot_join

# ── Fixed values: durations, zones, defaults ────────────────────────────────
PEAK_DURATIONS = {
    5: "5s", 30: "30s", 60: "1min", 300: "5min", 600: "10min",
    1200: "20min", 1800: "30min", 3600: "60min", 5400: "90min", 7200: "120min",
}
CHART_DURATIONS = [
    1, 2, 3, 5, 10, 15, 20, 30, 45, 60, 90, 120, 180, 240, 300, 360, 420, 480, 540, 600,
    720, 900, 1200, 1500, 1800, 2400, 3600, 5400, 7200,
]
CURVE_DURATIONS = list(range(120, 1201))
POWER_ZONES = [
    ("Z1 Recovery", 0.0, 0.55), ("Z2 Endurance", 0.55, 0.75), ("Z3 Tempo", 0.75, 0.90),
    ("Z4 Threshold", 0.90, 1.05), ("Z5 VO2max", 1.05, 1.20), ("Z6 Anaerobic", 1.20, 1.50),
    ("Z7 Neuromuscular", 1.50, None),
]
DEFAULT_FTP = 250.0
DAYS_PER_MONTH = 30

# past this many durations one numpy pass beats one window function per duration
FEW_DURATIONS = 64


def repaired_power(records: DataFrame, order: list[str] | None = None, halo: int = 0,
                   heavy: bool = False, of_activity: DataFrame | None = None, longer_than: int = 0) -> DataFrame:
    """Chunked whole-watt power of every activity that has any.

    A missing value becomes the mean of the two raw values before it when both exist, else
    0; the result is cut to whole watts. Columns: keys, order columns, ``seq``, ``chunk``,
    ``own`` and ``power``. ``halo`` is the look-back the caller needs; values of the copied
    rows are right except in the first two, which no frame within ``halo`` reaches.
    ``heavy`` keeps the configured number of tasks for costly work that follows. ``of_activity`` adds its columns (one
    row for each activity; others are left out). Activities of ``longer_than`` rows or fewer are left out before the
    chunks are dealt.
    """
    order = order or ["timestamp"]
    thin = records.select(*ACTIVITY, *order, "power")
    numbered = series.number_rows(
        thin, ACTIVITY, order, series.hour_bucket(order[0]), totals={"_known": F.count("power"), "_rows": F.count(F.lit(1))},
        of_group=of_activity,
    )
    if longer_than:
        numbered = numbered.filter(F.col("_rows") > longer_than)
    # no chunk is shorter than its look-back, so a row is copied once at most
    parts = series.chunked(numbered.filter(F.col("_known") > 0).drop("_known", "_rows"), halo + 2, rows=max(series.CHUNK_ROWS, halo + 2))
    if heavy:
        parts = parts.repartition(shuffle_width(records), *ACTIVITY, "chunk")
    w = series.chunk_window(ACTIVITY)
    gap = (F.lag("power", 1).over(w) + F.lag("power", 2).over(w)) / 2
    return parts.withColumn("power", F.coalesce("power", gap, F.lit(0.0)).cast("bigint"))


def power_series(records: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Repaired power, one row per recorded point."""
    return repaired_power(records, order).filter("own").drop("own", "chunk")


def _few(records: DataFrame, durations: list[int], order: list[str] | None) -> DataFrame:
    """Best mean per duration from running sums: each window is one subtraction, so cost
    does not grow with the window length, and whole-watt sums are exact."""
    parts = repaired_power(records, order, max(durations) - 1)
    w = series.chunk_window(ACTIVITY)
    summed = parts.withColumn("_c", F.sum("power").over(w))
    spans = summed.select(
        *ACTIVITY, "own", "seq",
        *[(F.col("_c") - F.coalesce(F.lag("_c", d).over(w), F.lit(0))).alias(f"_{d}") for d in durations],
    ).filter("own")
    best = spans.groupBy(*ACTIVITY).agg(
        *[F.max(F.when(F.col("seq") >= d - 1, F.col(f"_{d}"))).alias(f"_{d}") for d in durations]
    )
    entries = F.array(*[
        F.struct(F.lit(d).alias("duration_s"), (F.col(f"_{d}") / F.lit(d)).alias("watts")) for d in durations
    ])
    return best.select(*ACTIVITY, F.explode(entries).alias("e")).select(*ACTIVITY, "e.*")


def _chunk_curve(durations: list[int]):
    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        place = np.argsort(pdf["seq"].to_numpy())
        total = np.concatenate([[0], np.cumsum(pdf["power"].to_numpy(np.int64)[place])])
        first_own = int((~pdf["own"].to_numpy()).sum())  # copies lead the chunk
        rows = len(pdf)
        gained = np.empty(rows + 1, np.int64)  # one buffer for all durations
        found, best = [], []
        for d in durations:
            begin = max(first_own - d + 1, 0)
            if begin + d <= rows and first_own < rows:
                spans = np.subtract(total[begin + d:], total[begin:rows - d + 1], out=gained[:rows - d + 1 - begin])
                found.append(d)
                best.append(np.maximum.reduce(spans))
        reached = np.array(found, np.int32)
        out = pd.DataFrame({"duration_s": reached, "watts": np.array(best, np.int64) / reached})
        for k in ACTIVITY:
            out[k] = pdf[k].iloc[0] if rows else None
        return out[[*ACTIVITY, "duration_s", "watts"]]
    return kernel


def _many(records: DataFrame, durations: list[int], order: list[str] | None) -> DataFrame:
    """A chunk's curve is a row for each duration, so curves are dealt by activity: what meets them by activity needs no further exchange."""
    parts = repaired_power(records, order, max(durations) - 1, heavy=True)
    curves = parts.select(*ACTIVITY, "chunk", "seq", "own", "power").groupBy(*ACTIVITY, "chunk").applyInPandas(
        _chunk_curve(durations), "athlete_id string, source_file string, duration_s int, watts double"
    ).repartition(shuffle_width(records), *ACTIVITY)
    return curves.groupBy(*ACTIVITY, "duration_s").agg(F.max("watts").alias("watts"))


def mean_max_curve(records: DataFrame, durations: list[int] | None = None,
                   order: list[str] | None = None) -> DataFrame:
    """Best mean power per activity and duration, long form, not rounded.

    Durations count recorded points. Durations longer than the activity are left out.
    """
    durations = durations or CURVE_DURATIONS
    if len(durations) <= FEW_DURATIONS:
        return _few(records, durations, order).filter(F.col("watts").isNotNull())
    return _many(records, durations, order)


def peak_powers(records: DataFrame, durations: dict[int, str] | None = None,
                order: list[str] | None = None) -> DataFrame:
    """Whole-watt peak per standard duration; null where the activity is too short."""
    durations = durations or PEAK_DURATIONS
    label = F.create_map(*[F.lit(x) for kv in durations.items() for x in kv])
    return _few(records, list(durations), order).select(
        *ACTIVITY, "duration_s", label[F.col("duration_s")].alias("duration"), rint(F.col("watts")).alias("watts")
    )


def chart_curve(records: DataFrame, durations: list[int] | None = None,
                order: list[str] | None = None) -> DataFrame:
    """Sparse curve for charts, whole watts, only durations the activity reaches."""
    return _few(records, durations or CHART_DURATIONS, order).filter(F.col("watts").isNotNull()).withColumn(
        "watts", rint(F.col("watts"))
    )


def in_window(sessions: DataFrame, as_of: date | str, period_months: int | None) -> DataFrame:
    """Sessions of the last ``period_months`` blocks of 30 days by UTC date; None keeps all."""
    if period_months is None:
        return sessions
    day, first, last = utc_date("timestamp"), F.date_sub(as_date(as_of), period_months * DAYS_PER_MONTH), as_date(as_of)
    return sessions.filter(near_days("timestamp", first, last) & (day >= first) & (day <= last))


def best_curve(sessions: DataFrame, curves: DataFrame, as_of: date | str,
               period_months: int | None = None) -> DataFrame:
    """Best stored watts per athlete and duration over the activities in the window."""
    picked = in_window(sessions, as_of, period_months).select(*ACTIVITY).distinct()
    return curves.join(picked, ACTIVITY, "left_semi").groupBy("athlete_id", "duration_s").agg(
        F.max("watts").alias("watts")
    )


def best_chart_curve(sessions: DataFrame, curves: DataFrame, records: DataFrame, as_of: date | str,
                     period_months: int | None = None, durations: list[int] | None = None,
                     stored: list[int] | None = None, order: list[str] | None = None) -> DataFrame:
    """Chart durations over a window: stored curve points where they exist, the rest straight
    from the records at hand."""
    durations = durations or CHART_DURATIONS
    stored = stored if stored is not None else CURVE_DURATIONS
    picked = in_window(sessions, as_of, period_months).select(*ACTIVITY).distinct()
    kept = best_curve(sessions, curves, as_of, period_months).filter(F.col("duration_s").isin(durations))
    missing = [d for d in durations if d not in set(stored)]
    if not missing:
        return kept
    extra = mean_max_curve(hot_join(records, picked, ACTIVITY, "left_semi"), missing, order)
    best_extra = extra.groupBy("athlete_id", "duration_s").agg(F.max("watts").alias("watts"))
    return kept.unionByName(best_extra).groupBy("athlete_id", "duration_s").agg(F.max("watts").alias("watts"))


def to_process(sessions: DataFrame, stored: DataFrame, processed: DataFrame | None = None) -> DataFrame:
    """Activities without stored curve rows that were not looked at before either.

    ``processed`` are the activities of earlier runs, with or without a curve; append the result to it
    with the curves, so rides that are too short or have no power are not read again.
    """
    done = stored.select(*ACTIVITY)
    if processed is not None:
        done = done.union(processed.select(*ACTIVITY))
    return sessions.select(*ACTIVITY).distinct().join(done.distinct(), ACTIVITY, "left_anti")


def extend_curves(sessions: DataFrame, records: DataFrame, stored: DataFrame,
                  durations: list[int] | None = None, order: list[str] | None = None,
                  processed: DataFrame | None = None) -> DataFrame:
    """Curve rows of activities that are still ``to_process``; append them to the table."""
    new = to_process(sessions, stored, processed)
    return mean_max_curve(hot_join(records, new, ACTIVITY, "left_semi"), durations, order)


def threshold_by_activity(sessions: DataFrame) -> DataFrame:
    """Threshold power per activity: first session's value, default where missing or zero."""
    first = sessions.groupBy(*ACTIVITY).agg(F.min_by("threshold_power", "timestamp").alias("_ftp"))
    return first.select(*ACTIVITY, F.coalesce(F.nullif("_ftp", F.lit(0.0)), F.lit(DEFAULT_FTP)).alias("ftp"))


def zone_number(share: Column) -> Column:
    """1-based zone of power as a share of threshold; null below zero."""
    zone = F.lit(None).cast("int")
    for i, (_, low, high) in reversed(list(enumerate(POWER_ZONES, 1))):
        inside = share >= low if high is None else (share >= low) & (share < high)
        zone = F.when(inside, F.lit(i)).otherwise(zone)
    return zone


def _power_counts(records: DataFrame, order: list[str] | None) -> DataFrame:
    """Points per activity and whole watt: the counts, not the points, meet the sessions."""
    return power_series(records, order).groupBy(*ACTIVITY, "power").agg(F.count(F.lit(1)).alias("n"))


def _with_ftp(df: DataFrame, sessions: DataFrame) -> DataFrame:
    joined = df.join(threshold_by_activity(sessions), ACTIVITY, "left")
    return joined.withColumn("ftp", F.coalesce("ftp", F.lit(DEFAULT_FTP)))


def power_histogram(records: DataFrame, sessions: DataFrame, bin_size: int = 25,
                    order: list[str] | None = None) -> DataFrame:
    """Zero-filled bins from 0 W past the maximum, each with the zone of its midpoint."""
    bins = _power_counts(records, order).groupBy(*ACTIVITY, (F.floor(F.col("power") / bin_size) * bin_size).alias("bin")).agg(
        F.sum("n").alias("n"), F.max("power").alias("top")
    )
    # at most one entry per bin: bounded by the highest watt value
    packed = bins.groupBy(*ACTIVITY).agg(
        F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("_m"), F.max("top").alias("_top")
    )
    last = (F.floor((F.col("_top") + bin_size - 1) / bin_size) * bin_size).cast("bigint")
    spread = packed.select(
        *ACTIVITY, "_m", F.explode(F.sequence(F.lit(0).cast("bigint"), last, F.lit(bin_size).cast("bigint"))).alias("bin")
    )
    counted = spread.select(*ACTIVITY, "bin", F.coalesce(F.col("_m")[F.col("bin")], F.lit(0)).cast("bigint").alias("seconds"))
    zoned = _with_ftp(counted, sessions)
    share = (F.col("bin") + bin_size / 2) / F.col("ftp")
    return zoned.select(*ACTIVITY, "bin", "seconds", F.coalesce(zone_number(share), F.lit(1)).alias("zone"))


def time_in_zones(records: DataFrame, sessions: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Seconds and share per zone, empty zones included."""
    zoned = _with_ftp(_power_counts(records, order), sessions).withColumn(
        "zone", zone_number(F.col("power") / F.col("ftp"))
    )
    sums = [
        F.sum(F.when(F.col("zone") == i, F.col("n")).otherwise(0)).alias(f"_{i}")
        for i in range(1, len(POWER_ZONES) + 1)
    ]
    wide = zoned.groupBy(*ACTIVITY).agg(F.max("ftp").alias("ftp"), F.sum("n").alias("_all"), *sums)
    entries = F.array(*[
        F.struct(F.lit(i).alias("zone"), F.lit(name).alias("zone_name"), F.col(f"_{i}").alias("seconds"))
        for i, (name, _, _) in enumerate(POWER_ZONES, 1)
    ])
    return wide.select(*ACTIVITY, "ftp", "_all", F.explode(entries).alias("e")).select(
        *ACTIVITY, "ftp", "e.*", exact(F.col("e.seconds") / F.col("_all") * 100, 1).alias("pct")
    )
