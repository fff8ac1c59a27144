"""Critical power: fit, fit over time, W' balance."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import exact, rint
from ..functions.timekeys import as_date, month_start, utc_date
from ..session import shuffle_width
from . import series
from .power import DAYS_PER_MONTH, DEFAULT_FTP, repaired_power
from .series import ACTIVITY

OWNER = "athlete_id"
# Fit range in seconds, and constants of the recovery model.
FIT_RANGE = (120, 1200)
MIN_POINTS = 3
RIDE_MONTHS = 3
DEFAULT_WPRIME_KJ = 15.0
EULER = 2.718281828
LOW_SHARE = 0.25


def fit(curve: DataFrame, keys: list[str], fit_range: tuple[int, int] = FIT_RANGE) -> DataFrame:
    """P = CP + W'/t per ``keys``; nulls where there are too few points or W' is negative."""
    inverse = F.lit(1.0) / F.col("duration_s")
    inside = curve.filter(F.col("duration_s").between(*fit_range) & F.col("watts").isNotNull())
    found = inside.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("points"),
        F.regr_slope("watts", inverse).alias("_w"),
        F.regr_intercept("watts", inverse).alias("_cp"),
        F.regr_r2("watts", inverse).alias("_r2"),
        (F.max("watts") == F.min("watts")).alias("_flat"),
    )
    # strip summation noise first, so a value on a rounding tie does not depend on row order
    cp, wprime, r2 = F.round("_cp", 6), F.round("_w", 6), F.round("_r2", 9)
    ok = (F.col("points") >= MIN_POINTS) & (F.col("_w") >= 0)
    return found.select(
        *keys, "points",
        F.when(ok, rint(cp)).alias("cp"),
        F.when(ok, exact(wprime / 1000, 1)).alias("wprime_kj"),
        F.when(ok & ~F.col("_flat"), exact(r2, 3)).alias("r2"),
        F.when(ok, F.col("_cp")).alias("cp_exact"),
        F.when(ok, F.col("_w")).alias("wprime_exact"),
    )


def fitted_points(curve: DataFrame, fits: DataFrame, keys: list[str],
                  fit_range: tuple[int, int] = FIT_RANGE) -> DataFrame:
    """Measured and fitted watts per duration in the fit range."""
    inside = curve.filter(F.col("duration_s").between(*fit_range))
    model = fits.filter(F.col("cp").isNotNull()).select(*keys, "cp_exact", "wprime_exact")
    fitted = exact(F.col("cp_exact") + F.col("wprime_exact") / F.col("duration_s"), 1)
    return inside.join(model, keys).select(*keys, "duration_s", "watts", fitted.alias("fitted_watts"))


def over_time(sessions: DataFrame, curves: DataFrame, period_months: int,
              fit_range: tuple[int, int] = FIT_RANGE) -> DataFrame:
    """Fit at every month start, each over the ``period_months`` × 30 days before it.

    A ride is sent to the few month starts whose window holds it, so the rolling window is an equi-key aggregate:
    no row meets rows of other days. Curves are dealt once, by athlete and duration, over the configured width; rides of
    the same months are reduced before their watts are repeated for each month, and what is repeated does not travel.
    As a row becomes up to ``period_months`` rows in its task, there are that many times more tasks.
    """
    span = period_months * DAYS_PER_MONTH
    bounds = sessions.groupBy(OWNER).agg(
        F.min(utc_date("timestamp")).alias("_min"), F.max(utc_date("timestamp")).alias("_max")
    ).filter(F.date_add("_min", span) <= F.col("_max")).select(
        OWNER, month_start(F.date_add("_min", span)).alias("_first"), month_start(F.col("_max")).alias("_last")
    )
    days = sessions.select(*ACTIVITY, utc_date("timestamp").alias("day")).filter(F.col("day").isNotNull())
    next_start = F.when(F.dayofmonth("day") == 1, F.col("day")).otherwise(F.add_months(month_start(F.col("day")), 1))
    last_start = month_start(F.date_add("day", span))
    served = days.join(bounds, OWNER).select(
        *ACTIVITY, F.greatest(next_start, "_first").alias("_from"), F.least(last_start, "_last").alias("_to")
    ).filter(F.col("_from") <= F.col("_to"))
    inside = curves.filter(F.col("duration_s").between(*fit_range) & F.col("watts").isNotNull())
    dealt = inside.join(served, ACTIVITY).select(OWNER, "duration_s", "_from", "_to", "watts").repartition(
        shuffle_width(curves) * period_months, OWNER, "duration_s")
    spans = dealt.groupBy(OWNER, "duration_s", "_from", "_to").agg(F.max("watts").alias("watts"))
    reached = spans.select(OWNER, "duration_s", "watts", F.explode(F.sequence("_from", "_to", F.expr("interval 1 month"))).alias("date"))
    monthly = reached.groupBy(OWNER, "date", "duration_s").agg(F.max("watts").alias("watts"))
    return fit(monthly, [OWNER, "date"], fit_range).filter(F.col("cp").isNotNull()).select(
        OWNER, "date", "cp", "wprime_kj", "r2"
    )


def ride_models(sessions: DataFrame, curves: DataFrame, period_months: int = RIDE_MONTHS,
                fit_range: tuple[int, int] = FIT_RANGE) -> DataFrame:
    """CP and W' that apply to each ride: a fit over the months up to its day, else its
    threshold power and the default W'.

    A ride is sent to the ride days of its athlete it serves, its own and those of the months after it, so the look-back is
    an equi-key aggregate. The days, one short list for each activity, meet the curves where these lie; curves are dealt
    once, by athlete and duration, and what is repeated for each day does not travel.
    """
    span = period_months * DAYS_PER_MONTH
    dated = sessions.select(*ACTIVITY, utc_date("timestamp").alias("day")).filter(F.col("day").isNotNull()).distinct()
    ahead = Window.partitionBy(OWNER).orderBy(F.unix_date("day")).rangeBetween(0, span)
    ridden = dated.select(OWNER, "day").distinct().select(OWNER, "day", F.collect_list("day").over(ahead).alias("_days"))
    served = dated.join(ridden, [OWNER, "day"]).select(*ACTIVITY, "_days")
    inside = curves.filter(F.col("duration_s").between(*fit_range) & F.col("watts").isNotNull())
    dealt = inside.join(served, ACTIVITY).select(OWNER, "duration_s", "watts", "_days").repartition(
        shuffle_width(curves), OWNER, "duration_s")
    reached = dealt.select(OWNER, "duration_s", "watts", F.explode("_days").alias("day"))
    rolling = reached.groupBy(OWNER, "day", "duration_s").agg(F.max("watts").alias("watts"))
    fits = fit(rolling, [OWNER, "day"], fit_range).select(OWNER, "day", "cp", "wprime_kj")
    first = sessions.groupBy(*ACTIVITY).agg(
        F.min(utc_date("timestamp")).alias("day"), F.min_by("threshold_power", "timestamp").alias("_ftp")
    )
    joined = first.join(fits, [OWNER, "day"], "left")
    fitted = F.col("cp").isNotNull() & F.col("wprime_kj").isNotNull()
    fallback = F.coalesce(F.col("_ftp").cast("bigint"), F.lit(int(DEFAULT_FTP)).cast("bigint"))
    return joined.select(
        *ACTIVITY, F.when(fitted, F.col("cp")).otherwise(fallback).alias("cp"),
        F.when(fitted, F.col("wprime_kj")).otherwise(F.lit(DEFAULT_WPRIME_KJ)).alias("wprime_kj"),
        fitted.alias("from_model"),
    )


def _power_of_e(x: Column) -> Column:
    return F.pow(F.lit(EULER), x)


def _steps(points: DataFrame) -> DataFrame:
    """Per point of a chunk: the three running numbers of the closed form.

    Each second maps the balance b to max(l, m·b + c): at or above CP m = 1, c = −excess,
    l = 0; below it m decays and c refills, without a floor. With M the running product of
    m, S the running sum of c/M and V the running maximum of −S over depleting points, the
    balance after a point is M·(S + max(b_in, V)), b_in being the balance before the chunk.
    M is e to minus a running sum and stays far above underflow inside a chunk.
    """
    wp = F.col("wprime_kj") * 1000
    first = F.col("seq") == 0
    deplete = ~first & (F.col("power") >= F.col("cp"))
    recover = ~first & (F.col("power") < F.col("cp"))
    rate = 1.0 / (546.0 * _power_of_e(-0.01 * (F.col("cp") - F.col("power"))) + 316.0)
    w = series.chunk_window(ACTIVITY)
    running = points.withColumn("_rate", F.when(recover, rate).otherwise(0.0)).withColumn("_t", F.sum("_rate").over(w))
    change = (
        F.when(deplete, (F.col("cp") - F.col("power")).cast("double"))
        .when(recover, wp * (1 - _power_of_e(-F.col("_rate"))))
        .otherwise(0.0)
    )
    summed = running.withColumn("_s", F.sum(change * _power_of_e(F.col("_t"))).over(w))
    return summed.withColumn("_v", F.max(F.when(deplete, -F.col("_s"))).over(w))


def _after(b: Column, t: Column, s: Column, v: Column) -> Column:
    return _power_of_e(-t) * (s + F.greatest(b, v))


_ENTRY = "athlete_id string, source_file string, chunk bigint, b_in double"


def _entering(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One pass over the chunks of activities in order: the balance before each one.

    A chunk maps the balance b to max(a b + c, low); only that of the activity at hand is held.
    """
    held, b = None, 0.0
    for batch in batches:
        entries = []
        for r in batch.to_pylist():
            activity = (r["athlete_id"], r["source_file"])
            if activity != held:
                held, b = activity, r["full"]
            entries.append({"athlete_id": activity[0], "source_file": activity[1], "chunk": r["chunk"], "b_in": b})
            b = r["a"] * b + r["c"]
            if r["low"] is not None:
                b = max(b, r["low"])
        if entries:
            yield pa.RecordBatch.from_pylist(entries, schema=pa.schema([
                ("athlete_id", pa.string()), ("source_file", pa.string()), ("chunk", pa.int64()), ("b_in", pa.float64())]))


def wprime_balance(records: DataFrame, models: DataFrame, order: list[str] | None = None) -> DataFrame:
    """W' balance of every point. ``models`` is ``ride_models``' result.

    Chunks are solved side by side: each is a map of the balance it begins with, a pass over one small row per chunk
    applies these maps in turn, and the balances found meet the points again. An activity of one chunk begins it with
    all of its W', so only the points of longer activities are worked through for the maps.
    """
    found = models.select(*ACTIVITY, "cp", "wprime_kj")
    own = lambda parts: parts.filter("own").drop("own")
    points = _steps(own(repaired_power(records, order, heavy=True, of_activity=found)))
    longer = _steps(own(repaired_power(records, order, heavy=True, of_activity=found, longer_than=series.CHUNK_ROWS)))
    keys = [*ACTIVITY, "chunk"]
    after, last = _power_of_e(-F.col("t")), F.struct("_t", "_s")
    ends = longer.groupBy(*keys).agg(
        (F.max("wprime_kj") * 1000).alias("full"), F.max_by(last, "seq").alias("e"), F.max("_v").alias("v"),
    ).select(*keys, "full", F.col("e._t").alias("t"), F.col("e._s").alias("s"), "v").select(
        *keys, "full", after.alias("a"), (after * F.col("s")).alias("c"), (after * (F.col("s") + F.col("v"))).alias("low")
    )
    entering = (ends.repartition(shuffle_width(records), *ACTIVITY).sortWithinPartitions(*keys)
                .mapInArrow(_entering, _ENTRY))
    wp = F.col("wprime_kj") * 1000
    solved = points.join(entering, keys, "left").withColumn(
        "balance", _after(F.coalesce("b_in", wp), F.col("_t"), F.col("_s"), F.col("_v")))
    return solved.select(
        *ACTIVITY, "seq", (F.col("seq") / 60.0).alias("time_min"), "power",
        (F.col("balance") / 1000).alias("wprime_bal_kj"),
        F.try_divide(F.col("balance"), wp).alias("_share"), "cp", "wprime_kj",
    ).withColumn("wprime_pct", F.col("_share") * 100).drop("_share")


def wprime_summary(balance: DataFrame) -> DataFrame:
    """Lowest balance and seconds under a quarter of W' per activity."""
    low = F.col("wprime_bal_kj") < F.col("wprime_kj") * LOW_SHARE
    return balance.groupBy(*ACTIVITY).agg(
        F.max("cp").alias("cp"), F.max("wprime_kj").alias("wprime_kj"),
        exact(F.min("wprime_bal_kj"), 1).alias("min_kj"),
        (F.max("wprime_kj") * LOW_SHARE).alias("low_kj"),
        F.sum(F.when(low, 1).otherwise(0)).cast("bigint").alias("seconds_low"),
    )
