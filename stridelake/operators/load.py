"""Training load: daily stress, fitness/fatigue/form, forecast with overrides.

Fitness and fatigue are exponential averages over *dense* days, but between training days
they only decay, so the recursion is solved on the training days alone and the dense days
are generated last, each a power of the decay away from the training day before it.
A group is one athlete's training days, already summed per day: the calendar bounds it.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timekeys import DEFAULT_TZ, as_date, local_date

OWNER = "athlete_id"
# Fixed values.
CTL_DAYS = 42
ATL_DAYS = 7
PROJECTION_DAYS = 60
LOOKBACK_DAYS = 42
OVERRIDE_DAYS = 21
MIN_TSS, MAX_TSS = 0.0, 500.0
SAME = 0.05

# days per block of the closed form; the decay to this power stays far from overflow
BLOCK = 256


def training_days(rides: DataFrame, tz: str = DEFAULT_TZ) -> DataFrame:
    """Stress per athlete and local day. A missing score is estimated from time, power,
    intensity and threshold where all are there."""
    have = set(rides.columns)
    pieces = []
    if "training_stress_score" in have:
        pieces.append(F.col("training_stress_score"))
    if {"total_timer_time", "normalized_power", "intensity_factor", "threshold_power"} <= have:
        work = F.col("total_timer_time") * F.col("normalized_power") * F.col("intensity_factor")
        pieces.append(F.try_divide(work, F.col("threshold_power") * 3600) * 100)
    if not pieces:
        raise ValueError("rides carry neither a stress score nor the columns to estimate one")
    return rides.groupBy(OWNER, local_date("timestamp", tz).alias("date")).agg(
        F.coalesce(F.sum(F.coalesce(*pieces)), F.lit(0.0)).alias("tss")
    )


def _spread(days: DataFrame, end: Column, *decaying: str, since: date | str | None = None) -> DataFrame:
    """One row per calendar day from each training day to the next (or ``end``); ``offset``
    counts days since the training day. Days before ``since`` are not made at all."""
    following = F.lead("date").over(Window.partitionBy(OWNER).orderBy("date"))
    until = F.coalesce(F.date_sub(following, 1), end)
    begin = F.lit(0) if since is None else F.greatest(F.lit(0), F.datediff(as_date(since), "date"))
    staged = days.select(OWNER, "date", "tss", *decaying, until.alias("_until"))
    if since is not None:
        staged = staged.filter(F.col("_until") >= as_date(since))
    return staged.select(OWNER, "date", "tss", *decaying, F.sequence(begin, F.datediff("_until", "date")).alias("_gap")).select(
        OWNER, F.explode("_gap").alias("offset"), F.col("date").alias("_from"), "tss", *decaying
    ).select(
        OWNER, F.date_add("_from", F.col("offset")).alias("date"), "offset",
        F.when(F.col("offset") == 0, F.col("tss")).otherwise(0.0).alias("tss"), *decaying,
    )


def daily_tss(days: DataFrame, as_of: date | str, horizon: int = PROJECTION_DAYS) -> DataFrame:
    """Every calendar day from the first training day to ``horizon`` days past ``as_of``."""
    end = F.date_add(as_date(as_of), horizon)
    return _spread(days.filter(F.col("date") <= end), end).select(
        OWNER, "date", "tss", (F.col("date") > as_date(as_of)).alias("is_projection")
    )


def _average(alpha: float, name: str, days: DataFrame) -> DataFrame:
    """Exponential average on training days that carry ``_i``, the day's index.

    Inside a block the sum of decayed impulses has a closed form; whole earlier blocks
    arrive as a short list of block totals, folded in order.
    """
    keep = 1.0 - alpha
    block, at = F.floor(F.col("_i") / BLOCK), F.col("_i") % BLOCK
    impulse = F.lit(alpha) * F.col("tss")
    in_block = Window.partitionBy(OWNER, "_b")
    earlier = Window.partitionBy(OWNER).orderBy("_b").rangeBetween(Window.unboundedPreceding, -1)
    staged = days.withColumn("_b", block).withColumn("_p", at)
    grown = F.sum(impulse * F.pow(F.lit(keep), -F.col("_p"))).over(in_block.orderBy("_i"))
    total = F.sum(impulse * F.pow(F.lit(keep), BLOCK - 1 - F.col("_p"))).over(in_block)
    first = F.row_number().over(in_block.orderBy("_i")) == 1
    staged = staged.select(
        "*", (F.pow(F.lit(keep), F.col("_p")) * grown).alias("_in"),
        F.when(first, F.struct(F.col("_b").alias("b"), total.alias("t"))).alias("_tot"),
    )
    past = F.collect_list("_tot").over(earlier)
    return staged.withColumn("_past", past).withColumn(
        name,
        F.col("_in") + F.pow(F.lit(keep), F.col("_p") + 1) * F.aggregate(
            F.col("_past"), F.lit(0.0),
            lambda acc, e: acc + e["t"] * F.pow(F.lit(keep), (F.col("_b") - 1 - e["b"]) * BLOCK),
        ),
    ).drop("_b", "_p", "_in", "_tot", "_past")


def _alphas(ctl_days: int, atl_days: int) -> dict[str, float]:
    return {"ctl": 2.0 / (ctl_days + 1), "atl": 2.0 / (atl_days + 1)}


def _on_training_days(days: DataFrame, alphas: dict[str, float]) -> DataFrame:
    first = F.min("date").over(Window.partitionBy(OWNER))
    solved = days.withColumn("_i", F.datediff("date", first))
    for name, alpha in alphas.items():
        solved = _average(alpha, name, solved)
    return solved.drop("_i")


def _decayed(rows: DataFrame, alphas: dict[str, float]) -> DataFrame:
    return rows.select(*[
        (F.col(c) * F.pow(F.lit(1.0 - alphas[c]), F.col("offset"))).alias(c) if c in alphas else F.col(c)
        for c in rows.columns if c != "offset"
    ])


def training_load(days: DataFrame, as_of: date | str, ctl_days: int = CTL_DAYS, atl_days: int = ATL_DAYS,
                  horizon: int = PROJECTION_DAYS, since: date | str | None = None) -> DataFrame:
    """Fitness (ctl), fatigue (atl) and form (tsb) for every day, seeded at zero.

    ``since`` limits the rows, not the history they rest on: training days are solved
    without the days between them, so a window costs the days it shows.
    """
    alphas = _alphas(ctl_days, atl_days)
    end = F.date_add(as_date(as_of), horizon)
    solved = _on_training_days(days.filter(F.col("date") <= end), alphas)
    dense = _decayed(_spread(solved, end, *alphas, since=since), alphas)
    return dense.select(
        OWNER, "date", "tss", (F.col("date") > as_date(as_of)).alias("is_projection"),
        "ctl", "atl", (F.col("ctl") - F.col("atl")).alias("tsb"),
    )


def parse_overrides(raw: DataFrame) -> DataFrame:
    """(athlete_id, seq, date text, tss text) to one number per date; of rows with a usable
    number for the same date the latest wins."""
    usable = raw.select(
        OWNER, "seq", F.trim("date").alias("date"), F.trim("tss").try_cast("double").alias("tss")
    ).filter((F.col("date") != "") & F.col("tss").isNotNull())
    return usable.groupBy(OWNER, "date").agg(F.max_by("tss", "seq").alias("tss"))


def valid_overrides(parsed: DataFrame, as_of: date | str, forecast_days: int = OVERRIDE_DAYS,
                    low: float = MIN_TSS, high: float = MAX_TSS) -> DataFrame:
    """Overrides dated inside the forecast days, clamped to the accepted range."""
    day = F.to_date(F.try_to_timestamp("date", F.lit("yyyy-MM-dd")))
    return (
        parsed.select(OWNER, day.alias("date"), "tss")
        .filter(F.col("date").between(F.date_add(as_date(as_of), 1), F.date_add(as_date(as_of), forecast_days)))
        .select(OWNER, "date", F.least(F.greatest("tss", F.lit(low)), F.lit(high)).alias("tss"))
    )


def forecast(days: DataFrame, as_of: date | str, overrides: DataFrame | None = None,
             ctl_days: int = CTL_DAYS, atl_days: int = ATL_DAYS, lookback_days: int = LOOKBACK_DAYS,
             horizon: int = PROJECTION_DAYS) -> DataFrame:
    """Load with projected days taking an override or the mean of the last actual days."""
    alphas = _alphas(ctl_days, atl_days)
    today, end = as_date(as_of), F.date_add(as_date(as_of), horizon)
    known = days.filter(F.col("date") <= end)
    actual = known.filter(F.col("date") <= today)
    solved = _on_training_days(actual, alphas)
    past = _decayed(_spread(solved, today, *alphas), alphas)

    # state of each athlete at the end of the actual days: one small row
    since = F.date_sub(today, lookback_days - 1)
    first = known.groupBy(OWNER).agg(F.min("date").alias("_first"))
    last = solved.groupBy(OWNER).agg(
        *[F.max_by(F.col(c) * F.pow(F.lit(1.0 - a), F.datediff(today, "date")), "date").alias(f"_{c}") for c, a in alphas.items()],
        F.sum(F.when(F.col("date") >= since, F.col("tss")).otherwise(0.0)).alias("_recent"),
    )
    counted = F.least(F.lit(lookback_days), F.datediff(today, "_first") + 1)
    state = first.join(last, OWNER, "left").select(
        OWNER, F.greatest(F.date_add(today, 1), F.col("_first")).alias("_from"),
        F.when(counted > 0, F.coalesce("_recent", F.lit(0.0)) / counted).otherwise(0.0).alias("_avg"),
        *[F.coalesce(f"_{c}", F.lit(0.0)).alias(f"_{c}") for c in alphas],
    )
    future = state.select("*", F.explode(F.sequence("_from", end)).alias("date"))
    if overrides is not None:
        future = future.join(overrides.withColumnRenamed("tss", "_set"), [OWNER, "date"], "left")
        future = future.withColumn("tss", F.coalesce("_set", "_avg"))
    else:
        future = future.withColumn("tss", F.col("_avg"))
    n = F.datediff("date", "_from") + 1
    w = Window.partitionBy(OWNER).orderBy("date")
    for c, a in alphas.items():
        # at most ``horizon`` rows per athlete
        grown = F.sum(F.lit(a) * F.col("tss") * F.pow(F.lit(1.0 - a), -n)).over(w)
        future = future.withColumn(c, F.pow(F.lit(1.0 - a), n) * (F.col(f"_{c}") + grown))
    columns = [OWNER, "date", "tss", *alphas]
    both = past.select(*columns).unionByName(future.select(*columns))
    return both.select(
        OWNER, "date", F.col("tss").alias("tss_forecast"), (F.col("date") > today).alias("is_projection"),
        F.col("ctl").alias("ctl_forecast"), F.col("atl").alias("atl_forecast"),
        (F.col("ctl") - F.col("atl")).alias("tsb_forecast"),
    )


def load_comparison(load: DataFrame, projected: DataFrame, as_of: date | str,
                    days_ahead: int = OVERRIDE_DAYS) -> DataFrame:
    """Now against ``days_ahead`` days on, per metric, with the direction of change.

    Without a row for the day itself the last actual (or projected) row stands in.
    """
    today = as_date(as_of)
    target = F.date_add(today, days_ahead)
    metrics = ["ctl", "atl", "tsb"]
    now = load.groupBy(OWNER).agg(*[
        F.coalesce(
            F.max(F.when(F.col("date") == today, F.col(m))),
            F.max_by(m, F.when(~F.col("is_projection"), F.col("date"))),
        ).alias(f"now_{m}") for m in metrics
    ])
    then = projected.filter("is_projection").groupBy(OWNER).agg(*[
        F.coalesce(
            F.max(F.when(F.col("date") == target, F.col(f"{m}_forecast"))), F.max_by(f"{m}_forecast", "date")
        ).alias(f"then_{m}") for m in metrics
    ])
    entries = F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(f"now_{m}").alias("current"), F.col(f"then_{m}").alias("forecast"))
        for m in metrics
    ])
    rows = now.join(then, OWNER, "left").select(OWNER, F.explode(entries).alias("e")).select(OWNER, "e.*")
    delta = F.col("forecast") - F.col("current")
    arrow = F.when(delta > SAME, "↑").when(delta < -SAME, "↓").when(delta.isNotNull(), "→").otherwise("--")
    return rows.withColumn("delta", delta).withColumn("direction", arrow)


def display_window(load: DataFrame, as_of: date | str, months: int | None) -> DataFrame:
    """Rows from ``months`` blocks of 30 days before the first of the month; None keeps all."""
    return load if months is None else load.filter(F.col("date") >= as_date(window_start(as_of, months)))


def window_start(as_of: date | str, months: int) -> date:
    """First day of a display window; also ``training_load``'s ``since`` for it."""
    return date.fromisoformat(str(as_of)).replace(day=1) - timedelta(days=30 * months)


def latest_days(load: DataFrame, n: int) -> DataFrame:
    """Last ``n`` actual days of every athlete; days are dense, so this is a date filter
    relative to the athlete's last actual day."""
    actual = load.filter(~F.col("is_projection"))
    top = F.max("date").over(Window.partitionBy(OWNER))
    return actual.withColumn("_top", top).filter(F.col("date") > F.date_sub("_top", n)).drop("_top")
