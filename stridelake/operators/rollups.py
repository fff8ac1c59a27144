"""Roll-ups of sessions by sport and period."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import hours, miles, rint, rnd
from ..functions.text import clock
from ..functions.timekeys import DEFAULT_TZ, as_date, local_date, near_days, period_keys, period_label

# Display names and column order of sports.
RENAMED = {"training": "weight_lifting"}
LEADING_SPORTS = ["cycling", "weight_lifting", "rock_climbing"]

OWNER = "athlete_id"


def renamed_sport(sport):
    for old, new in RENAMED.items():
        sport = F.when(sport == old, F.lit(new)).otherwise(sport)
    return sport


def period_summary(rides: DataFrame, grain: str, tz: str = DEFAULT_TZ) -> DataFrame:
    """Rides, miles, hours and training stress per athlete and year, month or week.

    One shuffle on the group key; the stored null stress scores simply do not count.
    """
    keys = period_keys(local_date("timestamp", tz), grain)
    named = [c.alias(n) for n, c in keys.items()]
    grouped = rides.groupBy(OWNER, *named).agg(
        F.count(F.lit(1)).alias("rides"),
        F.coalesce(F.sum("total_distance"), F.lit(0.0)).alias("_m"),
        F.coalesce(F.sum("total_timer_time"), F.lit(0.0)).alias("_s"),
        F.coalesce(F.sum("training_stress_score"), F.lit(0.0)).alias("_t"),
    )
    return grouped.select(
        OWNER, *keys, "rides",
        rnd(miles(F.col("_m")), 1).alias("miles"),
        rnd(hours(F.col("_s")), 1).alias("hours"),
        rint(F.col("_t")).alias("tss"),
    )


def hours_by_sport(sessions: DataFrame) -> DataFrame:
    """Total clock time per athlete and sport; sport names as recorded."""
    return (
        sessions.groupBy(OWNER, "sport")
        .agg(F.coalesce(F.sum("total_timer_time"), F.lit(0.0)).alias("_s"))
        .select(OWNER, "sport", clock(F.col("_s")).alias("total_time"))
    )


def ordered_sports(sports: list[str]) -> list[str]:
    shown = [RENAMED.get(s, s) for s in sports]
    lead = [s for s in LEADING_SPORTS if s in shown]
    return lead + sorted(s for s in shown if s not in lead)


def found_sports(sessions: DataFrame) -> list[str]:
    """Recorded sport names; a device's enumeration, so a few dozen at most."""
    names = sessions.where(F.col("sport").isNotNull()).groupBy("sport").count()
    return sorted(r.sport for r in names.collect())


def sport_pivot(sessions: DataFrame, grain: str, tz: str = DEFAULT_TZ,
                sports: list[str] | None = None) -> DataFrame:
    """Period × sport table of ``HH:MM:SS (share%)`` with a ``total`` column over all rows.

    Without ``sports`` every recorded sport has a column; a given list fixes the columns
    (no extra job) and what it does not name counts in a column ``other``. A session without
    a sport counts in a column of its own named ``null``.
    """
    listed = found_sports(sessions) if sports is None else sports
    back = {RENAMED.get(s, s): s for s in listed}
    matches = {c: F.col("sport") == back[c] for c in ordered_sports(listed)}
    if sports is not None:
        matches["other"] = F.col("sport").isNotNull() & ~F.coalesce(F.col("sport").isin(listed), F.lit(False))
    matches["null"] = F.col("sport").isNull()
    keys = period_keys(local_date("timestamp", tz), grain)
    named = [c.alias(n) for n, c in keys.items()]

    def seconds(shown: str):
        match = matches[shown]
        present = F.max(F.when(match, True))
        return F.when(
            present, F.coalesce(F.sum(F.when(match, F.col("total_timer_time"))), F.lit(0.0))
        ).alias(f"_{shown}")

    whole = F.coalesce(F.sum("total_timer_time"), F.lit(0.0)).alias("_total")
    with_total = sessions.groupBy(OWNER, *named).agg(*[seconds(c) for c in matches], whole)

    def cell(c: str):
        value = F.col(f"_{c}")
        share = F.when(F.col("_total") > 0, rint(value / F.col("_total") * 100)).otherwise(0)
        text = F.concat(clock(value), F.lit(" ("), share.cast("string"), F.lit("%)"))
        return F.when(value.isNull(), F.lit("")).otherwise(text).alias(c)

    return with_total.select(OWNER, *keys, *[cell(c) for c in matches], clock(F.col("_total")).alias("total"))


def sport_chart(sessions: DataFrame, grain: str, tz: str = DEFAULT_TZ) -> DataFrame:
    """Seconds, activities and hours per sport and period label."""
    return (
        sessions.groupBy(
            OWNER,
            renamed_sport(F.col("sport")).alias("sport"),
            period_label(local_date("timestamp", tz), grain).alias("label"),
        )
        .agg(
            F.coalesce(F.sum("total_timer_time"), F.lit(0.0)).alias("total_seconds"),
            F.count(F.lit(1)).alias("activities"),
        )
        .withColumn("hours", rnd(hours(F.col("total_seconds")), 1))
    )


def total_hours(sessions: DataFrame, grain: str, tz: str = DEFAULT_TZ) -> DataFrame:
    """Hours per label as the sum of the sports' already rounded hours."""
    return (
        sport_chart(sessions, grain, tz)
        .groupBy(OWNER, "label")
        .agg(rnd(F.sum("hours"), 1).alias("hours"))
    )


def year_to_date(sessions: DataFrame, as_of: date | str, tz: str = DEFAULT_TZ) -> DataFrame:
    """Year-to-date hours and activities per sport; the row ``is_total`` covers all sports.

    A grouping set yields total and parts from one shuffle.
    """
    day = date.fromisoformat(str(as_of))
    weeks = max((day - date(day.year, 1, 1) + timedelta(days=1)).days / 7, 1)
    bound = near_days("timestamp", as_date(date(day.year, 1, 1)), as_date(date(day.year, 12, 31)))
    this_year = sessions.filter(bound & (F.year(local_date("timestamp", tz)) == day.year)).select(
        OWNER, renamed_sport(F.col("sport")).alias("sport"), "total_timer_time"
    )
    rolled = this_year.groupingSets([[OWNER, "sport"], [OWNER]], OWNER, "sport").agg(
        F.grouping("sport").cast("boolean").alias("is_total"),
        F.coalesce(F.sum("total_timer_time"), F.lit(0.0)).alias("_s"),
        F.count(F.lit(1)).alias("activities"),
    )
    rounded = rnd(hours(F.col("_s")), 1)
    return rolled.select(
        OWNER, "is_total", "sport", rounded.alias("hours"), "activities",
        F.when(~F.col("is_total"), rnd(rounded / F.lit(float(weeks)), 1)).alias("hours_per_week"),
        F.col("_s").alias("total_seconds"),
    )
