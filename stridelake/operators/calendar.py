"""Calendar feed: one event per activity, lifting days from the log, period totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import hours, miles, rnd
from ..functions.text import hours_minutes, title_words
from ..functions.timekeys import DEFAULT_TZ, iso, local_date, monday
from .rollups import OWNER, renamed_sport

# Display labels.
SPORT_LABELS = {
    "cycling": "Cycling",
    "training": "Lifting",
    "weight_lifting": "Lifting",
    "rock_climbing": "Rock Climbing",
    "running": "Running",
    "hiking": "Hiking",
    "alpine_skiing": "Skiing",
    "generic": "Other",
    "racket": "Racket",
}


def sport_label(sport: Column) -> Column:
    pairs = [F.lit(x) for kv in SPORT_LABELS.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), sport), title_words(sport))


def exercise_counts(workouts: DataFrame) -> DataFrame:
    """Exercises per athlete and date; of several entries for a date the last one counts."""
    return workouts.groupBy(OWNER, "date").agg(
        F.max_by(F.size("exercises"), "log_seq").alias("exercises")
    )


def calendar_events(sessions: DataFrame, workouts: DataFrame, tz: str = DEFAULT_TZ) -> DataFrame:
    """Title, date and raw measures of every calendar entry.

    Lifting days that only the log knows are appended. Counts are already one row per
    athlete and day before either join.
    """
    counts = exercise_counts(workouts)
    sport = F.coalesce(F.nullif(F.col("sport"), F.lit("")), F.lit("generic"))
    base = sessions.select(
        OWNER, "source_file", sport.alias("sport"),
        iso(local_date("timestamp", tz)).alias("date"),
        F.coalesce("total_timer_time", F.lit(0.0)).alias("seconds"),
        F.when(F.col("total_distance") > 0, miles(F.col("total_distance"))).otherwise(0.0).alias("miles"),
    )
    is_lifting = F.col("sport") == "training"
    joined = base.join(
        counts.withColumn("sport", F.lit("training")), [OWNER, "date", "sport"], "left"
    )
    duration = hours_minutes(F.col("seconds"))
    label = sport_label(F.col("sport"))
    title = (
        F.when(is_lifting & (F.col("exercises") > 0),
               F.format_string("Lifting (%s, %d exercises)", duration, F.col("exercises")))
        .when(is_lifting, F.format_string("Lifting (%s)", duration))
        .when((F.col("sport") == "cycling") & (F.col("miles") > 1),
              F.format_string("%s (%s, %smi)", label, duration, F.format_string("%.1f", F.col("miles"))))
        .otherwise(F.format_string("%s (%s)", label, duration))
    )
    recorded = joined.select(
        OWNER, "source_file", "date", renamed_sport(F.col("sport")).alias("sport"),
        "seconds", "miles", title.alias("title"),
    )
    lifted = base.filter(is_lifting).select(OWNER, "date").distinct()
    log_only = counts.join(lifted, [OWNER, "date"], "left_anti").select(
        OWNER, F.lit(None).cast("string").alias("source_file"), "date",
        F.lit("weight_lifting").alias("sport"), F.lit(0.0).alias("seconds"), F.lit(0.0).alias("miles"),
        F.format_string("Lifting (%d exercises)", F.col("exercises")).alias("title"),
    )
    return recorded.unionByName(log_only)


def calendar_totals(events: DataFrame, grain: str) -> DataFrame:
    """Count, hours and miles per period and sport with a grand-total row per period.

    Weeks are calendar rows starting on Monday. Sums of miles use whole micro-miles so
    the result does not depend on the order of addition.
    """
    day = F.col("date").cast("date")
    start = monday(day) if grain == "week" else F.trunc(day, "month")
    micro = F.bround(F.col("miles") * 1e6, 0).cast("bigint")
    rolled = (
        events.select(OWNER, start.alias("period_start"), "sport", "seconds", micro.alias("_mi"))
        .groupingSets([[OWNER, "period_start", "sport"], [OWNER, "period_start"]], OWNER, "period_start", "sport")
        .agg(
            F.grouping("sport").cast("boolean").alias("is_total"),
            F.count(F.lit(1)).alias("activities"),
            F.sum("seconds").alias("seconds"),
            (F.sum("_mi") / F.lit(1e6)).alias("miles"),
        )
    )
    return rolled.select(
        OWNER, "period_start", "is_total", "sport",
        F.when(F.col("is_total"), F.lit("All")).otherwise(sport_label(F.col("sport"))).alias("label"),
        "activities", "seconds", rnd(hours(F.col("seconds")), 1).alias("hours"), "miles",
    )


def score_band(score: Column) -> Column:
    return (
        F.when(score.isNull(), F.lit("none")).when(score >= 80, F.lit("good"))
        .when(score >= 60, F.lit("fair")).otherwise(F.lit("poor"))
    )


def sleep_overlay(events: DataFrame, nights: DataFrame) -> DataFrame:
    """Days with their activity count and the night's score and band, where there is one."""
    days = events.groupBy(OWNER, "date").agg(F.count(F.lit(1)).alias("activities"))
    scores = nights.filter(F.col("score_overall").isNotNull()).select(
        OWNER, F.col("calendar_date").alias("date"), "score_overall"
    )
    return days.join(scores, [OWNER, "date"], "left").withColumn(
        "band", score_band(F.col("score_overall"))
    )


def latest_event_date(events: DataFrame) -> DataFrame:
    return events.groupBy(OWNER).agg(F.max("date").alias("latest_date"))
