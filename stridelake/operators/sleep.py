"""Sleep summaries, trends and stage shares. A group is one athlete's nights, one per date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import mean, rnd
from .calendar import score_band

OWNER = "athlete_id"
# Metrics a trend can show, and the stages of a night.
METRICS = """
total_sleep_hrs deep_hrs rem_hrs score_overall avg_spo2 sleep_efficiency_pct avg_hr avg_sleep_stress
""".split()
STAGES = ["deep", "rem", "light", "awake"]
TREND_ROWS = 7


def summary(nights: DataFrame) -> DataFrame:
    return nights.groupBy(OWNER).agg(
        F.count(F.lit(1)).alias("total_nights"),
        mean("total_sleep_hrs", 1).alias("avg_sleep_hrs"),
        mean("score_overall", 1).alias("avg_score"),
        mean("deep_hrs", 2).alias("avg_deep_hrs"),
        mean("rem_hrs", 2).alias("avg_rem_hrs"),
        mean("sleep_efficiency_pct", 1).alias("avg_efficiency_pct"),
        mean("avg_spo2", 1).alias("avg_spo2"),
        F.min("calendar_date").alias("date_range_start"),
        F.max("calendar_date").alias("date_range_end"),
    )


def last_days(nights: DataFrame, days: int) -> DataFrame:
    """Nights no older than ``days`` before the athlete's latest one; 0 keeps all."""
    if not days:
        return nights
    latest = F.max("calendar_date").over(Window.partitionBy(OWNER))
    cutoff = F.date_sub(latest.try_cast("date"), days).cast("string")
    return nights.withColumn("_cutoff", cutoff).filter(F.col("calendar_date") >= F.col("_cutoff")).drop("_cutoff")


def recent(nights: DataFrame, days: int = 30) -> DataFrame:
    return last_days(nights, days).groupBy(OWNER).agg(
        mean("total_sleep_hrs", 1).alias("avg_sleep_hrs"),
        mean("score_overall", 1).alias("avg_score"),
        F.count(F.lit(1)).alias("nights"),
    )


def metric_series(nights: DataFrame, metric: str) -> DataFrame:
    """Date and one metric without missing values; an unknown metric gives no rows."""
    if metric not in METRICS or metric not in nights.columns:
        return nights.select(OWNER, "calendar_date", F.lit(None).cast("double").alias("value")).filter(F.lit(False))
    return nights.select(OWNER, "calendar_date", F.col(metric).cast("double").alias("value")).dropna("any")


def metric_trend(nights: DataFrame, metric: str, days: int = 0) -> DataFrame:
    """Metric with the mean of the last seven recorded nights."""
    picked = last_days(metric_series(nights, metric), days)
    w = Window.partitionBy(OWNER).orderBy("calendar_date").rowsBetween(-(TREND_ROWS - 1), 0)
    return picked.withColumn("rolling_avg", F.avg("value").over(w))


def _share(stage: str) -> Column:
    return rnd(F.col(f"{stage}_sec") / F.col("total_in_bed_sec") * 100, 1).alias(f"{stage}_pct")


def stage_shares(nights: DataFrame, days: int = 0) -> DataFrame:
    """Each stage's share of the time in bed, nights with any time in bed only."""
    in_bed = nights.filter(F.col("total_in_bed_sec") > 0)
    return last_days(in_bed, days).select(OWNER, "calendar_date", *[_share(s) for s in STAGES])


def latest_night(nights: DataFrame) -> DataFrame:
    """The newest night with stage hours, shares and the band of its score."""
    scores = [f"score_{n}" for n in "overall quality duration recovery deep rem".split()]
    columns = ["total_in_bed_sec", *scores, "feedback"] + [f"{s}_{u}" for s in STAGES for u in ("hrs", "sec")]
    newest = nights.groupBy(OWNER).agg(
        F.max("calendar_date").alias("calendar_date"), F.max_by(F.struct(*columns), "calendar_date").alias("n")
    ).select(OWNER, "calendar_date", "n.*")
    share = {
        s: F.when(F.col("total_in_bed_sec") > 0,
                  rnd(F.coalesce(f"{s}_sec", F.lit(0).cast("bigint")) / F.col("total_in_bed_sec") * 100, 1)) for s in STAGES
    }
    return newest.select(
        OWNER, "calendar_date", *[f"{s}_hrs" for s in STAGES], *[c.alias(f"{s}_pct") for s, c in share.items()],
        *scores, score_band(F.col("score_overall")).alias("band"), "feedback",
    )
