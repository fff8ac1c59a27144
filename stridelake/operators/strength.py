"""Strength log: volume, history, growth, records, upsert. Input is the nested log
(athlete_id, log_seq, date, body_weight, exercises[name, sets[set, weight, reps]])."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import rnd
from ..functions.parsing import sets_text
from ..functions.text import title_words
from . import series
from .skew import hot_join

OWNER = "athlete_id"
# Exercises that add the entered weight to body weight, default body weight.
BODY_WEIGHT_PLUS = ["pull_ups", "dips", "pullups", "chin_ups"]
BODY_WEIGHT = 133.0


def exploded_sets(workouts: DataFrame, body_weight: float = BODY_WEIGHT) -> DataFrame:
    """One row per set with its place in the log and the weight that counts."""
    exercises = workouts.select(OWNER, "log_seq", "date", "body_weight", F.posexplode("exercises").alias("ex_pos", "e"))
    sets = exercises.select(
        OWNER, "log_seq", "date", "ex_pos", F.col("e.name").alias("name"),
        F.coalesce(F.nullif("body_weight", F.lit(0.0)), F.lit(body_weight)).alias("bw"),
        F.posexplode("e.sets").alias("set_pos", "s"),
    )
    weight = F.col("s.weight")
    counted = F.when(weight == 0, F.col("bw")).when(
        F.col("name").isin(BODY_WEIGHT_PLUS), F.col("bw") + weight
    ).otherwise(weight)
    return sets.select(
        OWNER, "log_seq", "date", "name", "ex_pos", "set_pos", weight.alias("weight"),
        F.col("s.reps").alias("reps"), counted.alias("lifted"),
    )


def exercise_names(workouts: DataFrame) -> DataFrame:
    return workouts.select(OWNER, F.explode("exercises.name").alias("name")).distinct().withColumn(
        "label", title_words(F.col("name"))
    )


def session_volume(workouts: DataFrame, body_weight: float = BODY_WEIGHT) -> DataFrame:
    return exploded_sets(workouts, body_weight).groupBy(OWNER, "log_seq", "date").agg(
        F.sum(F.col("lifted") * F.col("reps")).alias("volume")
    )


def exercise_history(workouts: DataFrame, names: list[str] | None = None,
                     body_weight: float = BODY_WEIGHT) -> DataFrame:
    """Volume and heaviest weight per occurrence of an exercise."""
    sets = exploded_sets(workouts, body_weight)
    if names is not None:
        sets = sets.filter(F.col("name").isin(names))
    return sets.groupBy(OWNER, "name", "date", "log_seq", "ex_pos").agg(
        F.sum(F.col("lifted") * F.col("reps")).alias("volume"), F.max("lifted").alias("max_weight")
    )


def exercise_growth(workouts: DataFrame, names: list[str] | None = None,
                    body_weight: float = BODY_WEIGHT) -> DataFrame:
    """Occurrence number and change of volume against the first occurrence.

    Occurrences are numbered within months with an offset per month, and the first volume
    arrives with the offset, so a frequent exercise is not one task.
    """
    month = F.coalesce(F.substring("date", 1, 7), F.lit(""))
    numbered = series.number_rows(
        exercise_history(workouts, names, body_weight), [OWNER, "name"], ["date", "log_seq", "ex_pos"], month,
        "_k", firsts={"first_volume": "volume"},
    )
    change = F.col("volume") - F.col("first_volume")
    grows = (F.col("_k") > 0) & (F.col("first_volume") > 0)
    return numbered.select(
        OWNER, "name", "date", "log_seq", (F.col("_k") + 1).alias("occurrence"), "volume", "max_weight",
        F.when(grows, change).alias("volume_change"),
        F.when(grows, rnd(change / F.col("first_volume") * 100, 1)).alias("pct_change"),
    )


def personal_records(workouts: DataFrame, scope: str = "since_max", body_weight: float = BODY_WEIGHT) -> DataFrame:
    """Heaviest weight with its date and the best estimated one-repetition maximum.

    ``since_max`` looks for the estimate among the sets from the first heaviest one onward
    in log order, ``all_time`` among all sets. Ties go to the earlier set.
    """
    if scope not in ("since_max", "all_time"):
        raise ValueError(f"scope must be since_max or all_time, not {scope!r}")
    sets = exploded_sets(workouts, body_weight).withColumn("at", F.struct("log_seq", "ex_pos", "set_pos"))
    top = sets.groupBy(OWNER, "name").agg(
        F.min(F.struct((-F.col("lifted")).alias("w"), "at", "date")).alias("t"), F.count(F.lit(1)).alias("n")
    ).select(OWNER, "name", (-F.col("t.w")).alias("max_weight"), F.col("t.at").alias("_since"), F.col("t.date").alias("max_date"), "n")
    joined = hot_join(sets, top.drop("n"), [OWNER, "name"], spread=["log_seq", "ex_pos", "set_pos"], counts=top)
    if scope == "since_max":
        joined = joined.filter(F.col("at") >= F.col("_since"))
    estimate = F.col("lifted") * (1 + F.col("reps") / 30)
    best = joined.groupBy(OWNER, "name").agg(
        F.first("max_weight").alias("max_weight"), F.first("max_date").alias("max_date"),
        F.min(F.struct((-estimate).alias("e"), "at", "lifted", "reps", "date")).alias("b"),
    )
    return best.select(
        OWNER, "name", "max_weight", "max_date", rnd(-F.col("b.e"), 4).alias("e1rm"),
        F.col("b.lifted").alias("e1rm_weight"), F.col("b.reps").alias("e1rm_reps"), F.col("b.date").alias("e1rm_date"),
    )


def workout_detail(workouts: DataFrame) -> DataFrame:
    """Exercises of every workout with their sets as text."""
    return workouts.select(OWNER, "log_seq", "date", F.posexplode("exercises").alias("ex_pos", "e")).select(
        OWNER, "log_seq", "date", "ex_pos", title_words(F.col("e.name")).alias("exercise"), sets_text(F.col("e.sets")).alias("sets")
    )


def upsert(log: DataFrame, entries: DataFrame) -> DataFrame:
    """Add entries by date: the first workout of that date is extended, else a new one starts.

    ``entries`` has (athlete_id, log_seq, date, body_weight, exercises); several for one date
    join up in ``log_seq`` order.
    """
    day = [OWNER, "date"]
    added = entries.groupBy(*day).agg(
        F.min("log_seq").alias("_seq"), F.min_by("body_weight", "log_seq").alias("_bw"),
        F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("log_seq", "exercises"))), lambda x: x["exercises"])).alias("_new"),
    )
    target = log.groupBy(*day).agg(F.min("log_seq").alias("log_seq"))
    extend = target.join(added, day).select(*day, "log_seq", "_new")
    kept = log.join(extend, [*day, "log_seq"], "left").select(
        OWNER, "log_seq", "date", "body_weight",
        F.when(F.col("_new").isNotNull(), F.concat("exercises", "_new")).otherwise(F.col("exercises")).alias("exercises"),
    )
    fresh = added.join(target.select(*day), day, "left_anti").select(
        OWNER, F.col("_seq").alias("log_seq"), "date", F.col("_bw").alias("body_weight"), F.col("_new").alias("exercises")
    )
    return kept.unionByName(fresh)
