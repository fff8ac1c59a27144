"""Reader of the nested workout log."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import exercise_key
from ..operators.series import number_rows

LOG = ("date string, body_weight double, exercises array<struct<name: string, "
       "sets: array<struct<`set`: bigint, weight: double, reps: int>>>>")
COLUMNS = "athlete_id string, log_seq bigint, " + LOG


def read_workouts(spark: SparkSession, path: str, athlete_id: str | None = None) -> DataFrame:
    """The nested log (athlete_id, log_seq, date, body_weight, exercises) of the JSON arrays under ``path``.

    Exercise names are brought to their stored form. ``log_seq`` counts an athlete's workouts from 0, by file name and
    then by place in the file's array, so it depends neither on how files are read nor on how a log is cut into files
    in order. The athlete comes from an ``athlete_id=`` folder unless given. No file gives an empty frame; a document
    that is no log gives no row.
    """
    try:
        files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(path).select(
            "value", F.col("_metadata.file_path").alias("file"))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], COLUMNS)
    array = F.when(F.ltrim("value").startswith("{"), F.concat(F.lit("["), "value", F.lit("]"))).otherwise(F.col("value"))
    owner = F.lit(athlete_id) if athlete_id is not None else F.regexp_extract("file", "athlete_id=([^/]+)/", 1)
    logs = files.select(owner.alias("athlete_id"), "file", F.posexplode(F.from_json(array, f"array<struct<{LOG}>>")).alias("pos", "w"))
    found = number_rows(logs.filter("w.date is not null"), ["athlete_id"], ["file", "pos"], F.col("file"), "log_seq")
    exercises = F.transform("w.exercises", lambda e: F.struct(exercise_key(e["name"]).alias("name"), e["sets"].alias("sets")))
    return found.select("athlete_id", "log_seq", "w.date", "w.body_weight", exercises.alias("exercises"))
