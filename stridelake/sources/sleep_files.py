"""Sleep exports: nested JSON documents and key/value CSV files, and their merge."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parsing as X
from ..functions.numeric import hours, rnd
from . import schemas as S

OWNER = "athlete_id"
NIGHT = """struct<calendarDate:string, sleepStartTimestampGMT:string, sleepEndTimestampGMT:string,
deepSleepSeconds:bigint, lightSleepSeconds:bigint, remSleepSeconds:bigint, awakeSleepSeconds:bigint,
averageRespiration:double, lowestRespiration:double, highestRespiration:double,
awakeCount:bigint, restlessMomentCount:bigint, avgSleepStress:double,
spo2SleepSummary:struct<averageSPO2:double, lowestSPO2:int, averageHR:double>,
sleepScores:struct<overallScore:int, qualityScore:int, durationScore:int, recoveryScore:int,
deepScore:int, remScore:int, feedback:string>>"""

# ── Fixed values: labels a CSV may use for each column, first match wins ─────
CSV_LABELS = {
    "calendar_date": ["Calendar Date", "Date"],
    "sleep_start_gmt": ["Sleep Start GMT", "Sleep Start Time", "Sleep Start"],
    "sleep_end_gmt": ["Sleep End GMT", "Sleep End Time", "Sleep End"],
    "deep_sec": ["Deep Sleep Duration", "Deep Sleep"],
    "light_sec": ["Light Sleep Duration", "Light Sleep"],
    "rem_sec": ["REM Duration", "REM Sleep Duration", "REM Sleep"],
    "awake_sec": ["Awake Time", "Awake Duration", "Awake"],
    "total_sleep_sec": ["Sleep Duration", "Total Sleep Duration", "Total Sleep"],
    "total_in_bed_sec": ["Time in Bed", "Total in Bed", "In Bed Duration"],
    "sleep_efficiency_pct": ["Sleep Efficiency", "Sleep Efficiency %"],
    "avg_spo2": ["Average SpO2", "Avg SpO2"],
    "lowest_spo2": ["Lowest SpO2", "Min SpO2"],
    "avg_hr": ["Average Heart Rate", "Average HR", "Avg HR"],
    "avg_respiration": ["Average Respiration", "Avg Respiration"],
    "lowest_respiration": ["Lowest Respiration"],
    "highest_respiration": ["Highest Respiration"],
    "awake_count": ["Awakenings", "Awake Count"],
    "restless_moments": ["Restless Moments", "Restless"],
    "avg_sleep_stress": ["Average Sleep Stress", "Avg Sleep Stress"],
    "score_overall": ["Overall Sleep Score", "Sleep Score", "Score Overall"],
    "score_quality": ["Sleep Quality Score", "Score Quality"],
    "score_duration": ["Sleep Duration Score", "Score Duration"],
    "score_recovery": ["Recovery Score", "Score Recovery"],
    "score_deep": ["Deep Sleep Score", "Score Deep"],
    "score_rem": ["REM Sleep Score", "Score REM"],
    "feedback": ["Feedback", "Sleep Feedback"],
}
SECONDS = "deep_sec light_sec rem_sec awake_sec total_sleep_sec total_in_bed_sec".split()


def _athlete(path: Column, athlete_id: str | None) -> Column:
    return F.lit(athlete_id) if athlete_id else F.regexp_extract(path, r"athlete_id=([^/]+)", 1)


def flatten_nights(df: DataFrame, night: str = "night") -> DataFrame:
    """Nested night structs to the 31 sleep columns; other columns pass through.

    Missing stage seconds and counts are zero here.
    """
    def sec(name: str) -> Column:
        return F.coalesce(F.col(f"{night}.{name}"), F.lit(0).cast("bigint"))

    deep, light, rem, awake = (sec(f"{s}SleepSeconds") for s in ("deep", "light", "rem", "awake"))
    asleep = deep + light + rem
    in_bed = asleep + awake
    spo2, score = f"{night}.spo2SleepSummary", f"{night}.sleepScores"
    columns = {
        "calendar_date": F.col(f"{night}.calendarDate"),
        "sleep_start_gmt": F.col(f"{night}.sleepStartTimestampGMT"),
        "sleep_end_gmt": F.col(f"{night}.sleepEndTimestampGMT"),
        "deep_sec": deep, "light_sec": light, "rem_sec": rem, "awake_sec": awake,
        "total_sleep_sec": asleep, "total_in_bed_sec": in_bed,
        "sleep_efficiency_pct": F.when(in_bed > 0, rnd(asleep / in_bed * 100, 1)),
        **{f"{n}_hrs": rnd(hours(v), 2) for n, v in
           {"deep": deep, "light": light, "rem": rem, "awake": awake, "total_sleep": asleep}.items()},
        "avg_spo2": F.col(f"{spo2}.averageSPO2"), "lowest_spo2": F.col(f"{spo2}.lowestSPO2"),
        "avg_hr": F.col(f"{spo2}.averageHR"),
        "avg_respiration": F.col(f"{night}.averageRespiration"),
        "lowest_respiration": F.col(f"{night}.lowestRespiration"),
        "highest_respiration": F.col(f"{night}.highestRespiration"),
        "awake_count": sec("awakeCount"), "restless_moments": sec("restlessMomentCount"),
        "avg_sleep_stress": F.col(f"{night}.avgSleepStress"),
        **{f"score_{n}": F.col(f"{score}.{n}Score") for n in "overall quality duration recovery deep rem".split()},
        "feedback": F.col(f"{score}.feedback"),
    }
    passed = [c for c in df.columns if c != night]
    order = [f.name for f in S.SLEEP_SCHEMA.fields]
    return S.conform(df.select(*passed, *[columns[c].alias(c) for c in order]), S.SLEEP_SCHEMA)


def parse_night_documents(df: DataFrame, text: str = "night") -> DataFrame:
    """Rows whose ``text`` column holds one night's JSON object."""
    return flatten_nights(df.withColumn(text, F.from_json(text, NIGHT)), text)


def read_sleep_json(spark: SparkSession, path: str, athlete_id: str | None = None, pattern: str = "*_sleepData.json") -> DataFrame:
    """Nights of the files that ``pattern`` names, each an array. Any other document gives no rows.

    ``seq`` orders nights by file name, then position. The athlete comes from an
    ``athlete_id=`` folder unless given.
    """
    files = (
        spark.read.option("wholetext", True).option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", True).text(path).select("value", F.col("_metadata.file_path").alias("file"))
    )
    arrays = files.filter(F.ltrim("value").startswith("["))
    nights = arrays.select(
        _athlete(F.col("file"), athlete_id).alias(OWNER), "file",
        F.posexplode(F.from_json("value", f"array<{NIGHT}>")).alias("pos", "night"),
    ).filter(F.col("night").isNotNull())
    tagged = nights.withColumn("seq", F.struct("file", "pos")).drop("file", "pos")
    return flatten_nights(tagged)


def parse_key_values(lines: DataFrame) -> DataFrame:
    """(athlete_id, file, pos, key, value) lines to one night per file.

    Keys match through their labels, ignoring case and punctuation; a repeated key keeps its
    last value; a file without a date gives no row. Missing parts stay null here.
    """
    wanted = {norm for labels in CSV_LABELS.values() for norm in map(_norm, labels)}
    clean = lines.select(
        OWNER, "file", "pos", X.norm_key(F.col("key")).alias("key"), F.trim("value").alias("value")
    ).filter(F.col("key").isin(sorted(wanted)) & (F.col("value") != ""))
    last = clean.groupBy(OWNER, "file", "key").agg(F.max_by("value", "pos").alias("value"))
    # at most one entry per known label
    packed = last.groupBy(OWNER, "file").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("kv"))
    types = {f.name: f.dataType.simpleString() for f in S.SLEEP_SCHEMA.fields}

    # texts first, in a projection of their own: the parsers look at them many times
    texts = packed.select(OWNER, "file", *[
        F.coalesce(*[F.col("kv")[_norm(label)] for label in labels]).alias(name) for name, labels in CSV_LABELS.items()
    ])

    def parsed(name: str) -> Column:
        text = F.col(name)
        if name == "calendar_date":
            return X.parse_date_text(text)
        if name in SECONDS:
            return X.parse_duration(text)
        if types[name] in ("bigint", "int"):
            return X.parse_whole(text).try_cast(types[name])
        return X.parse_number(text) if types[name] == "double" else text

    named = texts.select(OWNER, "file", *[parsed(n).alias(n) for n in CSV_LABELS]).filter("calendar_date is not null")
    in_bed = F.coalesce("total_in_bed_sec", F.col("total_sleep_sec") + F.col("awake_sec"))
    full = named.withColumn("total_in_bed_sec", in_bed)
    for n in ("deep", "light", "rem", "awake", "total_sleep"):
        full = full.withColumn(f"{n}_hrs", hours(F.col(f"{n}_sec")))
    share = rnd(F.try_divide("total_sleep_sec", "total_in_bed_sec") * 100, 1)
    full = full.withColumn("sleep_efficiency_pct", F.coalesce("sleep_efficiency_pct", share))
    return S.conform(full, S.SLEEP_SCHEMA)


def _norm(label: str) -> str:
    return "".join(c for c in label.lower() if c.isascii() and c.isalnum())


def read_sleep_csv(spark: SparkSession, path: str, athlete_id: str | None = None,
                   pattern: str = "*[sS][lL][eE][eE][pP]*.[cC][sS][vV]") -> DataFrame:
    """Nights of CSV files that ``pattern`` names (with ``sleep`` in their name), one night per file."""
    lines = (
        spark.read.schema("key string, value string").option("header", True)
        .option("pathGlobFilter", pattern).option("recursiveFileLookup", True)
        .csv(path)
    )
    tagged = lines.select(
        _athlete(F.col("_metadata.file_path"), athlete_id).alias(OWNER),
        F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("pos"), "key", "value",
    )
    return parse_key_values(tagged).withColumn("seq", F.struct("file", F.lit(0).alias("pos"))).drop("file")


def merge_nights(stored: DataFrame | None, from_json: DataFrame | None, from_csv: DataFrame | None) -> DataFrame:
    """One night per athlete and date: documents beat CSV, both beat what is stored, and
    within a source the later ``seq`` wins.

    One aggregate with map-side combine; no source is joined to another.
    """
    columns = [f.name for f in S.SLEEP_SCHEMA.fields]
    parts = []
    for rank, part in enumerate((stored, from_csv, from_json)):
        if part is None:
            continue
        seq = F.struct(F.col("seq.file").alias("file"), F.col("seq.pos").cast("bigint").alias("pos")) if "seq" in part.columns else \
            F.struct(F.lit("").alias("file"), F.lit(0).cast("bigint").alias("pos"))
        keep = S.conform(part, S.SLEEP_SCHEMA)
        parts.append(keep.select(OWNER, *columns, F.struct(F.lit(rank).alias("r"), seq.alias("s")).alias("_rank")))
    if not parts:
        raise ValueError("nothing to merge")
    rows = reduce(DataFrame.unionByName, parts)
    rest = [c for c in columns if c != "calendar_date"]
    best = rows.groupBy(OWNER, "calendar_date").agg(F.max_by(F.struct(*rest), "_rank").alias("n"))
    return best.select(OWNER, "calendar_date", "n.*").select(OWNER, *columns)


def merge_stats(from_json: DataFrame, from_csv: DataFrame) -> DataFrame:
    """Per athlete: CSV nights taken, and CSV nights whose date a document already covers."""
    csv_dates = from_csv.select(OWNER, "calendar_date").distinct()
    json_dates = from_json.filter("calendar_date is not null").select(OWNER, "calendar_date").distinct().withColumn("_j", F.lit(True))
    joined = csv_dates.join(json_dates, [OWNER, "calendar_date"], "left")
    return joined.groupBy(OWNER).agg(
        F.sum(F.when(F.col("_j").isNull(), 1).otherwise(0)).cast("bigint").alias("csv_rows_added"),
        F.sum(F.when(F.col("_j"), 1).otherwise(0)).cast("bigint").alias("csv_rows_skipped"),
    )
