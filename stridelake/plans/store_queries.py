"""Stored tables and files: committed batches, rebuild, datasets, writers and file readers.

Each query writes tables derived from the supplied ones to a folder of its own beside the checkpoints, and reads them back.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import strength
from ..session import shared_folder, shuffle_width
from ..sources import footers, sinks
from ..sources import schemas as S
from ..sources import sleep_files as N
from ..sources import tables as R
from ..sources.ledger import Ledger
from ..sources.workout_files import read_workouts
from . import views as V
from .sleep_queries import NIGHTS
from .source_queries import ALL_TYPES_SQL, MAIN, TYPED
from .strength_queries import SETS


def _folder(spark):
    return f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"


def _typed(spark, sf_dir):
    return V.table(spark, sf_dir, "events").selectExpr("event_id", *[f"{e} AS {n}" for n, e in TYPED])


def _totals(store):
    """Rows and sum of the main number per athlete and type, from what is committed."""
    out = None
    for msg_type, (number, _) in MAIN.items():
        rows = store.read(msg_type)
        if rows is None:
            continue
        part = rows.groupBy("athlete_id").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(number).alias("total"))
        part = part.withColumn("msg_type", F.lit(msg_type))
        out = part if out is None else out.unionByName(part)
    return out


def ledger_ingest(spark, sf_dir):
    """Two batches, of which the second holds the first one's messages too, breaks off between two tables and is tried twice more."""
    msgs, store = _typed(spark, sf_dir), Ledger(spark, _folder(spark))
    store.append(msgs.filter("event_id % 3 <> 0").drop("event_id"), "first")
    every = msgs.drop("event_id")
    store.stage(every, "second", ["file_id_mesgs", "record_mesgs"])
    for _ in range(2):
        store.append(every, "second", skip_known=False)
    return _totals(store)


TOTALS_SQL = f"""with m as ({ALL_TYPES_SQL})
select athlete_id, msg_type, count(*) n_rows, sum(number) total from m group by 1, 2"""


SOME = ["session_mesgs", "record_mesgs", "split_summary_mesgs"]


def ledger_skips_known(spark, sf_dir):
    """A later batch under known source files adds nothing; the entries tell what each batch holds."""
    msgs, store = _typed(spark, sf_dir), Ledger(spark, _folder(spark))
    store.append(msgs.filter("cast(athlete_id as int) % 2 = 0").drop("event_id"), "first", SOME)
    store.append(msgs.drop("event_id"), "second", SOME)
    return store.entries().groupBy("athlete_id", "msg_type", F.col("batch").alias("batch_id")).agg(F.sum("rows").alias("n_rows"))


SKIPS_SQL = f"""with m as ({ALL_TYPES_SQL})
select athlete_id, msg_type, case when athlete_id::int % 2 = 0 then 'first' else 'second' end batch_id, cast(count(*) as bigint) n_rows from m
where msg_type in ('session_mesgs', 'record_mesgs', 'split_summary_mesgs') group by 1, 2"""


def ledger_rebuild(spark, sf_dir):
    """A rebuild replaces what readers see at its commit, not before."""
    msgs, store = _typed(spark, sf_dir), Ledger(spark, _folder(spark))
    store.append(msgs.drop("event_id"), "first", SOME)
    store.append(msgs.filter("event_id % 2 = 0").drop("event_id"), "again", SOME, rebuild=True)
    store.stage(msgs.filter("event_id % 5 = 0").drop("event_id"), "broken", SOME, rebuild=True)
    return _totals(store)


REBUILD_SQL = TOTALS_SQL.replace("from events", "from events where event_id % 2 = 0 and event_id % 6 in (2, 3, 5)")


def dataset_read(spark, sf_dir):
    """Two athletes' points through a dataset: written by day, read with lookback and projection."""
    base, last = _folder(spark), "2024-07-10"
    sinks.write_table(V.telemetry(spark, sf_dir).withColumn("dt", F.to_date("timestamp")), f"{base}/record_mesgs", ["dt"], sort_by=["athlete_id", "timestamp"])
    parts = [R.Dataset(base, a).read(spark, "record_mesgs", last, ["athlete_id", "event_id", "timestamp", "power"]) for a in ("1", "3")]
    return parts[0].unionByName(parts[1])


DATASET_SQL = V.with_views("telemetry", body="""
select athlete_id, event_id, "timestamp", power from telemetry where athlete_id in ('1', '3') and "timestamp" >= date '2024-07-10' - 182""")


def stored_records(spark, sf_dir):
    """Records written by day, and of some rides read from their own days only."""
    path = f"{_folder(spark)}/record_mesgs"
    points = V.telemetry(spark, sf_dir).select("athlete_id", "source_file", "timestamp", "event_id", "power")
    sinks.write_records(points.withColumn("dt", F.to_date("timestamp")), path)
    rides = V.ride_sessions(spark, sf_dir).filter("threshold_power > 80")
    last = V.telemetry(spark, sf_dir).groupBy("source_file").agg(F.max("timestamp").alias("_end"))
    lasted = rides.join(last, "source_file").withColumn("total_elapsed_time", F.expr("cast(unix_seconds(cast(_end as timestamp)) - unix_seconds(cast(timestamp as timestamp)) + 1 as double)")).drop("_end")
    return R.only_activities(spark.read.parquet(path), lasted).select("athlete_id", "source_file", "event_id", "power", "dt")


STORED_SQL = V.with_views("telemetry", "ride_sessions", body="""
select athlete_id, source_file, event_id, power, cast("timestamp" as date) dt from telemetry
where source_file in (select source_file from ride_sessions where threshold_power > 80)""")


def stored_drift(spark, sf_dir):
    """Points by day in three writes: a declared column is left out of all, some files have one more or another type for a while."""
    path = f"{_folder(spark)}/record_mesgs"
    points = S.conform(V.telemetry(spark, sf_dir), S.ingest_schema("record_mesgs")).withColumn("dt", F.to_date("timestamp"))
    points = points.drop("heart_rate")
    own = [f.name for f in S.ingest_schema("record_mesgs").fields if f.name != "heart_rate"]
    sinks.write_table(points.select("athlete_id", "dt", *own), path, ["dt"])
    late = points.filter("event_id % 3 = 0 and dt >= date '2024-01-08'").select("athlete_id", "dt", *own)
    sinks.write_table(late.withColumn("surface_wetness", F.col("power") / 2), path, ["dt"])
    some = points.filter("event_id % 7 = 0 and dt between date '2024-01-05' and date '2024-01-06'").select("athlete_id", "dt", *own)
    sinks.write_table(some.withColumns({"core_temp": F.lit(37.0), "power": F.col("power").cast("string")}), path, ["dt"])
    return footers.stored_drift(spark, {"record_mesgs": path}).withColumnRenamed("column", "column_name")


STORED_DRIFT_SQL = V.with_views("telemetry", body="""
p as (select event_id, cast("timestamp" as date) dt from telemetry),
late as (select cast(min(dt) as varchar) a, cast(max(dt) as varchar) z from p where event_id % 3 = 0 and dt >= date '2024-01-08' having count(*) > 0),
few as (select cast(min(dt) as varchar) a, cast(max(dt) as varchar) z from p where event_id % 7 = 0 and dt between date '2024-01-05' and date '2024-01-06' having count(*) > 0)
select 'record_mesgs' msg_type, 'surface_wetness' column_name, 'undeclared' status, 'double' stored_type, a first_day, z last_day from late
union all select 'record_mesgs', 'core_temp', 'undeclared', 'double', a, z from few
union all select 'record_mesgs', 'power', 'type', 'string', a, z from few
union all select 'record_mesgs', 'heart_rate', 'missing', null, null, null from p having count(*) > 0""")


def json_sink(spark, sf_dir):
    """Session columns written as JSON lines and read again."""
    path = f"{_folder(spark)}/sessions"
    sinks.write_json(V.sessions(spark, sf_dir).select("athlete_id", "source_file", "sport", "total_distance", "num_laps"), path)
    return spark.read.schema("athlete_id string, source_file string, sport string, total_distance double, num_laps double").json(path)


JSON_SQL = V.with_views("sessions", body="select athlete_id, source_file, sport, total_distance, num_laps from sessions")


def _write_texts(rows, path):
    """One text file for each athlete, in a folder named after it.

    The cost is a file's, not a byte's, so the tasks keep the configured width. Dealt by a hash of the athlete: by the
    athlete itself, the exchange of an aggregate on it stands in for this one, and that is folded into a task or two.
    """
    rows.repartition(shuffle_width(rows), F.xxhash64("athlete_id")).write.option("lineSep", "\n").partitionBy("athlete_id").text(path)


def workout_files(spark, sf_dir):
    """The strength log as one JSON array for each athlete, with names as people write them, read again."""
    path = f"{_folder(spark)}/log"
    named = V.workouts(spark, sf_dir).withColumn("exercises", F.transform("exercises", lambda e: F.struct(F.concat(F.lit(" "), T.title_words(e["name"])).alias("name"), e["sets"].alias("sets"))))
    logs = named.groupBy("athlete_id").agg(F.sort_array(F.collect_list(F.struct("log_seq", "date", "body_weight", "exercises"))).alias("w"))
    _write_texts(logs.select("athlete_id", F.to_json("w").alias("value")), path)
    sets = strength.exploded_sets(read_workouts(spark, path))
    return sets.groupBy("athlete_id", "log_seq", "date", "name").agg(F.count(F.lit(1)).alias("n_sets"), F.sum("lifted").alias("lifted"))


WORKOUTS_SQL = V.with_views("workout_sets", body=f"""{SETS},
no as (select athlete_id, log_seq, row_number() over (partition by athlete_id order by log_seq) - 1 place from (select distinct athlete_id, log_seq from workout_sets))
select e.athlete_id, place log_seq, "date", name, count(*) n_sets, sum(lifted) lifted from ef e join no using (athlete_id, log_seq) group by all""")


def sleep_json_files(spark, sf_dir):
    """Sleep documents as one JSON array for each athlete, read again."""
    path = f"{_folder(spark)}/sleep"
    nights = V.night_exports(spark, sf_dir).groupBy("athlete_id").agg(F.array_sort(F.collect_list("night")).alias("n"))
    _write_texts(nights.select("athlete_id", F.concat(F.lit("["), F.array_join("n", ","), F.lit("]")).alias("value")), path)
    return N.read_sleep_json(spark, path, pattern="*.txt").select("athlete_id", "calendar_date", "deep_sec", "total_in_bed_sec", "score_overall", "feedback")


SLEEP_JSON_SQL = V.with_views("night_exports", body=f"{NIGHTS} select athlete_id, calendar_date, deep_sec, total_in_bed_sec, score_overall, feedback from nt")


def sleep_csv_files(spark, sf_dir):
    """Two-column sleep files, one night of an athlete each, read again."""
    path = f"{_folder(spark)}/sleep"
    night = V.table(spark, sf_dir, "events").groupBy(F.col("user_id").cast("string").alias("athlete_id")).agg(
        F.min(F.expr("cast(ts as date)")).cast("string").alias("day"), F.count(F.lit(1)).alias("n"))
    lines = night.selectExpr("athlete_id", "concat_ws('\n', 'key,value', concat('Date,', day), concat('Deep Sleep,', cast(n % 9 as string), 'h ', cast(n % 60 as string), 'm'), "
                             "concat('SLEEP SCORE,', cast(n % 101 as string)), 'Sleep Score,') as value")
    _write_texts(lines, path)
    return N.read_sleep_csv(spark, path, pattern="*.txt").select("athlete_id", "calendar_date", "deep_sec", "score_overall")


SLEEP_CSV_SQL = """select cast(user_id as varchar) athlete_id, cast(min(cast(ts as date)) as varchar) calendar_date, count(*) % 9 * 3600 + count(*) % 60 * 60 deep_sec,
  cast(count(*) % 101 as int) score_overall from events group by 1"""


def text_labels(spark, sf_dir):
    """Axis labels of durations and stored forms of exercise names."""
    orders = V.table(spark, sf_dir, "orders").withColumn("seconds", F.expr("o_orderkey * 7 % 20000")).withColumn("shown", F.expr("concat(' ', o_orderpriority, ' ', o_orderstatus, ' ')"))
    return orders.select("o_orderkey", T.duration_label(F.col("seconds")).alias("label"), T.exercise_key(F.col("shown")).alias("key_name"))


LABELS_SQL = """with s as (select o_orderkey, o_orderkey * 7 % 20000 s, concat(' ', o_orderpriority, ' ', o_orderstatus, ' ') shown from orders)
select o_orderkey, case when s < 60 then s || 's' when s < 3600 then (s // 60) || 'min' when s % 3600 // 60 > 0 then (s // 3600) || 'h' || lpad((s % 3600 // 60)::varchar, 2, '0')
  else (s // 3600) || 'h' end label, replace(lower(trim(shown)), ' ', '_') key_name from s"""

QUERIES = {
    "ledger_ingest": (ledger_ingest, TOTALS_SQL),
    "ledger_skips_known": (ledger_skips_known, SKIPS_SQL),
    "ledger_rebuild": (ledger_rebuild, REBUILD_SQL),
    "dataset_read": (dataset_read, DATASET_SQL),
    "stored_records": (stored_records, STORED_SQL),
    "stored_drift": (stored_drift, STORED_DRIFT_SQL),
    "json_sink": (json_sink, JSON_SQL),
    "workout_files": (workout_files, WORKOUTS_SQL),
    "sleep_json_files": (sleep_json_files, SLEEP_JSON_SQL),
    "sleep_csv_files": (sleep_csv_files, SLEEP_CSV_SQL),
    "text_labels": (text_labels, LABELS_SQL),
}
