"""Readers, conformance and ingestion over the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import messages as M
from ..sources import schemas as S
from ..sources import tables as R
from . import views as V

# decoded messages: one record document per event; every tenth event was exported twice
MESSAGE_FIELDS = """concat('{"timestamp":"', substr(cast(ts as string), 1, 19), '","power":', cast(cast(floor(value * 5) as bigint) as string),
  ',"heart_rate":', case when event_id % 50 = 7 then '"n/a"' else cast(90 + event_id % 80 as string) end,
  ',"grit":', case when event_id % 2 = 0 then 'true' else 'false' end,
  ',"power_phase":[1,2],"dev":{"k":1}',
  case when event_id % 25 = 3 then ',"core_temp":37' else '' end,
  case when event_id % 500 = 11 then '' else '}' end)"""
MESSAGES = [
    ("athlete_id", "cast(user_id as string)"),
    ("msg_type", "'record_mesgs'"),
    ("fields", MESSAGE_FIELDS),
]


def messages(spark, sf_dir):
    events = V.table(spark, sf_dir, "events")
    first = events.withColumn("source_file", F.expr("concat('ride-', cast(user_id as string))"))
    again = events.filter("event_id % 10 = 0").withColumn(
        "source_file", F.expr("concat('copy-', cast(user_id as string))")
    )
    return first.unionByName(again).selectExpr("source_file", *[f"{e} AS {n}" for n, e in MESSAGES])


# the same rows without going through documents
PLAIN = """
exported as (
  select *, concat('ride-', cast(user_id as varchar)) source_file from events
  union all
  select *, concat('copy-', cast(user_id as varchar)) from events where event_id % 10 = 0),
plain as (
  select cast(user_id as varchar) athlete_id, source_file,
    cast(date_trunc('second', ts) as timestamp) "timestamp", floor(value * 5) power,
    case when event_id % 50 = 7 then null else cast(90 + event_id % 80 as double) end heart_rate,
    case when event_id % 2 = 0 then 1.0 else 0.0 end::double grit, event_id
  from exported where event_id % 500 <> 11)
"""


def ingest_messages(spark, sf_dir):
    rows = M.flatten_messages(messages(spark, sf_dir), "record_mesgs")
    good = rows.filter(~F.col("_bad")).drop("_bad")
    return M.dedup(good).select("athlete_id", "source_file", "timestamp", "power", "heart_rate", "grit", "cadence")


# one message of each type per event, with undeclared fields, bracketed text and whole numbers
TYPED = [
    ("athlete_id", "cast(user_id as string)"),
    ("source_file", "concat('ride-', cast(user_id as string))"),
    ("msg_type", """case event_id % 6 when 0 then 'file_id_mesgs' when 1 then 'activity_mesgs' when 2 then 'session_mesgs'
      when 3 then 'record_mesgs' when 4 then 'split_mesgs' else 'split_summary_mesgs' end"""),
    ("fields", """concat('{"timestamp":"', substr(cast(ts as string), 1, 19), '","number":', cast(event_id as string),
      ',"num_sessions":', cast(event_id % 9 as string), ',"num_laps":', cast(event_id % 20 as string), ',"power":', cast(event_id % 300 as string),
      ',"total_timer_time":', cast(event_id % 5000 as string), ',"num_splits":', cast(event_id % 7 as string),
      ',"type":"[Race] day","event":"{x} ', cast(event_id % 3 as string), '","split_type":"[climb]","activity_type":"', event_type,
      '","nested":{"a":1},"list":[', cast(event_id as string), '],"core_temp":', cast(event_id % 40 as string), '}')"""),
]
MAIN = {"file_id_mesgs": ("number", "type"), "activity_mesgs": ("num_sessions", "type"), "session_mesgs": ("num_laps", "event"),
        "record_mesgs": ("power", "activity_type"), "split_mesgs": ("total_timer_time", "split_type"), "split_summary_mesgs": ("num_splits", "split_type")}


def ingest_all_types(spark, sf_dir):
    msgs = V.table(spark, sf_dir, "events").selectExpr(*[f"{e} AS {n}" for n, e in TYPED])
    out = None
    for msg_type, rows in M.ingest(msgs, {}).items():
        number, text = MAIN[msg_type]
        temp = F.get_json_object("extra", "$.core_temp").alias("core_temp")
        part = rows.select("athlete_id", "source_file", F.lit(msg_type).alias("msg_type"), F.col(number).alias("number"), F.col(text).alias("label"), temp)
        out = part if out is None else out.unionByName(part)
    return out


ALL_TYPES_SQL = f"""
select {TYPED[0][1]} athlete_id, {TYPED[1][1]} source_file, {TYPED[2][1]} msg_type,
  cast(case event_id % 6 when 0 then event_id when 1 then event_id % 9 when 2 then event_id % 20 when 3 then event_id % 300
       when 4 then event_id % 5000 else event_id % 7 end as double) number,
  case event_id % 6 when 0 then '[Race] day' when 1 then '[Race] day' when 2 then concat('{{x}} ', cast(event_id % 3 as string))
       when 3 then event_type else '[climb]' end AS label,
  cast(event_id % 40 as string) core_temp
from events"""

INGEST_SQL = f"""with {PLAIN}
select athlete_id, min(source_file) source_file, "timestamp", power, heart_rate, grit, cast(null as double) cadence
from plain group by athlete_id, "timestamp", power, heart_rate, grit"""


def ingest_incremental(spark, sf_dir):
    msgs = messages(spark, sf_dir)
    stored = M.flatten_messages(msgs.filter("cast(athlete_id as int) % 3 = 0"), "record_mesgs")
    fresh = M.not_yet_stored(msgs, {"record_mesgs": stored})
    return fresh.groupBy("athlete_id", "source_file").agg(F.count(F.lit(1)).alias("new_messages"))


INCREMENTAL_SQL = """
select cast(user_id as varchar) athlete_id, source_file, count(*) new_messages from (
  select *, concat('ride-', cast(user_id as varchar)) source_file from events
  union all
  select *, concat('copy-', cast(user_id as varchar)) from events where event_id % 10 = 0)
where user_id % 3 <> 0 group by 1, 2"""


def dedup_append(spark, sf_dir):
    points = V.telemetry(spark, sf_dir).select("athlete_id", "source_file", "timestamp", "power", "heart_rate")
    again = points.filter("heart_rate < 130").withColumn("source_file", F.concat(F.lit("a-"), "source_file"))
    return M.append_dedup(points, again)


DEDUP_SQL = V.with_views("telemetry", body="""
select athlete_id, case when heart_rate < 130 then concat('a-', source_file) else source_file end source_file,
  "timestamp", power, heart_rate from telemetry
group by all""")


def align_union(spark, sf_dir):
    base = V.sessions(spark, sf_dir)
    old = base.filter("cast(source_file as bigint) % 2 = 0").select(
        "athlete_id", "source_file", "num_laps", F.col("total_timer_time").alias("only_old"), F.lit(None).alias("trigger")
    )
    new = base.filter("cast(source_file as bigint) % 2 = 1").select(
        "athlete_id", "source_file",
        F.expr("case when cast(source_file as bigint) % 7 = 0 then 'x' else cast(cast(num_laps as int) as string) end").alias("num_laps"),
        F.col("avg_power").alias("only_new"), F.lit("manual").alias("trigger"),
    )
    left, right = M.align(old, new)
    return left.unionByName(right)


ALIGN_SQL = V.with_views("sessions", body="""
select athlete_id, source_file, num_laps, total_timer_time only_old, cast(null as double) only_new, cast(null as varchar) "trigger"
from sessions where cast(source_file as bigint) % 2 = 0
union all
select athlete_id, source_file, case when cast(source_file as bigint) % 7 = 0 then null else num_laps end, null, avg_power, 'manual'
from sessions where cast(source_file as bigint) % 2 = 1""")


def schema_drift(spark, sf_dir):
    return M.message_drift(messages(spark, sf_dir))


DRIFT_SQL = f"""with {PLAIN}
select 'record_mesgs' msg_type, c.name as "column", count(*) messages
from plain, (values ('power_phase', 0), ('dev', 0), ('core_temp', 1)) c(name, part)
where c.part = 0 or event_id % 25 = 3 group by c.name"""


def ingest_report(spark, sf_dir):
    msgs = messages(spark, sf_dir)
    stored = M.flatten_messages(msgs.filter("cast(athlete_id as int) % 3 = 0"), "record_mesgs")
    return M.ingest_report(msgs, {"record_mesgs": stored})


REPORT_SQL = """
select cast(user_id as varchar) athlete_id, source_file, 'record_mesgs' msg_type, count(*) messages,
  count(*) filter (where event_id % 500 = 11) unparsable,
  count(*) filter (where event_id % 500 <> 11 and event_id % 50 = 7) misfit_values,
  user_id % 3 = 0 skipped
from (
  select *, concat('ride-', cast(user_id as varchar)) source_file from events
  union all
  select *, concat('copy-', cast(user_id as varchar)) from events where event_id % 10 = 0)
group by user_id, source_file"""


def recent_records_view(spark, sf_dir):
    return R.recent_records(V.telemetry(spark, sf_dir), "2024-07-10")


RECENT_SQL = V.with_views("telemetry", body="""
select athlete_id, source_file, "timestamp", power, distance, enhanced_altitude, position_lat, position_long,
  enhanced_speed, cadence, heart_rate, cast("timestamp" as date) dt
from telemetry where "timestamp" >= date '2024-07-10' - 182""")


def scan_lookback(spark, sf_dir):
    columns = ["athlete_id", "source_file", "sport", "timestamp", "total_timer_time"]
    return R.scan(V.sessions(spark, sf_dir), "session_mesgs", V.AS_OF, columns)


SCAN_SQL = V.with_views("sessions", body=f"""
select athlete_id, source_file, sport, "timestamp", total_timer_time from sessions
where "timestamp" >= date '{V.AS_OF}' - 1460""")

SPORT_COLUMNS = ["source_file", "athlete_id", "sport", "total_distance", "threshold_power", "stand_count", "trigger"]


def sessions_by_sport(spark, sf_dir):
    local = R.load_local_sessions(V.sessions(spark, sf_dir), "cycling")
    return local.select(*SPORT_COLUMNS, "local_timestamp", "local_date")


BY_SPORT_SQL = V.with_views("sessions", body="""
select source_file, athlete_id, sport, total_distance, threshold_power, cast(null as double) stand_count, cast(null as varchar) "trigger",
  timezone('America/Denver', timezone('UTC', "timestamp")) local_timestamp,
  cast(timezone('America/Denver', timezone('UTC', "timestamp")) as date) local_date
from sessions where sport = 'cycling'""")


def sessions_by_sub_sport(spark, sf_dir):
    picked = R.load_sub_sport(V.sessions(spark, sf_dir), "racket", "pickleball")
    return picked.select("athlete_id", "source_file", "sport", "sub_sport", "local_timestamp")


SUB_SPORT_SQL = V.with_views("sessions", body="""
select athlete_id, source_file, sport, sub_sport, timezone('America/Denver', timezone('UTC', "timestamp")) local_timestamp
from sessions where sport = 'racket' and sub_sport = 'pickleball'""")


def records_for_activities(spark, sf_dir):
    rides = V.ride_sessions(spark, sf_dir).filter("threshold_power > 0")
    got = R.load_records(V.telemetry(spark, sf_dir), "cycling", rides, ["source_file", "timestamp", "power", "flow"])
    return got


RECORDS_SQL = V.with_views("telemetry", "ride_sessions", body="""
select source_file, "timestamp", power, cast(null as double) flow from telemetry
where (athlete_id, source_file) in (select (athlete_id, source_file) from ride_sessions where threshold_power > 0)""")


def splits_for_activities(spark, sf_dir):
    climbs = R.load_sessions(V.sessions(spark, sf_dir), "climbing")
    got = R.load_splits(V.splits(spark, sf_dir).drop("sport"), climbs)
    return got.select("athlete_id", "source_file", "split_type", "start_time", "total_timer_time", "avg_vert_speed")


SPLITS_SQL = V.with_views("splits", body="""
select athlete_id, source_file, split_type, start_time, total_timer_time, cast(null as double) avg_vert_speed
from splits where sport = 'rock_climbing'""")


def split_summaries_for_activities(spark, sf_dir):
    climbs = R.load_sessions(V.sessions(spark, sf_dir), "climbing")
    grouped = V.splits(spark, sf_dir).groupBy("athlete_id", "source_file", "split_type").agg(
        F.count(F.lit(1)).alias("num_splits"), F.sum("total_timer_time").alias("total_timer_time")
    )
    got = R.load_split_summaries(grouped, climbs)
    return got.select("athlete_id", "source_file", "split_type", "num_splits", "total_timer_time", "max_speed")


SPLIT_SUMMARIES_SQL = V.with_views("splits", body="""
select athlete_id, source_file, split_type, cast(count(*) as double) num_splits, sum(total_timer_time) total_timer_time,
  cast(null as double) max_speed
from splits where sport = 'rock_climbing' group by all""")


def conform_schema(spark, sf_dir):
    raw = V.sessions(spark, sf_dir).select(
        "athlete_id", "source_file",
        F.col("num_laps").cast("int").alias("num_laps"),
        F.expr("case when cast(source_file as bigint) % 9 = 0 then 'oops' else cast(cast(total_ascent as int) as string) end").alias("total_ascent"),
        F.col("timestamp").cast("date").alias("timestamp"),
    )
    got = S.conform(raw, S.session_schema("hiking"))
    return got.select("athlete_id", "source_file", "num_laps", "total_ascent", "timestamp", "avg_step_length", "event")


CONFORM_SQL = V.with_views("sessions", body="""
select athlete_id, source_file, num_laps, case when cast(source_file as bigint) % 9 = 0 then null else total_ascent end total_ascent,
  cast(cast("timestamp" as date) as timestamp) "timestamp", cast(null as double) avg_step_length, cast(null as varchar) event
from sessions""")

QUERIES = {
    "scan_lookback": (scan_lookback, SCAN_SQL),
    "sessions_by_sport": (sessions_by_sport, BY_SPORT_SQL),
    "sessions_by_sub_sport": (sessions_by_sub_sport, SUB_SPORT_SQL),
    "records_for_activities": (records_for_activities, RECORDS_SQL),
    "splits_for_activities": (splits_for_activities, SPLITS_SQL),
    "split_summaries_for_activities": (split_summaries_for_activities, SPLIT_SUMMARIES_SQL),
    "conform_schema": (conform_schema, CONFORM_SQL),
    "ingest_messages": (ingest_messages, INGEST_SQL),
    "ingest_all_types": (ingest_all_types, ALL_TYPES_SQL),
    "ingest_incremental": (ingest_incremental, INCREMENTAL_SQL),
    "dedup_append": (dedup_append, DEDUP_SQL),
    "align_union": (align_union, ALIGN_SQL),
    "schema_drift": (schema_drift, DRIFT_SQL),
    "ingest_report": (ingest_report, REPORT_SQL),
    "recent_records_view": (recent_records_view, RECENT_SQL),
}
