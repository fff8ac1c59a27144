"""Projections of the supplied star-schema tables onto the activity domain.

Each view is a list of ``(column, expression)`` written in SQL that Spark and DuckDB
both accept, so the operator under test and its SQL counterpart read the same rows.

* sessions: one per order, 20 customers to an athlete, measures from its line items;
* telemetry: one point per event, one ride per user;
* lap_points: one point per line item, many short rides per athlete over years;
* splits: line items as climb or rest intervals;
* nights: events per user and day; score_nights: one night before most orders;
* workouts: nested exercise log from orders and line items.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.series import chunk_rows
from ..session import shuffle_width

AS_OF = "2001-06-15"
ATHLETE = "cast(cast(floor(o_custkey / 20) as bigint) as string)"
SESSION_TS = "o_orderdate + (o_orderkey % 24) * INTERVAL '1' HOUR + (o_orderkey % 60) * INTERVAL '1' MINUTE"
SPORT = """case when o_orderkey % 97 = 0 then null
  when o_orderkey % 89 = 0 then 'swimming'
  when o_orderkey % 83 = 0 then 'rowing'
  when o_orderkey % 11 = 0 then 'training'
  when o_orderkey % 13 = 0 then 'racket'
  when substr(o_orderpriority, 1, 1) = '1' then 'cycling'
  when substr(o_orderpriority, 1, 1) = '2' then 'running'
  when substr(o_orderpriority, 1, 1) = '3' then 'hiking'
  when substr(o_orderpriority, 1, 1) = '4' then 'alpine_skiing'
  else 'rock_climbing' end"""

SESSIONS = [
    ("athlete_id", ATHLETE),
    ("source_file", "cast(o_orderkey as string)"),
    ("sport", SPORT),
    ("sub_sport", "case when o_orderkey % 13 = 0 and o_orderkey % 2 = 0 then 'pickleball' else 'generic' end"),
    ("sport_profile_name", "case o_orderkey % 4 when 0 then 'Ski' when 1 then 'Backcountry Ski' when 2 then 'Resort' else null end"),
    ("timestamp", SESSION_TS),
    ("total_timer_time", "cast(qty * 60 as double)"),
    ("total_elapsed_time", "cast(qty * 66 as double)"),
    ("total_moving_time", "cast(qty * 54 as double)"),
    ("total_distance", "cast(ext as double) / 4"),
    ("avg_speed", "cast(o_orderkey % 120 as double) / 8"),
    ("max_speed", "cast(o_orderkey % 250 as double) / 8"),
    ("enhanced_avg_speed", "cast(o_orderkey % 120 as double) / 8"),
    ("enhanced_max_speed", "cast(o_orderkey % 250 as double) / 8"),
    ("total_ascent", "case when o_orderkey % 23 = 0 then null else cast(o_orderkey % 1500 as double) end"),
    ("total_descent", "case when o_orderkey % 31 = 0 then null else cast(o_orderkey % 1700 as double) end"),
    ("avg_heart_rate", "case when o_orderkey % 29 = 0 then null else cast(100 + o_orderkey % 60 as double) end"),
    ("max_heart_rate", "case when o_orderkey % 29 = 0 then null else cast(150 + o_orderkey % 45 as double) end"),
    ("num_laps", "case when o_orderkey % 37 = 0 then null else cast(o_orderkey % 20 as double) end"),
    ("total_calories", "cast(qty * 8 as double)"),
    ("training_stress_score", "case when o_orderkey % 5 = 0 then null else cast(qty as double) end"),
    ("normalized_power", "case when o_orderkey % 15 = 0 then null else cast(150 + o_orderkey % 100 as double) end"),
    ("avg_power", "case when o_orderkey % 15 = 0 then null else cast(120 + o_orderkey % 100 as double) end"),
    ("intensity_factor", "cast(64 + o_orderkey % 64 as double) / 128"),
    ("threshold_power", "case when o_orderkey % 17 = 0 then null when o_orderkey % 19 = 0 then 0.0e0 else cast(200 + o_custkey % 100 as double) end"),
    ("total_work", "cast(qty * 10000 as double)"),
    ("avg_cadence", "cast(60 + o_orderkey % 40 as double)"),
    ("left_right_balance", "case when o_orderkey % 41 = 0 then null else cast(37768 + o_orderkey % 200 as double) end"),
]

CLOCK = "((day(ts) - 1) * 86400 + hour(ts) * 3600 + minute(ts) * 60 + second(ts))"
# 6 m distance steps; eight days up at 8 %, eight days down at 5 %, plus point noise
METRES = f"cast(floor({CLOCK} / 600) * 6 as double)"
DAY16 = f"({CLOCK} % 1382400)"
CLIMB_CM = f"""(cast(floor({CLOCK} / 1382400) as bigint) * 20736
  + case when {DAY16} < 691200 then cast(floor({DAY16} * 8 / 100) as bigint)
    else 55296 - cast(floor(({DAY16} - 691200) * 5 / 100) as bigint) end
  + (event_id * 37) % 11 * 90)"""

TELEMETRY = [
    ("athlete_id", "cast(user_id as string)"),
    ("source_file", "concat('ride-', cast(user_id as string))"),
    ("timestamp", "ts"),
    ("event_id", "event_id"),
    ("power", "case when event_type = 'error' then null else cast(floor(value * 5) as double) end"),
    ("cadence", "case when event_id % 9 = 0 then null else cast(event_id % 100 as double) end"),
    ("heart_rate", "cast(90 + event_id % 80 as double)"),
    ("enhanced_speed", "cast(event_id % 160 as double) / 8"),
    ("position_lat", "case when event_id % 10 = 3 then null else 470000000.0e0 + (event_id % 1024) * 4096 end"),
    ("position_long", "case when event_id % 10 = 3 then null else -1250000000.0e0 + (event_id % 512) * 8192 end"),
    ("distance", f"case when event_id % 17 = 0 then null else {METRES} end"),
    ("enhanced_altitude", f"case when event_id % 19 = 0 or (day(ts) = 1 and event_id % 3 = 0) then null else cast({CLIMB_CM} as double) / 100 end"),
]

# events in a row as rides of up to 80,000 points, longer than one chunk of the power series
LONG_RIDE = "cast(cast(floor(event_id / 80000) as bigint) as string)"
LONG_RIDES = [(n, f"concat('long-', {LONG_RIDE})" if n == "source_file" else f"concat('rider-', {LONG_RIDE})" if n == "athlete_id" else e)
              for n, e in TELEMETRY]

# line items in a row as stages of about 1,600 points, one every 73 days, 48 to an athlete: rides long enough for
# every stored duration, over years
STAGE = "cast(floor(l_orderkey / 400) as bigint)"
TOURS = [
    ("athlete_id", f"concat('tour-', cast(cast(floor({STAGE} / 48) as bigint) as string))"),
    ("source_file", f"concat('stage-', cast({STAGE} as string))"),
    ("timestamp", f"cast('2015-01-05 14:00:00' as timestamp_ntz) + {STAGE} % 48 * 73 * INTERVAL '1' DAY + (l_orderkey % 400 * 8 + l_linenumber) * INTERVAL '1' SECOND"),
    ("point_id", "l_partkey * 100000 + l_suppkey"),
    ("power", f"case when l_suppkey % 13 = 0 then null else l_quantity * 5 + {STAGE} * 37 % 7 * 10 end"),
]
TOUR_SESSIONS = [
    ("sport", "'cycling'"),
    ("timestamp", "min(timestamp)"),
    ("training_stress_score", "cast(sum(point_id) % 151 as double)"),
    ("threshold_power", "case when count(*) % 7 = 0 then null else cast(150 + count(*) % 90 as double) end"),
]
TOUR_NIGHTS = [
    ("athlete_id", "athlete_id"),
    ("calendar_date", "cast(cast(timestamp - INTERVAL '1' DAY as date) as string)"),
    ("score_overall", "cast(case when training_stress_score % 9 = 0 then null else training_stress_score * 37 % 101 end as int)"),
]

LAP_POINTS = [
    ("athlete_id", ATHLETE),
    ("source_file", "cast(o_orderkey as string)"),
    ("timestamp", SESSION_TS + " + l_linenumber * INTERVAL '1' SECOND"),
    ("point_id", "l_partkey * 100000 + l_suppkey"),
    ("power", "case when l_suppkey % 13 = 0 then null else l_quantity * 5 end"),
]

SPLITS = [
    ("athlete_id", ATHLETE),
    ("source_file", "cast(l_orderkey as string)"),
    ("split_type", "case when l_returnflag = 'N' then 'climb_rest' else 'climb_active' end"),
    ("start_time", "l_shipdate"),
    ("message_index", "l_linenumber * 1000000.0e0 + l_partkey"),
    ("total_timer_time", "l_quantity * 12"),
    ("total_calories", "case when l_quantity < 6 then 0.0e0 else l_quantity end"),
    ("sport", SPORT),
]

RIDE_SESSIONS_GROUP = [
    ("athlete_id", "cast(user_id as string)"),
    ("source_file", "concat('ride-', cast(user_id as string))"),
    ("sport", "'cycling'"),
    ("timestamp", "min(ts)"),
    ("threshold_power", "max(case when user_id % 7 = 0 then null when user_id % 11 = 0 then 0.0e0 else cast(60 + user_id % 90 as double) end)"),
]

_SEC = "cast(floor(value * 60) as bigint)"
NIGHT_STAGES = [
    ("deep", f"sum(case when event_type = 'click' then {_SEC} end)"),
    ("light", f"sum(case when event_type = 'view' then {_SEC} end)"),
    ("rem", f"sum(case when event_type = 'purchase' then {_SEC} end)"),
    ("awake", f"sum(case when event_type = 'error' then {_SEC} end)"),
    ("points", f"sum({_SEC})"),
    ("n", "count(*)"),
]
# nested export text of one night, parsed again by the sleep reader
NIGHT_JSON = """concat('{"calendarDate":"', calendar_date, '","sleepStartTimestampGMT":"', calendar_date, 'T04:00:00.0"',
  case when deep is null then '' else concat(',"deepSleepSeconds":', cast(deep as string)) end,
  case when light is null then '' else concat(',"lightSleepSeconds":', cast(light as string)) end,
  case when rem is null then '' else concat(',"remSleepSeconds":', cast(rem as string)) end,
  case when awake is null then '' else concat(',"awakeSleepSeconds":', cast(awake as string)) end,
  case when n % 3 = 0 then '' else concat(',"spo2SleepSummary":{"averageSPO2":', cast(90 + n as string), '.5,"lowestSPO2":', cast(80 + n as string), '}') end,
  case when points % 7 = 0 then '' else concat(',"sleepScores":{"overallScore":', cast(points % 101 as string), ',"feedback":"F', cast(n as string), '"}') end,
  '}')"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _project(fields: list[tuple[str, str]]) -> list[str]:
    return [f"{expr} AS {name}" for name, expr in fields]


def _sql(fields: list[tuple[str, str]]) -> str:
    return ", ".join(f"{expr} AS {name}" for name, expr in fields)


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the sums of their line items; the join's tasks keep the configured width, roll-ups begin in them."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.sum(F.col("l_quantity").cast("bigint")).alias("qty"),
        F.sum(F.round("l_extendedprice").cast("bigint")).alias("ext"),
    )
    orders = table(spark, sf_dir, "orders")
    orders = orders.repartition(shuffle_width(orders), "o_orderkey")
    return orders.join(lines, orders.o_orderkey == lines.l_orderkey, "left").selectExpr(
        *_project(SESSIONS)
    )


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*_project(TELEMETRY))


def long_rides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*_project(LONG_RIDES))


def long_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The session of each long ride; all began within the same month."""
    rides = long_rides(spark, sf_dir)
    return rides.groupBy("athlete_id", "source_file").agg(F.min("timestamp").alias("timestamp"))


def ride_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = {"athlete_id", "source_file", "sport"}
    aggs = [F.expr(e).alias(n) for n, e in RIDE_SESSIONS_GROUP if n not in keys]
    grouped = table(spark, sf_dir, "events").groupBy("user_id").agg(*aggs)
    return grouped.selectExpr(
        *[f"{e} AS {n}" for n, e in RIDE_SESSIONS_GROUP if n in keys],
        *[n for n, _ in RIDE_SESSIONS_GROUP if n not in keys],
    )


def tours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(*_project(TOURS))


def tour_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tours(spark, sf_dir).groupBy("athlete_id", "source_file").agg(*[F.expr(e).alias(n) for n, e in TOUR_SESSIONS])


def tour_nights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scored night before each stage."""
    return tour_sessions(spark, sf_dir).selectExpr(*_project(TOUR_NIGHTS))


def lap_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").filter(f"({SPORT}) = 'cycling'")
    lines = table(spark, sf_dir, "lineitem")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).selectExpr(
        *_project(LAP_POINTS)
    )


def splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    lines = table(spark, sf_dir, "lineitem")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).selectExpr(*_project(SPLITS))


def night_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(athlete_id, calendar_date, night): the nested export document as text."""
    grouped = (
        table(spark, sf_dir, "events")
        .selectExpr("*", "cast(user_id as string) AS athlete_id", "cast(cast(ts as date) as string) AS calendar_date")
        .groupBy("athlete_id", "calendar_date")
        .agg(*[F.expr(e).alias(n) for n, e in NIGHT_STAGES])
    )
    return grouped.selectExpr("athlete_id", "calendar_date", f"{NIGHT_JSON} AS night")


def score_nights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One scored night per athlete and date, for the prior-night join."""
    return (
        table(spark, sf_dir, "orders")
        .selectExpr(f"{ATHLETE} AS athlete_id", "cast(cast(o_orderdate - INTERVAL '1' DAY as date) as string) AS calendar_date", "o_orderkey")
        .groupBy("athlete_id", "calendar_date")
        .agg(F.expr("cast(case when sum(o_orderkey) % 9 = 0 or min(o_orderkey) % 5 = 0 then null else sum(o_orderkey) % 101 end as int)").alias("score_overall"))
    )


def workout_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat lifting sets behind the nested log: every order is a workout.

    Sorts of the join and of the nesting run in the same tasks, so these keep the configured width.
    """
    orders = table(spark, sf_dir, "orders")
    lines = table(spark, sf_dir, "lineitem")
    lines = lines.repartition(shuffle_width(lines), "l_orderkey")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).selectExpr(*_project(WORKOUT_SETS))


WORKOUT_SETS = [
    ("athlete_id", ATHLETE),
    ("log_seq", "o_orderkey"),
    ("date", "cast(cast(o_orderdate as date) as string)"),
    ("body_weight", "case when o_orderkey % 2 = 0 then null else cast(150 + o_orderkey % 40 as double) end"),
    ("name", "case concat(l_returnflag, l_linestatus) when 'AF' then 'bench_press' when 'AO' then 'pull_ups' when 'NF' then 'squat' when 'NO' then 'dips' when 'RF' then 'deadlift' else 'row' end"),
    ("set", "l_partkey * 100000 + l_suppkey"),
    ("weight", "case when l_quantity < 5 then 0.0e0 else l_quantity end"),
    ("reps", "l_linenumber + 4"),
]


def workouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested log: one row per workout with exercises in name order, sets in set order."""
    sets = workout_sets(spark, sf_dir)
    exercises = sets.groupBy("athlete_id", "log_seq", "date", "body_weight", "name").agg(
        F.sort_array(F.collect_list(F.struct("set", "weight", "reps"))).alias("sets")
    )
    return exercises.groupBy("athlete_id", "log_seq", "date", "body_weight").agg(
        F.sort_array(F.collect_list(F.struct("name", "sets"))).alias("exercises")
    )


# ── the same views for the SQL side ──────────────────────────────────────────

CTE: dict[str, str] = {
    "sessions": f"""select {_sql(SESSIONS)} from orders left join (
        select l_orderkey, cast(sum(cast(l_quantity as bigint)) as bigint) qty,
               cast(sum(cast(round(l_extendedprice) as bigint)) as bigint) ext
        from lineitem group by l_orderkey) li on o_orderkey = l_orderkey""",
    "telemetry": f"select {_sql(TELEMETRY)} from events",
    "long_rides": f"select {_sql(LONG_RIDES)} from events",
    "ride_sessions": f"select {_sql(RIDE_SESSIONS_GROUP)} from events group by user_id",
    "tours": f"select {_sql(TOURS)} from lineitem".replace("timestamp_ntz", "timestamp"),
    "tour_sessions": f"select athlete_id, source_file, {_sql(TOUR_SESSIONS)} from tours group by 1, 2",
    "tour_nights": f"select {_sql(TOUR_NIGHTS)} from tour_sessions",
    "lap_points": f"select {_sql(LAP_POINTS)} from lineitem join orders on l_orderkey = o_orderkey where ({SPORT}) = 'cycling'",
    "splits": f"select {_sql(SPLITS)} from lineitem join orders on l_orderkey = o_orderkey",
    "night_exports": f"""select athlete_id, calendar_date, {NIGHT_JSON} AS night from (
        select cast(user_id as string) athlete_id, cast(cast(ts as date) as string) calendar_date, {_sql(NIGHT_STAGES)}
        from events group by 1, 2)""",
    "score_nights": f"""select athlete_id, calendar_date,
        cast(case when sum(o_orderkey) % 9 = 0 or min(o_orderkey) % 5 = 0 then null else sum(o_orderkey) % 101 end as int) score_overall
        from (select {ATHLETE} athlete_id, cast(cast(o_orderdate - INTERVAL '1' DAY as date) as string) calendar_date, o_orderkey
              from orders) group by 1, 2""",
    "workout_sets": f"select {_sql(WORKOUT_SETS)} from lineitem join orders on l_orderkey = o_orderkey",
}


def with_views(*names: str, body: str) -> str:
    """SQL text with the named views (and ``a as (...)`` steps in ``body``) in front."""
    head = ",\n".join(f"{n} as ({CTE[n]})" for n in names)
    body = body.strip()
    return f"with {head}{',' if not body.lower().startswith('select') else ''}\n{body}"


Query = Callable[[SparkSession, str], DataFrame]


def small_chunks(query: Query, rows: int = 13) -> Query:
    """``query`` with series cut every few rows, so short rides cross many chunk edges."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        with chunk_rows(rows):
            return query(spark, sf_dir)
    return run
