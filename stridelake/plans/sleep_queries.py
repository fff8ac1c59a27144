"""Sleep exports, merge and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sleep as O
from ..sources import sleep_files as R
from . import views as V


def _nights(spark, sf_dir):
    return R.parse_night_documents(V.night_exports(spark, sf_dir).select("athlete_id", "night"))


NIGHTS = """raw as (select athlete_id, night::json j from night_exports),
st as (select athlete_id, j, j->>'$.calendarDate' calendar_date, j->>'$.sleepStartTimestampGMT' sleep_start_gmt,
  coalesce((j->>'$.deepSleepSeconds')::bigint, 0) deep_sec, coalesce((j->>'$.lightSleepSeconds')::bigint, 0) light_sec,
  coalesce((j->>'$.remSleepSeconds')::bigint, 0) rem_sec, coalesce((j->>'$.awakeSleepSeconds')::bigint, 0) awake_sec from raw),
nt as (select athlete_id, calendar_date, sleep_start_gmt, cast(null as varchar) sleep_end_gmt, deep_sec, light_sec, rem_sec, awake_sec,
  deep_sec + light_sec + rem_sec total_sleep_sec, deep_sec + light_sec + rem_sec + awake_sec total_in_bed_sec,
  case when deep_sec + light_sec + rem_sec + awake_sec > 0 then round_even((deep_sec + light_sec + rem_sec) / (deep_sec + light_sec + rem_sec + awake_sec) * 100, 1) end sleep_efficiency_pct,
  round_even(deep_sec / 3600, 2) deep_hrs, round_even(light_sec / 3600, 2) light_hrs, round_even(rem_sec / 3600, 2) rem_hrs, round_even(awake_sec / 3600, 2) awake_hrs,
  round_even((deep_sec + light_sec + rem_sec) / 3600, 2) total_sleep_hrs,
  (j->>'$.spo2SleepSummary.averageSPO2')::double avg_spo2, (j->>'$.spo2SleepSummary.lowestSPO2')::int lowest_spo2, cast(null as double) avg_hr,
  cast(null as double) avg_respiration, cast(null as double) lowest_respiration, cast(null as double) highest_respiration,
  cast(0 as bigint) awake_count, cast(0 as bigint) restless_moments, cast(null as double) avg_sleep_stress,
  (j->>'$.sleepScores.overallScore')::int score_overall, cast(null as int) score_quality, cast(null as int) score_duration,
  cast(null as int) score_recovery, cast(null as int) score_deep, cast(null as int) score_rem, j->>'$.sleepScores.feedback' feedback from st)"""


def sleep_flatten(spark, sf_dir):
    return _nights(spark, sf_dir)


FLATTEN_SQL = V.with_views("night_exports", body=f"{NIGHTS} select * from nt")

# key/value lines of one CSV per user and day, with the accepted spellings mixed
CSV_BASE = """select cast(user_id as string) athlete_id, cast(cast(ts as date) as string) dt, concat('sleep-', cast(user_id as string), '-', cast(cast(ts as date) as string)) f,
  cast(count(*) as bigint) n, cast(sum(cast(floor(value * 60) as bigint)) as bigint) s, cast(min(event_id) as bigint) e from events group by user_id, cast(ts as date)"""
CSV_LINES = {
    "Calendar Date": "case when e % 29 = 0 then '' when e % 4 = 0 then concat(substr(dt, 6, 2), '/', substr(dt, 9, 2), '/', substr(dt, 1, 4)) when e % 4 = 1 then concat(substr(dt, 6, 2), '-', substr(dt, 9, 2), '-', substr(dt, 1, 4)) when e % 4 = 2 then concat(substr(dt, 1, 4), '/', substr(dt, 6, 2), '/', substr(dt, 9, 2)) else dt end",
    " deep sleep!": "concat(cast(n % 9 as string), ':', cast(10 + s % 50 as string), ':', cast(10 + e % 50 as string))",
    "Light Sleep Duration": "concat(cast(n % 7 as string), 'h ', cast(s % 60 as string), 'm')",
    "REM Sleep": "case when e % 5 = 0 then 'abc' else concat(cast(s % 60 as string), ':', cast(10 + e % 50 as string)) end",
    "Awake": "cast(s % 3000 as string)",
    "Sleep Duration": "case when e % 3 = 0 then '' else cast(10000 + s % 9000 as string) end",
    "Sleep Efficiency %": "case when e % 2 = 0 then '' else concat(cast(50 + e % 50 as string), '.5 %') end",
    "Sleep Score": "case when e % 6 = 0 then '1,0x' else cast(e % 101 as string) end",
    "Restless": "concat('1,', cast(100 + e % 800 as string), '.9')",
    "Avg SpO2": "concat(cast(90 + e % 10 as string), '.25')",
    "Unknown Label": "'x'",
}


def csv_lines(spark, sf_dir):
    base = V.table(spark, sf_dir, "events").groupBy("user_id", F.expr("cast(ts as date)").alias("d")).agg(
        F.count(F.lit(1)).alias("n"), F.expr("sum(cast(floor(value * 60) as bigint))").alias("s"), F.min("event_id").alias("e")
    ).selectExpr("cast(user_id as string) athlete_id", "cast(d as string) dt", "concat('sleep-', cast(user_id as string), '-', cast(d as string)) file", "n", "s", "e")
    lines = F.array(*[
        F.struct(F.lit(i).cast("bigint").alias("pos"), F.lit(k).alias("key"), F.expr(v).alias("value")) for i, (k, v) in enumerate(CSV_LINES.items())
    ])
    return base.select("athlete_id", "file", F.explode(lines).alias("l")).select("athlete_id", "file", "l.*")


CSV_COLUMNS = ["athlete_id", "file", "calendar_date", "deep_sec", "light_sec", "rem_sec", "awake_sec", "total_sleep_sec", "total_in_bed_sec",
               "sleep_efficiency_pct", "deep_hrs", "score_overall", "restless_moments", "avg_spo2"]


def sleep_csv(spark, sf_dir):
    return R.parse_key_values(csv_lines(spark, sf_dir)).select(*CSV_COLUMNS).withColumn("deep_hrs", F.round("deep_hrs", 6))


CSV_NIGHTS = f"""cb as ({CSV_BASE.replace('as string', 'as varchar')}),
cv as (select athlete_id, f file, dt calendar_date, (n % 9) * 3600 + (10 + s % 50) * 60 + 10 + e % 50 deep_sec, (n % 7) * 3600 + (s % 60) * 60 light_sec,
  case when e % 5 <> 0 then (s % 60) * 60 + 10 + e % 50 end rem_sec, s % 3000 awake_sec, case when e % 3 <> 0 then 10000 + s % 9000 end total_sleep_sec,
  case when e % 3 <> 0 then 10000 + s % 9000 + s % 3000 end total_in_bed_sec,
  case when e % 2 <> 0 then 50.5e0 + e % 50 when e % 3 <> 0 then round_even((10000 + s % 9000) / (10000 + s % 9000 + s % 3000) * 100, 1) end sleep_efficiency_pct,
  case when e % 6 <> 0 then cast(e % 101 as int) end score_overall, 1100 + e % 800 restless_moments, 90.25e0 + e % 10 avg_spo2
  from cb where e % 29 <> 0)"""
CSV_SQL = f"with {CSV_NIGHTS} select *, round(deep_sec / 3600, 6) deep_hrs from cv"


def _sources(spark, sf_dir):
    """Stored nights (documents of odd days), documents of even days, CSV of every user and day: all rows take part."""
    docs = _nights(spark, sf_dir)
    even = F.expr("cast(substr(calendar_date, 9, 2) as int) % 2 = 0")
    stored = docs.filter(~even).withColumn("feedback", F.lit("stored"))
    fresh = docs.filter(even).withColumn("seq", F.struct(F.lit("a").alias("file"), F.lit(0).cast("bigint").alias("pos")))
    csv = R.parse_key_values(csv_lines(spark, sf_dir))
    csv = csv.withColumn("seq", F.struct(F.col("file"), F.lit(0).cast("bigint").alias("pos"))).drop("file").withColumn("feedback", F.lit("csv"))
    return stored, fresh, csv


def sleep_merge(spark, sf_dir):
    merged = R.merge_nights(*_sources(spark, sf_dir))
    return merged.select("athlete_id", "calendar_date", "deep_sec", "total_in_bed_sec", "feedback")


MERGE_SQL = V.with_views("night_exports", body=f"""{NIGHTS}, {CSV_NIGHTS},
al as (select athlete_id, calendar_date, deep_sec, total_in_bed_sec, 'stored' feedback, 0 r from nt where substr(calendar_date, 9, 2)::int % 2 = 1
  union all select athlete_id, calendar_date, deep_sec, total_in_bed_sec, 'csv', 1 from cv
  union all select athlete_id, calendar_date, deep_sec, total_in_bed_sec, feedback, 2 from nt where substr(calendar_date, 9, 2)::int % 2 = 0)
select athlete_id, calendar_date, deep_sec, total_in_bed_sec, feedback from al qualify row_number() over (partition by athlete_id, calendar_date order by r desc) = 1""")


def sleep_merge_stats(spark, sf_dir):
    _, docs, csv = _sources(spark, sf_dir)
    return R.merge_stats(docs, csv)


STATS_SQL = f"""with {CSV_NIGHTS}
select athlete_id, count(*) filter (where substr(calendar_date, 9, 2)::int % 2 = 1) csv_rows_added,
  count(*) filter (where substr(calendar_date, 9, 2)::int % 2 = 0) csv_rows_skipped from cv group by 1"""


def sleep_summary(spark, sf_dir):
    return O.summary(_nights(spark, sf_dir))


SUMMARY_SQL = V.with_views("night_exports", body=f"""{NIGHTS}
select athlete_id, count(*) total_nights, round_even(round(avg(total_sleep_hrs), 9), 1) avg_sleep_hrs, round_even(round(avg(score_overall), 9), 1) avg_score,
  round_even(round(avg(deep_hrs), 9), 2) avg_deep_hrs, round_even(round(avg(rem_hrs), 9), 2) avg_rem_hrs, round_even(round(avg(sleep_efficiency_pct), 9), 1) avg_efficiency_pct,
  round_even(round(avg(avg_spo2), 9), 1) avg_spo2, min(calendar_date) date_range_start, max(calendar_date) date_range_end from nt group by 1""")


def sleep_recent(spark, sf_dir):
    return O.recent(_nights(spark, sf_dir), 14)


RECENT_SQL = V.with_views("night_exports", body=f"""{NIGHTS},
r as (select *, max(calendar_date) over (partition by athlete_id) top from nt)
select athlete_id, round_even(round(avg(total_sleep_hrs), 9), 1) avg_sleep_hrs, round_even(round(avg(score_overall), 9), 1) avg_score, count(*) nights
from r where calendar_date::date >= top::date - 14 group by 1""")


def sleep_metric_trend(spark, sf_dir):
    return O.metric_trend(_nights(spark, sf_dir), "score_overall", 20).withColumn("rolling_avg", F.round("rolling_avg", 6))


TREND_SQL = V.with_views("night_exports", body=f"""{NIGHTS},
k as (select athlete_id, calendar_date, score_overall::double AS value, max(calendar_date) over (partition by athlete_id) top from nt where score_overall is not null)
select athlete_id, calendar_date, value, round(avg(value) over (partition by athlete_id order by calendar_date rows 6 preceding), 6) rolling_avg
from k where calendar_date::date >= top::date - 20""")


def sleep_stages(spark, sf_dir):
    return O.stage_shares(_nights(spark, sf_dir))


STAGES_SQL = V.with_views("night_exports", body=f"""{NIGHTS}
select athlete_id, calendar_date, {", ".join(f"round_even({s}_sec / total_in_bed_sec * 100, 1) {s}_pct" for s in O.STAGES)} from nt where total_in_bed_sec > 0""")


def sleep_latest(spark, sf_dir):
    return O.latest_night(_nights(spark, sf_dir))


LATEST_SQL = V.with_views("night_exports", body=f"""{NIGHTS}
select athlete_id, calendar_date, {", ".join(f"{s}_hrs, case when total_in_bed_sec > 0 then round_even({s}_sec / total_in_bed_sec * 100, 1) end {s}_pct" for s in O.STAGES)},
  score_overall, score_quality, score_duration, score_recovery, score_deep, score_rem,
  case when score_overall is null then 'none' when score_overall >= 80 then 'good' when score_overall >= 60 then 'fair' else 'poor' end band, feedback
from nt qualify row_number() over (partition by athlete_id order by calendar_date desc) = 1""")

QUERIES = {
    "sleep_flatten": (sleep_flatten, FLATTEN_SQL),
    "sleep_csv": (sleep_csv, CSV_SQL),
    "sleep_merge": (sleep_merge, MERGE_SQL),
    "sleep_merge_stats": (sleep_merge_stats, STATS_SQL),
    "sleep_summary": (sleep_summary, SUMMARY_SQL),
    "sleep_recent": (sleep_recent, RECENT_SQL),
    "sleep_metric_trend": (sleep_metric_trend, TREND_SQL),
    "sleep_stages": (sleep_stages, STAGES_SQL),
    "sleep_latest": (sleep_latest, LATEST_SQL),
}
