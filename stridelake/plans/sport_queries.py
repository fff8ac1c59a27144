"""Per-sport totals, trends, lists and cards."""

from __future__ import annotations

from ..operators import sports as O
from ..sources import tables as R
from . import views as V

LOCAL = """loc as (select *, timezone('America/Denver', timezone('UTC', "timestamp")) lts,
  cast(timezone('America/Denver', timezone('UTC', "timestamp")) as date) ld from sessions)"""
HMS = """case when {0} is null then '—' when {0} >= 3600 then printf('%dh %dm %ds', cast(floor({0} / 3600) as bigint), cast(floor(({0} % 3600) / 60) as bigint), cast({0} as bigint) % 60)
  else printf('%dm %ds', cast(floor({0} / 60) as bigint), cast({0} as bigint) % 60) end"""
HM_S = """case when {0} is null then '—' when {0} >= 3600 then printf('%dh %dm', cast(floor({0} / 3600) as bigint), cast(floor(({0} % 3600) / 60) as bigint))
  else printf('%dm %ds', cast(floor({0} / 60) as bigint), cast({0} as bigint) % 60) end"""
WHOLE = "case when {0} <> 0 then cast(cast({0} as bigint) as varchar) else '—' end"
PACE = """case when total_distance > 0 and total_timer_time > 0 then printf('%d:%02d /mi',
  cast(floor(total_timer_time / (total_distance / 1609.344) / 60) as bigint), cast(floor((total_timer_time / (total_distance / 1609.344)) % 60) as bigint)) else '—' end"""
SEASON = "printf('%d-%02d', case when month(ld) >= 10 then year(ld) else year(ld) - 1 end, (case when month(ld) >= 10 then year(ld) + 1 else year(ld) end) % 100)"


def _of(sport, fn, *extra):
    return lambda spark, sf_dir: fn(R.load_sessions(V.sessions(spark, sf_dir), sport), *extra)


def _ski(fn, *extra):
    return lambda spark, sf_dir: fn(R.load_local_sessions(V.sessions(spark, sf_dir), "skiing"), *extra)


def _racket(fn, *extra):
    return lambda spark, sf_dir: fn(R.load_sub_sport(V.sessions(spark, sf_dir), "racket", "pickleball"), *extra)


def _climb(fn, *extra):
    def run(spark, sf_dir):
        sessions = R.load_sessions(V.sessions(spark, sf_dir), "climbing")
        return fn(sessions, R.load_splits(V.splits(spark, sf_dir).drop("sport"), sessions), *extra)
    return run


RUN_SQL = V.with_views("sessions", body="""
select athlete_id, count(*) total_runs, round_even(coalesce(sum(total_distance), 0) / 1609.344, 1) total_miles,
  round_even(coalesce(sum(total_timer_time), 0) / 3600, 1) total_hours from sessions where sport = 'running' group by 1""")
HIKE_SQL = V.with_views("sessions", body="""
select athlete_id, count(*) total_hikes, round_even(coalesce(sum(total_distance), 0) / 1609.344, 1) total_miles,
  round_even(coalesce(sum(total_timer_time), 0) / 3600, 1) total_hours,
  cast(round_even(coalesce(sum(total_ascent), 0) * 3.28084, 0) as bigint) total_ascent_ft from sessions where sport = 'hiking' group by 1""")
HIKE_MONTHLY_SQL = V.with_views("sessions", body=f"""{LOCAL}
select athlete_id, strftime(ld, '%Y-%m') AS month, count(*) hikes, round_even(coalesce(sum(total_distance), 0) / 1609.344, 1) miles,
  round_even(coalesce(sum(total_timer_time), 0) / 3600, 1) AS hours, round_even(coalesce(sum(total_ascent), 0) * 3.28084, 0) ascent_ft
from loc where sport = 'hiking' group by 1, 2""")
RACKET_SQL = V.with_views("sessions", body="""
select athlete_id, count(*) sessions, round_even(coalesce(sum(total_timer_time), 0) / 3600, 1) total_hours,
  cast(coalesce(sum(total_calories), 0) as bigint) total_calories, cast(round_even(avg(avg_heart_rate), 0) as bigint) avg_heart_rate
from sessions where sport = 'racket' and sub_sport = 'pickleball' group by 1""")
CLIMB_SQL = V.with_views("sessions", "splits", body="""
s as (select athlete_id, count(*) n, sum(total_timer_time) t, sum(total_calories) c from sessions where sport = 'rock_climbing' group by 1),
r as (select athlete_id, count(*) k from splits where sport = 'rock_climbing' and split_type = 'climb_active' group by 1)
select athlete_id, n sessions, round_even(coalesce(t, 0) / 3600, 1) total_hours, cast(coalesce(c, 0) as bigint) total_calories,
  coalesce(k, 0) total_routes, round_even(coalesce(k, 0) / n, 1) avg_routes, coalesce(k, 0) * 45 total_ascent_ft
from s left join r using (athlete_id)""")
CLIMB_MONTHLY_SQL = V.with_views("sessions", "splits", body=f"""{LOCAL},
s as (select athlete_id, strftime(ld, '%Y-%m') AS month, count(*) n, sum(total_timer_time) t from loc where sport = 'rock_climbing' group by 1, 2),
r as (select athlete_id, strftime(timezone('America/Denver', timezone('UTC', start_time)), '%Y-%m') AS month, count(*) k
  from splits where sport = 'rock_climbing' and split_type = 'climb_active' group by 1, 2)
select athlete_id, month, n sessions, round_even(coalesce(t, 0) / 3600, 1) AS hours, coalesce(k, 0) routes from s left join r using (athlete_id, month)""")
CLIMB_SPLITS_SQL = V.with_views("sessions", "splits", body=f"""
p as (select athlete_id, source_file, count(*) filter (where split_type = 'climb_active') k,
  coalesce(sum(total_timer_time) filter (where split_type = 'climb_active'), 0) cs, coalesce(sum(total_timer_time) filter (where split_type = 'climb_rest'), 0) rs
  from splits group by 1, 2)
select s.athlete_id, s.source_file, {HM_S.format('total_timer_time')} duration, coalesce(k, 0) routes,
  {HM_S.format('coalesce(cs, 0)')} climb_time, {HM_S.format('coalesce(rs, 0)')} rest_time, coalesce(k, 0) * 45 ascent_ft,
  {WHOLE.format('total_calories')} calories, {WHOLE.format('avg_heart_rate')} avg_hr, {WHOLE.format('max_heart_rate')} max_hr
from sessions s left join p on s.athlete_id = p.athlete_id and s.source_file = p.source_file where sport = 'rock_climbing'""")


def climb_numbering(spark, sf_dir):
    sessions = R.load_sessions(V.sessions(spark, sf_dir), "climbing")
    return O.climb_numbering(R.load_splits(V.splits(spark, sf_dir).drop("sport"), sessions))


NUMBERING_SQL = V.with_views("splits", body=f"""
select athlete_id, source_file, start_time, message_index, case when split_type = 'climb_active' then 'Climb' else 'Rest' end "type",
  {HM_S.format('total_timer_time')} duration, cast(case when split_type = 'climb_active' then 45 end as int) ascent_ft,
  {WHOLE.format('total_calories')} calories,
  cast(case when split_type = 'climb_active' then sum(case when split_type = 'climb_active' then 1 else 0 end)
    over (partition by athlete_id, source_file order by start_time, message_index) end as bigint) climb_no
from splits where sport = 'rock_climbing'""")

SKI_SQL = V.with_views("sessions", body=f"""{LOCAL}
select athlete_id, count(distinct ld) total_days, count(distinct {SEASON}) total_seasons,
  cast(round_even(coalesce(sum(total_descent), 0) * 3.28084, 0) as bigint) total_descent_ft, cast(coalesce(sum(num_laps), 0) as bigint) total_laps,
  round_even(max(enhanced_max_speed) * 2.23694, 1) max_speed_mph
from loc where sport = 'alpine_skiing' group by 1""")
SKI_AGGS = """round_even(avg(avg_heart_rate), 0) avg_heart_rate, max(max_heart_rate) max_heart_rate,
  coalesce(sum(total_moving_time), 0) total_moving_time, coalesce(sum(total_elapsed_time), 0) total_elapsed_time,
  round_even(coalesce(sum(total_distance), 0), 0) total_distance, round_even(coalesce(sum(total_ascent), 0), 0) total_ascent,
  round_even(coalesce(sum(total_descent), 0), 0) total_descent, coalesce(sum(num_laps), 0) num_laps"""
SKI_DAILY_SQL = V.with_views("sessions", body=f"""{LOCAL}
select athlete_id, ld local_date, {SKI_AGGS}, round_even(avg(avg_speed), 2) avg_speed, round_even(max(max_speed), 2) max_speed,
  round_even(max(enhanced_max_speed), 2) enhanced_max_speed, round_even(avg(enhanced_avg_speed), 2) enhanced_avg_speed
from loc where sport = 'alpine_skiing' group by 1, 2""")
SKI_SEASONS_SQL = V.with_views("sessions", body=f"""{LOCAL}
select athlete_id, {SEASON} season, min(ld) first_day, max(ld) last_day, count(distinct ld) total_days,
  count(distinct ld) filter (where sport_profile_name = 'Ski') ski_days,
  count(distinct ld) filter (where sport_profile_name = 'Backcountry Ski') bc_days,
  {SKI_AGGS}, round_even(max(enhanced_max_speed), 2) max_speed
from loc where sport = 'alpine_skiing' group by 1, 2""")

SUMMARY_SQL = V.with_views("sessions", body=f"""{LOCAL}
select athlete_id, source_file, strftime(lts, '%Y-%m-%d %I:%M %p') "date", round_even(total_distance / 1609.344, 1) distance_mi,
  round_even(total_timer_time / 3600, 2) duration_hr, total_timer_time total_timer_time_s, round_even(total_elapsed_time / 3600, 2) elapsed_hr,
  cast(trunc(avg_power) as bigint) avg_power, cast(trunc(normalized_power) as bigint) normalized_power,
  round_even(nullif(enhanced_avg_speed, 0) * 2.23694, 1) avg_speed_mph, cast(trunc(avg_cadence) as bigint) avg_cadence,
  avg_heart_rate avg_hr, max_heart_rate max_hr,
  format('{{:,}}', cast(round_even(nullif(total_ascent, 0) * 3.28084, 0) as bigint)) total_ascent_ft,
  cast(round_even(nullif(total_descent, 0) * 3.28084, 0) as bigint) total_descent_ft,
  format('{{:,}}', cast(nullif(total_calories, 0) as bigint)) calories,
  cast(round_even(nullif(training_stress_score, 0), 0) as bigint) tss, intensity_factor, cast(trunc(threshold_power) as bigint) ftp,
  format('{{:,}}', cast(round_even(nullif(total_work, 0) / 1000, 0) as bigint)) work_kj,
  round_even(100 - (cast(left_right_balance as bigint) & 16383) / 100, 1) left_balance,
  round_even((cast(left_right_balance as bigint) & 16383) / 100, 1) right_balance
from loc where sport = 'cycling'""")

RECENT_RIDES_SQL = V.with_views("sessions", body=f"""{LOCAL}
select athlete_id, source_file, lts local_timestamp, strftime(ld, '%Y-%m-%d') || ' — ' || cast(round_even(total_distance / 1609.344, 1) as varchar)
  || ' mi, ' || cast(round_even(total_timer_time / 3600, 1) as varchar) || ' hr' label
from loc where sport = 'cycling' and cast("timestamp" as date) >= date '{V.AS_OF}' - 182""")


def _foot_sql(sport, digits):
    return V.with_views("sessions", body=f"""{LOCAL}
select athlete_id, source_file, lts local_timestamp,
  strftime(ld, '%Y-%m-%d') || ' — ' || coalesce(cast(round_even(nullif(total_distance, 0) / 1609.344, {digits}) as varchar), '0') || ' mi' label
from loc where sport = '{sport}' and ld >= date '{V.AS_OF}' - 182""")


RECENT_SKI_SQL = V.with_views("sessions", body=f"""{LOCAL}
select athlete_id, source_file, ld local_date, strftime(ld, '%Y-%m-%d') || ' — ' || coalesce(sport_profile_name, 'Ski') || ' — ' ||
  cast(cast(coalesce(num_laps, 0) as bigint) as varchar) || ' laps — ' ||
  coalesce(format('{{:,}}', cast(floor(nullif(total_descent, 0) * 3.28084) as bigint)) || ' ft', '—') label, {SEASON} season
from loc where sport = 'alpine_skiing' and ld >= date '{V.AS_OF}' - 182""")
CLIMB_LIST_SQL = V.with_views("sessions", "splits", body=f"""{LOCAL},
p as (select athlete_id, source_file, count(*) k from splits where split_type = 'climb_active' group by 1, 2)
select s.athlete_id, s.source_file, lts local_timestamp, strftime(ld, '%Y-%m-%d') || ' — ' || cast(coalesce(k, 0) as varchar) || ' routes, ' || {HM_S.format('total_timer_time')} label
from loc s left join p on s.athlete_id = p.athlete_id and s.source_file = p.source_file where sport = 'rock_climbing'""")

_FT = lambda c: "coalesce(format('{:,}', nullif(cast(round_even(" + c + " * 3.28084, 0) as bigint), 0)) || ' ft', '—')"
_CAL = "coalesce(format('{:,}', nullif(cast(floor(total_calories) as bigint), 0)), '—')"
_MI = "cast(round_even(nullif(total_distance, 0) / 1609.344, 2) as varchar)"
_MPH = lambda c: f"coalesce(cast(round_even(nullif({c}, 0) * 2.23694, 1) as varchar), '—')"
_HR = f"{WHOLE.format('avg_heart_rate')} avg_hr, {WHOLE.format('max_heart_rate')} max_hr"
_DAY = "athlete_id, source_file, strftime(ld, '%Y-%m-%d') \"date\""


def _detail_sql(where, columns):
    return V.with_views("sessions", body=f"{LOCAL}\nselect {_DAY}, {columns} from loc where {where}")


DETAIL = {
    "running": _detail_sql("sport = 'running'", f"""coalesce(sport_profile_name, '—') profile, coalesce({_MI}, '—') distance_mi, {HMS.format('total_timer_time')} duration,
      {PACE} avg_pace, {WHOLE.format('avg_heart_rate')} avg_hr, {WHOLE.format('total_calories')} calories"""),
    "hiking": _detail_sql("sport = 'hiking'", f"""coalesce({_MI} || ' mi', '—') distance, {HM_S.format('total_timer_time')} duration, {PACE} avg_pace,
      {_FT('total_ascent')} ascent, {_FT('total_descent')} descent, {_HR}, {_CAL} calories"""),
    "skiing": _detail_sql("sport = 'alpine_skiing'", f"""coalesce(sport_profile_name, 'Ski') profile, cast(coalesce(num_laps, 0) as bigint) laps, {_FT('total_descent')} descent, {_FT('total_ascent')} ascent,
      {HMS.format('total_moving_time')} moving, {HMS.format('total_elapsed_time')} elapsed, {_MPH('enhanced_max_speed')} max_speed_mph, {_MPH('enhanced_avg_speed')} avg_speed_mph, {_HR}, {_CAL} calories"""),
    "racket": _detail_sql("sport = 'racket' and sub_sport = 'pickleball'", f"{HMS.format('total_timer_time')} duration, {_HR}, {WHOLE.format('total_calories')} calories"),
}

QUERIES = {
    "run_totals": (_of("running", O.run_totals), RUN_SQL),
    "hike_totals": (_of("hiking", O.hike_totals), HIKE_SQL),
    "hike_monthly": (_of("hiking", O.hike_monthly), HIKE_MONTHLY_SQL),
    "racket_totals": (_racket(O.racket_totals), RACKET_SQL),
    "climb_totals": (_climb(O.climb_totals), CLIMB_SQL),
    "climb_monthly": (_climb(O.climb_monthly), CLIMB_MONTHLY_SQL),
    "climb_session_splits": (_climb(O.climb_session_splits), CLIMB_SPLITS_SQL),
    "climb_numbering": (climb_numbering, NUMBERING_SQL),
    "ski_totals": (_ski(O.ski_totals), SKI_SQL),
    "ski_daily": (_ski(O.ski_daily), SKI_DAILY_SQL),
    "ski_seasons": (_ski(O.ski_seasons), SKI_SEASONS_SQL),
    "activity_summary": (_of("cycling", O.activity_summary), SUMMARY_SQL),
    "recent_rides": (_of("cycling", O.recent_rides, V.AS_OF), RECENT_RIDES_SQL),
    "recent_hikes": (_of("hiking", O.recent_hikes, V.AS_OF), _foot_sql("hiking", 1)),
    "recent_runs": (_of("running", O.recent_runs, V.AS_OF), _foot_sql("running", 2)),
    "recent_ski_days": (_ski(O.recent_ski_days, V.AS_OF), RECENT_SKI_SQL),
    "climb_session_list": (_climb(O.climb_session_list), CLIMB_LIST_SQL),
    "session_detail_running": (_of("running", O.session_detail, "running"), DETAIL["running"]),
    "session_detail_hiking": (_of("hiking", O.session_detail, "hiking"), DETAIL["hiking"]),
    "session_detail_skiing": (_of("skiing", O.session_detail, "skiing"), DETAIL["skiing"]),
    "session_detail_racket": (_racket(O.session_detail, "racket"), DETAIL["racket"]),
}
