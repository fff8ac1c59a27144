"""Sport and period roll-ups, calendar."""

from __future__ import annotations

from ..operators import calendar as C
from ..operators import rollups as P
from ..sources import tables as R
from . import views as V

LOCAL = """loc as (select *, timezone('America/Denver', timezone('UTC', "timestamp")) lts,
  cast(timezone('America/Denver', timezone('UTC', "timestamp")) as date) ld,
  case when sport = 'training' then 'weight_lifting' else sport end shown from sessions)"""
CLOCK = "printf('%02d:%02d:%02d', cast(floor({0} / 3600) as bigint), cast(floor(({0} % 3600) / 60) as bigint), cast({0} % 60 as bigint))"


def _period(grain):
    def run(spark, sf_dir):
        return P.period_summary(R.load_sessions(V.sessions(spark, sf_dir), "cycling"), grain)
    return run


KEYS = {
    "year": "cast(year(ld) as int) \"year\"",
    "month": "cast(year(ld) as int) \"year\", cast(month(ld) as int) \"month\"",
    "week": """cast(year(date_trunc('week', ld)) as int) "year", strftime(date_trunc('week', ld), '%Y-%m-%d') week_starting,
      strftime(date_trunc('week', ld) + interval 6 day, '%Y-%m-%d') week_ending""",
}
LABELS = {"year": "strftime(ld, '%Y')", "month": "strftime(ld, '%Y-%m')", "week": "strftime(date_trunc('week', ld), '%Y-%m-%d')"}


def _period_sql(grain):
    return V.with_views("sessions", body=f"""{LOCAL}
select athlete_id, {KEYS[grain]}, count(*) rides,
  round_even(coalesce(sum(total_distance), 0) / 1609.344, 1) miles, round_even(coalesce(sum(total_timer_time), 0) / 3600, 1) AS hours,
  cast(round_even(coalesce(sum(training_stress_score), 0), 0) as bigint) tss
from loc where sport = 'cycling' group by all""")


def hours_by_sport(spark, sf_dir):
    return P.hours_by_sport(R.load_all_sessions(V.sessions(spark, sf_dir)))


HOURS_SQL = V.with_views("sessions", body=f"""
select athlete_id, sport, {CLOCK.format('s')} total_time
from (select athlete_id, sport, coalesce(sum(total_timer_time), 0) s from sessions group by all)""")

LISTED = ["cycling", "training", "running"]
# every sport of the view, in the order of the columns
PIVOT_SPORTS = ["cycling", "training", "rock_climbing", "alpine_skiing", "hiking", "rowing", "racket", "running", "swimming"]


def _pivot(grain, sports=None):
    return lambda spark, sf_dir: P.sport_pivot(V.sessions(spark, sf_dir), grain, sports=sports)


def _pivot_sql(grain, sports=PIVOT_SPORTS, other=False):
    names = [("weight_lifting" if s == "training" else s, f"sport = '{s}'") for s in sports]
    names += [("other", "sport not in ({})".format(", ".join(f"'{s}'" for s in sports)))] * other + [("null", "sport is null")]
    aggs = ", ".join(
        f'case when count(*) filter (where {p}) > 0 then coalesce(sum(total_timer_time) filter (where {p}), 0) end "s_{n}"' for n, p in names
    )
    cells = ", ".join(
        f"""case when "s_{n}" is null then '' else {CLOCK.format(f'"s_{n}"')} || ' (' ||
        cast(case when tot > 0 then cast(round_even("s_{n}" / tot * 100, 0) as bigint) else 0 end as varchar) || '%)' end "{n}\"""" for n, _ in names
    )
    plain = {"year": '"year"', "month": '"year", "month"', "week": '"year", week_starting, week_ending'}[grain]
    return V.with_views("sessions", body=f"""{LOCAL},
t as (select athlete_id, {KEYS[grain]}, {aggs}, coalesce(sum(total_timer_time), 0) tot from loc group by all)
select athlete_id, {plain}, {cells}, {CLOCK.format('tot')} total from t""")


def sport_chart_data(spark, sf_dir):
    return P.sport_chart(V.sessions(spark, sf_dir), "month")


CHART_SQL = V.with_views("sessions", body=f"""{LOCAL}
select athlete_id, shown sport, {LABELS['month']} label, coalesce(sum(total_timer_time), 0) total_seconds, count(*) activities,
  round_even(coalesce(sum(total_timer_time), 0) / 3600, 1) AS hours from loc group by all""")


def sport_total_hours(spark, sf_dir):
    return P.total_hours(V.sessions(spark, sf_dir), "week")


TOTAL_SQL = V.with_views("sessions", body=f"""{LOCAL},
g as (select athlete_id, shown, {LABELS['week']} label, round_even(coalesce(sum(total_timer_time), 0) / 3600, 1) h from loc group by all)
select athlete_id, label, round_even(sum(h), 1) AS hours from g group by all""")


def ytd_stats(spark, sf_dir):
    return P.year_to_date(V.sessions(spark, sf_dir), V.AS_OF)


YTD_SQL = V.with_views("sessions", body=f"""{LOCAL},
y as (select * from loc where year(ld) = year(date '{V.AS_OF}')),
w as (select greatest(dayofyear(date '{V.AS_OF}') / 7, 1) AS weeks)
select athlete_id, false is_total, shown sport, round_even(coalesce(sum(total_timer_time), 0) / 3600, 1) AS hours, count(*) activities,
  round_even(round_even(coalesce(sum(total_timer_time), 0) / 3600, 1) / any_value(weeks), 1) hours_per_week,
  coalesce(sum(total_timer_time), 0) total_seconds
from y, w group by athlete_id, shown
union all
select athlete_id, true, null, round_even(coalesce(sum(total_timer_time), 0) / 3600, 1), count(*), null, coalesce(sum(total_timer_time), 0)
from y group by athlete_id""")

EVENTS = f"""{LOCAL},
last_log as (select athlete_id, "date", arg_max(n, log_seq) n_ex from (
  select athlete_id, log_seq, "date", count(distinct name) n from workout_sets group by all) group by all),
base as (select athlete_id, source_file, coalesce(sport, 'generic') sport, strftime(ld, '%Y-%m-%d') "date",
  coalesce(total_timer_time, 0) AS seconds, case when total_distance > 0 then total_distance / 1609.344 else 0 end miles from loc),
named as (select b.*, n_ex,
  case when seconds >= 3600 then printf('%dh %dm', cast(floor(seconds / 3600) as bigint), cast(floor((seconds % 3600) / 60) as bigint))
    else printf('%dm', cast(floor((seconds % 3600) / 60) as bigint)) end dur,
  case sport when 'cycling' then 'Cycling' when 'training' then 'Lifting' when 'rock_climbing' then 'Rock Climbing' when 'running' then 'Running'
    when 'hiking' then 'Hiking' when 'alpine_skiing' then 'Skiing' when 'generic' then 'Other' when 'racket' then 'Racket' when 'rowing' then 'Rowing' when 'swimming' then 'Swimming' end label
  from base b left join last_log l on b.athlete_id = l.athlete_id and b."date" = l."date"),
ev as (
  select athlete_id, source_file, "date", case when sport = 'training' then 'weight_lifting' else sport end sport, seconds, miles,
    case when sport = 'training' and n_ex > 0 then printf('Lifting (%s, %d exercises)', dur, n_ex)
      when sport = 'training' then printf('Lifting (%s)', dur)
      when sport = 'cycling' and miles > 1 then printf('Cycling (%s, %.1fmi)', dur, miles)
      else printf('%s (%s)', label, dur) end title from named
  union all
  select athlete_id, null, "date", 'weight_lifting', 0, 0, printf('Lifting (%d exercises)', n_ex) from last_log l
  where not exists (select 1 from base b where b.athlete_id = l.athlete_id and b."date" = l."date" and b.sport = 'training'))"""


def _events(spark, sf_dir):
    return C.calendar_events(V.sessions(spark, sf_dir), V.workouts(spark, sf_dir))


def calendar_events(spark, sf_dir):
    from pyspark.sql import functions as F
    return _events(spark, sf_dir).withColumn("miles", F.bround("miles", 6))


EVENTS_SQL = V.with_views("sessions", "workout_sets", body=f"""{EVENTS}
select athlete_id, source_file, "date", sport, seconds::double AS seconds, round_even(miles, 6) miles, title from ev""")


def _totals(grain):
    return lambda spark, sf_dir: C.calendar_totals(_events(spark, sf_dir), grain)


def _totals_sql(grain):
    labels = """case sport when 'cycling' then 'Cycling' when 'weight_lifting' then 'Lifting' when 'rock_climbing' then 'Rock Climbing'
      when 'running' then 'Running' when 'hiking' then 'Hiking' when 'alpine_skiing' then 'Skiing' when 'generic' then 'Other' when 'rowing' then 'Rowing' when 'swimming' then 'Swimming' else 'Racket' end"""
    return V.with_views("sessions", "workout_sets", body=f"""{EVENTS},
e as (select athlete_id, cast(date_trunc('{grain}', cast("date" as date)) as date) period_start, sport, seconds,
  cast(round_even(miles * 1e6, 0) as bigint) mi from ev)
select athlete_id, period_start, false is_total, sport, {labels} label, count(*) activities, sum(seconds)::double AS seconds,
  round_even(sum(seconds) / 3600, 1) AS hours, sum(mi)::double / 1e6 miles from e group by athlete_id, period_start, sport
union all
select athlete_id, period_start, true, null, 'All', count(*), sum(seconds), round_even(sum(seconds) / 3600, 1), sum(mi)::double / 1e6
from e group by athlete_id, period_start""")


def calendar_sleep_overlay(spark, sf_dir):
    return C.sleep_overlay(_events(spark, sf_dir), V.score_nights(spark, sf_dir))


OVERLAY_SQL = V.with_views("sessions", "workout_sets", "score_nights", body=f"""{EVENTS},
d as (select athlete_id, "date", count(*) activities from ev group by all)
select d.athlete_id, d."date", activities, score_overall,
  case when score_overall is null then 'none' when score_overall >= 80 then 'good' when score_overall >= 60 then 'fair' else 'poor' end band
from d left join score_nights s on s.athlete_id = d.athlete_id and s.calendar_date = d."date" """)


def calendar_latest_date(spark, sf_dir):
    return C.latest_event_date(_events(spark, sf_dir))


LATEST_SQL = V.with_views("sessions", "workout_sets", body=f"""{EVENTS}
select athlete_id, max("date") latest_date from ev group by all""")

QUERIES = {
    **{f"period_summary_{g}": (_period(g), _period_sql(g)) for g in ("year", "month", "week")},
    "hours_by_sport": (hours_by_sport, HOURS_SQL),
    **{f"sport_pivot_{g}": (_pivot(g), _pivot_sql(g)) for g in ("year", "month", "week")},
    "sport_pivot_listed": (_pivot("year", LISTED), _pivot_sql("year", LISTED, True)),
    "sport_chart_data": (sport_chart_data, CHART_SQL),
    "sport_total_hours": (sport_total_hours, TOTAL_SQL),
    "ytd_stats": (ytd_stats, YTD_SQL),
    "calendar_events": (calendar_events, EVENTS_SQL),
    "calendar_totals_week": (_totals("week"), _totals_sql("week")),
    "calendar_totals_month": (_totals("month"), _totals_sql("month")),
    "calendar_sleep_overlay": (calendar_sleep_overlay, OVERLAY_SQL),
    "calendar_latest_date": (calendar_latest_date, LATEST_SQL),
}
