"""Route analytics over the telemetry view."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import exact_sql
from ..operators import route as O
from . import views as V

ORDER = ["timestamp", "event_id"]
SIX = 6


def _rounded(df, *columns):
    for c in columns:
        df = df.withColumn(c, F.round(c, SIX))
    return df


DEG = "180.0e0 / 2147483648.0e0"
ROUTE = f"""route as (
  select athlete_id, source_file, row_number() over (partition by athlete_id, source_file order by "timestamp", event_id) - 1 seq,
    position_lat * ({DEG}) lat, position_long * ({DEG}) lon, coalesce(power, 0) power, enhanced_altitude elevation_m,
    enhanced_altitude * 3.28084e0 elevation_ft, enhanced_speed * 2.23694e0 speed_mph, heart_rate
  from telemetry where position_lat is not null)"""


def route_points(spark, sf_dir):
    return _rounded(O.route_points(V.telemetry(spark, sf_dir), ORDER), "lat", "lon", "elevation_ft", "speed_mph")


POINTS_SQL = V.with_views("telemetry", body=f"""{ROUTE}
select athlete_id, source_file, seq, round(lat, 6) lat, round(lon, 6) lon, power, elevation_m, round(elevation_ft, 6) elevation_ft,
  round(speed_mph, 6) speed_mph, heart_rate from route""")


def route_center(spark, sf_dir):
    found = O.route_centre(O.route_points(V.telemetry(spark, sf_dir), ORDER))
    return _rounded(found, "centre_lat", "centre_lon", "start_lat", "start_lon", "end_lat", "end_lon")


CENTER_SQL = V.with_views("telemetry", body=f"""{ROUTE}
select athlete_id, source_file, round(avg(lat), 6) centre_lat, round(avg(lon), 6) centre_lon,
  round(arg_min(lat, seq), 6) start_lat, round(arg_min(lon, seq), 6) start_lon, round(arg_max(lat, seq), 6) end_lat, round(arg_max(lon, seq), 6) end_lon,
  count(*) points from route group by 1, 2""")

PROFILE = """filled as (
  select athlete_id, source_file, "timestamp", event_id, power, cadence,
    last_value(distance ignore nulls) over w d, last_value(enhanced_altitude ignore nulls) over w a
  from telemetry window w as (partition by athlete_id, source_file order by "timestamp", event_id rows unbounded preceding)),
kept as (select *, row_number() over (partition by athlete_id, source_file order by "timestamp", event_id) - 1 seq,
    count(*) over (partition by athlete_id, source_file) n from filled where d is not null and a is not null),
graded as (select *, case when d - lag(d) over w > 0 then (a - lag(a) over w) / (d - lag(d) over w) * 100 else 0 end g
  from kept where n >= 2 window w as (partition by athlete_id, source_file order by seq)),
prof as (select *, avg(g) over (partition by athlete_id, source_file order by seq rows 19 preceding) g20,
    avg(g) over (partition by athlete_id, source_file order by seq rows 4 preceding) g5 from graded)"""


def elevation_profile(spark, sf_dir):
    return _rounded(O.elevation_profile(V.telemetry(spark, sf_dir), ORDER),
                    "distance_mi", "altitude_ft", "grade_pct", "grade_instant")


PROFILE_SQL = V.with_views("telemetry", body=f"""{PROFILE}
select athlete_id, source_file, seq, round(d / 1609.344e0, 6) distance_mi, round(a * 3.28084e0, 6) altitude_ft, round(g20, 6) grade_pct,
  round(g5, 6) grade_instant, round_even(g5 - g20, 1) grade_delta from prof""")


def route_grade(spark, sf_dir):
    records = V.telemetry(spark, sf_dir)
    joined = O.graded_route(O.route_points(records, ORDER), O.elevation_profile(records, ORDER))
    return _rounded(joined.select("athlete_id", "source_file", "seq", "lat", "lon", "grade_pct"), "lat", "lon", "grade_pct")


GRADE_SQL = V.with_views("telemetry", body=f"""{ROUTE}, {PROFILE}
select r.athlete_id, r.source_file, r.seq, round(lat, 6) lat, round(lon, 6) lon, round(coalesce(g20, 0), 6) grade_pct
from route r left join prof p on r.athlete_id = p.athlete_id and r.source_file = p.source_file and r.seq = p.seq""")

SEGMENTS = f"""{PROFILE},
isl as (select *, sum(case when g20 >= 3 and coalesce(pg, 0) < 3 then 1 else 0 end) over (partition by athlete_id, source_file order by seq) island
  from (select *, lag(g20) over (partition by athlete_id, source_file order by seq) pg from prof)),
seg as (select athlete_id, source_file, island - 1 segment, min(seq) start_seq, max(seq) end_seq, arg_min(d, seq) start_m, arg_max(d, seq) end_m,
    arg_min(a, seq) start_alt_m, arg_max(a, seq) end_alt_m, min("timestamp") start_ts, max("timestamp") end_ts
  from isl where g20 >= 3 group by athlete_id, source_file, island)"""


def climb_segments(spark, sf_dir):
    return O.climb_segments(V.telemetry(spark, sf_dir), ORDER)


SEGMENTS_SQL = V.with_views("telemetry", body=f"""{SEGMENTS}
select athlete_id, source_file, cast(segment as bigint) segment, start_seq, end_seq, start_m, end_m, start_alt_m, end_alt_m, start_ts, end_ts from seg""")

# fold: walk the segments in order, carrying the start of the current merged climb
MERGED = f"""{SEGMENTS},
walk as (
  select athlete_id, source_file, segment, start_seq head, start_m head_m, start_alt_m head_alt, end_m, end_alt_m from seg where segment = 0
  union all
  select s.athlete_id, s.source_file, s.segment,
    case when joins then w.head else s.start_seq end, case when joins then w.head_m else s.start_m end,
    case when joins then w.head_alt else s.start_alt_m end, s.end_m, s.end_alt_m
  from walk w join seg s on w.athlete_id = s.athlete_id and w.source_file = s.source_file and s.segment = w.segment + 1,
  lateral (select s.start_m - w.end_m < 1609 and (w.end_alt_m - w.head_alt <= 0 or w.end_alt_m - s.start_alt_m < (w.end_alt_m - w.head_alt) * 0.3e0) joins)),
mrg as (select w.athlete_id, w.source_file, head start_seq, max(s.end_seq) end_seq, any_value(head_m) start_m, arg_max(s.end_m, s.segment) end_m,
    any_value(head_alt) start_alt_m, arg_max(s.end_alt_m, s.segment) end_alt_m, arg_max(s.end_ts, s.segment) end_ts
  from walk w join seg s on w.athlete_id = s.athlete_id and w.source_file = s.source_file and w.segment = s.segment group by 1, 2, 3),
big as (select m.*, s.start_ts, row_number() over (partition by m.athlete_id, m.source_file order by m.start_seq) climb_no
  from mrg m join seg s on m.athlete_id = s.athlete_id and m.source_file = s.source_file and m.start_seq = s.start_seq
  where m.end_m - m.start_m >= 400 and m.end_alt_m - m.start_alt_m >= 30),
pts as (select b.athlete_id, b.source_file, b.climb_no, b.start_seq, p.seq, g5, cast(trunc(coalesce(power, 0)) as bigint) p, cast(trunc(coalesce(cadence, 0)) as bigint) cad
  from big b join prof p on b.athlete_id = p.athlete_id and b.source_file = p.source_file and p.seq between b.start_seq and b.end_seq),
roll as (select *, avg(p) over (partition by athlete_id, source_file, climb_no order by seq rows 29 preceding) p30 from pts),
stat as (select athlete_id, source_file, climb_no, max(g5) mg, cast(round_even(avg(p) filter (where p > 0), 0) as bigint) ap,
    cast(round_even(pow(avg(pow(p30, 4)) filter (where seq - start_seq >= 29), 0.25e0), 0) as bigint) np,
    cast(round_even(avg(cad) filter (where cad > 0), 0) as bigint) ac from roll group by 1, 2, 3),
climb as (select b.*, mg, ap, case when ap is not null then np end np, ac from big b join stat using (athlete_id, source_file, climb_no))"""


def merged_climbs(spark, sf_dir):
    return O.climbs(V.telemetry(spark, sf_dir), ORDER)


CLIMBS_SQL = V.with_views("telemetry", body=f"""{MERGED}
select athlete_id, source_file, climb_no, start_seq, end_seq, {exact_sql('start_m / 1609.344e0', 2)} start_mi, {exact_sql('end_m / 1609.344e0', 2)} end_mi,
  {exact_sql('(end_m - start_m) / 1609.344e0', 2)} distance_mi, cast(round_even((end_alt_m - start_alt_m) * 3.28084e0, 0) as bigint) elevation_gain_ft,
  {exact_sql('(end_alt_m - start_alt_m) / (end_m - start_m) * 100', 1)} avg_grade, {exact_sql('mg', 1)} max_grade,
  cast(floor(epoch_us(end_ts) / 1e6 - epoch_us(start_ts) / 1e6) as bigint) duration_s,
  cast(round_even((end_alt_m - start_alt_m) / ((epoch_us(end_ts) - epoch_us(start_ts)) / 1e6 / 3600), 0) as bigint) vam,
  ap avg_power, np normalized_power, ac avg_cadence from climb""").replace("with ", "with recursive ", 1)


def climb_route_points(spark, sf_dir):
    records = V.telemetry(spark, sf_dir)
    found = O.climb_route_points(O.climbs(records, ORDER), O.elevation_profile(records, ORDER), O.route_points(records, ORDER))
    return _rounded(found, "lat", "lon")


CLIMB_POINTS_SQL = V.with_views("telemetry", body=f"""{ROUTE}, {MERGED},
mk as (select athlete_id, source_file, climb_no, 'start' mark, {exact_sql('start_m / 1609.344e0', 2)} at_mi from climb
  union all select athlete_id, source_file, climb_no, 'end', {exact_sql('end_m / 1609.344e0', 2)} from climb),
near as (select k.athlete_id, k.source_file, climb_no, mark, at_mi, p.seq,
    row_number() over (partition by k.athlete_id, k.source_file, climb_no, mark order by abs(d / 1609.344e0 - at_mi), p.seq) r
  from mk k join prof p on k.athlete_id = p.athlete_id and k.source_file = p.source_file)
select n.athlete_id, n.source_file, climb_no, mark, at_mi, n.seq, round(lat, 6) lat, round(lon, 6) lon
from near n left join route r on n.athlete_id = r.athlete_id and n.source_file = r.source_file and n.seq = r.seq where n.r = 1""").replace("with ", "with recursive ", 1)

QUERIES = {
    "route_points": (route_points, POINTS_SQL),
    "route_center": (route_center, CENTER_SQL),
    "elevation_profile": (elevation_profile, PROFILE_SQL),
    "elevation_profile_small_chunks": (V.small_chunks(elevation_profile), PROFILE_SQL),
    "route_grade": (route_grade, GRADE_SQL),
    "climb_segments": (climb_segments, SEGMENTS_SQL),
    "climbs": (merged_climbs, CLIMBS_SQL),
    "climbs_small_chunks": (V.small_chunks(merged_climbs), CLIMBS_SQL),
    "climb_route_points": (climb_route_points, CLIMB_POINTS_SQL),
}
