"""Per-second power with the module's default durations, over long rides and over stages of several years."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import exact_sql
from ..operators import power as P
from . import views as V

ORDER = ["timestamp", "event_id"]
PEAKS, SPARSE, DENSE = P.PEAK_DURATIONS, P.CHART_DURATIONS, P.CURVE_DURATIONS
TOUR_DAY = "2016-06-15"

POWER = """pw as (
  select athlete_id, source_file, "timestamp", event_id, row_number() over w - 1 seq,
    cast(trunc(coalesce(power, (lag(power, 1) over w + lag(power, 2) over w) / 2, 0)) as bigint) p,
    count(power) over (partition by athlete_id, source_file) np
  from telemetry window w as (partition by athlete_id, source_file order by "timestamp", event_id)),
ok as (select * from pw where np > 0)"""
LONG_POWER = POWER.replace("from telemetry", "from long_rides")


def curve_cte(durations, name="curve", source="ok"):
    values = ", ".join(f"({d})" for d in durations)
    return f"""
{name}_sum as (select athlete_id, source_file, seq, sum(p) over (partition by athlete_id, source_file order by seq) c from {source}),
{name} as (select a.athlete_id, a.source_file, cast(d.d as int) duration_s, cast(max(a.c - coalesce(b.c, 0)) as double) / d.d watts
  from {name}_sum a join (values {values}) d(d) on a.seq >= d.d - 1
  left join {name}_sum b on a.athlete_id = b.athlete_id and a.source_file = b.source_file and b.seq = a.seq - d.d
  group by a.athlete_id, a.source_file, d.d)"""


TOUR_ORDER = ["timestamp", "point_id"]
TOUR_POWER = POWER.replace("from telemetry", "from tours").replace("event_id", "point_id")


def tour_curves(spark, sf_dir, durations=DENSE):
    return P.mean_max_curve(V.tours(spark, sf_dir), durations, TOUR_ORDER)


def power_repair(spark, sf_dir):
    return P.power_series(V.telemetry(spark, sf_dir), ORDER)


REPAIR_SQL = V.with_views("telemetry", body=f'{POWER} select athlete_id, source_file, "timestamp", event_id, seq, p power from ok')


def power_repair_long(spark, sf_dir):
    return P.power_series(V.long_rides(spark, sf_dir), ORDER)


REPAIR_LONG_SQL = V.with_views("long_rides", body=f'{LONG_POWER} select athlete_id, source_file, "timestamp", event_id, seq, p power from ok')


def peak_powers(spark, sf_dir):
    return P.peak_powers(V.long_rides(spark, sf_dir), PEAKS, ORDER)


PEAK_SQL = V.with_views("long_rides", body=f"""{LONG_POWER}, {curve_cte(PEAKS)},
rides as (select distinct athlete_id, source_file from ok),
names as (select * from (values {", ".join(f"({d}, '{n}')" for d, n in PEAKS.items())}) n(d, label))
select r.athlete_id, r.source_file, cast(d as int) duration_s, label duration, cast(round_even(watts, 0) as bigint) watts
from rides r cross join names left join curve c on r.athlete_id = c.athlete_id and r.source_file = c.source_file and c.duration_s = d""")


def power_curve_sparse(spark, sf_dir):
    return P.chart_curve(V.long_rides(spark, sf_dir), SPARSE, ORDER)


SPARSE_SQL = V.with_views("long_rides", body=f"""{LONG_POWER}, {curve_cte(SPARSE)}
select athlete_id, source_file, duration_s, cast(round_even(watts, 0) as bigint) watts from curve""")


def power_curve_dense(spark, sf_dir):
    return P.mean_max_curve(V.long_rides(spark, sf_dir), DENSE, ORDER).withColumn("watts", F.round("watts", 6))


DENSE_SQL = V.with_views("long_rides", body=f"""{LONG_POWER}, {curve_cte(DENSE)}
select athlete_id, source_file, duration_s, round(watts, 6) watts from curve""")


def best_curve_period(spark, sf_dir):
    return P.best_curve(V.tour_sessions(spark, sf_dir), tour_curves(spark, sf_dir), TOUR_DAY, 12).withColumn("watts", F.round("watts", 6))


def _best_sql(durations):
    return V.with_views("tours", "tour_sessions", body=f"""{TOUR_POWER}, {curve_cte(durations)}
select c.athlete_id, duration_s, round(max(watts), 6) watts from curve c join tour_sessions s on c.athlete_id = s.athlete_id and c.source_file = s.source_file
where cast(s."timestamp" as date) between date '{TOUR_DAY}' - 360 and date '{TOUR_DAY}' group by 1, 2""")


def best_curve_chart(spark, sf_dir):
    return P.best_chart_curve(V.tour_sessions(spark, sf_dir), tour_curves(spark, sf_dir), V.tours(spark, sf_dir), TOUR_DAY, 12,
                              order=TOUR_ORDER).withColumn("watts", F.round("watts", 6))


def power_curve_incremental(spark, sf_dir):
    points = V.tours(spark, sf_dir)
    stored = P.mean_max_curve(points.filter("timestamp < timestamp '2015-06-01'"), DENSE, TOUR_ORDER)
    return P.extend_curves(V.tour_sessions(spark, sf_dir), points, stored, DENSE, TOUR_ORDER).withColumn("watts", F.round("watts", 6))


INCREMENTAL_SQL = V.with_views("tours", body=f"""{TOUR_POWER}, {curve_cte(DENSE)},
have as (select source_file from tours where "timestamp" < timestamp '2015-06-01' group by 1 having count(power) > 0)
select athlete_id, source_file, duration_s, round(watts, 6) watts from curve where source_file not in (select source_file from have)""")

ZONE = """case when {0} < 0.55 then 1 when {0} < 0.75 then 2 when {0} < 0.90 then 3 when {0} < 1.05 then 4
  when {0} < 1.20 then 5 when {0} < 1.50 then 6 else 7 end"""
FTP = "coalesce(nullif(s.threshold_power, 0), 250)"


def power_histogram(spark, sf_dir):
    return P.power_histogram(V.telemetry(spark, sf_dir), V.ride_sessions(spark, sf_dir), 25, ORDER)


HISTOGRAM_SQL = V.with_views("telemetry", "ride_sessions", body=f"""{POWER},
top as (select athlete_id, source_file, max(p) top from ok group by all),
bins as (select athlete_id, source_file, unnest(range(0, top + 25, 25)) bin from top),
cnt as (select athlete_id, source_file, p // 25 * 25 bin, count(*) n from ok group by all)
select b.athlete_id, b.source_file, b.bin, coalesce(n, 0) AS seconds, {ZONE.format(f'((b.bin + 12.5) / {FTP})')} "zone"
from bins b left join cnt c on b.athlete_id = c.athlete_id and b.source_file = c.source_file and b.bin = c.bin
left join ride_sessions s on b.athlete_id = s.athlete_id and b.source_file = s.source_file""")


def power_zones(spark, sf_dir):
    return P.time_in_zones(V.telemetry(spark, sf_dir), V.ride_sessions(spark, sf_dir), ORDER)


ZONES_SQL = V.with_views("telemetry", "ride_sessions", body=f"""{POWER},
z as (select o.athlete_id, o.source_file, {FTP} ftp, {ZONE.format(f'(p / {FTP})')} z from ok o
  left join ride_sessions s on o.athlete_id = s.athlete_id and o.source_file = s.source_file),
names as (select * from (values {", ".join(f"({i}, '{n}')" for i, (n, _, _) in enumerate(P.POWER_ZONES, 1))}) n(i, zone_name))
select athlete_id, source_file, ftp, cast(i as int) "zone", zone_name, count(*) filter (where z = i) AS seconds,
  {exact_sql('count(*) filter (where z = i) / count(*) * 100', 1)} pct
from z cross join names group by athlete_id, source_file, ftp, i, zone_name""")

QUERIES = {
    "power_repair": (power_repair, REPAIR_SQL),
    "power_repair_small_chunks": (V.small_chunks(power_repair), REPAIR_SQL),
    "power_repair_long": (power_repair_long, REPAIR_LONG_SQL),
    "peak_powers": (peak_powers, PEAK_SQL),
    "power_curve_sparse": (power_curve_sparse, SPARSE_SQL),
    "power_curve_dense": (power_curve_dense, DENSE_SQL),
    "best_curve_period": (best_curve_period, _best_sql(DENSE)),
    "best_curve_chart": (best_curve_chart, _best_sql(SPARSE)),
    "power_curve_incremental": (power_curve_incremental, INCREMENTAL_SQL),
    "power_histogram": (power_histogram, HISTOGRAM_SQL),
    "power_zones": (power_zones, ZONES_SQL),
}
