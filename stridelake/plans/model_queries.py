"""Critical power and covariate models with the modules' default durations, fit range and peaks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import exact_sql
from ..operators import covariates as K
from ..operators import critical_power as C
from ..operators import power as P
from ..session import cut_lineage
from . import views as V
from .power_queries import LONG_POWER, ORDER, TOUR_ORDER, TOUR_POWER, curve_cte, tour_curves

PEAKS = dict(zip(K.PEAKS, ("p1", "p2", "p3"), strict=True))
TOUR_CURVE = f"{TOUR_POWER}, {curve_cte(P.CURVE_DURATIONS)}"
PEAK_CURVE = f"{TOUR_POWER}, {curve_cte(PEAKS)}"
LABELS = list(PEAKS.values())
REPLICATES = K.BOOTSTRAP

FIT = """count(*) points, regr_slope(watts, 1.0 / duration_s) w, regr_intercept(watts, 1.0 / duration_s) c,
  regr_r2(watts, 1.0 / duration_s) r2, max(watts) = min(watts) flat"""
FIT_OUT = f"""case when points >= 3 and w >= 0 then cast(round_even(round(c, 6), 0) as bigint) end cp,
  case when points >= 3 and w >= 0 then {exact_sql('round(w, 6) / 1000', 1)} end wprime_kj,
  case when points >= 3 and w >= 0 and not flat then {exact_sql('round(r2, 9)', 3)} end r2"""


def long_curves(spark, sf_dir):
    return P.mean_max_curve(V.long_rides(spark, sf_dir), P.CURVE_DURATIONS, ORDER)


def cp_fit(spark, sf_dir):
    sessions, curves = V.long_sessions(spark, sf_dir), long_curves(spark, sf_dir)
    best = P.best_curve(sessions, curves, "2024-02-01", 3)
    return C.fit(best, ["athlete_id"]).drop("cp_exact", "wprime_exact")


CP_SQL = V.with_views("long_rides", body=f"""{LONG_POWER}, {curve_cte(P.CURVE_DURATIONS)},
f as (select athlete_id, {FIT} from curve group by 1)
select athlete_id, points, {FIT_OUT} from f""")


def cp_fit_points(spark, sf_dir):
    curves = long_curves(spark, sf_dir)
    fits = C.fit(curves, ["athlete_id"])
    return C.fitted_points(curves, fits, ["athlete_id"]).withColumn("watts", F.round("watts", 6))


CP_POINTS_SQL = V.with_views("long_rides", body=f"""{LONG_POWER}, {curve_cte(P.CURVE_DURATIONS)},
f as (select athlete_id, {FIT} from curve group by 1)
select athlete_id, duration_s, round(watts, 6) watts, {exact_sql('c + w / duration_s', 1)} fitted_watts
from curve join f using (athlete_id) where points >= 3 and w >= 0""")


def _over_time(months):
    return lambda spark, sf_dir: C.over_time(V.tour_sessions(spark, sf_dir), tour_curves(spark, sf_dir), months)


def _over_time_sql(months):
    return V.with_views("tours", "tour_sessions", body=f"""{TOUR_CURVE},
ride as (select athlete_id, source_file, cast("timestamp" as date) AS day from tour_sessions),
pt as (select athlete_id, unnest(generate_series(date_trunc('month', min(day) + {30 * months}), date_trunc('month', max(day)), interval 1 month))::date "date"
  from ride group by 1 having min(day) + {30 * months} <= max(day)),
best as (select pt.athlete_id, pt."date", duration_s, max(watts) watts from pt
  join ride r on r.athlete_id = pt.athlete_id and r.day between pt."date" - {30 * months} and pt."date"
  join curve c on c.athlete_id = r.athlete_id and c.source_file = r.source_file group by 1, 2, 3),
f as (select athlete_id, "date", {FIT} from best group by 1, 2)
select athlete_id, "date", {FIT_OUT} from f where points >= 3 and w >= 0""")


def _balance(spark, sf_dir):
    models = C.ride_models(V.tour_sessions(spark, sf_dir), tour_curves(spark, sf_dir))
    return C.wprime_balance(V.tours(spark, sf_dir), models, TOUR_ORDER)


def wprime_balance(spark, sf_dir):
    out = _balance(spark, sf_dir)
    for c in ("time_min", "wprime_bal_kj", "wprime_pct"):
        out = out.withColumn(c, F.round(F.col(c) + F.lit(1e-8), 5))
    return out


BALANCE = f"""{TOUR_CURVE},
rd as (select athlete_id, source_file, cast("timestamp" as date) AS day from tour_sessions),
bw as (select r.athlete_id, r.source_file, duration_s, max(watts) watts from rd r join rd q on q.athlete_id = r.athlete_id and q.day between r.day - 90 and r.day
  join curve c on c.athlete_id = q.athlete_id and c.source_file = q.source_file group by 1, 2, 3),
f0 as (select athlete_id, source_file, {FIT} from bw group by 1, 2),
f1 as (select athlete_id, source_file, {FIT_OUT} from f0),
md as (select s.athlete_id, s.source_file, coalesce(cp, cast(trunc(threshold_power) as bigint), 250) cp, coalesce(wprime_kj, 15.0) kj
  from tour_sessions s left join f1 using (athlete_id, source_file)),
bal as (
  select o.athlete_id, o.source_file, seq, p, cp, kj, kj * 1000 b from ok o join md using (athlete_id, source_file) where seq = 0
  union all
  select o.athlete_id, o.source_file, o.seq, o.p, cp, kj, case when o.p >= cp then greatest(0, b - (o.p - cp))
    else kj * 1000 - (kj * 1000 - b) * pow(2.718281828e0, -1.0e0 / (546.0e0 * pow(2.718281828e0, -0.01e0 * (cp - o.p)) + 316.0e0)) end
  from bal join ok o on o.athlete_id = bal.athlete_id and o.source_file = bal.source_file and o.seq = bal.seq + 1)"""
BALANCE_SQL = V.with_views("tours", "tour_sessions", body=f"""{BALANCE}
select athlete_id, source_file, seq, round(seq / 60.0e0 + 1e-8, 5) time_min, p "power", round(b / 1000 + 1e-8, 5) wprime_bal_kj,
  round(b / nullif(kj * 1000, 0) * 100 + 1e-8, 5) wprime_pct, cp, kj wprime_kj from bal""").replace("with ", "with recursive ", 1)


def wprime_summary(spark, sf_dir):
    return C.wprime_summary(_balance(spark, sf_dir))


BALANCE_SUMMARY_SQL = V.with_views("tours", "tour_sessions", body=f"""{BALANCE}
select athlete_id, source_file, any_value(cp) cp, any_value(kj) wprime_kj, {exact_sql('min(b / 1000)', 1)} min_kj, any_value(kj) * 0.25 low_kj,
  count(*) filter (where b / 1000 < kj * 0.25) seconds_low from bal group by 1, 2""").replace("with ", "with recursive ", 1)


# ── covariates ───────────────────────────────────────────────────────────────

def _rides(spark, sf_dir):
    return K.ride_peaks(V.tour_sessions(spark, sf_dir), tour_curves(spark, sf_dir, list(PEAKS)), PEAKS)


def _design(spark, sf_dir):
    # one row per ride feeds the months, with and without sleep; the point-level plan runs once
    rides = cut_lineage(_rides(spark, sf_dir))
    rows = K.design(K.monthly_peaks(rides, LABELS), K.monthly_sleep(rides, V.tour_nights(spark, sf_dir)), LABELS)
    # one row per athlete and month feeds every model
    return cut_lineage(rows)


MONTHLY = f"""{PEAK_CURVE},
wide as (select athlete_id, source_file, max(watts) filter (where duration_s = 120) p1, max(watts) filter (where duration_s = 300) p2,
  max(watts) filter (where duration_s = 1200) p3 from curve group by 1, 2),
ride as (select s.athlete_id, s.source_file, cast(timezone('America/Denver', timezone('UTC', "timestamp")) as date) AS day, training_stress_score tss, p1, p2, p3
  from tour_sessions s join wide w on s.athlete_id = w.athlete_id and s.source_file = w.source_file),
mon as (select athlete_id, cast(date_trunc('month', day) as date) mo, max(p1) p1, max(p2) p2, max(p3) p3, coalesce(sum(tss), 0) / 100 tss from ride group by 1, 2),
slp as (select r.athlete_id, cast(date_trunc('month', day) as date) mo, avg(score_overall) sc from ride r
  left join tour_nights n on n.athlete_id = r.athlete_id and n.calendar_date = cast(day - 1 as varchar) group by 1, 2)"""
DESIGN = f"""{MONTHLY},
rws as (select athlete_id, 'no_sleep' variant, mo, p1, p2, p3, tss, cast(null as double) sc from mon where p1 is not null and p2 is not null and p3 is not null
  union all select m.athlete_id, 'sleep', m.mo, p1, p2, p3, tss, sc from mon m join slp using (athlete_id, mo)
  where p1 is not null and p2 is not null and p3 is not null and sc is not null),
cen as (select *, count(*) over g n, case when max(tss) over g > min(tss) over g then tss - avg(tss) over g end x1,
    case when max(sc) over g > min(sc) over g then sc - avg(sc) over g end x2 from rws window g as (partition by athlete_id, variant)),
des as (select * from cen where n >= 5 and (x1 is not null or x2 is not null)),
lng as (select athlete_id, variant, mo, n, x1 is not null h1, x2 is not null h2, coalesce(x1, 0) x1, coalesce(x2, 0) x2, dep, y from des
  unpivot (y for dep in (p1, p2, p3))),
sm as (select athlete_id, variant, dep, any_value(n) n, any_value(h1) h1, any_value(h2) h2, avg(y) b0, sum(x1 * x1) s11, sum(x1 * x2) s12, sum(x2 * x2) s22, sum(x1 * y) s1y, sum(x2 * y) s2y
  from lng group by 1, 2, 3),
co as (select *, case when h1 and h2 then (s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12) when h1 then s1y / s11 end b1,
    case when h1 and h2 then (s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12) when h2 then s2y / s22 end b2 from sm),
rs as (select l.*, b0, b1, b2, y - b0 - coalesce(b1, 0) * l.x1 - coalesce(b2, 0) * l.x2 e from lng l join co using (athlete_id, variant, dep)),
fq as (select athlete_id, variant, dep, sum(e * e) ssr, sum((y - b0) * (y - b0)) sst from rs group by 1, 2, 3)"""


def monthly_peaks(spark, sf_dir):
    out = K.monthly_peaks(_rides(spark, sf_dir), LABELS)
    for c in LABELS:
        out = out.withColumn(c, F.round(c, 6))
    return out


MONTHLY_SQL = V.with_views("tours", "tour_sessions", "tour_nights", body=f"""{MONTHLY}
select athlete_id, mo AS month, round(p1, 6) p1, round(p2, 6) p2, round(p3, 6) p3, tss tss_per_100 from mon""")


def sleep_covariate(spark, sf_dir):
    return K.monthly_sleep(_rides(spark, sf_dir), V.tour_nights(spark, sf_dir)).withColumn("sleep_score", F.round("sleep_score", 6))


SLEEP_SQL = V.with_views("tours", "tour_sessions", "tour_nights", body=f"{MONTHLY} select athlete_id, mo AS month, round(sc, 6) sleep_score from slp")


def _fits(spark, sf_dir):
    rows = _design(spark, sf_dir)
    return rows, K.fit_models(rows, LABELS)


def covariate_ols(spark, sf_dir):
    _, fits = _fits(spark, sf_dir)
    return K.model_summary(fits).drop("f_pvalue").join(
        fits.select(*K.MODEL, F.round("b0", 4).alias("const"), F.round("b1", 4).alias("tss_per_100"), F.round("b2", 4).alias("sleep_score")), K.MODEL)


OLS_SQL = V.with_views("tours", "tour_sessions", "tour_nights", body=f"""{DESIGN}
select athlete_id, variant, dep, n, round_even(1 - ssr / sst, 3) r2,
  round_even(1 - (ssr / sst) * (n - 1) / (n - (h1::int + h2::int) - 1), 3) r2_adj,
  round(b0, 4) const, round(b1, 4) tss_per_100, round(b2, 4) sleep_score
from co join fq using (athlete_id, variant, dep)""")


def covariate_hac(spark, sf_dir):
    return K.coefficients(_fits(spark, sf_dir)[1])


# meat of the sandwich as an explicit double sum over month pairs at most three apart
HAC = f"""{DESIGN},
idx as (select *, row_number() over (partition by athlete_id, variant, dep order by mo) i from rs),
meat as (select a.athlete_id, a.variant, a.dep, sum((1 - abs(a.i - b.i) / 4.0) * a.e * b.e) m00,
    sum((1 - abs(a.i - b.i) / 4.0) * a.e * b.e * a.x1 * b.x1) m11, sum((1 - abs(a.i - b.i) / 4.0) * a.e * b.e * a.x1 * b.x2) m12,
    sum((1 - abs(a.i - b.i) / 4.0) * a.e * b.e * a.x2 * b.x2) m22
  from idx a join idx b on a.athlete_id = b.athlete_id and a.variant = b.variant and a.dep = b.dep and abs(a.i - b.i) <= 3 group by 1, 2, 3),
gi as (select *, case when h1 and h2 then s22 / (s11 * s22 - s12 * s12) when h1 then 1 / s11 else 0 end g11,
    case when h1 and h2 then s11 / (s11 * s22 - s12 * s12) when h2 then 1 / s22 else 0 end g22,
    case when h1 and h2 then -s12 / (s11 * s22 - s12 * s12) else 0 end g12 from co join meat using (athlete_id, variant, dep)),
vv as (select *, m00 / n / n v0, g11 * g11 * m11 + 2 * g11 * g12 * m12 + g12 * g12 * m22 v1, g12 * g12 * m11 + 2 * g12 * g22 * m12 + g22 * g22 * m22 v2 from gi),
tm as (select athlete_id, variant, dep, 'const' term, b0 coef, sqrt(v0) se from vv
  union all select athlete_id, variant, dep, 'tss_per_100', b1, sqrt(v1) from vv where b1 is not null
  union all select athlete_id, variant, dep, 'sleep_score', b2, sqrt(v2) from vv where b2 is not null)"""
# normal tail by Simpson's rule on the density
TAIL = """greatest(0, 1 - 2 * list_sum(list_transform(range(0, 401), lambda i: (case when i = 0 or i = 400 then 1 when i % 2 = 1 then 4 else 2 end)
  * exp(-0.5 * pow(least(abs(tm.coef / tm.se), 9) * i / 400.0, 2)))) * least(abs(tm.coef / tm.se), 9) / 400.0 / 3 / sqrt(2 * pi()))"""
HAC_SQL = V.with_views("tours", "tour_sessions", "tour_nights", body=f"""{HAC}
select athlete_id, variant, dep, term, round_even(coef, 4) coef, round_even(se, 4) se, round_even({TAIL}, 4) pvalue,
  round_even(coef - 1.959963984540054e0 * se, 4) ci_low, round_even(coef + 1.959963984540054e0 * se, 4) ci_high from tm""")


def covariate_model(spark, sf_dir):
    return K.model_summary(_fits(spark, sf_dir)[1])


# F(2, m) has a closed tail; F(1, m) is a two-sided t, integrated by Simpson's rule
MODEL_SQL = V.with_views("tours", "tour_sessions", "tour_nights", body=f"""{HAC},
wd as (select *, (n - (h1::int + h2::int) - 1)::double m, g11 * g12 * m11 + (g11 * g22 + g12 * g12) * m12 + g12 * g22 * m22 v12 from vv),
ff as (select *, case when h1 and h2 then (b1 * b1 * v2 - 2 * b1 * b2 * v12 + b2 * b2 * v1) / (v1 * v2 - v12 * v12) / 2
  when h1 then b1 * b1 / v1 else b2 * b2 / v2 end f from wd),
tt as (select *, sqrt(f) t from ff),
ar as (select *, list_sum(list_transform(range(0, 4001), lambda i: (case when i = 0 or i = 4000 then 1 when i % 2 = 1 then 4 else 2 end)
  * pow(1 + pow(t * i / 4000.0, 2) / m, -(m + 1) / 2))) * t / 4000.0 / 3 area from tt)
select athlete_id, variant, dep, n, round_even(1 - ssr / sst, 3) r2, round_even(1 - (ssr / sst) * (n - 1) / m, 3) r2_adj,
  round_even(case when h1 and h2 then pow(1 + 2 * f / m, -m / 2)
    else greatest(0, 1 - 2 * area * exp(lgamma((m + 1) / 2) - lgamma(m / 2)) / sqrt(m * pi())) end, 4) f_pvalue
from ar join fq using (athlete_id, variant, dep)""")


def covariate_correlation(spark, sf_dir):
    return K.correlations(_design(spark, sf_dir), LABELS)


CORRELATION_SQL = V.with_views("tours", "tour_sessions", "tour_nights", body=f"""{DESIGN},
cols as (select athlete_id, variant, mo, unnest([struct_pack(c := 'p1', v := p1), struct_pack(c := 'p2', v := p2), struct_pack(c := 'p3', v := p3),
  struct_pack(c := 'tss_per_100', v := x1), struct_pack(c := 'sleep_score', v := x2)], recursive := true) from des)
select a.athlete_id, a.variant, a.c a, b.c b, case when max(a.v) > min(a.v) and max(b.v) > min(b.v) then round_even(corr(a.v, b.v), 3) end r
from cols a join cols b on a.athlete_id = b.athlete_id and a.variant = b.variant and a.mo = b.mo
where a.v is not null and b.v is not null group by 1, 2, 3, 4""")


def _boot(spark, sf_dir):
    rows, fits = _fits(spark, sf_dir)
    return K.bootstrap(rows, LABELS, fits, REPLICATES)


def covariate_bootstrap(spark, sf_dir):
    return _boot(spark, sf_dir)


BOOT = f"""{HAC},
num as (select *, row_number() over (partition by athlete_id, variant order by mo) - 1 i from des),
drw as (select g.athlete_id, g.variant, b, xor(x2, x2 >> 16) % n i from (
  select *, (xor(x1, x1 >> 16) * 73244475) % 4294967296 x2 from (
    select *, (xor(x0, x0 >> 16) * 73244475) % 4294967296 x1 from (
      select *, (b * 7919 + j * 104729 + 650406246) % 4294967296 x0 from (
        select s.athlete_id, s.variant, s.n, b.b, unnest(range(0, s.n)) j
        from (select athlete_id, variant, any_value(n) n from des group by 1, 2) s cross join range(0, {REPLICATES}) b(b))))) g),
smp as (select d.athlete_id, d.variant, d.b, x1, x2, dep, y from drw d
  join (select * from num unpivot (y for dep in (p1, p2, p3))) m on m.athlete_id = d.athlete_id and m.variant = d.variant and m.i = d.i),
gr as (select athlete_id, variant, dep, b, bool_or(x1 is not null) h1, bool_or(x2 is not null) h2, avg(coalesce(x1, 0)) a1, avg(coalesce(x2, 0)) a2, avg(y) ay,
    coalesce(sum(x1 * x1), 0) q1, coalesce(sum(x2 * x2), 0) q2,
    count(*) * var_pop(coalesce(x1, 0)) s11, count(*) * var_pop(coalesce(x2, 0)) s22, count(*) * covar_pop(coalesce(x1, 0), coalesce(x2, 0)) s12,
    count(*) * covar_pop(coalesce(x1, 0), y) s1y, count(*) * covar_pop(coalesce(x2, 0), y) s2y from smp group by 1, 2, 3, 4),
sz as (select *, case when s11 > 1e-9 * q1 then s11 else 0 end z11, case when s22 > 1e-9 * q2 then s22 else 0 end z22 from gr),
rk as (select *, z11 > 0 and z22 > 0 and z11 * z22 - s12 * s12 > 1e-12 * z11 * z22 flat, z11 + z22 > 0 line,
    case when z11 >= z22 then z11 else s12 end u1, case when z11 >= z22 then s12 else z22 end u2 from sz),
dr as (select *, case when line then u1 / sqrt(u1 * u1 + u2 * u2) else 0 end d1, case when line then u2 / sqrt(u1 * u1 + u2 * u2) else 0 end d2 from rk),
al as (select *, case when line then (d1 * s1y + d2 * s2y) / (z11 + z22) else 0 end t, a1 * d1 + a2 * d2 o, 1 + a1 * a1 + a2 * a2 m from dr),
kk as (select *, (ay - o * t) / (m - o * o) k1, case when line then (m * t - o * ay) / (m - o * o) else 0 end k2 from al),
sl as (select *, case when flat then (s1y * z22 - s2y * s12) / (z11 * z22 - s12 * s12) else k1 * a1 + k2 * d1 end c1,
    case when flat then (s2y * z11 - s1y * s12) / (z11 * z22 - s12 * s12) else k1 * a2 + k2 * d2 end c2 from kk),
cf as (select athlete_id, variant, dep, 'const' term, round(case when flat then ay - c1 * a1 - c2 * a2 else k1 end, 9) v from sl
  union all select athlete_id, variant, dep, 'tss_per_100', round(c1, 9) from sl where h1
  union all select athlete_id, variant, dep, 'sleep_score', round(c2, 9) from sl where h2),
bt as (select c.athlete_id, c.variant, c.dep, c.term, count(*) n_bootstrap, round_even(quantile_cont(v, 0.5), 4) coef_median, round_even(avg(v), 4) coef_mean,
    round_even(least(2 * avg(case when any_coef >= 0 then (v <= 0)::int else (v >= 0)::int end), 1), 4) pvalue_boot,
    round_even(quantile_cont(v, 0.025), 4) boot_low, round_even(quantile_cont(v, 0.975), 4) boot_high
  from cf c join (select athlete_id, variant, dep, term, coef any_coef from tm) t using (athlete_id, variant, dep, term) group by 1, 2, 3, 4)"""
BOOT_SQL = V.with_views("tours", "tour_sessions", "tour_nights", body=f"{BOOT} select * from bt")


def covariate_report(spark, sf_dir):
    rows, fits = _fits(spark, sf_dir)
    return K.report(K.coefficients(fits), K.bootstrap(rows, LABELS, fits, REPLICATES))


REPORT_SQL = V.with_views("tours", "tour_sessions", "tour_nights", body=f"""{BOOT},
an as (select athlete_id, variant, dep, term, round_even(coef, 4) coef, round_even({TAIL}, 4) pvalue,
  round_even(coef - 1.959963984540054e0 * se, 4) lo, round_even(coef + 1.959963984540054e0 * se, 4) hi from tm)
select athlete_id, variant, dep, term, coef, coef_median, coef_mean, pvalue, pvalue_boot, coalesce(boot_low, lo) ci_low, coalesce(boot_high, hi) ci_high,
  case when boot_low is not null then 'bootstrap' else 'robust' end ci_method,
  not (coalesce(boot_low, lo) <= 0 and coalesce(boot_high, hi) >= 0) significant, n_bootstrap
from an left join bt using (athlete_id, variant, dep, term)""")

QUERIES = {
    "cp_fit": (cp_fit, CP_SQL),
    "cp_fit_points": (cp_fit_points, CP_POINTS_SQL),
    "cp_over_time": (_over_time(6), _over_time_sql(6)),
    **{f"cp_over_time_{m}": (_over_time(m), _over_time_sql(m)) for m in (3, 9, 12)},
    "wprime_balance": (wprime_balance, BALANCE_SQL),
    "wprime_balance_small_chunks": (V.small_chunks(wprime_balance), BALANCE_SQL),
    "wprime_summary": (wprime_summary, BALANCE_SUMMARY_SQL),
    "monthly_peaks": (monthly_peaks, MONTHLY_SQL),
    "sleep_covariate": (sleep_covariate, SLEEP_SQL),
    "covariate_ols": (covariate_ols, OLS_SQL),
    "covariate_hac": (covariate_hac, HAC_SQL),
    "covariate_model": (covariate_model, MODEL_SQL),
    "covariate_correlation": (covariate_correlation, CORRELATION_SQL),
    "covariate_bootstrap": (covariate_bootstrap, BOOT_SQL),
    "covariate_report": (covariate_report, REPORT_SQL),
}
