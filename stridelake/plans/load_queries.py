"""Training load over all cycling sessions."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import functions as F

from ..operators import load as L
from ..sources import tables as R
from . import views as V


def _days(spark, sf_dir):
    return L.training_days(R.load_sessions(V.sessions(spark, sf_dir), "cycling"))


NUDGE = "1e-9"  # decays of 3/4 land on exact decimal ties; move off them before rounding


def _rounded(df, *columns):
    for c in columns:
        df = df.withColumn(c, F.round(F.col(c) + F.lit(float(NUDGE)), 6))
    return df


def raw_overrides(spark, sf_dir):
    return V.table(spark, sf_dir, "customer").selectExpr(
        "cast(cast(floor(c_custkey / 20) as bigint) as string) AS athlete_id", "c_custkey AS seq",
        f"case when c_custkey % 11 = 0 then '' else cast(cast(date '{V.AS_OF}' + cast(c_custkey % 25 as int) as date) as string) end AS date",
        "case when c_custkey % 13 = 0 then 'abc' when c_custkey % 17 = 0 then ' ' else cast(c_acctbal / 16 as string) end AS tss",
    )


def overrides(spark, sf_dir):
    return L.valid_overrides(L.parse_overrides(raw_overrides(spark, sf_dir)), V.AS_OF)


DAYS = """act as (
  select athlete_id, cast(timezone('America/Denver', timezone('UTC', "timestamp")) as date) AS day,
    coalesce(sum(coalesce(training_stress_score, total_timer_time * normalized_power * intensity_factor / (nullif(threshold_power, 0) * 3600) * 100)), 0) tss
  from sessions where sport = 'cycling' group by 1, 2)"""
SPINE = f"""{DAYS},
spine as (select athlete_id, cast(unnest(generate_series(min(day), date '{V.AS_OF}' + 60, interval 1 day)) as date) AS day from act group by 1),
dense as (select s.athlete_id, s.day, coalesce(a.tss, 0) tss, s.day > date '{V.AS_OF}' is_projection
  from spine s left join act a on s.athlete_id = a.athlete_id and s.day = a.day)"""
OVERRIDES = f"""ov as (
  select athlete_id, day, least(greatest(arg_max(v, seq), 0), 500) tss from (
    select cast(c_custkey // 20 as varchar) athlete_id, c_custkey seq, date '{V.AS_OF}' + cast(c_custkey % 25 as int) AS day, c_acctbal / 16 v
    from customer where c_custkey % 11 <> 0 and c_custkey % 13 <> 0 and c_custkey % 17 <> 0)
  where day between date '{V.AS_OF}' + 1 and date '{V.AS_OF}' + 21 group by 1, 2)"""


def _ewma(source, value, prefix=""):
    return f"""
select d.athlete_id, d.day, sum(2.0 / 43 * a.{value} * pow(41.0 / 43, d.day - a.day)) ctl, sum(2.0 / 8 * a.{value} * pow(6.0 / 8, d.day - a.day)) atl
from {source} d left join {source} a on d.athlete_id = a.athlete_id and a.day <= d.day and a.{value} <> 0 group by 1, 2"""


LOAD = f"""{SPINE}, ew as ({_ewma('dense', 'tss')}),
ld as (select d.*, coalesce(ctl, 0) ctl, coalesce(atl, 0) atl, coalesce(ctl, 0) - coalesce(atl, 0) tsb from dense d join ew using (athlete_id, day))"""
FORECAST = f"""{OVERRIDES},
av as (select athlete_id, avg(tss) m from (select *, row_number() over (partition by athlete_id order by day desc) r from dense where not is_projection) where r <= 42 group by 1),
fc as (select d.athlete_id, d.day, case when is_projection then coalesce(o.tss, m, 0) else d.tss end f, is_projection
  from dense d left join av using (athlete_id) left join ov o on d.athlete_id = o.athlete_id and d.day = o.day),
few as ({_ewma('fc', 'f')}),
fl as (select f.*, coalesce(ctl, 0) ctl, coalesce(atl, 0) atl, coalesce(ctl, 0) - coalesce(atl, 0) tsb from fc f join few using (athlete_id, day))"""


def daily_tss(spark, sf_dir):
    return _rounded(L.daily_tss(_days(spark, sf_dir), V.AS_OF), "tss")


DAILY_SQL = V.with_views("sessions", body=f'{SPINE} select athlete_id, day "date", round(tss + 1e-9, 6) tss, is_projection from dense')


def ctl_atl_tsb(spark, sf_dir):
    return _rounded(L.training_load(_days(spark, sf_dir), V.AS_OF), "tss", "ctl", "atl", "tsb")


LOAD_SQL = V.with_views("sessions", body=f"""{LOAD}
select athlete_id, day "date", round(tss + 1e-9, 6) tss, is_projection, round(ctl + 1e-9, 6) ctl, round(atl + 1e-9, 6) atl, round(tsb + 1e-9, 6) tsb from ld""")


def tss_overrides(spark, sf_dir):
    return overrides(spark, sf_dir)


OVERRIDES_SQL = f'with {OVERRIDES} select athlete_id, day "date", tss from ov'


def training_forecast(spark, sf_dir):
    found = L.forecast(_days(spark, sf_dir), V.AS_OF, overrides(spark, sf_dir))
    return _rounded(found, "tss_forecast", "ctl_forecast", "atl_forecast", "tsb_forecast")


FORECAST_SQL = V.with_views("sessions", body=f"""{SPINE}, {FORECAST}
select athlete_id, day "date", round(f + 1e-9, 6) tss_forecast, is_projection, round(ctl + 1e-9, 6) ctl_forecast, round(atl + 1e-9, 6) atl_forecast, round(tsb + 1e-9, 6) tsb_forecast from fl""")


def load_comparison(spark, sf_dir):
    days = _days(spark, sf_dir)
    found = L.load_comparison(L.training_load(days, V.AS_OF, since=V.AS_OF), L.forecast(days, V.AS_OF, overrides(spark, sf_dir)), V.AS_OF)
    return _rounded(found, "current", "forecast", "delta")


COMPARISON_SQL = V.with_views("sessions", body=f"""{LOAD}, {FORECAST},
n as (select athlete_id, ctl, atl, tsb from ld where day = date '{V.AS_OF}'),
t as (select athlete_id, ctl, atl, tsb from fl where day = date '{V.AS_OF}' + 21),
m as (select a.athlete_id, k.metric, case k.metric when 'ctl' then n.ctl when 'atl' then n.atl else n.tsb end c,
    case k.metric when 'ctl' then t.ctl when 'atl' then t.atl else t.tsb end f
  from (select distinct athlete_id from dense) a cross join (values ('ctl'), ('atl'), ('tsb')) k(metric)
  left join n on a.athlete_id = n.athlete_id left join t on a.athlete_id = t.athlete_id)
select athlete_id, metric, round(c + 1e-9, 6) "current", round(f + 1e-9, 6) forecast, round(f - c + 1e-9, 6) delta,
  case when f - c > 0.05 then '↑' when f - c < -0.05 then '↓' when f - c is null then '--' else '→' end direction from m""")


def load_window(spark, sf_dir):
    load = L.training_load(_days(spark, sf_dir), V.AS_OF, since=L.window_start(V.AS_OF, 6))
    return _rounded(L.display_window(load, V.AS_OF, 6), "tss", "ctl", "atl", "tsb")


WINDOW_SQL = V.with_views("sessions", body=f"""{LOAD}
select athlete_id, day "date", round(tss + 1e-9, 6) tss, is_projection, round(ctl + 1e-9, 6) ctl, round(atl + 1e-9, 6) atl, round(tsb + 1e-9, 6) tsb from ld
where day >= date_trunc('month', date '{V.AS_OF}') - interval 180 day""")


def load_last_days(spark, sf_dir):
    load = L.training_load(_days(spark, sf_dir), V.AS_OF, since=date.fromisoformat(V.AS_OF) - timedelta(days=42))
    return _rounded(L.latest_days(load, 42).select("athlete_id", "date", "tss", "ctl"), "tss", "ctl")


LAST_SQL = V.with_views("sessions", body=f"""{LOAD}
select athlete_id, day "date", round(tss + 1e-9, 6) tss, round(ctl + 1e-9, 6) ctl
from ld where not is_projection qualify row_number() over (partition by athlete_id order by day desc) <= 42""")

QUERIES = {
    "daily_tss": (daily_tss, DAILY_SQL),
    "ctl_atl_tsb": (ctl_atl_tsb, LOAD_SQL),
    "tss_overrides": (tss_overrides, OVERRIDES_SQL),
    "training_forecast": (training_forecast, FORECAST_SQL),
    "load_comparison": (load_comparison, COMPARISON_SQL),
    "load_window": (load_window, WINDOW_SQL),
    "load_last_days": (load_last_days, LAST_SQL),
}
