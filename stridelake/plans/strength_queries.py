"""Strength log."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.parsing import expand_sets
from ..operators import strength as O
from . import views as V

SETS = """ex as (select distinct athlete_id, log_seq, name from workout_sets),
px as (select *, row_number() over (partition by athlete_id, log_seq order by name) - 1 ex_pos from ex),
st as (select s.*, ex_pos, row_number() over (partition by s.athlete_id, s.log_seq, s.name order by "set", weight, reps) - 1 set_pos,
    coalesce(body_weight, 133) bw from workout_sets s join px using (athlete_id, log_seq, name)),
ef as (select *, case when weight = 0 then bw when name in ('pull_ups', 'dips') then bw + weight else weight end lifted from st)"""


def _log(spark, sf_dir):
    return V.workouts(spark, sf_dir)


def exercise_names(spark, sf_dir):
    return O.exercise_names(_log(spark, sf_dir))


NAMES_SQL = V.with_views("workout_sets", body="""select distinct athlete_id, name,
  case name when 'bench_press' then 'Bench Press' when 'pull_ups' then 'Pull Ups' when 'squat' then 'Squat' when 'dips' then 'Dips' when 'deadlift' then 'Deadlift' else 'Row' end label
from workout_sets""")


def session_volume(spark, sf_dir):
    return O.session_volume(_log(spark, sf_dir))


VOLUME_SQL = V.with_views("workout_sets", body=f"""{SETS} select athlete_id, log_seq, "date", sum(lifted * reps) volume from ef group by all""")


def exercise_history(spark, sf_dir):
    return O.exercise_history(_log(spark, sf_dir), ["squat", "dips", "row"]).drop("ex_pos")


HISTORY_SQL = V.with_views("workout_sets", body=f"""{SETS}
select athlete_id, name, "date", log_seq, sum(lifted * reps) volume, max(lifted) max_weight from ef where name in ('squat', 'dips', 'row') group by all""")


def exercise_growth(spark, sf_dir):
    return O.exercise_growth(_log(spark, sf_dir))


GROWTH_SQL = V.with_views("workout_sets", body=f"""{SETS},
h as (select athlete_id, name, "date", log_seq, sum(lifted * reps) volume, max(lifted) max_weight from ef group by all),
o as (select *, row_number() over w occurrence, first_value(volume) over w v1 from h window w as (partition by athlete_id, name order by "date", log_seq))
select athlete_id, name, "date", log_seq, occurrence, volume, max_weight, case when occurrence > 1 and v1 > 0 then volume - v1 end volume_change,
  case when occurrence > 1 and v1 > 0 then round_even((volume - v1) / v1 * 100, 1) end pct_change from o""")


def _records(scope):
    return lambda spark, sf_dir: O.personal_records(_log(spark, sf_dir), scope)


def _records_sql(keep):
    return V.with_views("workout_sets", body=f"""{SETS},
q as (select *, row_number() over (partition by athlete_id, name order by log_seq, ex_pos, set_pos) i, lifted * (1 + reps / 30) e from ef),
m as (select * from q qualify row_number() over (partition by athlete_id, name order by lifted desc, i) = 1),
b as (select q.* from q join m on q.athlete_id = m.athlete_id and q.name = m.name and {keep}
  qualify row_number() over (partition by q.athlete_id, q.name order by q.e desc, q.i) = 1)
select m.athlete_id, m.name, m.lifted max_weight, m."date" max_date, round_even(b.e, 4) e1rm, b.lifted e1rm_weight, b.reps e1rm_reps, b."date" e1rm_date
from m join b on m.athlete_id = b.athlete_id and m.name = b.name""")


def workout_detail(spark, sf_dir):
    return O.workout_detail(_log(spark, sf_dir))


DETAIL_SQL = V.with_views("workout_sets", body=f"""{SETS}
select athlete_id, log_seq, "date", cast(ex_pos as int) ex_pos, case name when 'bench_press' then 'Bench Press' when 'pull_ups' then 'Pull Ups' when 'squat' then 'Squat' when 'dips' then 'Dips' when 'deadlift' then 'Deadlift' else 'Row' end exercise,
  string_agg(case when weight > 0 then printf('%dx%dlb', reps, weight::bigint) else printf('%dxBW', reps) end, ' | ' order by set_pos) sets
from ef group by all""")


def workout_upsert(spark, sf_dir):
    log = _log(spark, sf_dir)
    merged = O.upsert(log.filter("log_seq % 2 = 0"), log.filter("log_seq % 2 = 1"))
    return merged.select("athlete_id", "log_seq", "date", F.array_join("exercises.name", ",").alias("names"),
                         F.expr("aggregate(exercises, 0, (a, e) -> a + size(e.sets))").alias("sets"))


UPSERT_SQL = V.with_views("workout_sets", body="""
w as (select athlete_id, log_seq, "date", string_agg(name, ',' order by name) names, sum(n) n from (
  select athlete_id, log_seq, "date", name, count(*) n from workout_sets group by all) group by all),
old as (select *, row_number() over (partition by athlete_id, "date" order by log_seq) r from w where log_seq % 2 = 0),
add as (select athlete_id, "date", min(log_seq) log_seq, string_agg(names, ',' order by log_seq) names, sum(n) n from w where log_seq % 2 = 1 group by 1, 2)
select o.athlete_id, o.log_seq, o."date", o.names || coalesce(',' || a.names, '') names, cast(o.n + coalesce(a.n, 0) as int) sets
from old o left join add a on o.athlete_id = a.athlete_id and o."date" = a."date" and o.r = 1
union all
select a.athlete_id, a.log_seq, a."date", a.names, cast(a.n as int) from add a
where not exists (select 1 from old o where o.athlete_id = a.athlete_id and o."date" = a."date")""")

# weights and repetitions as typed into the bulk form
NOTATION = {
    "weights": "case o_orderkey % 5 when 0 then '60' when 1 then '60, 70' when 2 then '60,70,80' when 3 then '60,x' else concat(cast(o_orderkey % 90 as string), ',0') end",
    "reps": "case o_orderkey % 4 when 0 then '8' when 1 then '8,6' when 2 then '8, 6,4' else '5' end",
}


def set_notation(spark, sf_dir):
    typed = V.table(spark, sf_dir, "orders").selectExpr("o_orderkey AS entry", *[f"{e} AS {n}" for n, e in NOTATION.items()])
    sets = typed.select("entry", F.explode(expand_sets(F.col("weights"), F.col("reps"))).alias("s"))
    return sets.select("entry", "s.*")


NOTATION_SQL = f"""with t as (select o_orderkey entry, {", ".join(f"string_split({e}, ',') {n}" for n, e in NOTATION.items())} from orders),
z as (select *, len(weights) nw, len(reps) nr, greatest(len(weights), len(reps)) n from t where len(list_filter(weights, lambda x: try_cast(trim(x) as int) is null)) = 0),
g as (select *, unnest(range(1, n + 1)) i from z where nw = nr or nw = 1 or nr = 1)
select entry, cast(i as int) "set", cast(trim(weights[case when nw = 1 then 1 else i end]) as double) weight, cast(trim(reps[case when nr = 1 then 1 else i end]) as int) reps from g"""

QUERIES = {
    "workout_upsert": (workout_upsert, UPSERT_SQL),
    "workout_detail": (workout_detail, DETAIL_SQL),
    "exercise_names": (exercise_names, NAMES_SQL),
    "session_volume": (session_volume, VOLUME_SQL),
    "exercise_history": (exercise_history, HISTORY_SQL),
    "exercise_growth": (exercise_growth, GROWTH_SQL),
    "personal_records": (_records("since_max"), _records_sql("q.i >= m.i")),
    "personal_records_all_time": (_records("all_time"), _records_sql("true")),
    "set_notation": (set_notation, NOTATION_SQL),
}
