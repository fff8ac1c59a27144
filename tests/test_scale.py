"""Work is dealt over the configured width where runtime coalescing would fold it, and halos are copied once."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from stridelake.operators import critical_power, power, series
from stridelake.plans import model_queries, store_queries
from stridelake.plans import views as V
from stridelake.sources import ledger

DAY = dt.datetime(2024, 1, 1)


@pytest.fixture
def tables(spark, tmp_path):
    """Some orders with four line items each; joins are not broadcast."""
    conf = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = {k: spark.conf.get(k, None) for k in conf}
    for k in conf:
        spark.conf.set(k, "-1")
    orders = spark.range(200).selectExpr("id o_orderkey", "id % 50 o_custkey", "timestamp_ntz'2024-01-01' + make_dt_interval(cast(id as int)) o_orderdate",
                                         "concat(cast(id % 5 + 1 as string), '-X') o_orderpriority")
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(800).selectExpr("id div 4 l_orderkey", "id l_partkey", "id % 7 l_suppkey", "cast(id % 4 as int) l_linenumber", "cast(id % 50 as double) l_quantity",
                                "cast(id as double) l_extendedprice", "'A' l_returnflag", "'F' l_linestatus").write.parquet(f"{tmp_path}/lineitem.parquet")
    yield str(tmp_path)
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("view", ["sessions", "workout_sets"])
def test_joins_of_orders_keep_the_configured_width(spark, tables, view):
    got = getattr(V, view)(spark, tables)
    tasks = got.select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1
    assert got.count() == {"sessions": 200, "workout_sets": 800}[view]


def test_a_long_look_back_is_copied_once(spark, small_chunks):
    points = spark.createDataFrame([("a", "f", DAY + dt.timedelta(seconds=s), float(s % 90)) for s in range(400)],
                                   "athlete_id string, source_file string, timestamp timestamp_ntz, power double")
    parts = power.repaired_power(points, halo=99)
    assert parts.filter("own").count() == 400 and parts.count() <= 2 * 400
    short = power.repaired_power(points)  # a short look-back keeps the module's chunks
    assert short.agg(F.max("chunk")).first()[0] == 399 // series.CHUNK_ROWS


def test_files_of_athletes_are_written_by_several_tasks(spark, tmp_path):
    rows = spark.range(400).selectExpr("cast(id % 60 as string) athlete_id", "id").groupBy("athlete_id").agg(F.max("id").cast("string").alias("value"))
    store_queries._write_texts(rows, f"{tmp_path}/log")
    files = sorted((tmp_path / "log").glob("athlete_id=*/part-*"))
    assert len(files) == 60  # one for each athlete
    assert len({re.match(r"part-(\d+)", f.name)[1] for f in files}) == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_messages_are_parsed_by_as_many_tasks_as_configured(spark, tmp_path, monkeypatch):
    kinds, seen = ["record_mesgs", "split_summary_mesgs"], []
    flatten = ledger.M.flatten_messages

    def watched(messages, msg_type):
        seen.append((messages.select(F.spark_partition_id()).distinct().count(), {r.msg_type for r in messages.select("msg_type").distinct().collect()}))
        return flatten(messages, msg_type)

    monkeypatch.setattr(ledger.M, "flatten_messages", watched)
    rows = spark.range(300).selectExpr("'a' athlete_id", "'f' source_file", "element_at(array('record_mesgs', 'split_summary_mesgs', 'split_mesgs'), cast(id % 3 as int) + 1) msg_type",
                                       """concat('{"timestamp":"2024-05-01 10:00:00","power":', id, ',"num_splits":', id, '}') fields""")
    store = ledger.Ledger(spark, str(tmp_path))
    store.append(rows.coalesce(1), "one", kinds)
    assert seen == [(int(spark.conf.get("spark.sql.shuffle.partitions")), set(kinds))] * 2  # types not asked for are not kept
    assert store.read("record_mesgs").count() == store.read("split_summary_mesgs").count() == 100


def test_watts_repeated_for_each_month_do_not_travel(spark):
    sessions = spark.range(40).selectExpr("cast(id div 1000 as string) athlete_id", "cast(id as string) source_file", "timestamp_ntz'2024-01-05 12:00:00' + make_dt_interval(cast(id * 20 as int)) timestamp")
    curves = spark.range(200).selectExpr("cast(id div 1000 as string) athlete_id", "cast(id % 40 as string) source_file", "cast(120 + id div 40 as int) duration_s", "cast(200 + id % 9 - id div 40 as double) watts")
    got = critical_power.over_time(sessions, curves, 6)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\([^)]*date#[^)]*duration_s#", plan)
    assert re.search(rf"hashpartitioning\(athlete_id#\d+, duration_s#\d+, {6 * int(spark.conf.get('spark.sql.shuffle.partitions'))}\)", plan)
    assert got.count() == 20  # months from July 2024, 180 days after the first ride, to that of the last one


def test_ride_models_read_the_curves_once(spark):
    sessions = spark.range(40).selectExpr("cast(id div 1000 as string) athlete_id", "cast(id as string) source_file", "timestamp_ntz'2024-01-05 12:00:00' + make_dt_interval(cast(id * 20 as int)) timestamp",
                                          "cast(null as double) threshold_power")
    curves = spark.range(201).filter("id < 200").selectExpr("cast(id div 1000 as string) athlete_id", "cast(id % 40 as string) source_file", "cast(120 + id div 40 as int) duration_s", "cast(200 + id % 9 - id div 40 as double) watts")
    got = critical_power.ride_models(sessions, curves)
    assert got._jdf.queryExecution().executedPlan().toString().count("Range (0, 201,") == 1
    assert got.count() == 40


def test_ride_models_look_over_days_without_a_curve(spark):
    start = dt.datetime(2024, 1, 5, 12)
    rides = {"r0": (0, 300), "r1": (30, None), "r2": (30, 250), "r3": (90, None), "r4": (91, None), "r5": (121, 200), "r6": (None, 400)}
    sessions = spark.createDataFrame([("a", f, None if d is None else start + dt.timedelta(days=d), 222.0) for f, (d, _) in rides.items()],
                                     "athlete_id string, source_file string, timestamp timestamp_ntz, threshold_power double")
    curves = spark.createDataFrame([("a", f, t, cp + 12000 / t) for f, (_, cp) in rides.items() if cp for t in (120, 300, 1200)],
                                   "athlete_id string, source_file string, duration_s int, watts double")
    got = {r.source_file: (r.cp, r.from_model) for r in critical_power.ride_models(sessions, curves).collect()}
    assert got == {"r0": (300, True), "r1": (300, True), "r2": (300, True), "r3": (300, True), "r4": (250, True), "r5": (200, True), "r6": (250, False)}


def test_points_of_short_rides_are_worked_through_once(spark):
    records = spark.range(300).selectExpr("'a' athlete_id", "cast(id % 3 as string) source_file", "timestamp_ntz'2024-01-05 12:00:00' + make_dt_interval(0, 0, 0, id) timestamp", "cast(id as double) power")
    models = spark.range(3).selectExpr("'a' athlete_id", "cast(id as string) source_file", "200L cp", "15D wprime_kj")
    got = critical_power.wprime_balance(records, models)
    assert len(got.collect()) == 300
    assert "MapInArrow" not in got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_rides_behind_covariates_are_made_once(spark, monkeypatch):
    made, seen = spark.range(30).selectExpr("'a' athlete_id", "cast(id as string) source_file", "date_add(date'2024-01-05', cast(id * 11 as int)) day",
                                            "cast(date_trunc('month', date_add(date'2024-01-05', cast(id * 11 as int))) as date) month", "cast(id * 7 % 50 as double) training_stress_score",
                                            "cast(id * 3 % 11 as double) p1", "cast(id * 5 % 13 as double) p2", "cast(id * 2 % 17 as double) p3"), spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    nights = made.selectExpr("athlete_id", "cast(date_sub(day, 1) as string) calendar_date", "cast(day(day) as int) score_overall")
    monkeypatch.setattr(model_queries, "_rides", lambda *_: made.mapInPandas(counted, made.schema))
    monkeypatch.setattr(model_queries.V, "tour_nights", lambda *_: nights)
    assert model_queries._design(spark, "").count() == 2 * 11
    assert seen.value == 30
