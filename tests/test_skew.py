"""Joins with hot keys: equal results, balanced tasks, day pruning."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from stridelake.operators.skew import hot_join, hot_keys
from stridelake.sources import tables


@pytest.fixture
def shuffled(spark):
    """Neither broadcast nor merged partitions, so tasks show how keys are dealt."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def points(spark, n=40_000):
    """One activity holds half of the points."""
    return spark.range(n).select(
        F.lit("a").alias("athlete_id"), F.when(F.col("id") % 2 == 0, F.lit("hot")).otherwise(F.concat(F.lit("f"), (F.col("id") % 499).cast("string"))).alias("source_file"),
        F.col("id").alias("k"))


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("limit", [100, 1 << 20])
def test_same_rows_as_a_plain_join(shuffled, how, limit):
    big = points(shuffled, 4000).unionByName(shuffled.createDataFrame([(None, "hot", -1), ("a", None, -2)], "athlete_id string, source_file string, k long"))
    small = shuffled.createDataFrame([("a", "hot", 1), ("a", "hot", 2), ("a", "f7", 3), ("a", "none", 4), (None, "hot", 5)], "athlete_id string, source_file string, w int")
    keys = ["athlete_id", "source_file"]
    got, want = hot_join(big, small, keys, how, rows_per_task=limit), big.join(small, keys, how)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))


def test_tasks_are_even_with_half_the_points_in_one_activity(shuffled):
    rides = points(shuffled).select("athlete_id", "source_file").distinct()
    sizes = {}
    for limit in (150, 1 << 20):
        got = tables.only_activities(points(shuffled), rides, limit)
        sizes[limit] = sorted(r["count"] for r in got.groupBy(F.spark_partition_id().alias("p")).count().collect())
        assert sum(sizes[limit]) == 40_000
    assert sizes[1 << 20][-1] > 20_000  # unsplit: one task reads the hot activity
    assert len(sizes[150]) == 16 and sizes[150][-1] <= 3 * sizes[150][8]


def test_hot_keys_are_counted_exactly_and_bounded(spark):
    counts = spark.createDataFrame([("x", 10), ("y", 11), ("z", 45)], "k string, n long")
    assert sorted((r.k, r["_salts"]) for r in hot_keys(counts, ["k"], 10).collect()) == [("y", 2), ("z", 5)]


def test_records_of_activities_read_their_days_only(spark, tmp_path):
    start = dt.datetime(2024, 1, 1, 23, 30)
    rows = [("a", f"f{d}", start + dt.timedelta(days=d, minutes=m)) for d in range(40) for m in (0, 50)]
    df = spark.createDataFrame(rows, "athlete_id string, source_file string, timestamp timestamp_ntz").withColumn("dt", F.to_date("timestamp"))
    df.write.partitionBy("dt").parquet(str(tmp_path / "r"))
    stored = spark.read.parquet(str(tmp_path / "r"))
    rides = spark.createDataFrame([("a", "f20", start + dt.timedelta(days=20), 3000.0), ("a", "f22", start + dt.timedelta(days=22, minutes=50), 3000.0)],
                                  "athlete_id string, source_file string, timestamp timestamp_ntz, total_elapsed_time double")
    got = tables.only_activities(stored, rides)
    assert sorted((r.source_file, r.timestamp) for r in got.collect()) == [r[1:] for r in rows if r[1] in ("f20", "f22")]
    scan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dt" in scan and "subquery" in scan.lower()
    # a session without a timestamp may have rows on any day
    unknown = rides.unionByName(spark.createDataFrame([("a", "f3", None, None)], rides.schema))
    assert {r.source_file for r in tables.only_activities(stored, unknown).collect()} == {"f3", "f20", "f22"}
    assert tables.only_activities(stored, rides.limit(0)).count() == 0
