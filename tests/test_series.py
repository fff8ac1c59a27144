import datetime as dt
import random

from pyspark.sql import functions as F

from stridelake.operators import series as S

START = dt.datetime(2024, 3, 1, 5, 30)


def _points(n, seed, group="a"):
    rnd = random.Random(seed)
    t, out = START, []
    for i in range(n):
        t += dt.timedelta(seconds=rnd.choice([0, 1, 1, 40, 5000]))
        out.append((group, "f", t, i, None if rnd.random() < 0.4 else float(i)))
    return out


def _frame(spark, data):
    rnd = random.Random(1)
    data = list(data)
    rnd.shuffle(data)
    return spark.createDataFrame(data, "athlete_id string, source_file string, timestamp timestamp_ntz, id int, v double")


def test_positions_totals_and_firsts(spark):
    data = _points(60, 3) + _points(9, 4, "b")
    got = S.number_rows(_frame(spark, data), S.ACTIVITY, ["timestamp", "id"], S.hour_bucket(),
                        totals={"known": F.count("v")}, firsts={"first_id": "id"}).collect()
    for group in ("a", "b"):
        mine = [r for r in got if r.athlete_id == group]
        assert all(r.seq == r.id for r in mine)
        known = sum(1 for g, *_, v in data if g == group and v is not None)
        assert {r.known for r in mine} == {known} and {r.first_id for r in mine} == {0}


def test_rows_without_time_come_first(spark):
    data = [("a", "f", None, 0, 1.0), ("a", "f", START, 1, 1.0), ("a", "f", START + dt.timedelta(days=2), 2, 1.0)]
    got = S.number_rows(_frame(spark, data), S.ACTIVITY, ["timestamp", "id"], S.hour_bucket()).collect()
    assert {(r.id, r.seq) for r in got} == {(0, 0), (1, 1), (2, 2)}


def test_chunks_copy_the_halo_into_every_chunk_that_needs_it(spark, small_chunks):
    df = spark.range(40).select(F.lit("a").alias("athlete_id"), F.lit("f").alias("source_file"), F.col("id").alias("seq"))
    for halo in (0, 1, 3, 7, 18):
        got = S.chunked(df, halo).collect()
        assert sorted(r.seq for r in got if r.own) == list(range(40))
        have = {(r.chunk, r.seq) for r in got}
        for s in range(40):
            assert all((s // 7, b) in have for b in range(max(0, s - halo), s + 1))


def test_fill_forward_crosses_chunks(spark, small_chunks):
    data = [("a", "f", START, i, None if i < 5 or 9 < i < 31 else float(i)) for i in range(40)]
    df = _frame(spark, data).withColumnRenamed("id", "seq").withColumn("w", F.col("v"))
    got = sorted(S.fill_forward(df, S.ACTIVITY, ["v", "w"]).collect(), key=lambda r: r.seq)
    last = None
    for r, (_, _, _, _, v) in zip(got, data):
        last = v if v is not None else last
        assert r.v == last and r.w == last and r.rows == 40 and r.lead == 5


def test_fill_forward_without_any_value_has_no_lead(spark):
    data = [("a", "f", START, i, None) for i in range(4)]
    got = S.fill_forward(_frame(spark, data).withColumnRenamed("id", "seq"), S.ACTIVITY, ["v"]).collect()
    assert len(got) == 4 and {r.lead for r in got} == {None}


def test_salted_join_keeps_every_row(spark):
    big = spark.range(500).select(F.lit("k").alias("key"), "id")
    small = spark.createDataFrame([("k", 5)], "key string, x int")
    assert S.salted_join(big, small, ["key"], F.col("id")).agg(F.count("*"), F.sum("x")).first()[:] == (500, 2500)
