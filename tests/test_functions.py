import datetime as dt

import pytest
from pyspark.sql import functions as F

from stridelake.functions import numeric as N
from stridelake.functions import parsing as P
from stridelake.functions import text as X
from stridelake.functions import timekeys as K


def _map(spark, values, kind, *columns):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [tuple(r)[1:] for r in df.select("i", *columns).orderBy("i").collect()]


def test_durations_parse(spark):
    texts = ["7:32:10", "32:10", "7h 32m", "450", "abc", "", None, "1:2:3:4", "5 M", "1:xh 2m", "2h30s"]
    got = [r[0] for r in _map(spark, texts, "string", P.parse_duration(F.col("v")))]
    assert got == [27130, 1930, 27120, 450, None, None, None, None, 300, 120, 7230]


def test_dates_parse_or_pass_through(spark):
    texts = ["2024-05-01", "05/01/2024", "5-1-2024", "2024/05/01", "2024-05-01T23:10:00", "someday", " ", "13/45/2024"]
    assert [r[0] for r in _map(spark, texts, "string", P.parse_date_text(F.col("v")))] == ["2024-05-01"] * 5 + ["someday", None, "13/45/2024"]


def test_numbers_parse(spark):
    got = _map(spark, ["1,234.9", "96%", "96 %", "x", "-3.7"], "string", P.parse_number(F.col("v")), P.parse_whole(F.col("v")))
    assert got == [(1234.9, 1234), (96.0, None), (96.0, None), (None, None), (-3.7, -3)]


def test_set_notation(spark):
    df = spark.createDataFrame([("60, 70", "8,6"), ("60", "8,6"), ("60,70", "5"), ("60,70,80", "8,6"), ("x", "5")], "w string, r string")
    got = [[(s.set, s.weight, s.reps) for s in r[0]] for r in df.select(P.expand_sets(F.col("w"), F.col("r"))).collect()]
    assert got == [[(1, 60.0, 8), (2, 70.0, 6)], [(1, 60.0, 8), (2, 60.0, 6)], [(1, 60.0, 5), (2, 70.0, 5)], [], []]


def test_time_text(spark):
    got = _map(spark, [59.0, 3725.0, 360000.0, None], "double", X.clock(F.col("v")), X.hours_minutes(F.col("v")),
               X.hours_minutes_seconds(F.col("v")), X.hours_or_seconds(F.col("v")))
    assert got[0] == ("00:00:59", "0m", "0m 59s", "0m 59s") and got[1] == ("01:02:05", "1h 2m", "1h 2m 5s", "1h 2m")
    assert got[2][0] == "100:00:00" and got[3][2:] == (None, "—")
    labels = _map(spark, [45, 300, 5400, 7200], "int", X.duration_label(F.col("v")), X.short_duration_label(F.col("v")))
    assert labels == [("45s", "45s"), ("5min", "5m"), ("1h30", "1h"), ("2h", "2h")]
    assert _map(spark, [1609.344, 0.0, None], "double", X.pace_per_mile(F.lit(605.9), F.col("v"))) == [("10:05 /mi",), ("—",), ("—",)]


def test_periods_follow_local_time(spark):
    stamps = [dt.datetime(2024, 12, 30, 6, 59), dt.datetime(2024, 12, 30, 7, 1), dt.datetime(2024, 3, 10, 8, 30), dt.datetime(2024, 3, 10, 9, 30)]
    day = K.local_date("v")
    week = K.period_keys(day, "week")
    got = _map(spark, stamps, "timestamp_ntz", K.to_local("v"), *week.values(), K.season_label(day), K.period_label(day, "week"))
    assert got[0][1:] == (2024, "2024-12-23", "2024-12-29", "2024-25", "2024-12-23") and got[1][1:4] == (2024, "2024-12-30", "2025-01-05")
    # clocks go forward between the last two
    assert got[2][0] == dt.datetime(2024, 3, 10, 1, 30) and got[3][0] == dt.datetime(2024, 3, 10, 3, 30) and got[2][4] == "2023-24"
    with pytest.raises(ValueError):
        K.period_keys(day, "decade")


def test_half_even_rounding(spark):
    assert [r[0] for r in _map(spark, [0.5, 1.5, 2.5, -0.5], "double", N.rint(F.col("v")))] == [0, 2, 2, 0]
    assert [r[0] for r in _map(spark, [0.25, 0.35, 2.345], "double", N.rnd(F.col("v"), 1))] == [0.2, 0.4, 2.3]


def test_exact_rounding_over_random_ties(spark):
    """Beside the language's own round: apparent ties, real ties, neighbours of ties and plain values."""
    import math
    import random

    rng = random.Random(12)
    for digits in (1, 2, 3, 4):
        scale = 10**digits
        values = [1.115, 2.675, 0.15, 0.25, -1.115, -0.25, 0.0, 2.5, 1e9 + 0.05, None]
        for _ in range(3000):
            tie = (rng.randrange(-10**rng.randrange(1, 8), 10**7) + 0.5) / scale
            values += [tie, math.nextafter(tie, 1e9), math.nextafter(tie, -1e9), rng.uniform(-1000, 1000)]
        df = spark.createDataFrame([(v,) for v in values], "x double").coalesce(1)
        got = [r.y for r in df.select(N.exact(F.col("x"), digits).alias("y")).collect()]
        assert [g for g, v in zip(got, values) if v is not None and g != round(v, digits)] == []
        assert got[9] is None
