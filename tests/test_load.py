import datetime as dt
import random

import pytest

from stridelake.operators import load as L

AS_OF = dt.date(2024, 6, 1)


def _days(spark, data):
    return spark.createDataFrame([(a, d, float(t)) for a, d, t in data], "athlete_id string, date date, tss double")


def _data():
    rnd = random.Random(2)
    out = []
    for k in range(0, 2600, 1):
        if rnd.random() < 0.2 and not 600 < k < 1400:
            out.append(("many", AS_OF - dt.timedelta(days=2550 - k), rnd.randrange(0, 200)))
    out += [("single", AS_OF - dt.timedelta(days=3), 50), ("future", AS_OF + dt.timedelta(days=10), 80),
            ("past_end", AS_OF + dt.timedelta(days=61), 80)]
    out += [("constant", AS_OF - dt.timedelta(days=k), 100) for k in range(400)]
    return out


def _dense(data, athlete):
    tss = {d: t for a, d, t in data if a == athlete and d <= AS_OF + dt.timedelta(days=60)}
    day, out = min(tss), []
    while day <= AS_OF + dt.timedelta(days=60):
        out.append((day, tss.get(day, 0.0)))
        day += dt.timedelta(days=1)
    return out


def _walk(values):
    ctl = atl = 0.0
    out = []
    for v in values:
        ctl += (v - ctl) * 2 / 43
        atl += (v - atl) * 2 / 8
        out.append((ctl, atl))
    return out


def test_load_matches_the_daily_recursion(spark):
    data = _data()
    got = L.training_load(_days(spark, data), AS_OF).collect()
    assert {r.athlete_id for r in got} == {"many", "single", "future", "constant"}
    for a in {"many", "single", "future", "constant"}:
        dense = _dense(data, a)
        mine = sorted((r for r in got if r.athlete_id == a), key=lambda r: r.date)
        assert [(r.date, r.tss, r.is_projection) for r in mine] == [(d, t, d > AS_OF) for d, t in dense]
        want = _walk([t for _, t in dense])
        assert [r.ctl for r in mine] == pytest.approx([w[0] for w in want], rel=1e-9)
        assert [r.atl for r in mine] == pytest.approx([w[1] for w in want], rel=1e-9, abs=1e-12)
    on_day = next(r for r in got if r.athlete_id == "constant" and r.date == AS_OF)
    assert on_day.ctl == pytest.approx(100, abs=1e-5) and on_day.tsb == pytest.approx(0, abs=1e-5)


def test_forecast_takes_override_then_recent_mean(spark):
    data = _data()
    ov = {("many", AS_OF + dt.timedelta(days=2)): 300.0, ("many", AS_OF + dt.timedelta(days=21)): 0.0, ("single", AS_OF + dt.timedelta(days=1)): 500.0}
    overrides = _days(spark, [(a, d, t) for (a, d), t in ov.items()])
    for given in (overrides, None):
        got = L.forecast(_days(spark, data), AS_OF, given).collect()
        for a in {"many", "single", "future", "constant"}:
            dense = _dense(data, a)
            actual = [t for d, t in dense if d <= AS_OF]
            recent = actual[-42:]
            mean = sum(recent) / len(recent) if recent else 0.0
            use = ov if given is not None else {}
            series = [(d, use.get((a, d), mean) if d > AS_OF else t) for d, t in dense]
            mine = sorted((r for r in got if r.athlete_id == a), key=lambda r: r.date)
            assert [r.date for r in mine] == [d for d, _ in series]
            assert [r.tss_forecast for r in mine] == pytest.approx([t for _, t in series])
            want = _walk([t for _, t in series])
            assert [r.ctl_forecast for r in mine] == pytest.approx([w[0] for w in want], rel=1e-9)
            assert [r.atl_forecast for r in mine] == pytest.approx([w[1] for w in want], rel=1e-9, abs=1e-12)


def test_overrides_are_parsed_kept_by_last_row_and_clamped(spark):
    day = lambda n: str(AS_OF + dt.timedelta(days=n))
    raw = [("a", 1, day(1), "50"), ("a", 2, day(1), "70"), ("a", 3, day(1), "abc"), ("a", 4, day(2), "-5"), ("a", 5, day(3), "900"),
           ("a", 6, day(0), "10"), ("a", 7, day(21), "21.5"), ("a", 8, day(22), "10"), ("a", 9, "", "10"), ("a", 10, day(4), " "), ("a", 11, "soon", "10")]
    df = spark.createDataFrame(raw, "athlete_id string, seq int, date string, tss string")
    got = {str(r.date): r.tss for r in L.valid_overrides(L.parse_overrides(df), AS_OF).collect()}
    assert got == {day(1): 70.0, day(2): 0.0, day(3): 500.0, day(21): 21.5}


def test_missing_scores_are_estimated_when_possible(spark):
    at = dt.datetime(2024, 5, 1, 3, 0)  # still 30 April in Denver
    rows = [("a", at, 10.0, 3600.0, 200.0, 0.8, 200.0), ("a", at, None, 3600.0, 200.0, 0.8, 200.0), ("a", at, None, 3600.0, None, 0.8, 200.0),
            ("b", at, None, 3600.0, 200.0, 0.8, 0.0)]
    df = spark.createDataFrame(rows, "athlete_id string, timestamp timestamp_ntz, training_stress_score double, total_timer_time double, normalized_power double, intensity_factor double, threshold_power double")
    got = {r.athlete_id: r for r in L.training_days(df).collect()}
    assert str(got["a"].date) == "2024-04-30" and got["a"].tss == pytest.approx(90.0) and got["b"].tss == 0.0


def test_comparison_direction_and_window(spark):
    days = _days(spark, _data())
    load, ahead = L.training_load(days, AS_OF), L.forecast(days, AS_OF)
    got = {(r.athlete_id, r.metric): r for r in L.load_comparison(load, ahead, AS_OF).collect()}
    assert got["constant", "ctl"].direction == "→" and got["single", "ctl"].direction == "↑" and got["future", "ctl"].direction == "--"
    shown = L.display_window(load, AS_OF, 3).agg({"date": "min"}).first()[0]
    assert shown == dt.date(2024, 6, 1) - dt.timedelta(days=90)
    assert L.latest_days(load.filter("athlete_id = 'constant'"), 42).count() == 42
