import datetime as dt
import random

import pytest

from stridelake.operators import critical_power as C

START = dt.datetime(2024, 3, 1, 5, 30)
CURVE = "athlete_id string, duration_s int, watts double"


def _brute(powers, cp, wp):
    bal, out = wp, [wp]
    for p in powers[1:]:
        if p >= cp:
            bal = max(0, bal - (p - cp))
        else:
            tau = 546 * 2.718281828 ** (-0.01 * (cp - p)) + 316
            bal = wp - (wp - bal) * 2.718281828 ** (-1 / tau)
        out.append(bal)
    return out


@pytest.mark.parametrize("chunk", [7, 50, 65536])
def test_balance_matches_the_recursion(spark, monkeypatch, chunk):
    monkeypatch.setattr(C.series, "CHUNK_ROWS", chunk)
    rnd = random.Random(3)
    rides = {
        "mixed": [float(rnd.choice([0, 100, 200, 250, 900, 1500])) for _ in range(240)],
        "above": [260.0] * 60, "at": [250.0] * 20, "below": [100.0] * 33,
        "drained": [2000.0] * 30 + [0.0] * 60 + [2000.0] * 20, "one": [300.0],
    }
    data = [("a", f, START + dt.timedelta(seconds=i), p) for f, ps in rides.items() for i, p in enumerate(ps)]
    records = spark.createDataFrame(data, "athlete_id string, source_file string, timestamp timestamp_ntz, power double")
    models = spark.createDataFrame([("a", f, 250, 10.0, True) for f in rides],
                                   "athlete_id string, source_file string, cp bigint, wprime_kj double, from_model boolean")
    balance = C.wprime_balance(records, models)
    got = balance.collect()
    for f, ps in rides.items():
        mine = sorted((r for r in got if r.source_file == f), key=lambda r: r.seq)
        want = _brute(ps, 250, 10000.0)
        assert [r.wprime_bal_kj * 1000 for r in mine] == pytest.approx(want, abs=1e-6)
        assert all(-1e-9 <= r.wprime_pct <= 100 + 1e-9 for r in mine)
    low = {r.source_file: r for r in C.wprime_summary(balance).collect()}
    assert low["drained"].min_kj == 0.0 and low["below"].seconds_low == 0


def test_fit_needs_three_points_and_a_positive_reserve(spark):
    good = [("good", t, 200 + 15000 / t) for t in (120, 300, 600, 1200)]
    flat = [("flat", t, 200.0) for t in (120, 300, 600)]
    rising = [("rising", t, 100.0 + t) for t in (120, 300, 600)]
    few = [("few", 120, 300.0), ("few", 300, 250.0), ("few", 60, 400.0), ("few", 1300, 200.0)]
    got = {r.athlete_id: r for r in C.fit(spark.createDataFrame(good + flat + rising + few, CURVE), ["athlete_id"]).collect()}
    assert (got["good"].cp, got["good"].wprime_kj, got["good"].r2) == (200, 15.0, 1.0)
    assert got["flat"].cp == 200 and got["flat"].r2 is None
    assert got["rising"].cp is None and got["few"].cp is None and got["few"].points == 2


def _sessions(spark, dates, ftp=None):
    rows = [("a", f"r{i}", dt.datetime.fromisoformat(d + "T12:00:00"), ftp) for i, d in enumerate(dates)]
    return spark.createDataFrame(rows, "athlete_id string, source_file string, timestamp timestamp_ntz, threshold_power double")


def _curves(spark, levels):
    rows = [("a", f"r{i}", t, cp + 12000 / t) for i, cp in enumerate(levels) if cp for t in (120, 300, 1200)]
    return spark.createDataFrame(rows, "athlete_id string, source_file string, duration_s int, watts double")


def test_rolling_fit_starts_after_one_period_and_forgets_old_rides(spark):
    dates = ["2023-01-15", "2023-04-01", "2023-04-02", "2023-08-20"]
    got = {str(r.date): r.cp for r in C.over_time(_sessions(spark, dates), _curves(spark, [200, 250, 300, 210]), 3).collect()}
    # starts in the month 90 days after the first ride; 2 April is out of the window of 1 April
    assert got == {"2023-04-01": 250, "2023-05-01": 300, "2023-06-01": 300, "2023-07-01": 300}


def test_ride_model_looks_back_ninety_days_and_falls_back(spark):
    dates = ["2023-01-01", "2023-04-01", "2023-04-02", "2023-12-01"]
    sessions = _sessions(spark, dates, 222.7)
    got = {r.source_file: r for r in C.ride_models(sessions, _curves(spark, [300, None, None, None])).collect()}
    assert got["r0"].cp == 300 and got["r1"].cp == 300 and got["r1"].from_model
    assert (got["r2"].cp, got["r2"].wprime_kj, got["r2"].from_model) == (222, 15.0, False)
    assert got["r3"].cp == 222
