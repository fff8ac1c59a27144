import datetime as dt
import random

import pytest

from stridelake.operators import power as P

START = dt.datetime(2024, 3, 1, 5, 30)
SCHEMA = "athlete_id string, source_file string, timestamp timestamp_ntz, power double"


def _records(spark, rides):
    data = [("a", f, START + dt.timedelta(seconds=i * (700 if f == "long" else 1)), p) for f, ps in rides.items() for i, p in enumerate(ps)]
    random.Random(5).shuffle(data)
    return spark.createDataFrame(data, SCHEMA)


def _repair(raw):
    out = []
    for i, p in enumerate(raw):
        if p is None:
            two = raw[i - 2:i] if i >= 2 else [None]
            p = 0 if None in two else sum(two) / 2
        out.append(int(p))
    return out


def _best(ps, d):
    return max(sum(ps[i:i + d]) for i in range(len(ps) - d + 1)) / d if d <= len(ps) else None


def _rides():
    rnd = random.Random(11)
    return {
        "long": [None if rnd.random() < 0.3 else float(rnd.randrange(0, 400)) for _ in range(90)],
        "short": [None, None, 100.0, 201.0, None, None, 50.0],
        "one": [None, 250.0],
        "none": [None, None, None],
    }


def test_repair_uses_two_raw_values_and_only_the_first_of_a_run(spark, small_chunks):
    got = P.power_series(_records(spark, _rides())).collect()
    for name, raw in _rides().items():
        mine = [r.power for r in sorted((r for r in got if r.source_file == name), key=lambda r: r.seq)]
        assert mine == ([] if name == "none" else _repair(raw))
    assert [r.power for r in sorted((r for r in got if r.source_file == "short"), key=lambda r: r.seq)] == [0, 0, 100, 201, 150, 0, 50]


@pytest.mark.parametrize("kernel", ["few", "many"])
def test_curve_matches_every_window(spark, small_chunks, monkeypatch, kernel):
    if kernel == "many":
        monkeypatch.setattr(P, "FEW_DURATIONS", 1)
    durations = [1, 2, 3, 5, 7, 8, 20, 50, 90, 91]
    got = {(r.source_file, r.duration_s): r.watts for r in P.mean_max_curve(_records(spark, _rides()), durations).collect()}
    want = {}
    for name, raw in _rides().items():
        for d in durations:
            w = None if name == "none" else _best(_repair(raw), d)
            if w is not None:
                want[name, d] = w
    assert got == pytest.approx(want)


def test_peaks_keep_durations_the_ride_does_not_reach(spark):
    got = {(r.source_file, r.duration): r.watts for r in P.peak_powers(_records(spark, _rides())).collect()}
    assert got["one", "5s"] is None and got["short", "5s"] == round(_best(_repair(_rides()["short"]), 5))
    assert not any(f == "none" for f, _ in got) and len(got) == 30


def test_histogram_is_zero_filled_and_zones_use_the_default_threshold(spark):
    records = _records(spark, {"r": [0.0, 10.0, 130.0, 131.0, 260.0]})
    sessions = spark.createDataFrame([("a", "r", START, 0.0)], "athlete_id string, source_file string, timestamp timestamp_ntz, threshold_power double")
    bins = {r.bin: (r.seconds, r.zone) for r in P.power_histogram(records, sessions).collect()}
    assert sorted(bins) == list(range(0, 285, 25))
    assert bins[0] == (2, 1) and bins[125] == (2, 2) and bins[250] == (1, 5) and bins[275] == (0, 5)
    zones = {r.zone: (r.seconds, r.pct, r.ftp) for r in P.time_in_zones(records, sessions).collect()}
    assert zones[1] == (4, 80.0, 250.0) and zones[4] == (1, 20.0, 250.0) and zones[7] == (0, 0.0, 250.0)


def test_incremental_curve_skips_stored_activities(spark):
    records = _records(spark, _rides())
    sessions = records.select("athlete_id", "source_file").distinct()
    stored = P.mean_max_curve(records.filter("source_file = 'long'"), [1, 2])
    got = P.extend_curves(sessions, records, stored, [1, 2]).collect()
    assert {r.source_file for r in got} == {"short", "one"}


def test_second_incremental_run_has_no_work(spark):
    import datetime as dt

    t0 = dt.datetime(2024, 1, 1)
    points = [("a", "long", t0 + dt.timedelta(seconds=i), 200.0) for i in range(10)]
    points += [("a", "short", t0 + dt.timedelta(seconds=i), 200.0) for i in range(2)]
    points += [("a", "none", t0 + dt.timedelta(seconds=i), None) for i in range(10)]
    records = spark.createDataFrame(points, "athlete_id string, source_file string, timestamp timestamp_ntz, power double")
    sessions = records.select("athlete_id", "source_file").distinct()
    empty = spark.createDataFrame([], "athlete_id string, source_file string, duration_s int, watts double")
    first = P.to_process(sessions, empty)
    curves = P.extend_curves(sessions, records, empty, [5])
    assert [r.source_file for r in curves.collect()] == ["long"] and first.count() == 3
    assert P.to_process(sessions, curves).count() == 2  # without the table they come up for ever
    assert P.to_process(sessions, curves, first).count() == 0
    assert P.extend_curves(sessions, records, curves, [5], processed=first).count() == 0
