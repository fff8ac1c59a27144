import datetime as dt
import math
import random

import pytest

from stridelake.operators import route as R

START = dt.datetime(2024, 3, 1, 5, 30)
SCHEMA = "athlete_id string, source_file string, timestamp timestamp_ntz, distance double, enhanced_altitude double, power double, cadence double"


def _ride(legs, step=10.0, seed=0):
    """Points from (count, grade %) legs, with some values missing."""
    rnd = random.Random(seed)
    dist, alt, out = 0.0, 500.0, []
    for count, grade in legs:
        for _ in range(count):
            run = 0.0 if rnd.random() < 0.05 else step
            dist, alt = dist + run, alt + run * grade / 100
            out.append([dist, alt, float(rnd.randrange(0, 300)), float(rnd.randrange(0, 100))])
    for i, p in enumerate(out):
        if i < 3 or rnd.random() < 0.05:
            p[rnd.randrange(0, 2)] = None
        if rnd.random() < 0.1:
            p[2] = None
    return out


RIDES = {
    "merge": _ride([(30, 0), (80, 6), (20, -1), (80, 6), (60, 0)], seed=1),
    "dip": _ride([(30, 0), (80, 6), (60, -6), (80, 6), (60, 0)], seed=2),
    "gap": _ride([(80, 6), (220, 0), (80, 6)], seed=3),
    "tiny": _ride([(30, 0), (22, 4), (40, -3)], seed=4),
    "steep_short": _ride([(30, 0), (25, 40), (40, 0)], step=2.0, seed=5),
    "chain": _ride([(50, 5), (30, -0.5)] * 6, seed=6),
    "point": [[0.0, 1.0, 1.0, 1.0]],
}


def _records(spark):
    data = [("a", f, START + dt.timedelta(seconds=i), *p) for f, ps in RIDES.items() for i, p in enumerate(ps)]
    random.Random(9).shuffle(data)
    return spark.createDataFrame(data, SCHEMA)


def _brute_profile(points):
    d = a = None
    kept = []
    for p in points:
        d, a = p[0] if p[0] is not None else d, p[1] if p[1] is not None else a
        if d is not None and a is not None:
            kept.append((d, a, int(p[2] or 0), int(p[3] or 0)))
    if len(kept) < 2:
        return [], [], []
    grade = [0.0] + [
        (y[1] - x[1]) / (y[0] - x[0]) * 100 if y[0] > x[0] else 0.0 for x, y in zip(kept, kept[1:])
    ]
    mean = lambda n: [sum(grade[max(0, i - n + 1):i + 1]) / min(n, i + 1) for i in range(len(grade))]
    return kept, mean(20), mean(5)


def _brute_climbs(points):
    kept, smooth, instant = _brute_profile(points)
    runs, i = [], 0
    while i < len(smooth):
        if smooth[i] >= 3.0:
            j = i
            while j + 1 < len(smooth) and smooth[j + 1] >= 3.0:
                j += 1
            runs.append([i, j])
            i = j
        i += 1
    merged = []
    for s, e in runs:
        if merged:
            ps, pe = merged[-1]
            won = kept[pe][1] - kept[ps][1]
            if kept[s][0] - kept[pe][0] < 1609 and (won <= 0 or kept[pe][1] - kept[s][1] < won * 0.3):
                merged[-1][1] = e
                continue
        merged.append([s, e])
    out = []
    for s, e in merged:
        dist, gain = kept[e][0] - kept[s][0], kept[e][1] - kept[s][1]
        if dist < 400 or gain < 30:
            continue
        watts = [k[2] for k in kept[s:e + 1]]
        on = [w for w in watts if w > 0]
        turning = [k[3] for k in kept[s:e + 1] if k[3] > 0]
        rolled = [sum(watts[k:k + 30]) / 30 for k in range(len(watts) - 29)]
        np_ = round((sum(r**4 for r in rolled) / len(rolled)) ** 0.25) if rolled and on else None
        out.append((s, e, round(sum(on) / len(on)), np_, round(sum(turning) / len(turning)), round(max(instant[s:e + 1]), 1)))
    return out


def test_profile_matches_point_by_point(spark, small_chunks):
    got = R.elevation_profile(_records(spark)).collect()
    for name, points in RIDES.items():
        kept, smooth, instant = _brute_profile(points)
        mine = sorted((r for r in got if r.source_file == name), key=lambda r: r.seq)
        assert [r.seq for r in mine] == list(range(len(kept)))
        for r, k, s, i in zip(mine, kept, smooth, instant):
            assert math.isclose(r.grade_pct, s, abs_tol=1e-9) and math.isclose(r.grade_instant, i, abs_tol=1e-9)
            assert math.isclose(r.distance_mi, k[0] / 1609.344) and math.isclose(r.altitude_ft, k[1] * 3.28084)


@pytest.mark.parametrize("chunk", [7, 65536])
def test_climbs_match_a_sequential_walk(spark, monkeypatch, chunk):
    monkeypatch.setattr(R.series, "CHUNK_ROWS", chunk)
    got = R.climbs(_records(spark)).collect()
    counts = {}
    for name, points in RIDES.items():
        want = _brute_climbs(points)
        mine = sorted((r for r in got if r.source_file == name), key=lambda r: r.climb_no)
        counts[name] = len(mine)
        assert [(r.start_seq, r.end_seq, r.avg_power, r.normalized_power, r.avg_cadence, r.max_grade) for r in mine] == want
        assert [r.climb_no for r in mine] == list(range(1, len(want) + 1))
    assert counts["merge"] == 1 and counts["dip"] == 2 and counts["gap"] == 2 and counts["tiny"] == 0


def test_climb_marks_land_on_the_nearest_profile_point(spark):
    records = _records(spark)
    found, profile = R.climbs(records), R.elevation_profile(records)
    points = profile.selectExpr("athlete_id", "source_file", "seq", "0.0 lat", "0.0 lon")
    got = R.climb_route_points(found, profile, points).collect()
    by_file = {}
    for r in profile.collect():
        by_file.setdefault(r.source_file, []).append((r.seq, r.distance_mi))
    assert len(got) == 2 * found.count()
    for r in got:
        assert r.seq == min(by_file[r.source_file], key=lambda p: (abs(p[1] - r.at_mi), p[0]))[0]


def test_route_keeps_located_points_in_order(spark):
    df = spark.createDataFrame(
        [("a", "f", START + dt.timedelta(seconds=i), None if i == 1 else 2.0**29, 2.0**30, None) for i in range(4)],
        "athlete_id string, source_file string, timestamp timestamp_ntz, position_lat double, position_long double, power double")
    got = R.route_points(df).orderBy("seq").collect()
    assert [(r.seq, r.lat, r.lon, r.power) for r in got] == [(i, 45.0, 90.0, 0.0) for i in range(3)]
    assert R.route_centre(R.route_points(df)).first().points == 3


def test_nearest_place_at_any_distance(spark):
    """Marks at arbitrary places, gaps of many miles, ties to both sides and routes that go back."""
    rnd = random.Random(7)
    places, marks = [], []
    for f in "abcdef":
        at = [round(rnd.choice([rnd.random() * 3, 40 + rnd.random(), 500.0, -2.5]), rnd.choice([0, 1, 5])) for _ in range(rnd.randrange(1, 60))]
        places += [("a", f, x, i) for i, x in enumerate(at)] + [("a", f, None, 99)]
        marks += [("a", f, k, rnd.choice([round(rnd.random() * 60, 1), 520.25, -7.0, 250.0, 1.5])) for k in range(30)]
    marks += [("a", "none", 1, 1.0), ("a", "a", 77, None)]
    got = R.nearest_places(spark.createDataFrame(marks, "athlete_id string, source_file string, k int, at_mi double"),
                           spark.createDataFrame(places, "athlete_id string, source_file string, distance_mi double, seq long"), R.ACTIVITY)
    want = {}
    for _, f, k, x in marks:
        if x is not None:
            want[f, k] = min(((abs(d - x), i) for _, g, d, i in places if g == f and d is not None), default=(0, None))[1]
    assert {(r.source_file, r.k): r.seq for r in got.collect()} == want
