from stridelake.operators import strength as O

LOG = "athlete_id string, log_seq int, date string, body_weight double, exercises array<struct<name:string,sets:array<struct<set:int,weight:double,reps:int>>>>"


def _log(spark, entries):
    return spark.createDataFrame([("a", i, d, bw, [(n, [(k + 1, float(w), r) for k, (w, r) in enumerate(sets)]) for n, sets in ex])
                                  for i, (d, bw, ex) in enumerate(entries)], LOG)


ENTRIES = [
    ("2024-01-05", None, [("squat", [(100, 20), (110, 1)]), ("pull_ups", [(0, 5), (10, 5)])]),
    ("2024-01-03", 160.0, [("squat", [(120, 1), (60, 30)]), ("plank", [(0, 1)])]),
    ("2024-02-01", 0.0, [("squat", [(120, 2)]), ("squat", [(50, 1)])]),
]


def test_weights_that_count(spark):
    got = {(r.log_seq, r.name, r.set_pos): r.lifted for r in O.exploded_sets(_log(spark, ENTRIES), 133).collect() if r.name != "squat"}
    assert got == {(0, "pull_ups", 0): 133.0, (0, "pull_ups", 1): 143.0, (1, "plank", 0): 160.0}
    assert {r.log_seq: r.volume for r in O.session_volume(_log(spark, ENTRIES)).collect()}[1] == 120 + 1800 + 160


def test_record_restarts_at_the_first_heaviest_set(spark):
    since = {r.name: r for r in O.personal_records(_log(spark, ENTRIES)).collect()}["squat"]
    # the estimate from 100 x 20 is better, but came before the heaviest set
    assert (since.max_weight, since.max_date, since.e1rm_weight, since.e1rm_reps, since.e1rm_date) == (120.0, "2024-01-03", 120.0, 2, "2024-02-01")
    best = {r.name: r for r in O.personal_records(_log(spark, ENTRIES), "all_time").collect()}["squat"]
    assert (best.max_weight, best.e1rm_weight, best.e1rm_reps) == (120.0, 100.0, 20)


def test_growth_counts_occurrences_by_date(spark):
    got = sorted(((r.occurrence, r.date, r.volume, r.pct_change) for r in O.exercise_growth(_log(spark, ENTRIES), ["squat"]).collect()))
    assert got == [(1, "2024-01-03", 1920.0, None), (2, "2024-01-05", 2110.0, 9.9), (3, "2024-02-01", 240.0, -87.5), (4, "2024-02-01", 50.0, -97.4)]


def test_upsert_extends_the_first_workout_of_a_date(spark):
    log = _log(spark, [("2024-01-01", None, [("row", [(1, 1)])]), ("2024-01-01", None, [("dips", [(1, 1)])])])
    new = _log(spark, [("2024-01-01", None, [("squat", [(5, 5)])]), ("2024-01-02", 150.0, [("row", [(2, 2)])]), ("2024-01-02", None, [("dips", [(3, 3)])])])
    got = sorted((r.date, [e.name for e in r.exercises]) for r in O.upsert(log, new).collect())
    assert got == [("2024-01-01", ["dips"]), ("2024-01-01", ["row", "squat"]), ("2024-01-02", ["row", "dips"])]


def test_detail_text(spark):
    got = {r.exercise: r.sets for r in O.workout_detail(_log(spark, ENTRIES[:1])).collect()}
    assert got == {"Squat": "20x100lb | 1x110lb", "Pull Ups": "5xBW | 5x10lb"}


def test_workout_log_file(spark, tmp_path):
    import json

    from stridelake.sources.workout_files import read_workouts

    log = [{"date": "2024-01-02", "body_weight": 140.0, "exercises": [{"name": " Bench Press", "sets": [{"set": 1, "weight": 100, "reps": 5}]}]},
           {"date": "2024-01-03", "exercises": []}]
    (tmp_path / "log.json").write_text(json.dumps(log))
    (tmp_path / "other.json").write_text("[1, 2")
    got = read_workouts(spark, str(tmp_path), "a")
    assert [(r.date, r.body_weight) for r in got.orderBy("date").collect()] == [("2024-01-02", 140.0), ("2024-01-03", None)]
    assert [(r.name, r.lifted, r.reps) for r in O.exploded_sets(got).collect()] == [("bench_press", 100.0, 5)]
    assert read_workouts(spark, str(tmp_path / "none"), "a").count() == 0
