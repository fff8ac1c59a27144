"""Committed batches: what readers see after crashes, retries, rebuilds, and what a batch reads."""

import json
import threading

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stridelake.sources import messages as M
from stridelake.sources.ledger import UNDATED, Ledger, placed, within_places
from stridelake.sources.workout_files import read_workouts
from stridelake.streaming import message_stream

MSG = "athlete_id string, source_file string, msg_type string, fields string"


def record(f, n, day=1):
    return ("a", f, "record_mesgs", json.dumps({"timestamp": f"2024-05-{day:02d} 10:00:{n:02d}", "power": n}))


def undated(f, n):
    return ("a", f, "split_summary_mesgs", json.dumps({"num_splits": n, "split_type": "climb"}))


def seen(store, msg_type="record_mesgs", column="power"):
    found = store.read(msg_type)
    return [] if found is None else sorted((r.source_file, r[column]) for r in found.collect())


def test_a_crash_between_two_tables_shows_nothing_and_a_retry_gives_one_copy(spark, tmp_path):
    store = Ledger(spark, str(tmp_path))
    rows = spark.createDataFrame([record("f", 1), record("f", 2, 2), undated("f", 7)], MSG)
    store.stage(rows, "one", ["record_mesgs"])  # the process ends before the second table
    assert seen(store) == [] and store.entries() is None
    store.append(rows, "one")
    store.append(rows, "one")
    assert seen(store) == [("f", 1.0), ("f", 2.0)] and seen(store, "split_summary_mesgs", "num_splits") == [("f", 7.0)]
    store.stage(spark.createDataFrame([record("g", 3), undated("g", 8)], MSG), "two")  # before its commit
    assert len(seen(store)) == 2 and {r.source_file for r in store.entries().collect()} == {"f"}
    store.append(spark.createDataFrame([record("g", 3), undated("g", 8)], MSG), "two")
    assert len(seen(store)) == 3 and store.entries().agg(F.sum("rows")).first()[0] == 5


def test_known_sources_are_skipped_by_the_entries(spark, tmp_path):
    store = Ledger(spark, str(tmp_path))
    store.append(spark.createDataFrame([record("f", 1)], MSG), "one")
    again = spark.createDataFrame([record("f", 5), record("h", 1), record("h", 6)], MSG)
    assert sorted(r.source_file for r in store.unknown(again).collect()) == ["h", "h"]
    store.append(again, "two")
    assert seen(store) == [("f", 1.0), ("h", 6.0)]  # the copy of a stored row is left out whatever its source
    store.append(again, "three", skip_known=False)
    assert seen(store) == [("f", 1.0), ("f", 5.0), ("h", 6.0)]


def test_a_rebuild_counts_from_its_commit(spark, tmp_path):
    store = Ledger(spark, str(tmp_path))
    store.append(spark.createDataFrame([record("f", 1), record("f", 2)], MSG), "one")
    store.stage(spark.createDataFrame([record("x", 9)], MSG), "again", rebuild=True)
    assert len(seen(store)) == 2
    store.append(spark.createDataFrame([record("x", 9), record("f", 1)], MSG), "again", rebuild=True)
    assert seen(store) == [("f", 1.0), ("x", 9.0)]
    store.append(spark.createDataFrame([record("y", 4)], MSG), "more")
    assert len(seen(store)) == 3


def test_a_batch_reads_its_days_and_buckets_only(spark, tmp_path):
    store = Ledger(spark, str(tmp_path))
    store.append(spark.createDataFrame([record(f"f{d}", d, d) for d in range(1, 20)] + [undated("f", n) for n in range(60)], MSG), "one")
    rows = placed(M.flatten_messages(spark.createDataFrame([undated("g", 3)], MSG), "split_summary_mesgs").drop("_bad"), "split_summary_mesgs")
    places = [(r.dt, r.bucket) for r in rows.select("dt", "bucket").collect()]
    assert places[0][0] == UNDATED
    for msg_type, where in (("split_summary_mesgs", places), ("record_mesgs", [(r.dt, 0) for r in store.read("record_mesgs").where("power in (3, 5)").collect()])):
        got = store.read(msg_type, where)
        scan = next(x for x in got._jdf.queryExecution().executedPlan().toString().splitlines() if "PartitionFilters" in x)
        assert ("bucket" if msg_type == "split_summary_mesgs" else "dt") in scan.split("PartitionFilters")[1]
        assert 0 < got.count() < store.read(msg_type).count()
    assert spark.range(1).filter(F.lit(False)).count() == 0 and within_places([]) is not None


def test_batch_ids_name_folders(spark, tmp_path):
    with pytest.raises(ValueError):
        Ledger(spark, str(tmp_path)).stage(spark.createDataFrame([record("f", 1)], MSG), "7")


def test_streamed_rows_without_a_day_lie_in_buckets(spark, tmp_path):
    rows = spark.createDataFrame([undated("f", n) for n in range(40)], MSG)
    for _ in range(2):
        message_stream.append_batch(rows, str(tmp_path), ["split_summary_mesgs"])
    back = spark.read.parquet(f"{tmp_path}/split_summary_mesgs")
    assert back.count() == 40 and back.select("bucket").distinct().count() > 8


def test_misfits_are_judged_by_type(spark):
    rows = [("a", "f", "record_mesgs", json.dumps({"power": "[n/a]", "cadence": [1], "heart_rate": "12", "speed": True, "distance": {"x": 1}}))]
    got = M.ingest_report(spark.createDataFrame(rows, MSG), {}).first()
    assert (got.unparsable, got.misfit_values) == (0, 1)


def test_workout_order_does_not_depend_on_files(spark, tmp_path):
    log = [{"date": f"2024-01-{1 + k % 5:02d}", "body_weight": k, "exercises": [{"name": " Bench Press", "sets": [{"set": 1, "weight": k, "reps": 5}]}]} for k in range(23)]
    (tmp_path / "one").mkdir()
    (tmp_path / "many" / "athlete_id=a").mkdir(parents=True)
    (tmp_path / "one" / "log.json").write_text(json.dumps(log))
    for k in range(0, 23, 5):
        (tmp_path / "many" / "athlete_id=a" / f"log-{k:03d}.json").write_text(json.dumps(log[k : k + 5]))
    (tmp_path / "many" / "athlete_id=a" / "note.txt").write_text("no log")
    one, many = read_workouts(spark, str(tmp_path / "one"), "a"), read_workouts(spark, str(tmp_path / "many"))
    assert sorted(map(str, one.collect())) == sorted(map(str, many.collect()))
    assert [(r.log_seq, r.body_weight) for r in many.orderBy("log_seq").collect()] == [(k, float(k)) for k in range(23)]


def test_types_of_a_batch_are_staged_side_by_side(spark, tmp_path, monkeypatch):
    meet, stage_type = threading.Barrier(2, timeout=60), Ledger._stage_type

    def staged(self, messages, batch, msg_type, rebuild):
        meet.wait()  # one type after the other never meet
        return stage_type(self, messages, batch, msg_type, rebuild)

    monkeypatch.setattr(Ledger, "_stage_type", staged)
    store = Ledger(spark, str(tmp_path))
    store.append(spark.createDataFrame([record("f", 1), record("f", 2, 2), undated("f", 7)], MSG), "one", ["record_mesgs", "split_summary_mesgs"])
    assert seen(store) == [("f", 1.0), ("f", 2.0)] and seen(store, "split_summary_mesgs", "num_splits") == [("f", 7.0)]
    entries = sorted((r.msg_type, str(r.dt), r.rows, r.batch) for r in store.entries().collect())
    assert entries == [("record_mesgs", "2024-05-01", 1, "one"), ("record_mesgs", "2024-05-02", 1, "one"), ("split_summary_mesgs", str(UNDATED), 1, "one")]


def test_a_type_that_fails_fails_the_batch(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(Ledger, "_write", lambda self, rows, path: 1 / 0)
    store = Ledger(spark, str(tmp_path))
    with pytest.raises(ZeroDivisionError):
        store.append(spark.createDataFrame([record("f", 1), undated("f", 7)], MSG), "one")
    assert not store.committed("one") and seen(store) == [] and store.entries() is None


def test_unseen_rows_are_worked_out_once(spark, tmp_path, monkeypatch):
    store, rows, without_stored = Ledger(spark, str(tmp_path)), spark.sparkContext.accumulator(0), M.without_stored
    store.append(spark.createDataFrame([record("f", n, 1 + n % 3) for n in range(10)], MSG), "one")

    def counted(new, stored):
        def passes(_):
            rows.add(1)
            return True

        passed = F.udf(passes, "boolean").asNondeterministic()  # stays behind the join
        return without_stored(new, stored).filter(passed("source_file"))

    monkeypatch.setattr(M, "without_stored", counted)
    store.append(spark.createDataFrame([record("g", n, 1 + n % 3) for n in range(16)], MSG), "two", ["record_mesgs"], skip_known=False)
    assert rows.value == 6 and len(seen(store)) == 16
    assert sum(r.rows for r in store.entries().collect() if r.batch == "two") == 6


def test_fields_of_any_name_are_found(spark):
    schema = T.StructType([T.StructField("it's \\ \"x\"", T.DoubleType()), T.StructField("a`b", T.StringType()), T.StructField("c d", T.DoubleType())])
    document = json.dumps({"it's \\ \"x\"": True, "a`b": "true", "c d": "[1]", "e": {"x": 1}, "f": "{y}", "g": None})
    rows = M.flatten_messages(spark.createDataFrame([("a", "f", "t", document), ("a", "f", "t", "{")], MSG), "t", schema)
    good, bad = sorted((tuple(r) for r in rows.collect()), key=lambda r: r[2])
    assert good == ("a", "f", False, 1.0, "true", None, '{"f":"{y}"}') and bad == ("a", "f", True, None, None, None, None)
