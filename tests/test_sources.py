import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from stridelake.sources import messages as M
from stridelake.sources import schemas as S
from stridelake.sources import sinks, tables
from stridelake.streaming import message_stream

MSG = "athlete_id string, source_file string, msg_type string, fields string"


def _msg(f, fields, kind="record_mesgs", a="a"):
    return (a, f, kind, fields if isinstance(fields, str) else json.dumps(fields))


def _second(n, **more):
    return {"timestamp": f"2024-05-01 10:00:{n:02d}", "power": 200 + n, **more}


def test_declared_column_counts():
    assert len(S.session_schema("cycling")) == 51 + 25 and len(S.session_schema("running")) == 51 + 11
    assert len(S.session_schema("hiking")) == 51 + 6 and len(S.session_schema("climbing")) == 53 and len(S.session_schema("skiing")) == 51
    assert len(S.record_schema("cycling")) == 14 + 21 and len(S.record_schema("skiing")) == 14
    assert len(S.SPLIT_SCHEMA) == 20 and len(S.SPLIT_SUMMARY_SCHEMA) == 15 and len(S.SLEEP_SCHEMA) == 31
    with pytest.raises(ValueError):
        S.session_schema("curling")


def test_flatten_types_values_and_drops_nested(spark):
    rows = [_msg("f", _second(1, heart_rate=120, grit=True, flow="n/a", cycles=[1, 2], stance_time={"x": 1}, activity_type="road")),
            _msg("f", "{broken"), _msg("f", {"sport": "cycling"}, "session_mesgs")]
    got = M.flatten_messages(spark.createDataFrame(rows, MSG), "record_mesgs").orderBy("_bad").collect()
    assert len(got) == 2 and got[1]._bad
    r = got[0]
    assert (r.power, r.heart_rate, r.grit, r.flow, r.cycles, r.stance_time, r.activity_type) == (201.0, 120.0, 1.0, None, None, None, "road")
    assert r.timestamp == dt.datetime(2024, 5, 1, 10, 0, 1)


def test_ingest_skips_known_activities_and_dedups_copies(spark):
    first = spark.createDataFrame([_msg("b.fit", _second(i)) for i in range(3)], MSG)
    stored = M.ingest(first, {})["record_mesgs"]
    again = spark.createDataFrame(
        [_msg("b.fit", _second(9)), _msg("a.fit", _second(0)), _msg("c.fit", _second(5)), _msg("c.fit", "{no")], MSG)
    got = M.ingest(again, {"record_mesgs": stored})["record_mesgs"]
    assert sorted((r.source_file, r.power) for r in got.collect()) == [("a.fit", 200.0), ("b.fit", 201.0), ("b.fit", 202.0), ("c.fit", 205.0)]
    report = {r.source_file: r for r in M.ingest_report(again, {"record_mesgs": stored}).collect()}
    assert report["b.fit"].skipped and not report["c.fit"].skipped and report["c.fit"].unparsable == 1
    rebuilt = M.ingest(again, {"record_mesgs": stored}, rebuild=True)["record_mesgs"]
    assert sorted(r.source_file for r in rebuilt.collect()) == ["a.fit", "b.fit", "c.fit"]


def test_align_keeps_the_stored_type(spark):
    old = spark.createDataFrame([(1.5, None, "x")], "n double, empty void, only_old string")
    new = spark.createDataFrame([("2", 7, 1), ("bad", 8, 2)], "n string, empty int, only_new int")
    left, right = M.align(old, new)
    assert left.dtypes == right.dtypes == [("empty", "int"), ("n", "double"), ("only_new", "int"), ("only_old", "string")]
    assert [tuple(r) for r in right.orderBy("empty").collect()] == [(7, 2.0, 1, None), (8, None, 2, None)]


def test_dedup_treats_nulls_as_equal(spark):
    df = spark.createDataFrame([("b", None, 1), ("a", None, 1), ("c", 2.0, 1)], "source_file string, x double, y int")
    assert sorted(r.source_file for r in M.dedup(df).collect()) == ["a", "c"]


def test_drift_names_undeclared_columns(spark):
    got = M.schema_drift(spark, {"record_mesgs": ["power", "core_temp", "athlete_id"], "split_mesgs": ["zzz"]}).collect()
    assert [tuple(r) for r in got] == [("record_mesgs", "core_temp")]


def test_lookback_reaches_the_reader_and_needs_its_column(spark, tmp_path):
    df = spark.createDataFrame([("a", "f", dt.datetime(2024, 1, 1) + dt.timedelta(days=30 * i), 1.0) for i in range(12)],
                               "athlete_id string, source_file string, timestamp timestamp_ntz, power double")
    path = str(tmp_path / "record_mesgs")
    df.write.parquet(path)
    data = tables.Dataset(str(tmp_path), "a")
    got = data.read(spark, "record_mesgs", "2024-12-01")
    assert got.count() == 6
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "GreaterThanOrEqual(timestamp" in plan
    assert data.read(spark, "record_mesgs", "2024-12-01", ["power"]).count() == 12
    with pytest.raises(ValueError):
        tables.Dataset("s3a://bucket")
    with pytest.raises(ValueError):
        tables.Dataset(str(tmp_path), " ")


def test_lookback_does_not_depend_on_day_folders(spark, tmp_path):
    df = spark.createDataFrame([("a", dt.datetime(2024, 1, 1) + dt.timedelta(days=30 * i), dt.date(2024, 1, 1) + dt.timedelta(days=30 * i), 1.0) for i in range(12)],
                               "athlete_id string, timestamp timestamp_ntz, dt date, power double")
    df.write.partitionBy("dt").parquet(str(tmp_path / "days" / "record_mesgs"))
    df.drop("dt").write.parquet(str(tmp_path / "flat" / "record_mesgs"))
    for layout in ("days", "flat"):
        data = tables.Dataset(str(tmp_path / layout), "a")
        assert data.read(spark, "record_mesgs", "2024-12-01", ["power"]).count() == 12
        assert data.read(spark, "record_mesgs", "2024-12-01", ["timestamp", "power"]).count() == 6
        assert data.read(spark, "record_mesgs", "2024-12-01").count() == 6


def test_loads(spark):
    df = spark.createDataFrame([("a", "f", "alpine_skiing", "4"), ("a", "g", "running", "x")], "athlete_id string, source_file string, sport string, num_laps string")
    got = tables.load_sessions(df, "skiing")
    assert [(r.source_file, r.num_laps, r.athlete_id) for r in got.collect()] == [("f", 4.0, "a")]
    assert tables.load_sessions(None, "hiking", spark).count() == 0
    records = tables.load_records(df, "rowing", df.filter("source_file = 'g'"))
    assert [r.source_file for r in records.collect()] == ["g"] and "power" not in records.columns


def test_record_writer_partitions_by_day(spark, tmp_path):
    df = spark.createDataFrame([("a", "f", dt.datetime(2024, 5, 1 + i % 3, 5), float(i)) for i in range(30)],
                               "athlete_id string, source_file string, timestamp timestamp_ntz, power double")
    path = str(tmp_path / "records")
    sinks.write_records(tables.recent_records(df, "2024-05-10"), path)
    sinks.write_records(tables.recent_records(df, "2024-05-10"), path, mode="overwrite")
    back = spark.read.parquet(path)
    assert back.count() == 30 and back.select("dt").distinct().count() == 3
    sinks.write_json(back.limit(3), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 3


def test_stream_reads_each_file_once(spark, tmp_path):
    source, base, check = tmp_path / "in", str(tmp_path / "tables"), str(tmp_path / "check")
    source.mkdir()

    def drop(name, messages):
        (source / name).write_text("\n".join(json.dumps(dict(zip(("athlete_id", "source_file", "msg_type", "fields"), m))) for m in messages))

    def run():
        message_stream.run_available(spark, str(source), base, check, ["record_mesgs"]).awaitTermination()
        return sorted((r.source_file, r.power) for r in spark.read.parquet(f"{base}/record_mesgs").collect())

    drop("1.json", [_msg("a.fit", _second(i)) for i in range(3)])
    assert run() == [("a.fit", 200.0), ("a.fit", 201.0), ("a.fit", 202.0)]
    drop("2.json", [_msg("b.fit", _second(0)), _msg("b.fit", _second(7)), _msg("a.fit", _second(8))])
    # a source that is split over two batches loses nothing; a copy under another name adds nothing
    want = [("a.fit", 200.0), ("a.fit", 201.0), ("a.fit", 202.0), ("a.fit", 208.0), ("b.fit", 207.0)]
    assert run() == want and run() == want
    again = spark.createDataFrame([_msg("a.fit", _second(1)), _msg("c.fit", _second(9))], MSG)
    for _ in range(2):  # a retried batch
        message_stream.append_batch(again, base)
    assert run() == [*want, ("c.fit", 209.0)]
    assert "dt=" in str(list((tmp_path / "tables" / "record_mesgs").iterdir()))
