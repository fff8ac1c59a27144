import json

import pytest
from pyspark.sql import functions as F

from stridelake.operators import sleep as O
from stridelake.sources import sleep_files as R


def _night(day, **more):
    return {"calendarDate": day, "deepSleepSeconds": 3600, "lightSleepSeconds": 7200, "remSleepSeconds": 1800, "awakeSleepSeconds": 600, **more}


@pytest.fixture
def exports(tmp_path):
    folder = tmp_path / "athlete_id=a"
    folder.mkdir()
    (folder / "1_sleepData.json").write_text(json.dumps([_night("2024-05-01"), _night("2024-05-02"), {"calendarDate": "2024-05-03"}]))
    (folder / "2_sleepData.json").write_text(json.dumps([
        _night("2024-05-02", spo2SleepSummary={"averageSPO2": 95.5, "lowestSPO2": 88, "averageHR": 51.0}, sleepScores={"overallScore": 81, "feedback": "OK"}, awakeCount=2)]))
    (folder / "3_sleepData.json").write_text(json.dumps({"calendarDate": "2024-05-09"}))
    (folder / "other.json").write_text("[]")
    head = "Label,Value\n"
    (folder / "Sleep-a.csv").write_text(head + "Calendar Date,05/02/2024\nDeep Sleep,1:00:00\n")
    (folder / "sleep-b.csv").write_text(head + "Date,2024/05/04\nDeep Sleep,1h 30m\nDEEP sleep duration,90\nTotal Sleep,7:32:10\nAwake,10m\nSleep Score,\"1,081\"\nSleep Efficiency,\"96 %\"\n")
    (folder / "sleep-c.csv").write_text(head + "Deep Sleep,1:00:00\n")
    (folder / "steps.csv").write_text(head + "Date,2024-05-05\n")
    return str(tmp_path)


def test_json_files_flatten_and_skip_other_documents(spark, exports):
    got = R.read_sleep_json(spark, exports).orderBy("calendar_date", "seq").collect()
    assert [(r.athlete_id, r.calendar_date) for r in got] == [("a", d) for d in ("2024-05-01", "2024-05-02", "2024-05-02", "2024-05-03")]
    full, empty = got[2], got[3]
    assert (full.avg_spo2, full.lowest_spo2, full.score_overall, full.awake_count, full.feedback) == (95.5, 88, 81, 2, "OK")
    assert (full.total_sleep_sec, full.total_in_bed_sec, full.sleep_efficiency_pct, full.deep_hrs) == (12600, 13200, 95.5, 1.0)
    assert (empty.deep_sec, empty.total_in_bed_sec, empty.sleep_efficiency_pct, empty.score_overall) == (0, 0, None, None)


def test_csv_files_parse_by_label(spark, exports):
    got = {r.calendar_date: r for r in R.read_sleep_csv(spark, exports).collect()}
    assert sorted(got) == ["2024-05-02", "2024-05-04"]
    b = got["2024-05-04"]
    assert (b.deep_sec, b.total_sleep_sec, b.awake_sec, b.total_in_bed_sec) == (90, 27130, 600, 27730)
    assert (b.score_overall, b.sleep_efficiency_pct, b.deep_hrs, b.rem_hrs) == (1081, 96.0, 0.025, None)
    a = got["2024-05-02"]
    assert (a.total_in_bed_sec, a.sleep_efficiency_pct, a.light_sec) == (None, None, None)


def test_merge_prefers_documents_then_csv_then_stored(spark, exports):
    docs, csv = R.read_sleep_json(spark, exports), R.read_sleep_csv(spark, exports)
    first = R.merge_nights(None, docs, csv)
    got = {r.calendar_date: r for r in first.collect()}
    assert sorted(got) == ["2024-05-01", "2024-05-02", "2024-05-03", "2024-05-04"] and got["2024-05-02"].score_overall == 81
    stored = first.withColumn("feedback", F.lit("stored")).unionByName(first.limit(1).withColumn("calendar_date", F.lit("2020-01-01")).withColumn("feedback", F.lit("stored")))
    again = {r.calendar_date: r for r in R.merge_nights(stored, docs.filter("calendar_date <> '2024-05-01'"), csv).collect()}
    assert len(again) == 5 and again["2024-05-01"].feedback == "stored" and again["2024-05-02"].feedback == "OK" and again["2020-01-01"].feedback == "stored"
    stats = R.merge_stats(docs, csv).first()
    assert (stats.csv_rows_added, stats.csv_rows_skipped) == (1, 1)


def test_trend_windows_and_unknown_metric(spark):
    nights = spark.createDataFrame([("a", f"2024-05-{d:02d}", float(d) if d != 5 else None) for d in range(1, 21)], "athlete_id string, calendar_date string, deep_hrs double")
    got = O.metric_trend(nights, "deep_hrs", 10).orderBy("calendar_date").collect()
    assert [r.calendar_date for r in got] == [f"2024-05-{d}" for d in range(10, 21)]
    assert got[0].rolling_avg == 10.0 and got[-1].rolling_avg == 17.0
    assert O.metric_trend(nights, "deep_hrs").count() == 19 and O.metric_trend(nights, "nope").count() == 0
