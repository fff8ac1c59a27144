"""Every text operator and pipeline stage on null, empty, long, tied and repeated rows, empty tables, clashing columns."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stridelake.llm import bpe, decontaminate, exact_dedup, html_text, line_dedup, quality, simhash, substring_dedup, toxicity, url_filters
from stridelake.llm.queries import QUERIES

LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(40_000))
ROWS = [(1, "The same text here"), (2, "the SAME text here"), (3, None), (4, ""), (5, LONG), (6, LONG), (7, " \n\t "),
        (8, "ümläut ñ 日本 \U0001f600 <|endoftext|>"), (9, "short"), (10, "a " * 30), (11, "twin row"), (11, "twin row"), (None, "no id"), (None, None)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep_id string, kept int, key0 string, flag int, word string, words string, n int, start int, key string, fp int, score string, blocks int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, None, "s", None, "k", 1, "k0", 7, "wd", "w", 2, 3, "y", 4, "z", 5) for i, t in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "same text", "x"), (2, None, None), (3, "", None), (None, "twin row", None), (1, "same text", "x")],
                                 "item_id long, text string, spans string")


def model():
    return quality.RuleModel(0.5, [(1.0, ((0, True, 1.0),))])


OPERATORS = {
    "simhash": lambda d, b: simhash.classes(d),
    "bpe": lambda d, b: bpe.round_trip(d),
    "bpe_ids": lambda d, b: bpe.decode(bpe.encode(d)),
    "exact": lambda d, b: exact_dedup.marked(d.where("doc_id is not null").select("doc_id"), exact_dedup.verdicts(d)),
    "decontaminate": decontaminate.scan,
    "decontaminate_blocks": lambda d, b: decontaminate.scan(d, b, block_bytes=80),
    "quality": lambda d, b: quality.score(d, model()),
    "lines": lambda d, b: line_dedup.deduplicated(d),
    "toxicity": lambda d, b: toxicity.score(d, toxicity.char_model(d), toxicity.Lexicon(0.01, {"shor": 0.9})),
    "substrings": lambda d, b: substring_dedup.removed(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_for_each_identified_row(docs, benchmark, name):
    got = Counter(r.doc_id for r in OPERATORS[name](docs, benchmark).collect())
    want = Counter(i for i, _ in ROWS if i is not None)
    assert got == want


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(docs, benchmark, name):
    assert OPERATORS[name](docs.where("false"), benchmark.where("false")).collect() == []


def test_empty_benchmark_hits_nothing(docs, benchmark):
    assert all(not r["items"] for r in decontaminate.scan(docs, benchmark.where("false")).collect())


STAGES = dict(corpus_pipeline.STAGES)


def folder(spark, path, docs, benchmark, labels):
    docs.write.parquet(f"{path}/documents.parquet")
    benchmark.write.parquet(f"{path}/benchmark.parquet")
    labels.write.parquet(f"{path}/labels.parquet")
    return str(path)


@pytest.mark.parametrize("empty", [False, True])
@pytest.mark.parametrize("name", STAGES)
def test_stage(spark, tmp_path, docs, benchmark, name, empty):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, None), (None, 1, 1), (4, None, None), (6, 0, 1)], "doc_id long, quality int, toxic int")
    d = docs.where("false") if empty else docs
    sf_dir = folder(spark, tmp_path, d, benchmark, labels.where("false") if empty else labels)
    out = STAGES[name](spark, d, sf_dir)
    if name != corpus_pipeline.STAGES[-1][0]:
        assert out.schema.names == docs.schema.names
    rows = out.collect()
    assert not empty or rows == []
    ids = [r.doc_id for r in rows]
    if empty:
        return
    if name == "exact_dedup":
        assert sorted(ids) == [2, 4, 6, 7, 8, 9, 10, 11]
    if name == "benchmark_decontamination":
        assert sorted(i for i in ids if i) == [3, 4, 5, 6, 7, 8, 9, 10]
    if name == "simhash_near_dedup":
        assert sorted(ids) == [1, 3, 5, 8, 9, 10, 11]
    if name == "quality_classifier":
        assert any(i is None for i in ids) or len(ids) < len(ROWS)


def test_pipeline_runs_on_an_empty_corpus(spark, tmp_path, docs, benchmark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert corpus_pipeline.run(spark, folder(spark, tmp_path, docs.where("false"), benchmark, labels)).collect() == []


def test_pages_and_captures(spark):
    pages = spark.createDataFrame([(1, "http://A.example/x", "<p>a<p>b", "t"), (1, "http://A.example/x", "<p>a<p>b", "t"), (2, None, None, "t"),
                                   (None, "nonsense", "", "t"), (None, "http://a.example/x", "", "t")], "page_id long, url string, html string, text string")
    got = html_text.extract(pages).collect()
    assert sorted((r.page_id or 0, r.text) for r in got) == [(0, ""), (0, ""), (1, "a\n\nb"), (1, "a\n\nb"), (2, "")]
    assert html_text.extract(pages.where("false")).collect() == []
    captures = pages.withColumn("fetched", F.when(F.col("url") != "nonsense", F.lit("2024-02-01").cast("date")))
    entries = spark.createDataFrame([("l", "host", "a.example", "add", "2024-01-01", 1), (None, "host", "a.example", "add", "2024-01-01", 1),
                                     ("l", "host", None, "add", None, 1)], "list string, kind string, value string, action string, day string, blocked int")
    entries = entries.withColumn("day", F.col("day").cast("date"))
    got = url_filters.evaluate(captures, entries).collect()
    assert sorted((r.page_id or 0, r.blocked) for r in got) == [(0, False), (0, True), (1, True), (1, True), (2, False)]
    assert not any(r.blocked for r in url_filters.evaluate(captures, entries.where("false")).collect())
    assert url_filters.evaluate(captures.where("false"), entries).collect() == []


def test_all_are_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 14))
