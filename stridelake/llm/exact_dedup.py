"""Exact dedup by progressive refinement: length, then a hash of the beginning, then a full hash.

Texts are equal when identical after lower-casing A-Z only. A stage looks only at groups that the
stage before left with two rows or more; the full content is hashed only for what survives both. Of
equal texts the row with the largest doc_id stays. Null texts are empty, and empty texts are equal.
Rows repeating a doc_id with the same text count each in ``group_size``; they stay together. Rows of one doc_id
with different texts are judged each by its own text.

Lower-casing A-Z keeps every byte's place, so lengths need no normalising. Between the stages bounded
filters (``common.maybe_in``) thin the rows in place: a filter lets through what it need not, which is then
hashed in vain, but nothing that recurs is lost, and no text is shuffled. Of literal repeats (one doc_id, equal
texts) ``deduplicated`` keeps one row.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, maybe_in, one_each, texts, without

PREFIX_CHARS = 64


@F.arrow_udf(T.BinaryType())
def full_hash(text: pa.Array) -> pa.Array:
    """SHA-256 of the text with A-Z lower-cased, in UTF-8."""
    return pa.array([hashlib.sha256(t.lower()).digest() for t in text.cast(pa.binary()).to_pylist()], pa.binary())


def _keys(text: Column) -> list[Column]:
    """(len, start): bytes, and hash of the lower-cased beginning; translate() maps A-Z alone and 64 characters cost little."""
    start = F.translate(F.substring(text, 1, PREFIX_CHARS), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return [F.octet_length(text).alias("len"), F.xxhash64(start).alias("start")]


def verdicts(docs: DataFrame) -> DataFrame:
    """(doc_id, _len, _raw, _sha, _rows, keep_id, group_size) of the documents, by id and text, with an equal one.

    ``_raw`` is a hash of the text as it is, by which rows of one doc_id are told apart without a full hash.
    """
    content = texts(docs).select("*", *_keys(F.col("text")))
    keys = content.select("len", "start")
    lengths = keys.groupBy("len").count().where("count > 1")
    starts = cut(maybe_in(keys, F.col("len"), lengths, F.col("len")).groupBy("len", "start").count().where("count > 1"), compact=True)
    alive = maybe_in(content, F.xxhash64("len", "start"), starts, F.xxhash64("len", "start"))
    full = cut(alive.select("doc_id", F.col("len").alias("_len"), F.xxhash64("text").alias("_raw"), full_hash("text").alias("_sha"))
               .groupBy("doc_id", "_len", "_raw", "_sha").agg(F.count("*").alias("_rows")), compact=True)
    # kept as a table, so that both sides of the join are dealt anew and a hot text can be split
    groups = cut(full.groupBy("_len", "_sha").agg(F.max("doc_id").alias("keep_id"), F.sum("_rows").alias("group_size"))
                 .where("group_size > 1"), compact=True)
    return full.join(groups, ["_len", "_sha"]).select("doc_id", "_len", "_raw", "_sha", "_rows", "keep_id", "group_size")


def marked(rows: DataFrame, found: DataFrame, sha: str | None = None) -> DataFrame:
    """``rows`` of documents with keep_id, group_size and kept from the ``found`` verdicts.

    ``sha`` names the column with the hexadecimal full hash; without it a doc_id must have one text.
    """
    keys = ["doc_id"] if sha is None else ["doc_id", sha]
    of = found.select("doc_id", *([] if sha is None else [F.lower(F.hex("_sha")).alias(sha)]), "keep_id", "group_size").distinct()
    return rows.join(of, keys, "left").select(
        *rows.columns, F.coalesce("keep_id", "doc_id").alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce(F.col("keep_id") == F.col("doc_id"), F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """Rows of ``docs``, with all their columns, without the dropped copies; literal repeats leave one row."""
    found = cut(verdicts(docs), compact=True)
    text = F.coalesce("text", F.lit(""))
    own = [F.col("doc_id").cast("long"), F.octet_length(text), F.xxhash64(text)]
    rest = without(docs.where(F.col("doc_id").isNotNull()), own, found.where("keep_id <> doc_id").select("doc_id", "_len", "_raw"))
    same = Window.partitionBy("doc_id", "_len", "_sha")
    repeats = (found.where("keep_id = doc_id").withColumn("_all", F.sum("_rows").over(same)).where("_all > 1").select("doc_id", "_len", "_raw"))
    return one_each(rest, repeats.select("doc_id"), full_hash(text))
