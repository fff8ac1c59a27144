"""Benchmark decontamination: one Aho-Corasick automaton over the benchmark's word windows.

Texts are lower-cased (A-Z) and cut into words of digits, letters and non-ASCII bytes. A window is 10
consecutive words of an item, or the whole of a shorter item. Each document is normalised and
scanned once; matches are mapped back to words and to byte offsets of the original text. Null
and wordless texts match nothing; items without words have no window; a null item_id is written
as an empty string; repeated items count once per item_id.

The automaton is broadcast, so its size is checked: windows beyond ``block_bytes`` are dealt to
further automata of that size, the documents are scanned by each, and the matches are merged.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, per_text, small_batches, texts

WINDOW_WORDS = 10
#: Windows' text in one automaton, at most.
BLOCK_BYTES = 16 << 20

_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_NORMAL = bytes(ord(chr(i).lower()) if i < 128 and _WORD[i] else i if _WORD[i] else 32 for i in range(256))

_WINDOWS = pa.schema([("win", pa.binary()), ("item", pa.string())])
_SPAN = pa.struct([("from_word", pa.int64()), ("to_word", pa.int64()), ("from_byte", pa.int64()), ("to_byte", pa.int64())])
_SCAN = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(_SPAN)), ("items", pa.list_(pa.string()))])
_SCAN_DDL = ("doc_id long, n_words long, spans array<struct<from_word: long, to_word: long, from_byte: long, to_byte: long>>, "
             "items array<string>")


def words(text: bytes) -> list[bytes]:
    return text.translate(_NORMAL).split()


def windows(benchmark: DataFrame, size: int = WINDOW_WORDS) -> DataFrame:
    """Distinct windows with the items that have them."""

    def cut_item(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                w = words(text.encode())
                out += [(b" ".join(w[i : i + size]), item) for i in range(max(1, len(w) - size + 1)) if w]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], f.type) for k, f in enumerate(_WINDOWS)], schema=_WINDOWS)

    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")), F.coalesce("text", F.lit("")))
    return items.mapInArrow(cut_item, "win binary, item string").groupBy("win").agg(F.collect_set("item").alias("items"))


def _scanner(patterns: list[tuple[bytes, list[str]]]) -> Callable[[], Callable[[int, bytes], Iterable[tuple]]]:
    def prepare() -> Callable[[int, bytes], Iterable[tuple]]:
        import ahocorasick

        # words stand between single spaces, so a match of " w1 ... wk " keeps to whole words
        machine = ahocorasick.Automaton()
        for k, (win, _) in enumerate(patterns):
            machine.add_word(f" {win.decode('latin-1')} ", (k, win.count(b" ") + 1))
        if patterns:
            machine.make_automaton()

        def scan(doc_id: int, text: bytes) -> Iterable[tuple]:
            own = words(text)
            found = list(machine.iter(f" {b' '.join(own).decode('latin-1')} ")) if own and patterns else []
            if not found:
                return [(doc_id, len(own), [], [])]
            # place of the space after word i in the normalised text
            after = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1)
            to = np.searchsorted(after, np.fromiter((e for e, _ in found), np.int64, len(found))) + 1
            size = np.fromiter((n for _, (_, n) in found), np.int64, len(found))
            mark = np.zeros(len(own) + 1, np.int64)
            np.add.at(mark, to - size, 1)
            np.add.at(mark, to, -1)
            edge = np.diff(np.concatenate(([0], (np.cumsum(mark[:-1]) > 0).view(np.int8), [0])))
            starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            inside = np.diff(np.concatenate(([0], _WORD[np.frombuffer(text, np.uint8)].view(np.int8), [0])))
            first, last = np.flatnonzero(inside == 1), np.flatnonzero(inside == -1)
            spans = [{"from_word": s, "to_word": e, "from_byte": first[s], "to_byte": last[e - 1]}
                     for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
            return [(doc_id, len(own), spans, sorted({i for k in {k for _, (k, _) in found} for i in patterns[k][1]}))]

        return scan

    return prepare


def _blocks(win: DataFrame, block_bytes: int) -> list[DataFrame]:
    """The windows in parts of about ``block_bytes``; 64 bytes stand for a window's item ids."""
    total = win.agg(F.sum(F.octet_length("win") + 64)).first()[0] or 0
    n = -(-total // block_bytes)
    if n <= 1:
        return [win]
    win = cut(win.withColumn("_block", F.pmod(F.xxhash64("win"), F.lit(n))))
    return [win.where(F.col("_block") == k) for k in range(n)]


def _patterns(block: DataFrame) -> list[tuple[bytes, list[str]]]:
    return sorted((bytes(r.win), sorted(r["items"])) for r in block.collect())


def scan(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_words, spans, items) of every document.

    ``spans`` are the hit stretches, with word numbers and byte offsets in the original text (ends
    are exclusive); ``items`` are the item ids with an occurring window.
    """
    content, blocks = texts(docs), _blocks(windows(benchmark, size), block_bytes)
    if len(blocks) == 1:
        return per_text(content, None, _SCAN, _SCAN_DDL, _scanner(_patterns(blocks[0])))
    parts = None
    for block in blocks:
        part = cut(per_text(content, None, _SCAN, _SCAN_DDL, _scanner(_patterns(block))).where(F.size("items") > 0))
        parts = part if parts is None else parts.union(part)
    merged = parts.distinct().groupBy("doc_id").agg(F.flatten(F.collect_list("spans")).alias("_all"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("_items"))
    # stretches of several blocks, joined where they overlap or touch
    joined = F.expr("""
        aggregate(array_sort(_all), cast(array() as array<struct<from_word: bigint, to_word: bigint, from_byte: bigint, to_byte: bigint>>),
          (acc, s) -> if(size(acc) > 0 and element_at(acc, -1).to_word >= s.from_word,
            concat(slice(acc, 1, size(acc) - 1), array(named_struct('from_word', element_at(acc, -1).from_word,
              'to_word', greatest(element_at(acc, -1).to_word, s.to_word), 'from_byte', element_at(acc, -1).from_byte,
              'to_byte', greatest(element_at(acc, -1).to_byte, s.to_byte)))), concat(acc, array(s))))""")
    none = per_text(content, None, _SCAN, _SCAN_DDL, _scanner([]))
    return (none.drop("spans", "items").join(merged.select("doc_id", joined.alias("spans"), "_items"), "doc_id", "left")
            .select("doc_id", "n_words", F.coalesce("spans", F.expr("array()").cast(none.schema["spans"].dataType)).alias("spans"),
                    F.coalesce("_items", F.expr("array()").cast("array<string>")).alias("items")))


def clean(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows of ``docs``, with all their columns, that hold no window of the benchmark; nothing is shuffled."""
    small_batches(docs.sparkSession)
    for block in _blocks(windows(benchmark, size), block_bytes):
        prepare = _scanner(_patterns(block))

        @F.pandas_udf(T.BooleanType())
        def hit(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            fn = prepare()  # noqa: B023 - pickled with this block before the next one is made
            for text in batches:
                yield text.map(lambda t: bool(fn(0, (t or "").encode())[0][3])).astype(bool)

        docs = docs.where(~hit("text"))
    return docs
