"""Periodic runs of words by seed and extend on diagonals.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) and at
least max(24, 3 q) words that neither neighbour extends keeping q. On the diagonal of lag q it is a
stretch of max(24 - q, 2 q) matching words or more, so lags up to 16 are sure to share a 16-gram with
the text q words on, and lags in (B, 2 B] a gram of 2 B words. These are the grams indexed, one length
for each doubling of the lag.

Only the next occurrence of a gram is a seed, and only if its distance lies in the band. That loses
nothing: a gram of 2 B words that recurs within B words has a period of at most B; two stretches of
different such periods share fewer than 2 B - 1 words, so were all grams of a run of lag q > B of that
kind, they would lie in one stretch of period p <= B that covers 2 q >= p + q words of the run, and
the run's smallest period would divide p. The other grams recur at most once within 2 B words. So
seeds grow with the words, never with the square of a gram's occurrences. A table by lag of the
furthest covered place keeps a diagonal's stretch from being extended twice.

Words are numbered exactly, grams by mixing the numbers of their halves to 64 bits; each seed is
extended over the words themselves, so no hash decides that something matches.

A document is the unit: its words are held by one task, further documents are packed beside it.
Null and empty texts have no words, no run and an empty collapsed text. Rows repeating a doc_id give
a row each; rows without one are dropped. A table without rows gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import texts

MIN_WORDS = 24
MIN_TURNS = 3
#: Longest lag that grams of the first length serve; a run of 24 words and period 8 matches over 16.
FIRST = 16
#: Words of short documents looked at together.
PACK_WORDS = 1 << 18


def _mixed(a: np.ndarray, b: np.ndarray | int) -> np.ndarray:
    x = (a ^ (a >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + b
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _same(x: np.ndarray, i: int, j: int, most: int, step: int) -> int:
    """How many words from ``i`` equal those from ``j``, going by ``step`` (1 or -1), ``most`` at most."""
    n, width = 0, 16
    while n < most:
        m = min(width, most - n)
        a = x[i + n : i + n + m] if step > 0 else x[i - n - m + 1 : i - n + 1][::-1]
        b = x[j + n : j + n + m] if step > 0 else x[j - n - m + 1 : j - n + 1][::-1]
        differ = np.flatnonzero(a != b)
        if len(differ):
            return n + int(differ[0])
        n, width = n + m, width * 2
    return n


def find_runs(x: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """Runs (start, length, period) of each document ``x[starts[d]:ends[d]]`` of word numbers, by start and period."""
    found: list[dict[tuple[int, int], int]] = [{} for _ in starts]
    covered: list[dict[int, int]] = [{} for _ in starts]
    n = len(x)
    doc = np.repeat(np.arange(len(starts)), ends - starts)
    left = ends[doc] - np.arange(n)  # words from a place to its document's end
    grams, size = _mixed(x.astype(np.uint64), 1), 1
    at = np.arange(n)  # places still looked at
    while size < FIRST:
        grams = _mixed(grams, np.concatenate((grams[size:], np.zeros(min(size, n), np.uint64))))
        size *= 2
    low = 0
    while True:
        at = at[left[at] >= size]
        key = _mixed(grams[at], doc[at].astype(np.uint64))
        order = np.argsort(key, kind="stable")
        again = key[order[1:]] == key[order[:-1]]
        a, b = at[order[:-1][again]], at[order[1:][again]]
        if not len(a):
            break
        lag = b - a
        seed = (lag > low) & (lag <= size) & (lag * MIN_TURNS <= (ends - starts)[doc[a]]) & (doc[a] == doc[b])
        for i, q in _stretches(a[seed], lag[seed]):
            d = int(doc[i])
            if i < covered[d].get(q, -1):
                continue
            s, e = int(starts[d]), int(ends[d])
            begin = i - _same(x, i - 1, i - 1 + q, i - s, -1)
            stop = i + _same(x, i, i + q, e - i - q, 1)
            covered[d][q] = stop
            if stop - begin + q >= max(MIN_WORDS, MIN_TURNS * q):
                found[d].setdefault((begin - s, stop - begin + q), q)
        # a longer gram recurs only where this one does, in documents that are long enough for its lags
        at = np.unique(np.concatenate((a, b)))
        at = at[(ends - starts)[doc[at]] > MIN_TURNS * size]
        if not len(at):
            break
        grams = _mixed(grams, np.concatenate((grams[size:], np.zeros(min(size, n), np.uint64))))
        low, size = size, size * 2
    return [sorted(((s, m, q) for (s, m), q in f.items()), key=lambda r: (r[0], r[2])) for f in found]


def _stretches(at: np.ndarray, lag: np.ndarray) -> Iterator[tuple[int, int]]:
    """(first place, lag) of each row of neighbouring seeds on one diagonal, by lag and place."""
    order = np.lexsort((at, lag))
    at, lag = at[order], lag[order]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (lag[1:] != lag[:-1])
    for i, q in zip(at[new].tolist(), lag[new].tolist(), strict=True):
        yield i, q


_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()),
                  ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))),
                  ("text", pa.string())])
_DDL = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, text string"


def _pack(ids: list[int], words: list[list[bytes]]) -> pa.RecordBatch:
    number: dict[bytes, int] = {}
    x = np.array([number.setdefault(w, len(number)) for ws in words for w in ws], np.int64)
    ends = np.cumsum([len(ws) for ws in words])
    all_runs = find_runs(x, ends - [len(ws) for ws in words], ends)
    kept = []
    for ws, runs in zip(words, all_runs, strict=True):
        stay = np.ones(len(ws), bool)
        for start, length, period in runs:
            stay[start + period : start + length] = False
        kept.append(b" ".join(w for w, s in zip(ws, stay.tolist(), strict=True) if s) if runs else b" ".join(ws))
    runs = [[{"start": s, "length": m, "period": q} for s, m, q in r] for r in all_runs]
    return pa.RecordBatch.from_arrays([
        pa.array(ids, pa.int64()), pa.array([len(ws) for ws in words], pa.int64()), pa.array(runs, _OUT.field("runs").type),
        pa.array(kept, pa.binary()).cast(pa.string())], schema=_OUT)


def collapsed(docs: DataFrame, pack_words: int = PACK_WORDS) -> DataFrame:
    """(doc_id, n_words, runs, text) of every document: its runs by start and period, and the text in
    which a word stays unless some run holds it after the first period; words joined by one blank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, words, held = [], [], 0
        for batch in batches:
            content = batch.column(1).cast(pa.binary())
            for k in range(batch.num_rows):
                ids.append(batch.column(0)[k].as_py())
                words.append(content[k].as_py().split())
                held += len(words[-1])
                if held >= pack_words:
                    yield _pack(ids, words)
                    ids, words, held = [], [], 0
        if ids:
            yield _pack(ids, words)

    return texts(docs).mapInArrow(run, _DDL)


def longest(runs: Column) -> Column:
    """The run with the greatest exact length / period; ties go to the smallest start, then period."""
    return F.reduce(runs, F.lit(None).cast("struct<start:long,length:long,period:long>"), lambda best, r: F.when(
        best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best))
