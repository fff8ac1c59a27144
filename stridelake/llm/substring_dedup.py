"""Substring dedup: suffix trees over partitions of the suffixes, cut at the length that counts.

A window is ``size`` (20) consecutive words of one document. Every word covered by a window that also starts
earlier (smaller doc_id, or same document and earlier start) is removed; windows are judged on the input.

* Partitions. Equal suffixes must meet, in groups that fit memory. A suffix is keyed by a short run of its
  words, the one of smallest hash among those within its first ``size`` words, rather than by its very first
  words: about eight neighbouring suffixes then share the key, so their common segment is moved once.
  Keys that occur once hold no repeat and drop out by a count before any text moves.
* Key lengths vary. A key with more than ``group_segments`` segments is dealt over several trees; each keeps one
  suffix, its earliest, for each full ``size``-word prefix, and those meet again under that full prefix.
* Trees. A group's suffixes enter a path-compressed tree down to ``size`` words. A node there with two leaves
  or more is a deep internal node of the full suffix tree: a repeat. All its leaves but the earliest
  are removed; neighbouring ones join to the maximal stretch.

Words are compared, never only their hashes. Null, empty and shorter texts have no window. Rows that repeat a
doc_id are one document, not repeats of one another.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import texts

WINDOW_WORDS = 20
KEY_WORDS = 6
#: Segments of one key in one tree, at most.
GROUP_SEGMENTS = 20_000
#: Bytes of text whose keys are computed together.
PIECE = 1 << 21

_MUL, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_BACK = np.uint64(pow(int(_MUL), -1, 1 << 64))
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base)
    out[:1] = 1
    return np.multiply.accumulate(out)


def word_hashes(text: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of the bytes, and the number of words before each text; ``begins`` are the texts' places."""
    if len(text) > 2 * PIECE and len(begins) == 1:  # one long text goes by parts that end at blanks
        a, parts = 0, []
        while a < len(text):
            b = min(a + PIECE, len(text))
            while b < len(text) and not _BLANK[text[b]]:
                b += 1
            parts.append(_word_hashes(text[a:b], np.zeros(1, np.int64))[0])
            a = b
        return np.concatenate(parts), np.zeros(1, np.int64)
    return _word_hashes(text, begins)


def _word_hashes(text: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    solid = ~_BLANK[text]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    at = begins[begins < len(text)]
    first[at] = solid[at]
    starts = np.flatnonzero(first)
    # a word's letters as digits: differences of one running sum, moved back to place zero
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((text + np.uint64(1)) * solid * _powers(_MUL, len(text)))))
    ends = np.concatenate((starts[1:], [len(text)]))
    h = (total[ends] - total[starts]) * _powers(_BACK, len(text) + 1)[starts]
    return (h ^ (h >> np.uint64(29))) * _MIX, np.searchsorted(starts, begins)


def key_runs(h: np.ndarray, texts_at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Key, first window and number of windows of each stretch of windows with the same key place.

    ``h`` are the word hashes of texts that begin at ``texts_at``; no window reaches into the next text.
    """
    width = min(KEY_WORDS, size)
    n = len(h) - size + 1
    if n < 1:
        none = np.empty(0, np.int64)
        return none, none, none
    g = h[: len(h) - width + 1].copy()
    for k in range(1, width):
        g = g * _MUL + h[k : len(h) - width + 1 + k]
    g = (g ^ (g >> np.uint64(32))) * _MIX
    g ^= g >> np.uint64(32)
    # smallest of each window, the leftmost of equal ones: the place fills the low half
    low = (g & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(g), dtype=np.uint64)
    span, reach = size - width + 1, 1
    while reach * 2 <= span:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    if reach < span:
        low = np.minimum(low[:n], low[span - reach : span - reach + n])
    inside = np.ones(n, bool)
    for cut in texts_at[(texts_at > 0) & (texts_at < len(h))].tolist():
        inside[max(0, cut - size + 1) : cut] = False
    windows = np.flatnonzero(inside)
    if not len(windows):
        return windows, windows, windows
    place = (low[windows] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    begin = np.concatenate(([0], np.flatnonzero(np.diff(place)) + 1))
    return g[place[begin]].view(np.int64), windows[begin], np.diff(np.concatenate((begin, [len(windows)])))


_KEYS = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int64())])


def _keys(content: DataFrame, size: int) -> DataFrame:
    """(key, doc_id, at): ``at`` packs the first window and the number of windows of a stretch."""

    def found(text: np.ndarray, ids: np.ndarray, begins: np.ndarray) -> pa.RecordBatch:
        h, texts_at = word_hashes(text, begins)
        key, first, n = key_runs(h, texts_at, size)
        doc = np.searchsorted(texts_at, first, "right") - 1
        at = (first - texts_at[doc]) * (size + 1) + n
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(ids[doc]), pa.array(at)], schema=_KEYS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, column = batch.column(0).to_numpy(), batch.column(1).cast(pa.large_binary())
            offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
            data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] and offsets[-1] else np.empty(0, np.uint8)
            a = 0
            while a < len(ids):
                b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + PIECE, "right")) - 1)
                yield found(data[offsets[a] : offsets[b]], ids[a:b], offsets[a:b] - offsets[a])
                a = b

    return content.mapInArrow(run, "key long, doc_id long, at long")


_SEGMENTS = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("words", pa.binary())])


def _segments(rows: DataFrame, size: int) -> DataFrame:
    """A row for each stretch of windows whose key repeats, with the words they cover.

    ``start`` is twice the first window, plus one where the key has several trees.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for i in range(batch.num_rows):
                doc_id, words = batch.column(0)[i].as_py(), batch.column(1)[i].as_py().encode().split()
                again = batch.column(2)[i].values
                keys, ats = again.field("key").to_pylist(), again.field("at").to_pylist()
                for key, at in zip(keys, ats, strict=True):
                    first, n = divmod(at >> 1, size + 1)
                    out.append((key, doc_id, first * 2 + (at & 1), b" ".join(words[first : first + n + size - 1])))
                if len(out) >= 20_000:
                    yield _table(out, _SEGMENTS)
                    out = []
            if out:
                yield _table(out, _SEGMENTS)

    return rows.mapInArrow(run, "key long, doc_id long, start long, words binary")


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


class Node:
    """Node of a path-compressed suffix tree: the words on the edge to it, its children, its leaves' places."""

    __slots__ = ("kids", "label", "places")

    def __init__(self, label: list[bytes]) -> None:
        self.label, self.kids, self.places = label, {}, []

    def at(self, window: list[bytes]) -> Node:
        """The node ``window`` leads to, made where missing. All windows of a tree are equally long."""
        node, depth = self, 0
        while True:
            kid = node.kids.get(window[depth])
            if kid is None:
                kid = node.kids[window[depth]] = Node(window[depth:])
                return kid
            label = kid.label
            if window[depth : depth + len(label)] == label:
                depth += len(label)
                if depth == len(window):
                    return kid
                node = kid
                continue
            same = 1
            while label[same] == window[depth + same]:
                same += 1
            middle = node.kids[label[0]] = Node(label[:same])
            kid.label = label[same:]
            middle.kids[kid.label[0]] = kid
            node, depth = middle, depth + same


_FOUND = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n", pa.int64()), ("words", pa.binary())])


def _later(rows: list[tuple], size: int, several: bool) -> Iterator[tuple]:
    """Stretches of later occurrences of a group's windows (``words`` null); where its key has several trees,
    also the earliest occurrence of each window with its words.

    Equal segments enter the tree once, with all their places.
    """
    places: dict[bytes, set[tuple[int, int]]] = {}
    for doc_id, start, text in rows:
        places.setdefault(text, set()).add((doc_id, start))
    if len(rows) == 1 and not several:
        return
    root, deep, firsts = Node([]), [], []
    for text, at in places.items():
        words = text.split()
        first, k = min(at), len(firsts)
        firsts.append(first)
        n = len(words) - size + 1
        for place in at:
            if place != first and n > 0:
                yield (*place, n, None)
        if len(places) == 1 and not several:
            return  # a tree of one segment has no further repeat
        for i in range(n):
            node = root.at(window := words[i : i + size])
            if not node.places:
                deep.append((node, b" ".join(window) if several else None))
            node.places.append((k, i))
    runs: dict[int, list[int]] = {}
    for node, window in deep:
        at = [((firsts[k][0], firsts[k][1] + i), k, i) for k, i in node.places]
        first = min(at)
        for place, k, i in at:
            if place != first[0]:
                runs.setdefault(k, []).append(i)
        if several:
            yield (*first[0], 1, window)
    for k, gone in runs.items():
        gone.sort()
        begin = 0
        for i in range(1, len(gone) + 1):
            if i == len(gone) or gone[i] != gone[i - 1] + 1:
                yield (firsts[k][0], firsts[k][1] + gone[begin], i - begin, None)
                begin = i


def _trees(segments: DataFrame, size: int) -> DataFrame:
    """What ``_later`` finds in each group; groups come sorted, one is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows, out = None, [], []
        for batch in batches:
            for key, doc_id, start, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (key, start & 1) != at:
                    if rows:
                        out += _later(rows, size, bool(at[1]))
                    at, rows = (key, start & 1), []
                    if len(out) >= 20_000:
                        yield _table(out, _FOUND)
                        out = []
                rows.append((doc_id, start >> 1, text))
        if rows:
            out += _later(rows, size, bool(at[1]))
        if out:
            yield _table(out, _FOUND)

    width = int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (segments.repartition(width, "key").sortWithinPartitions("key", F.col("start") % 2)
            .mapInArrow(run, "doc_id long, start long, n long, words binary"))


def repeats(docs: DataFrame, size: int = WINDOW_WORDS, group_segments: int = GROUP_SEGMENTS) -> DataFrame:
    """(doc_id, start, n): stretches of ``n`` windows from word ``start`` on that occur earlier."""
    content = texts(docs)
    keys = _keys(content, size)
    times = keys.groupBy("key").agg(F.count("*").alias("times")).where("times > 1")
    trees = F.ceil(F.col("times") / group_segments)
    # a key of several trees is dealt over as many groups
    group = F.when(trees > 1, F.xxhash64("key", F.pmod(F.xxhash64("doc_id", "at"), trees))).otherwise(F.col("key"))
    again = (keys.join(times, "key").select("doc_id", F.struct(group.alias("key"), (F.col("at") * 2 + (trees > 1).cast("long")).alias("at")).alias("a"))
             .groupBy("doc_id").agg(F.collect_set("a").alias("again")))
    found = _trees(_segments(content.join(again, "doc_id").select("doc_id", "text", "again"), size), size)
    # firsts of several trees meet under their words; the trees are evaluated for either kind of rows from the same
    # shuffled segments, which costs less than moving all rows once more
    place = F.struct("doc_id", "start")
    firsts = (found.where("words is not null")
              .select("doc_id", "start", "n", F.min(place).over(Window.partitionBy("words")).alias("first"))
              .where(place != F.col("first")))
    return found.where("words is null").select("doc_id", "start", "n").union(firsts.select("doc_id", "start", "n"))


_KEPT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])


def removed(docs: DataFrame, size: int = WINDOW_WORDS, group_segments: int = GROUP_SEGMENTS) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): ``kept`` are the remaining words joined by single spaces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                words = batch.column(1)[i].as_py().encode().split()
                n, runs = len(words), batch.column(2)[i].as_py()
                if runs:
                    mark = np.zeros(n + 1, np.int64)
                    for r in runs:
                        mark[min(r["start"], n)] += 1
                        mark[min(r["start"] + r["n"] + size - 1, n)] -= 1
                    words = [words[k] for k in np.flatnonzero(np.cumsum(mark[:-1]) == 0).tolist()]
                out.append((batch.column(0)[i].as_py(), n, n - len(words), b" ".join(words).decode()))
            if out:
                yield _table(out, _KEPT)

    runs = repeats(docs, size, group_segments).groupBy("doc_id").agg(F.collect_set(F.struct("start", "n")).alias("runs"))
    return (texts(docs).join(runs, "doc_id", "left").select("doc_id", "text", "runs")
            .mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string"))
