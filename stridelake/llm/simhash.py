"""SimHash near-dedup by multi-index hashing.

A fingerprint takes the majority of each bit over the XXH64 hashes (seed 42) of all word shingles.
Fingerprints that differ in at most ``MAX_BITS`` bits are linked, and components are the classes.

Search. The 64 bits are three segments. By the pigeonhole principle two fingerprints within 4 bits
agree within 1 bit on the first segment, or within 1 bit on the second, or exactly on the third (were
the differences 2, 2 and 1 at least, they would sum to 5). Each distinct fingerprint enters the table
of every segment under its value, and looks up the Hamming ball of that radius: 23 + 23 + 1 keys.
Fetched entries are verified on all 64 bits.

Copies share a fingerprint, so only distinct ones are searched. A bucket with very many entries is
dealt to several tasks (lookups go to each), and a task keeps a spanning forest of a bucket's links
instead of all pairs: members already joined to an entry are not compared again, so a dense
group costs about one comparison a member, and no link between classes is lost.

Null and empty texts have fingerprint zero and are linked like any other. Of rows repeating a doc_id
each gets its own fingerprint; components count the doc_id once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, min_reachable, one_each, texts, without

SHINGLE_WORDS = 4
MAX_BITS = 4
#: (lowest bit, bits, radius of the ball looked up) of each segment.
SEGMENTS = [(0, 22, 1), (22, 22, 1), (44, 20, 0)]
#: Entries of one bucket in one task, at most.
BLOCK_ENTRIES = 1 << 16


def simhash(text: bytes, size: int = SHINGLE_WORDS) -> int:
    """Fingerprint as an unsigned 64-bit number."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - size + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    begin = np.concatenate(([0], ends[: n - 1])).tolist()
    end = ends[len(words) - n :] - 1
    hashes = np.array([xxh64_intdigest(joined[a:b], 42) for a, b in zip(begin, end.tolist(), strict=True)], np.uint64)
    lanes = hashes.view(np.uint8).reshape(n, 8)
    votes = np.concatenate([np.bincount(lanes[:, k], minlength=256) @ _BITS for k in range(8)])
    return int(((votes * 2 > n).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum())


_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


@F.pandas_udf(T.LongType())
def fingerprint(text: pd.Series) -> pd.Series:
    """Fingerprint of each text as a signed long."""
    return pd.Series(np.array([simhash(t.encode()) for t in text], np.uint64).view(np.int64))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of every document."""
    return texts(docs).select("doc_id", fingerprint("text").alias("fp"))


def links(reps: DataFrame, block_entries: int = BLOCK_ENTRIES) -> DataFrame:
    """(a, b): links that span the classes of (fp, rep), one row per distinct fingerprint."""
    tables, probes = [], []
    for k, (low, bits, radius) in enumerate(SEGMENTS):
        value = F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << bits) - 1))
        key = value + F.lit(k << 32)
        tables.append(key)
        probes += [key] + [key.bitwiseXOR(F.lit(1 << i)) for i in range(bits) if radius]
    entries = reps.select("fp", "rep", F.explode(F.array(*tables)).alias("key"), F.lit(0).alias("probe"))
    lookups = reps.select("fp", "rep", F.explode(F.array(*probes)).alias("key"), F.lit(1).alias("probe"))
    # at most 3 n / block_entries buckets are as large, so this table is small
    large = (entries.groupBy("key").count().where(F.col("count") > block_entries)
             .select("key", F.ceil(F.col("count") / block_entries).cast("int").alias("blocks")))
    own = F.pmod(F.xxhash64("fp"), F.coalesce("blocks", F.lit(1)).cast("long")).cast("int")
    every = F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)
    dealt = (entries.unionByName(lookups).join(large, "key", "left")
             .withColumn("block", F.explode(F.when(F.col("probe") == 0, F.array(own)).otherwise(every))))
    dealt = dealt.select("key", "block", "probe", "fp", "rep")
    width = int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (dealt.repartition(width, "key", "block").sortWithinPartitions("key", "block", "probe", "fp")
            .mapInArrow(_verify, "a long, b long"))


_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])
CHUNK = 1 << 16


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets come sorted, entries before lookups; whole small buckets are compared together."""
    bucket: tuple[int, int] | None = None
    entry_fp = entry_rep = np.empty(0, np.int64)
    forest = _Forest()
    for batch in batches:
        key, block, probe, fp, rep = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        if not len(key):
            continue
        edge = np.flatnonzero((key[1:] != key[:-1]) | (block[1:] != block[:-1])) + 1
        starts = np.concatenate(([0], edge))
        ends = np.concatenate((edge, [len(key)]))
        out_a: list[int] = []
        out_b: list[int] = []
        split = starts + np.add.reduceat((probe == 0).astype(np.int64), starts)
        # entries look themselves up too, so a bucket with one entry and one lookup has nothing to compare;
        # the first and the last bucket of a batch may go on in another one
        busy = (split > starts) & (ends - split > 1)
        busy[[0, -1]] = True
        for s, m, e in zip(starts[busy].tolist(), split[busy].tolist(), ends[busy].tolist(), strict=True):
            at = (int(key[s]), int(block[s]))
            if at != bucket:
                bucket, forest = at, _Forest()
                entry_fp, entry_rep = fp[s:m], rep[s:m]
            elif m > s:
                entry_fp, entry_rep = np.concatenate((entry_fp, fp[s:m])), np.concatenate((entry_rep, rep[s:m]))
            if len(entry_fp) and e > m:
                for c in range(m, e, CHUNK):
                    _compare(entry_fp, entry_rep, fp[c : min(e, c + CHUNK)], rep[c : min(e, c + CHUNK)], forest, out_a, out_b)
        yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], schema=_LINK)


class _Forest:
    """Classes joined so far within a bucket."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


def _compare(entry_fp: np.ndarray, entry_rep: np.ndarray, fp: np.ndarray, rep: np.ndarray, forest: _Forest,
             out_a: list[int], out_b: list[int]) -> None:
    """Join each lookup to the entries within ``MAX_BITS``; a lookup in an entry's class is not compared with it."""
    if len(entry_fp) * len(fp) <= 4096:
        near = np.bitwise_count((entry_fp[:, None] ^ fp[None, :]).view(np.uint64)) <= MAX_BITS
        for i, j in zip(*np.nonzero(near), strict=True):
            a, b = int(entry_rep[i]), int(rep[j])
            if a != b and forest.join(a, b):
                out_a.append(a)
                out_b.append(b)
        return
    roots = np.array([forest.root(int(r)) for r in rep], np.int64)
    for f, r in zip(entry_fp.tolist(), entry_rep.tolist(), strict=True):
        own = forest.root(r)
        other = np.flatnonzero(roots != own)
        if not len(other):
            continue
        hits = other[np.bitwise_count((fp[other] ^ f).view(np.uint64)) <= MAX_BITS]
        if len(hits):
            for j in hits.tolist():
                b = int(rep[j])
                if b != r and forest.join(r, b):
                    out_a.append(r)
                    out_b.append(b)
            new = forest.root(r)
            roots[np.isin(roots, np.unique(np.append(roots[hits], own)))] = new


def classes(docs: DataFrame, block_entries: int = BLOCK_ENTRIES) -> DataFrame:
    """(doc_id, fp, component_id) of every document; the component's smallest doc_id names it."""
    prints = cut(fingerprints(docs))
    reps = prints.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    joined = min_reachable(cut(links(reps, block_entries)))
    by_fp = (reps.join(joined, reps["rep"] == joined["node"], "left")
             .select("fp", F.coalesce("component", "rep").alias("component_id")))
    return cut(prints.join(by_fp, "fp").select("doc_id", "fp", "component_id"), compact=True)


def representatives(docs: DataFrame) -> DataFrame:
    """Rows of ``docs``, with all their columns: of each class the document with the smallest doc_id, and of its literal repeats one."""
    found = classes(docs)
    rest = without(docs.where(F.col("doc_id").isNotNull()), [F.col("doc_id").cast("long")], found.where("doc_id <> component_id").select("doc_id"))
    repeats = found.where("doc_id = component_id").groupBy("doc_id").count().where("count > 1").select("doc_id")
    return one_each(rest, repeats, F.coalesce("text", F.lit("")))
