"""MinHash near-dedup with an LSH forest.

A document's set holds its distinct three-word shingles (A-Z lower-cased); documents are linked where the
intersection has at least 85 % of the union, and components of links are the classes.

Search. A signature holds the minima of 64 hash functions. Tree t reads it from place 4 t on (the
end goes on at the beginning), so sixteen orders start with different values. In a tree's sorted order
the rows with a common prefix of four values are neighbours, and such a region's members are candidates.
The depth adapts: a region with more than a block of rows or shingles goes on to prefixes of six, then
eight values, and what is still larger is dealt to blocks, each block's entries meeting the members
of all later ones too, so no neighbour is left out for a region's size. Two sets at exactly 0.85
miss each other in all trees with a chance of 7e-6 at depth four (4e-4 at six, 6e-3 at eight, where however a large
region of near copies offers many ways round); at 0.9 with 1e-7.

Verification. A region's task gets whole texts, makes their whole sets and compares them exactly, as
bits over the shingles that two of its members share. Members that are already in one class are not
compared, so a dense group yields a spanning forest of links. The trees are taken in three rounds, and only regions
that still hold two classes go on, so a class found early moves no text again.

Equal sets are one node, named by its smallest doc_id, whatever the number of copies. Documents without
words or text have an empty set and are linked with nothing. Rows repeating a doc_id get a row each,
with their own set; links count the doc_id once. Rows without doc_id are dropped. An empty
table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, maybe_in, min_reachable, per_text, texts

SHINGLE_WORDS = 3
#: Linked at 100 * intersection >= PERCENT * union.
PERCENT = 85
HASHES = 64
#: Values in a prefix, from the first depth to the last.
DEPTHS = (4, 6, 8)
#: Trees of each round.
ROUNDS = (range(0, 2), range(2, 7), range(7, 16))
#: Rows and shingles of a region that one task compares at once.
BLOCK_ROWS, BLOCK_SHINGLES = 1024, 1 << 18

# odd multipliers and offsets of the hash functions, from a fixed seed
_MULT, _ADD = (np.random.default_rng(85).integers(0, 1 << 63, (HASHES, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(k) for k in (1, 0))


def shingle_set(text: bytes) -> np.ndarray:
    """Sorted distinct XXH64 of the shingles; with fewer words, of the whole sequence."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) <= SHINGLE_WORDS:
        return np.array([xxh64_intdigest(b" ".join(words))], np.uint64)
    grams = set(map(b" ".join, zip(*(words[k:] for k in range(SHINGLE_WORDS)), strict=False)))
    return np.unique(np.fromiter(map(xxh64_intdigest, grams), np.uint64, len(grams)))


def minima(shingles: np.ndarray) -> np.ndarray:
    """Signature: for each hash function the smallest upper half over the set."""
    low = np.full(HASHES, np.iinfo(np.uint64).max)
    for k in range(0, len(shingles), 4096):
        low = np.minimum(low, (shingles[None, k : k + 4096] * _MULT + _ADD).min(axis=1))
    return (low >> np.uint64(32)).astype(">u4")


def _digest(shingles: np.ndarray) -> tuple[int, int]:
    from xxhash import xxh3_128_digest

    one, two = np.frombuffer(xxh3_128_digest(shingles.tobytes()), ">i8").tolist()
    return one, two


def _row(doc_id: int, text: bytes) -> list[tuple]:
    shingles = shingle_set(text)
    return [(doc_id, len(shingles), *_digest(shingles), minima(shingles).tobytes() if len(shingles) else None)]


def signed(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, one, two, signature) of every document; (one, two) is the digest of its set."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("one", pa.int64()), ("two", pa.int64()),
                        ("signature", pa.binary())])
    return per_text(texts(docs), _row, schema, "doc_id long, n_shingles long, one long, two long, signature binary")


class _Classes:
    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    def roots(self, xs: list[int]) -> np.ndarray:
        return np.array([self.root(x) for x in xs], np.int64)

    def join(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)


def _incidence(sets: list[np.ndarray]) -> np.ndarray:
    """A row of bits for each set over the shingles that occur in two of them or more."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    column = (np.cumsum(shared) - 1)[place]
    keep = shared[place]
    bits = np.zeros((len(sets), int(shared.sum()) // 64 + 1), np.uint64)
    np.bitwise_or.at(bits, (owner[keep], column[keep] >> 6), np.uint64(1) << (column[keep] & 63).astype(np.uint64))
    return bits


def link(sets: list[np.ndarray], names: list[int], n_entries: int, classes: _Classes) -> list[tuple[int, int]]:
    """Links that join the classes of ``names``, with at least one end among the first ``n_entries`` sets."""
    out: list[tuple[int, int]] = []
    if len(sets) < 2:
        return out
    bits, sizes = _incidence(sets), np.array([len(s) for s in sets], np.int64)
    for i in range(min(n_entries, len(sets) - 1)):
        roots = classes.roots(names[i + 1 :])
        other = i + 1 + np.flatnonzero(roots != classes.root(names[i]))
        small, big = np.minimum(sizes[other], sizes[i]), np.maximum(sizes[other], sizes[i])
        other = other[100 * small >= PERCENT * big]
        if not len(other):
            continue
        both = np.bitwise_count(bits[other] & bits[i]).sum(axis=1, dtype=np.int64)
        for j in other[100 * both >= PERCENT * (sizes[other] + sizes[i] - both)].tolist():
            if classes.root(names[i]) != classes.root(names[j]):
                classes.join(names[i], names[j])
                out.append((names[i], names[j]))
    return out


_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks come sorted, entries before members of later blocks; a block holds its entries and some of those."""
    at, held, entries, names, extra = None, 0, [], [], []
    classes, out = _Classes(), []

    def flush() -> None:
        nonlocal held
        if not extra:
            out.extend(link(entries, names, len(entries), classes))
        else:
            out.extend(link(entries + [s for s, _ in extra], names + [c for _, c in extra], len(entries), classes))
        extra.clear()
        held = 0

    for batch in batches:
        key, block, probe, comp, one = (batch.column(k).to_numpy(zero_copy_only=False).tolist() for k in range(5))
        content = batch.column(5).cast(pa.binary())
        for k in range(batch.num_rows):
            if (key[k], block[k]) != at:
                flush()
                at, entries, names, classes = (key[k], block[k]), [], [], _Classes()
            shingles = shingle_set(content[k].as_py())
            if _digest(shingles)[0] != one[k]:  # another text under the same doc_id
                continue
            if not probe[k]:
                entries.append(shingles)
                names.append(comp[k])
                continue
            if entries:
                extra.append((shingles, comp[k]))
                held += len(shingles)
                if len(extra) >= BLOCK_ROWS or held >= BLOCK_SHINGLES:
                    flush()
        if len(out) >= 1000:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=_LINK)
            out.clear()
    flush()
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=_LINK)


def _regions(nodes: DataFrame, trees: range, block_rows: int, block_shingles: int) -> DataFrame:
    """(key, blocks, rep, comp, one) of the members of regions with two classes, at the depth that the region needs."""
    order = F.concat("signature", "signature")
    rows = nodes.select("rep", "comp", "one", "n_shingles", F.explode(F.array(*[
        F.struct(*[F.xxhash64(F.lit(t), F.lit(d), order.substr(16 * t + 1, 4 * d)).alias(f"k{d}") for d in DEPTHS]) for t in trees])).alias("k"))
    rows = rows.select("rep", "comp", "one", "n_shingles", "k.*")
    done: DataFrame | None = None
    for d in DEPTHS:
        live = cut(rows.groupBy(f"k{d}").agg(F.count("*").alias("m"), F.sum("n_shingles").alias("t"), F.min("comp").alias("c0"), F.max("comp").alias("c1"))
                   .where("c0 < c1").select(F.col(f"k{d}").alias("key"), F.ceil(F.greatest(
                       F.col("m") / block_rows, F.col("t") / block_shingles)).cast("int").alias("blocks")))
        # kept as a table, so that both sides of the join are dealt anew and a hot region can be split
        members = maybe_in(rows, F.col(f"k{d}"), live, F.col("key")) if d == DEPTHS[0] else rows
        members = cut(members.join(live, F.col(f"k{d}") == F.col("key")))
        deepest = d == DEPTHS[-1]
        part = (members if deepest else members.where("blocks = 1")).select("key", "blocks", "rep", "comp", "one")
        done = part if done is None else done.unionByName(part)
        rows = members.where("blocks > 1").drop("key", "blocks")
        if deepest or not rows.take(1):
            return done
    return done


def links(nodes: DataFrame, docs: DataFrame, trees: range, block_rows: int = BLOCK_ROWS, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """(a, b): verified links that join classes of ``nodes`` (rep, comp, one, n_shingles, signature) within the trees."""
    regions = _regions(nodes, trees, block_rows, block_shingles)
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    dealt = (regions.withColumn("own", own).withColumn("block", F.explode(F.sequence(F.lit(0), "own")))
             .select("key", "block", (F.col("block") < F.col("own")).cast("int").alias("probe"), "rep", "comp", "one"))
    content = maybe_in(texts(docs), F.col("doc_id"), regions, F.col("rep"))
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (dealt.join(content, F.col("rep") == F.col("doc_id")).select("key", "block", "probe", "comp", "one", "text")
            .repartition(width, "key", "block").sortWithinPartitions("key", "block", "probe").mapInArrow(_verify, "a long, b long"))


def classes(docs: DataFrame, block_rows: int = BLOCK_ROWS, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document; the class's smallest doc_id names it and stays."""
    sets = cut(signed(docs))
    reps = cut(sets.where("n_shingles > 0").groupBy("one", "two").agg(
        F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature")))
    found: DataFrame | None = None
    for trees in ROUNDS:
        nodes = (reps.withColumn("comp", F.col("rep")) if found is None else
                 reps.join(found, F.col("rep") == F.col("node"), "left").withColumn("comp", F.coalesce("component", "rep")))
        new = cut(links(nodes, docs, trees, block_rows, block_shingles))
        found = min_reachable(new if found is None else new.unionByName(found.select(F.col("node").alias("a"), F.col("component").alias("b"))))
    named = (reps.join(found, F.col("rep") == F.col("node"), "left")
             .select("one", "two", F.coalesce("component", "rep").alias("component_id")))
    component = F.coalesce("component_id", "doc_id")
    return sets.join(named, ["one", "two"], "left").select(
        "doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))
