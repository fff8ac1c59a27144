"""Prefix trie of conversations, as balanced parentheses per shard.

Conversations sorted by their sequences of turns are a walk through their trie in document order. The
sorted order is dealt to shards by ranges and read as a stream: what a sequence shares with the one
before stays open, the rest of that one is closed, the new turns are opened. A shard holds the parentheses
as bits with the excess after each, and the least and greatest excess of each block and of each pair of
blocks above them; findclose looks for the first lower excess in the rest of the block, then climbs over the pairs.
An open bracket and its close delimit a subtree, ranks of open brackets number its nodes, ranks of
"()" pairs count its leaves, and cumulative sums over its nodes give members and savings.

A node can lie in several shards only on the path to a shard's first or last sequence, the spines.
Their rows are merged by node: counts and smallest members add up, and what hangs below a spine node
is summed once, in the first shard that has the node. So a hot first turn, which a third of all conversations may share, is
spread over all shards it needs.

A turn is 20 bytes here (MD5 of role and text, number of words): texts never leave the first stage. A
conversation's turns as such bytes are one value; equal sequences are one row from there on. A node's
digest goes over its members' ids in order, of which a task holds one piece of at most ``ID_PIECE`` ids.

Turns are ordered by turn (null first), then role and text, so repeated turn numbers have one order.
Null role and text are empty; rows without conv_id are dropped, further columns are not read. Without
conversations there is no node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

TURN_BYTES = 20
#: Nodes of one shard of parentheses; a partition of the sorted sequences may hold several.
SHARD_NODES = 1 << 17
#: Conversation ids joined to text in one piece.
ID_PIECE = 1 << 14
#: Excess values in a block of the parentheses.
BLOCK = 64


def sequences(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): the packed turns of every conversation, in order, as hexadecimal texts."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    said = F.concat(F.octet_length(role).cast("string").cast("binary"), F.encode(F.lit(" "), "utf-8"), role.cast("binary"), text.cast("binary"))
    words = F.lpad(F.hex(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))), 8, "0")
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.concat(F.upper(F.md5(said)), words).alias("packed"))
    ordered = F.sort_array(F.collect_list(F.struct("turn", "packed")))
    return rows.groupBy("conv_id").agg(ordered.alias("turns")).select("conv_id", F.col("turns.packed").alias("turns"))


def distinct_sequences(seqs: DataFrame) -> DataFrame:
    """(seq, n, low, ends): each distinct sequence, its conversations' number and smallest id, and their digest."""
    keyed = seqs.select("conv_id", F.unhex(F.array_join("turns", "")).alias("seq")).withColumn("sid", F.md5("seq"))
    pieces = (keyed.groupBy("sid", F.shiftright("conv_id", ID_PIECE.bit_length() - 1).alias("piece"))
              .agg(F.first("seq").alias("seq"), F.sort_array(F.collect_list("conv_id")).alias("ids"))
              .select("sid", "piece", "seq", F.size("ids").cast("long").alias("n"), F.col("ids")[0].alias("low"), F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids")))
    width = int(seqs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (pieces.repartition(width, "sid").sortWithinPartitions("sid", "piece").select("sid", "seq", "n", "low", "ids")
            .mapInArrow(_digests, "seq binary, n long, low long, ends string"))


_DISTINCT = pa.schema([("seq", pa.binary()), ("n", pa.int64()), ("low", pa.int64()), ("ends", pa.string())])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for the sorted pieces of a sequence: its digest goes on from piece to piece."""
    sid, row, digest = None, None, None
    out: list[tuple] = []
    for batch in batches:
        for r in batch.to_pylist():
            if r["sid"] != sid:
                if row:
                    out.append((*row, digest.hexdigest()))
                sid, row, digest = r["sid"], (r["seq"], r["n"], r["low"]), hashlib.sha256(r["ids"].encode())
            else:
                row = (row[0], row[1] + r["n"], row[2])
                digest.update(b"," + r["ids"].encode())
        if len(out) >= 10_000:
            yield _table(out, _DISTINCT)
            out = []
    if row:
        out.append((*row, digest.hexdigest()))
        yield _table(out, _DISTINCT)


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


class Parentheses:
    """Balanced parentheses (1 opens, 0 closes) with the least and greatest excess of blocks and of pairs above them."""

    def __init__(self, bits: np.ndarray) -> None:
        self.bits = bits
        self.excess = np.cumsum(bits.astype(np.int64) * 2 - 1)
        padded = np.pad(self.excess, (0, -len(bits) % BLOCK), mode="edge").reshape(-1, BLOCK)
        self.least, self.greatest = [padded.min(axis=1)], [padded.max(axis=1)]
        while len(self.least[-1]) > 1:
            for levels, fold in ((self.least, np.minimum), (self.greatest, np.maximum)):
                pairs = np.pad(levels[-1], (0, len(levels[-1]) % 2), mode="edge").reshape(-1, 2)
                levels.append(fold(pairs[:, 0], pairs[:, 1]))

    def _holds(self, level: int, k: int, excess: int) -> bool:
        return self.least[level][k] <= excess <= self.greatest[level][k]

    def findclose(self, at: int) -> int:
        """Place of the bracket that closes the one opened at ``at``: the next with an excess lower by one."""
        goal = self.excess[at] - 1
        k = at // BLOCK
        hit = np.flatnonzero(self.excess[at : (k + 1) * BLOCK] == goal)
        if len(hit):
            return at + int(hit[0])
        level, k = 0, k + 1
        while not self._holds(level, k, goal):  # a right half is done: go on beside the pair that holds it
            level, k = (level + 1, (k + 1) // 2) if k % 2 else (level, k + 1)
        while level:
            level, k = level - 1, 2 * k if self._holds(level - 1, 2 * k, goal) else 2 * k + 1
        return k * BLOCK + int(np.flatnonzero(self.excess[k * BLOCK : (k + 1) * BLOCK] == goal)[0])

    def closes(self, opens: np.ndarray) -> np.ndarray:
        """``findclose`` of many; a pair side by side needs no search."""
        out = opens + 1
        for k in np.flatnonzero(self.bits[out] == 1).tolist():
            out[k] = self.findclose(int(opens[k]))
        return out


def _range_min(values: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Smallest of ``values[k : k + size[k]]`` for each k, from two overlapping powers of two."""
    out, level, width = values.copy(), values, 1
    while True:
        k = np.flatnonzero((size >= width) & (size < 2 * width))
        out[k] = np.minimum(level[k], level[k + size[k] - width])
        if 2 * width > len(values):
            return out
        level, width = np.minimum(level[:-width], level[width:]), 2 * width


_NODE = pa.schema([("shard", pa.int64()), ("path", pa.int32()), ("node", pa.binary()), ("parent", pa.binary()), ("depth", pa.int64()),
                   ("words", pa.int64()), ("conv_id", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()),
                   ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends", pa.string())])
_NODE_DDL = ("shard long, path int, node binary, parent binary, depth long, words long, conv_id long, parent_conv_id long, "
             "n_convs long, n_children long, n_leaves long, saved_tokens long, ends string")
_NONE = np.iinfo(np.int64).max


class _Shard:
    """Brackets and nodes of some neighbouring sequences, in order; node 0 is the root."""

    def __init__(self) -> None:
        self.bits, self.up, self.depth, self.words, self.names = [1], [0], [0], [0], [b""]
        self.n, self.low, self.ends = [0], [_NONE], [None]
        self.path, self.last, self.first = [0], b"", None

    def add(self, seq: bytes, n: int, low: int, ends: str) -> None:
        from xxhash import xxh3_128_digest

        same, most = 0, min(len(seq), len(self.last)) // TURN_BYTES
        while same < most and seq[same * TURN_BYTES : (same + 1) * TURN_BYTES] == self.last[same * TURN_BYTES : (same + 1) * TURN_BYTES]:
            same += 1
        self.bits += [0] * (len(self.path) - 1 - same)
        del self.path[same + 1 :]
        for d in range(same, len(seq) // TURN_BYTES):
            turn = seq[d * TURN_BYTES : (d + 1) * TURN_BYTES]
            up = self.path[-1]
            self.bits.append(1)
            self.path.append(len(self.up))
            self.up.append(up)
            self.depth.append(d + 1)
            self.words.append(int.from_bytes(turn[16:], "big"))
            self.names.append(xxh3_128_digest(self.names[up] + turn))
            self.n.append(0)
            self.low.append(_NONE)
            self.ends.append(None)
        k = self.path[-1]
        self.n[k], self.low[k], self.ends[k], self.last = n, low, ends, seq
        if self.first is None:
            self.first = len(self.up)  # the first sequence's nodes are the first ones

    def rows(self, shard: int) -> pa.RecordBatch:
        brackets = Parentheses(np.array(self.bits + [0] * len(self.path), np.uint8))
        opens = np.flatnonzero(brackets.bits)
        size = (brackets.closes(opens) - opens + 1) // 2
        at, words = np.arange(len(opens)), np.array(self.words, np.int64)

        def within(values: np.ndarray) -> np.ndarray:
            total = np.concatenate(([0], np.cumsum(values)))
            return total[at + size] - total[at]

        path = np.zeros(len(opens), np.int32)
        path[: self.first] += 1
        path[self.path] += 2
        off = path == 0
        n, low, up = within(np.array(self.n, np.int64)), _range_min(np.array(self.low, np.int64), size), np.array(self.up)
        leaves = within((size == 1) & off)
        saved = within(np.where(off, (n - 1) * words, 0))
        children = np.bincount(up[1:][off[1:]], minlength=len(opens))
        inner = off & off[up]
        pick = lambda x, use: pa.array([v if u else None for v, u in zip(x, use.tolist(), strict=True)], pa.binary())
        return pa.RecordBatch.from_arrays([
            pa.array(np.full(len(opens), shard), pa.int64()), pa.array(path, pa.int32()), pick(self.names, ~off),
            pick([self.names[u] for u in self.up], ~inner & (at > 0)), pa.array(self.depth, pa.int64()), pa.array(words),
            pa.array(low), pa.array(low[up], pa.int64(), mask=~inner), pa.array(n), pa.array(children, pa.int64()), pa.array(leaves, pa.int64()),
            pa.array(saved, pa.int64()), pa.array(self.ends, pa.string())], schema=_NODE)


def shards(found: DataFrame, shard_nodes: int = SHARD_NODES) -> DataFrame:
    """Rows of nodes by shard: whole ones off the spines (path 0), parts on the way to the first (1) or last sequence (2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, shard = TaskContext.get().partitionId() << 32, _Shard()
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if len(shard.up) > shard_nodes:
                    yield shard.rows(number)
                    number, shard = number + 1, _Shard()
                shard.add(*row)
        if shard.first is not None:
            yield shard.rows(number)

    width = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return found.repartitionByRange(width, "seq").sortWithinPartitions("seq").select("seq", "n", "low", "ends").mapInArrow(run, _NODE_DDL)


def _below(spine: pd.DataFrame) -> pd.DataFrame:
    """For each spine node of a shard what the shard's own spine nodes in its subtree add up to."""
    spine = spine.sort_values("depth", ascending=False)
    gain, leaf = spine["gain"].where(spine["own"], 0), spine["leaf"].where(spine["own"], 0)
    out = pd.DataFrame({"node": spine["node"], "saved": gain.groupby(spine["path"]).cumsum(), "leaves": leaf.groupby(spine["path"]).cumsum()})
    shared, single = spine["path"] == 3, spine["path"] < 3  # a node on both ways has all nodes on one of them below it
    out.loc[shared, "saved"] += gain[single].sum()
    out.loc[shared, "leaves"] += leaf[single].sum()
    return out


def merged_spines(rows: DataFrame) -> DataFrame:
    """One whole row for each node of the spines, whose parts several shards may hold."""
    spine = rows.where("path > 0")
    parts = cut(spine.groupBy("node").agg(
        F.min("shard").alias("owner"), F.first("depth").alias("depth"), F.first("parent").alias("parent"), F.first("words").alias("words"),
        F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("n_children"),
        F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"), F.max("ends").alias("ends")))
    kids = parts.where("parent is not null").groupBy(F.col("parent").alias("of")).agg(F.count("*").alias("kids"))
    whole = cut(parts.join(kids, F.col("node") == F.col("of"), "left").withColumn("n_children", F.col("n_children") + F.coalesce("kids", F.lit(0)))
                .withColumn("gain", (F.col("n_convs") - 1) * F.col("words")).withColumn("leaf", (F.col("n_children") == 0).cast("long"))
                .drop("of", "kids"))
    own = whole.select(F.col("node").alias("of"), "owner", "gain", "leaf")
    below = (spine.select("shard", "path", "node", "depth").join(own, F.col("node") == F.col("of"))
             .select("shard", "path", "node", "depth", (F.col("owner") == F.col("shard")).alias("own"), "gain", "leaf")
             .groupBy("shard").applyInPandas(_below, "node binary, saved long, leaves long")
             .groupBy(F.col("node").alias("of")).agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves")))
    return (whole.join(below, F.col("node") == F.col("of"))
            .withColumn("saved_tokens", F.col("saved_tokens") + F.col("saved")).withColumn("n_leaves", F.col("n_leaves") + F.col("leaves"))
            .select("node", "parent", "depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends"))


def trie(seqs: DataFrame, shard_nodes: int = SHARD_NODES) -> DataFrame:
    """Nodes of the trie over (conv_id, turns): conv_id (smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens and ends_sha256 of the members that end there."""
    rows = cut(shards(cut(distinct_sequences(seqs)), shard_nodes))
    spine = cut(merged_spines(rows))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends"]
    waiting = rows.where("path = 0 and parent is not null").drop("parent_conv_id").unionByName(spine, allowMissingColumns=True)
    of = spine.select(F.col("node").alias("of"), F.col("conv_id").alias("parent_conv_id"))
    found = rows.where("path = 0 and parent is null").select(*columns).unionByName(
        waiting.join(of, F.col("parent") == F.col("of"), "left").select(*columns))
    empty = hashlib.sha256().hexdigest()
    return found.withColumn("ends_sha256", F.coalesce("ends", F.lit(empty))).drop("ends")
