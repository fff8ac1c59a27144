"""Byte-level BPE as a streaming transducer with bounded lookahead, and the inverse state machine.

Text is cut into pieces by the tokenizer's pattern; merges never cross pieces. Within a piece, text that
follows can change tokens only a bounded way back. ``lookahead`` computes that bound from the merge list:

  Run the merges with and without a continuation and follow the place up to which both agree. It moves
  left only when a merge (u, v) takes the token u that ends there in one run alone; the next move is a
  later merge whose v begins with that u, because the token that starts at the new place has u as its
  beginning in both runs. So the way back is at most the longest sum of |u| along merges in rank order
  where each v begins with the u before.

A long piece is therefore read in blocks: tokens that end at least ``lookahead`` bytes before the end of
what was read are stable and emitted, and the rest is read again with the next block. Memory stays at a
block plus the lookahead, however long a piece is. Short pieces are kept in a bounded table.

Decoding feeds the tokens' bytes to an incremental UTF-8 machine; malformed input gives U+FFFD, ids
without a token give nothing. Null and empty texts have no tokens and decode to an empty text. Special
tokens' strings in a text become their ids unless ``special`` is off.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
from collections.abc import Callable, Iterable, Iterator
from functools import cache
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import per_text, texts

# fixed values: the pattern of the byte-level tokenizers, with Unicode classes
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: The same pattern where no character is in OTHER: letters and digits are then these.
LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u02af"
LATIN_PIECES = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LATIN}]+| ?[0-9]+| ?[^ \t-\r0-9{LATIN}]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]+")
OTHER = re.compile(rf"[^\x00-\x7f{LATIN}]")
LONE_SPACE = regex.compile(r"(?<=\S) (?=\S)")

#: Characters of a piece kept in the table, pieces in it, characters cut into pieces at once, bytes of a block.
SHORT, KNOWN, SLICE, BLOCK = 48, 400_000, 1 << 18, 1 << 14
NONE = 1 << 60


def default_path() -> str:
    """The public vocabulary file on this machine; not part of the repository."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """Letter that stands for each byte in vocabulary files: printable ones themselves, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


class _Pieces(dict):
    """Ids of pieces as bytes; two generations, so that what is in use outlives a full table."""

    def __init__(self, ids: Callable[[bytes], list[int]]) -> None:
        super().__init__()
        self.ids, self.older = ids, {}

    def __missing__(self, piece: str) -> bytes:
        found = self.older.get(piece) or np.array(self.ids(piece.encode()), np.int32).tobytes()
        if len(self) >= KNOWN:
            self.older = dict(self)
            self.clear()
        self[piece] = found
        return found


class Transducer:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.bytes_of = {i: raw(t) for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.single = [vocab[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.rank = {(vocab[a], vocab[b]): rank for rank, (a, b) in enumerate(pairs)}
        self.made = [vocab[a + b] for a, b in pairs]
        self.lookahead = lookahead([(raw(a), raw(b)) for a, b in pairs])
        self.known = _Pieces(self._short)
        names = sorted(self.special, key=len, reverse=True)
        self.cuts = regex.compile("|".join(map(regex.escape, names))) if names else None

    def encode(self, text: str, special: bool = True) -> Iterator[np.ndarray]:
        """Ids of ``text``, a part at a time."""
        at = 0
        for m in self.cuts.finditer(text) if special and self.cuts else ():
            yield from self._plain(text[at : m.start()])  # what stands behind a special token is no context
            yield np.array([self.special[m.group()]], np.int32)
            at = m.end()
        yield from self._plain(text[at:] if at else text)

    def _plain(self, text: str) -> Iterator[np.ndarray]:
        known = self.known
        split = PIECES if OTHER.search(text) else LATIN_PIECES
        at = 0
        while at < len(text):
            # a lone space between two others always begins a piece
            edge = LONE_SPACE.search(text, at + SLICE) if len(text) > at + SLICE else None
            to = edge.start() if edge else len(text)
            pieces = split.findall(text[at:to])
            at = to
            if max(map(len, pieces)) <= SHORT:
                yield np.frombuffer(b"".join(map(known.__getitem__, pieces)), np.int32)
                continue
            for p in pieces:
                if len(p) > SHORT:
                    for ids in self.stream(p.encode()):
                        yield np.array(ids, np.int32)
                else:
                    yield np.frombuffer(known[p], np.int32)

    def _short(self, piece: bytes) -> list[int]:
        """Merge the leftmost pair of lowest rank until there is none."""
        single, get, made = self.single, self.rank.get, self.made
        ids = [single[b] for b in piece]
        ranks = [get(p, NONE) for p in zip(ids, ids[1:])]
        while ranks and (low := min(ranks)) != NONE:
            i = ranks.index(low)
            ids[i] = made[low]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get((ids[i - 1], ids[i]), NONE)
            if i < len(ranks):
                ranks[i] = get((ids[i], ids[i + 1]), NONE)
        return ids

    def stream(self, piece: bytes, block: int | None = None) -> Iterator[list[int]]:
        """Ids of a piece of any length, a stable part at a time."""
        step = block or max(BLOCK, 4 * self.lookahead)
        open_, at = b"", 0
        while at < len(piece):
            open_ += piece[at : at + step]
            at += step
            ids = self._merged(open_)
            if at >= len(piece):
                yield ids
                return
            stable = len(open_) - self.lookahead
            n = used = 0
            for i in ids:
                if used + len(self.bytes_of[i]) > stable:
                    break
                used += len(self.bytes_of[i])
                n += 1
            if n:
                yield ids[:n]
                open_ = open_[used:]

    def _merged(self, piece: bytes) -> list[int]:
        """Merges by rank, then place, with a heap over a linked list: n log n for long pieces."""
        get, made = self.rank.get, self.made
        ids = [self.single[b] for b in piece]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i, p in enumerate(zip(ids, ids[1:])) if (r := get(p, NONE)) != NONE]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if j >= n or get((ids[i], ids[j])) != rank:
                continue  # one of the two has been merged meanwhile
            ids[i], ids[j] = made[rank], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := get((ids[i], ids[k]), NONE)) != NONE:
                    heapq.heappush(heap, (r, i))
            if (h := before[i]) >= 0 and (r := get((ids[h], ids[i]), NONE)) != NONE:
                heapq.heappush(heap, (r, h))
        return [x for x in ids if x >= 0]

    def decode(self, ids: Iterable[int], chunk: int = 1 << 14) -> Iterator[str]:
        """Text of the ids, a part at a time; bytes of an unfinished character wait for the next part."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        known, rest = self.bytes_of, iter(ids)
        while part := list(islice(rest, chunk)):
            yield machine.decode(b"".join([known.get(i, b"") for i in part]))
        yield machine.decode(b"", True)


def lookahead(merges: list[tuple[bytes, bytes]]) -> int:
    """Bytes back from the end that a continuation can change at most."""
    way: dict[bytes, int] = {}
    for u, v in merges:
        behind = max((way.get(v[:k], 0) for k in range(1, len(v) + 1)), default=0)
        way[u] = max(way.get(u, 0), len(u) + behind)
    return max(way.values(), default=0)


@cache
def transducer(path: str) -> Transducer:
    """One per Python worker."""
    return Transducer(path)


def ids_of(text: Column, path: str, special: bool = True) -> Column:
    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def encode(text: pd.Series) -> pd.Series:
        own = transducer(path)

        def one(t: str) -> np.ndarray:
            return np.concatenate([np.empty(0, np.int32), *own.encode(t, special)])

        return text.map(one)

    return encode(text)


def text_of(ids: Column, path: str) -> Column:
    @F.pandas_udf(T.StringType())
    def decode(ids: pd.Series) -> pd.Series:
        own = transducer(path)
        return ids.map(lambda x: "".join(own.decode(x.tolist())))

    return decode(ids)


def encode(docs: DataFrame, path: str | None = None, special: bool = True) -> DataFrame:
    """(doc_id, ids) of every document."""
    return texts(docs).select("doc_id", ids_of(F.col("text"), path or default_path(), special).alias("ids"))


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids, text) of (doc_id, ids)."""
    return encoded.select("doc_id", "ids", text_of(F.col("ids"), path or default_path()).alias("text"))


_TRIP = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def round_trip(docs: DataFrame, path: str | None = None, special: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document, encoded and decoded part by part.

    The digests are those of the decimal ids joined by commas and of the decoded text in UTF-8. Tokens go
    from the encoder to the decoder as they become stable, so neither ids nor text are ever held whole.
    """
    path = path or default_path()

    def prepare() -> Callable[[int, bytes], list[tuple]]:
        own = transducer(path)

        def trip(doc_id: int, text: bytes) -> list[tuple]:
            n, ids_sha, text_sha = 0, hashlib.sha256(), hashlib.sha256()

            def tokens() -> Iterator[int]:
                nonlocal n
                for part in own.encode(text.decode(), special):
                    ids = part.tolist()
                    if ids:
                        ids_sha.update(("," if n else "").encode() + ",".join(map(str, ids)).encode())
                        n += len(ids)
                        yield from ids

            for part in own.decode(tokens()):
                text_sha.update(part.encode())
            return [(doc_id, n, ids_sha.hexdigest(), text_sha.hexdigest())]

        return trip

    return per_text(texts(docs), None, _TRIP, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", prepare)
