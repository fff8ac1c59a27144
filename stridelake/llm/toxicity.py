"""Toxicity behind disguises: restore the text by a noisy channel, then score the restored words.

* Language model. Words of all documents are counted (the table of words grows with the corpus); their letter
  trigrams over a fixed alphabet give a character model of bounded size.
* Channel. A disguised word is a lattice: digits and signs stand for letters, marks between letters may be
  nothing or a word's end, long repetitions are one or two letters. Three or more single characters in a row
  are one lattice, whatever blanks part them, and each blank is nothing or a word's end. Viterbi finds the likeliest
  words under channel and language model. Plain words stay as they are, also when a blank parts them in
  pieces of several letters ("st upid"): those are not joined.
* Score. A lexicon of words and word beginnings is learnt from labelled rows: greedily the one that explains
  most toxic documents not yet explained, if it is precise. Each entry has the share of toxic documents among
  those that have it, and a document's score is the noisy-or of its entries over a base rate.

Null and empty texts have no entry and get the base rate. Without usable labels of both kinds the lexicon is
empty. Texts are judged whole. A doc_id labelled twice counts once, with its largest label.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, texts

#: Labelled rows to learn from, at most (those with the smallest hash of doc_id), and lexicon candidates, at most.
SAMPLE_ROWS, CANDIDATES = 20_000, 5_000
THRESHOLD, PRECISION, SUPPORT, STEMS = 0.3, 0.6, 3, (3, 4, 5, 6, 7, 8)
#: Weight of a document's first, second, third and further entries in the cover; least gain of an entry.
COVERS, GAIN = (1.0, 0.1, 0.1, 0.0), 2.0

LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(chr(c) for c in range(0xDF, 0x100) if c != 0xF7)
EDGE, OTHER = "\x02", "\x01"
# fixed values: letters that a digit or sign may stand for
LOOKS_LIKE = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "gq",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¥": "y",
    "*": "aeiou", "#": "aeiou", "%": "aeiou",
}
MARKS = frozenset("._-~'`^*#%/\\:,;")
#: Log costs of a substitution, a dropped mark, a doubled letter kept from a repetition; states kept by Viterbi.
SWAP, DROP, DOUBLE, BEAM = -1.0, -0.7, -1.0, 48
#: Words a task remembers, and counts before handing them on.
KNOWN_WORDS = 500_000

_SPELLED = re.compile(r"(?<!\S)(?:\S\s+){2,}\S(?!\S)")
_PLAIN = re.compile(rf"[{LETTERS}]+")
_EDGES = ".,;:!?\"'()[]{}«»“”…"


def words(text: str) -> set[str]:
    """Distinct words of the lower-cased text; a run of single characters also as one, with single blanks."""
    text = text.lower()
    found = set(text.split())
    for m in _SPELLED.finditer(text):
        found.add(" ".join(m.group().split()) + " ")  # the space at its end marks it as disguised
    return found


def disguised(word: str) -> bool:
    """Whether ``word`` has letters and, within them, signs, digits or a letter three times."""
    return word.endswith(" ") or any(c.isalpha() for c in word) and (
        any(c in LOOKS_LIKE or c in MARKS for c in word) or re.search(r"(.)\1\1", word) is not None)


@dataclass
class CharModel:
    """Log probability of a letter after two others."""

    logs: dict[str, float] = field(default_factory=dict)
    pairs: dict[str, float] = field(default_factory=dict)

    def log(self, a: str, b: str, c: str) -> float:
        return self.logs.get(a + b + c) or self.pairs.get(a + b, -math.log(len(LETTERS) + 2))

    def restore(self, word: str) -> str:
        """The likeliest words behind ``word``, with single blanks; a plain word as it is."""
        core = word.strip().rstrip(_EDGES).lstrip("\"'([{«“")
        if not disguised(word if word.endswith(" ") else core):
            return core
        # what was done is a chain of (chain before, letters), so that long runs are not copied at each step
        beam: dict[tuple[str, str], tuple[float, tuple | None]] = {(EDGE, EDGE): (0.0, None)}
        for c, run in groupby(core):
            n = len(list(run))
            options = [(0.0, c)] if c.isalpha() else [(SWAP, x) for x in LOOKS_LIKE.get(c, "")]
            if n > 1:
                options += [(cost + (0.0 if n == 2 and c.isalpha() else DOUBLE), x * 2) for cost, x in options]
            if c == " ":
                options = [(0.0, ""), (0.0, EDGE)]
            elif c in MARKS:
                options += [(DROP * n, ""), (DROP * n, EDGE)]
            elif not options:
                options = [(DROP * n, "")] if not c.isdigit() else [(SWAP, OTHER)]
            grown: dict[tuple[str, str], tuple[float, tuple | None]] = {}
            for (a, b), (total, done) in beam.items():
                for cost, out in options:
                    x, y, value = a, b, total + cost
                    if out == EDGE:
                        if b == EDGE:
                            continue  # no empty words
                        value += self.log(a, b, EDGE)
                        x = y = EDGE
                    else:
                        for letter in out:
                            letter = letter if letter in LETTERS else OTHER
                            value += self.log(x, y, letter)
                            x, y = y, letter
                    if value > grown.get((x, y), (-math.inf,))[0]:
                        grown[x, y] = (value, (done, out) if out else done)
            beam = dict(sorted(grown.items(), key=lambda s: (-s[1][0], s[0]))[:BEAM])
        ends = [(total + (0.0 if b == EDGE else self.log(a, b, EDGE)), (a, b), done) for (a, b), (total, done) in beam.items()]
        done, parts = max(ends, key=lambda e: e[:2])[2], []
        while done is not None:
            done, out = done
            parts.append(out)
        return "".join(reversed(parts)).replace(EDGE, " ").strip()


_COUNTS = pa.schema([("word", pa.string()), ("n", pa.int64())])


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over all documents; words of letters only. Tasks count what they have read before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0):
                counts.update(text.as_py().lower().split())
                if len(counts) > KNOWN_WORDS:
                    yield _counted(counts)
                    counts = Counter()
        yield _counted(counts)

    return texts(docs).select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _counted(counts: Counter[str]) -> pa.RecordBatch:
    plain = Counter[str]()
    for w, n in counts.items():
        if _PLAIN.fullmatch(w := w.strip(_EDGES)):
            plain[w] += n
    return pa.RecordBatch.from_arrays([pa.array(list(plain), pa.string()), pa.array(list(plain.values()), pa.int64())], schema=_COUNTS)


def char_model(docs: DataFrame) -> CharModel:
    """Trigram model; the alphabet bounds what reaches the driver, whatever the corpus."""
    spelled = F.concat(F.lit(EDGE * 2), "word", F.lit(EDGE))
    grams = (word_counts(docs).select("n", F.explode(F.transform(
        F.sequence(F.lit(1), F.length("word") + 1), lambda i: F.substr(spelled, i, F.lit(3)))).alias("gram"))
        .groupBy("gram").agg(F.sum("n").alias("n")))
    count = {r.gram: r.n for r in grams.collect()}
    total: Counter[str] = Counter()
    for gram, n in count.items():
        total[gram[:2]] += n
    size = len(LETTERS) + 2
    return CharModel({g: math.log((n + 0.1) / (total[g[:2]] + 0.1 * size)) for g, n in sorted(count.items())},
                     {p: math.log(0.1 / (n + 0.1 * size)) for p, n in sorted(total.items())})


def entries(word: str) -> list[str]:
    """What a restored word offers the lexicon: itself (marked) and its beginnings."""
    return [f"{word}$", *(word[:n] for n in STEMS if len(word) >= n)]


@dataclass
class Lexicon:
    base: float
    share: dict[str, float]

    def chance(self, word: str) -> float:
        """Largest share of toxic documents among the word's entries, zero without any."""
        return max((self.share[e] for e in entries(word) if e in self.share), default=0.0)

    def chances(self, restored: str) -> tuple[float, ...]:
        """The chances of all words of a restored text that have one."""
        return tuple(p for w in restored.split(" ") if (p := self.chance(w)))


def _restored(model: CharModel) -> Column:
    """Array of the distinct restored words of a text."""
    return _per_text(lambda: model.restore, T.ArrayType(T.StringType()), lambda known, found: sorted({x for w in found for x in known[w].split(" ")}))


class _Known(dict):
    """Bounded table of a function's values."""

    def __init__(self, fn) -> None:  # noqa: ANN001
        super().__init__()
        self.fn = fn

    def __missing__(self, word: str):  # noqa: ANN204
        if len(self) >= KNOWN_WORDS:
            self.clear()
        self[word] = out = self.fn(word)
        return out


def _per_text(make, kind: T.DataType, of) -> Column:  # noqa: ANN001
    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = _Known(make())
        for text in batches:
            yield pd.Series([of(known, words(t or "")) for t in text], dtype=object if isinstance(kind, T.ArrayType) else float)

    return run("text")


def restored(docs: DataFrame, model: CharModel) -> DataFrame:
    """(doc_id, words): distinct restored words of every document."""
    return texts(docs).select("doc_id", _restored(model).alias("words"))


def fit(docs: DataFrame, labels: DataFrame, model: CharModel, label: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> Lexicon:
    """Lexicon from at most ``sample_rows`` labelled documents; copies of a text count once."""
    sample = (labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
              .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).alias("_y"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows))
    rows = cut(texts(docs).join(F.broadcast(sample), "doc_id").select("_y", F.xxhash64("text").alias("_h"), _restored(model).alias("words"))
               .dropDuplicates(["_h", "_y"]))
    offered = F.array_distinct(F.flatten(F.transform("words", lambda w: F.concat(
        F.array(F.concat(w, F.lit("$"))), *[F.when(F.length(w) >= n, F.array(F.substring(w, 1, n))).otherwise(F.array()) for n in STEMS]))))
    toxic = F.sum((F.col("_y") == 1).cast("long"))
    counts = (rows.select("_y", F.explode(offered).alias("entry")).groupBy("entry").agg(toxic.alias("t"), F.count("*").alias("n"))
              .where((F.col("t") >= SUPPORT) & (F.col("t") >= PRECISION * F.col("n")))
              .orderBy(F.desc(F.col("t") * 2 - F.col("n")), F.length("entry"), "entry").limit(CANDIDATES))
    candidates = [(r.entry, r.t, r.n) for r in counts.collect()]
    place = {e: k for k, (e, _, _) in enumerate(candidates)}
    table = rows.sparkSession.createDataFrame([(e, k) for e, k in place.items()], "entry string, k int")
    hits = (rows.where("_y = 1").select("_h", F.explode(offered).alias("entry")).join(F.broadcast(table), "entry")
            .groupBy("_h").agg(F.collect_set("k").alias("ks")).collect())
    sizes = rows.agg(toxic, F.count("*")).first()
    return _cover(candidates, [r.ks for r in hits], sizes[0] or 0, sizes[1])


def _cover(candidates: list[tuple[str, int, int]], hits: list[list[int]], toxic: int, rows: int) -> Lexicon:
    """Greedy cover of the toxic documents, each by several entries; ties go to the candidate listed first.

    Further entries of a document weigh less, clean documents that an entry has weigh against it, and an entry
    that is a beginning of a chosen one, or begins with it, tells nothing new.
    """
    open_ = np.zeros(len(candidates))
    having: dict[int, list[int]] = {}
    for d, ks in enumerate(hits):
        open_[ks] += COVERS[0]
        for k in ks:
            having.setdefault(k, []).append(d)
    clean = np.array([n - t for _, t, n in candidates], float)
    covered, share = [0] * len(hits), {}
    while len(candidates) and (gain := open_ - clean).max() >= GAIN:
        entry, t, n = candidates[k := int(gain.argmax())]
        share[entry] = (t + 0.5) / (n + 1)
        for d in having[k]:
            change = COVERS[covered[d] + 1] - COVERS[covered[d]]
            if change:
                open_[hits[d]] += change
                covered[d] += 1
        word = entry.rstrip("$")
        for i, (other, _, _) in enumerate(candidates):
            if word.startswith(other.rstrip("$")) or other.startswith(word):
                open_[i] = -math.inf
    found = sum(c > 0 for c in covered)
    return Lexicon((toxic - found + 0.5) / (rows - found + 1), share)


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


def score(docs: DataFrame, model: CharModel, lexicon: Lexicon) -> DataFrame:
    """(doc_id, score) of every document."""

    def noisy_or(known: dict[str, tuple[float, ...]], found: set[str]) -> float:
        clean = 1.0 - lexicon.base
        for p in sorted({p for w in found for p in known[w]}):
            clean *= 1.0 - p
        return 1.0 - clean

    made = _per_text(lambda: lambda w: lexicon.chances(model.restore(w)), T.DoubleType(), noisy_or)
    return texts(docs).select("doc_id", made.alias("score"))
