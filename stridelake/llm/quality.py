"""Quality classifier: a sparse ensemble of rules over text statistics.

Boosted shallow trees are grown on a bounded sample of labelled rows; every path from a root is a
conjunction of conditions on statistics. A lasso logistic regression weighs these rules, most get
weight zero, and the others become one Spark column expression that scores every row.

Empty and null texts have all statistics zero and get a score like any other. Without usable labels of
both kinds there are no rules and the score is the smoothed share of label 1 (0.5 without labels).
A doc_id labelled twice counts once, with its smallest label; null labels do not count.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import islice
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, texts

#: Labelled rows to fit on, at most: those with the smallest hash of doc_id.
SAMPLE_ROWS = 20_000
TREES, DEPTH, BINS, LEAF_ROWS, SHRINKAGE, LASSO = 40, 3, 64, 8, 0.3, 2e-3
THRESHOLD = 0.3
#: Words within which distinct ones are counted, so that long texts do not look repetitive.
BLOCK = 64

STATISTICS = [
    "size", "word_bytes", "marks", "bangs", "bars", "upper", "digits", "repeats", "distinct", "stops", "lines", "wide",
]


def _statistics(text: bytes) -> tuple[float, ...]:
    n = max(len(text), 1)
    c = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    words = text.split()
    w = max(len(words), 1)
    letters = max(int(c[65:91].sum() + c[97:123].sum()), 1)
    return (
        math.log1p(len(text)), (len(text) - (w - 1)) / w,
        c[[35, 36, 37, 38, 42, 60, 62, 94, 95, 126]].sum() / n, c[33] / w, c[124] / w,
        c[65:91].sum() / letters, c[48:58].sum() / n, sum(map(eq, words, islice(words, 1, None))) / w,
        sum(len(set(words[i : i + BLOCK])) for i in range(0, len(words), BLOCK)) / w, (c[46] + c[44]) / w, c[10] / n, c[128:].sum() / n,
    )


@F.pandas_udf(T.StructType([T.StructField(s, T.DoubleType()) for s in STATISTICS]))
def statistics(text: pd.Series) -> pd.DataFrame:
    """Statistics of each text; null counts as empty."""
    return pd.DataFrame([_statistics((t or "").encode()) for t in text], columns=STATISTICS, dtype="float64")


Rule = tuple[tuple[int, bool, float], ...]  # conditions: statistic, whether above, limit


@dataclass
class RuleModel:
    intercept: float
    rules: list[tuple[float, Rule]]

    def score(self, stats: str) -> Column:
        """Probability of label 1 as a column expression over the struct column ``stats``."""
        total = F.lit(self.intercept)
        for weight, rule in self.rules:
            holds = F.lit(True)
            for k, above, limit in rule:
                value = F.col(f"{stats}.{STATISTICS[k]}")
                holds = holds & ((value > limit) if above else (value <= limit))
            total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _holds(x: np.ndarray, rule: Rule) -> np.ndarray:
    out = np.ones(len(x), bool)
    for k, above, limit in rule:
        out &= (x[:, k] > limit) if above else (x[:, k] <= limit)
    return out


def _grow(x: np.ndarray, limits: list[np.ndarray], grad: np.ndarray, hess: np.ndarray, rows: np.ndarray,
          path: Rule, found: list[Rule], step: np.ndarray) -> None:
    """Split ``rows`` by the largest gain; note the path of every node and the value of every leaf."""
    if path:
        found.append(path)
    best = (1e-6, None)
    g, h = grad[rows].sum(), hess[rows].sum()
    if len(path) < DEPTH:
        for k, cuts in enumerate(limits):
            if not len(cuts):
                continue
            b = np.searchsorted(cuts, x[rows, k], "left")  # bin i: at most cuts[i]
            size = len(cuts) + 1
            gl, hl, nl = (np.cumsum(np.bincount(b, v, size))[:-1] for v in (grad[rows], hess[rows], np.ones(len(rows))))
            gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
            gain[(nl < LEAF_ROWS) | (len(rows) - nl < LEAF_ROWS)] = 0
            i = int(gain.argmax())
            if gain[i] > best[0]:
                best = (gain[i], (k, cuts[i]))
    if best[1] is None:
        step[rows] = g / (h + 1)
        return
    k, limit = best[1]
    above = x[rows, k] > limit
    for side in (False, True):
        _grow(x, limits, grad, hess, rows[above == side], (*path, (k, side, float(limit))), found, step)


def fit_rules(x: np.ndarray, y: np.ndarray) -> RuleModel:
    """Rules from boosted trees, weights from a lasso logistic regression (accelerated proximal gradient)."""
    n, ones = len(y), int(y.sum())
    prior = math.log((ones + 1) / (n - ones + 1))
    if not 0 < ones < n:
        return RuleModel(prior, [])
    limits = []
    for k in range(x.shape[1]):
        values = np.unique(x[:, k])
        middles = (values[1:] + values[:-1]) / 2
        limits.append(middles if len(middles) <= BINS else np.unique(np.quantile(middles, np.linspace(0, 1, BINS))))
    found: list[Rule] = []
    margin = np.full(n, prior)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        step = np.zeros(n)
        _grow(x, limits, y - p, p * (1 - p), np.arange(n), (), found, step)
        margin = margin + SHRINKAGE * step
    by_rows = {_holds(x, r).tobytes(): r for r in reversed(dict.fromkeys(found))}  # one rule for equal sets of rows
    rules = list(by_rows.values())
    if not rules:
        return RuleModel(prior, [])
    z = np.stack([_holds(x, r) for r in rules], 1).astype(float)
    mean, scale = z.mean(0), np.maximum(z.std(0), 1e-9)
    z = (z - mean) / scale
    rate = 4.0 * n / (np.linalg.norm(z, 2) ** 2 + n)
    w = v = np.zeros(len(rules))
    b = c = prior
    t = 1.0
    for _ in range(400):
        r = 1 / (1 + np.exp(-(z @ v + c))) - y
        nw, nb = v - rate * (z.T @ r) / n, c - rate * r.mean()
        nw = np.sign(nw) * np.maximum(np.abs(nw) - rate * LASSO, 0)
        nt = (1 + math.sqrt(1 + 4 * t * t)) / 2
        v, c = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    kept = [(float(w[i] / scale[i]), rules[i]) for i in np.flatnonzero(w)]
    return RuleModel(float(b - (w * mean / scale).sum()), kept)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> RuleModel:
    """Fit on at most ``sample_rows`` labelled documents; ``labels`` holds the rows one may learn from.

    The sample's ids (bounded by ``sample_rows``) are broadcast, so only sampled texts are measured.
    """
    sample = (labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
              .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(label).alias("_y"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows))
    rows = (texts(docs).join(F.broadcast(sample), "doc_id").select("doc_id", "_y", statistics("text").alias("_s"))
            .select("doc_id", "_y", "_s.*").toPandas().sort_values("doc_id").drop_duplicates("doc_id"))
    return fit_rules(rows[STATISTICS].to_numpy(float), rows["_y"].to_numpy(float))


def may_learn(labels: DataFrame) -> DataFrame:
    """Labels outside the held-out fold."""
    return labels.where(~held_out())


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def score(docs: DataFrame, model: RuleModel) -> DataFrame:
    """(doc_id, score) of every document."""
    return texts(docs).select("doc_id", statistics("text").alias("_s")).select("doc_id", model.score("_s").alias("score"))


def accepted(docs: DataFrame, model: RuleModel, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``docs``, with all their columns, that score at least ``threshold``."""
    small_batches(docs.sparkSession)
    own = "_llm_statistics"
    return (docs.withColumn(own, statistics("text")).where(model.score(own) >= threshold).select(*(docs[c] for c in docs.columns)))
