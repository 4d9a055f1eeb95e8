"""Quality scores from preference pairs (Bradley-Terry), cut at a quantile of the scores.

Labelled documents give pairs (better, worse); the weights minimise the mean logistic loss of the
pairs' feature differences plus an L2 term. A document's utility is the weighted sum of its features.
The cut is the quantile of the training utilities at the share of low-quality labels, and a logistic
fit of the training labels, smoothed by one document of each label, on the utility's distance from that cut
gives a score that equals ``threshold`` at the cut and keeps the ranking, even where the labels are told
apart without a fault.

Features are shares of byte classes, word lengths and repetition of words and lines, from the whole
text alone. Training reads at most ``MAX_TRAINING_ROWS`` labelled rows, those with the smallest hash
of their id; scoring reads every row.

Defined cases: null text scores as the empty text; a document with conflicting labels, or a null
label or id, does not train; repeated rows each get a row; without both labels in training every
score is the share of label 1 (0.5 without labels); equal texts have equal scores; texts of any length
count whole; other columns stay as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline.llm.common import bounded_batches, fresh, held_out, read

#: Bound of the training sample, whatever the size of the labels table.
MAX_TRAINING_ROWS = 6_000
#: Preference pairs drawn from that sample.
PAIRS = 60_000
THRESHOLD = 0.3
L2 = 1e-4
SEED = 11

_CLASSES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" ", b"\n", b"\t\r\x0b\x0c", b".", b",", b"!?", b"#", b"$", b"%", b"&", b"*", b"|", b"@", b":;", b"/\\", b"<>[]{}()", b"=+-_~^", b"'\"`"]
_LOOKUP = np.full(256, len(_CLASSES), np.intp)
for _i, _c in enumerate(_CLASSES):
    _LOOKUP[list(_c)] = _i
_LOOKUP[128:] = len(_CLASSES) + 1
_CONTROL = len(_CLASSES)
N_BASE = len(_CLASSES) + 2
N_FEATURES = 2 * N_BASE + 9


def features(text: str | None) -> np.ndarray:
    """The feature vector of one text, all of it."""
    raw = (text or "").encode("utf-8", "replace")
    n = len(raw)
    out = np.zeros(N_FEATURES)
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    shares = np.bincount(_LOOKUP, weights=hist, minlength=N_BASE) / max(n, 1)
    out[:N_BASE] = shares
    out[N_BASE : 2 * N_BASE] = np.sqrt(shares)
    words = raw.split()
    k = len(words)
    if k:
        lines = raw.split(b"\n")
        o = 2 * N_BASE
        distinct = len(set(words))
        out[o] = np.log1p(k)
        out[o + 1] = np.log1p(n / k)
        out[o + 2] = distinct / k
        out[o + 3] = np.log1p(distinct)
        out[o + 4] = len(set(zip(words, words[1:], words[2:], strict=False))) / max(k - 2, 1) if k > 2 else 1.0
        out[o + 5] = len(set(lines)) / len(lines)
        out[o + 6] = np.log1p(n / len(lines))
        out[o + 7] = np.log1p(max(map(len, words)))
        out[o + 8] = 1.0
    return out


@dataclass(frozen=True)
class BradleyTerry:
    """Utility weights over standardised features, and the logistic line from utility to score."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    slope: float
    threshold: float
    constant: float | None = None

    def utility(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        z = self.slope * (self.utility(x) - self.cut) + np.log(self.threshold / (1 - self.threshold))
        return np.where(z >= 0, 1, np.exp(np.minimum(z, 0))) / (1 + np.exp(-np.abs(z)))


def _descend(diff: np.ndarray, l2: float, rounds: int = 25) -> np.ndarray:
    """Newton steps on the mean of log(1 + exp(-w d)) + l2 |w|^2 / 2."""
    w = np.zeros(diff.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(np.clip(diff @ w, -40, 40)))
        grad = -(diff * p[:, None]).mean(0) + l2 * w
        hess = (diff * (p * (1 - p))[:, None]).T @ diff / len(diff) + l2 * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step * min(1.0, 4.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, threshold: float = THRESHOLD, seed: int = SEED) -> BradleyTerry:
    """Learns from feature rows and 0/1 labels; the preferred side of a pair is the one labelled 1."""
    y = np.asarray(y, int)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        share = float(y.mean()) if len(y) else 0.5
        zero = np.zeros(N_FEATURES)
        return BradleyTerry(zero, zero + 1, zero, 0.0, 1.0, threshold, share)
    mean, scale = x.mean(0), x.std(0)
    scale[scale < 1e-9] = 1.0
    z = np.clip((x - mean) / scale, -6, 6)
    rng = np.random.default_rng(seed)
    diff = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
    w = _descend(diff, L2)
    u = z @ w
    cut = float(np.quantile(u, len(bad) / len(y)))
    # the slope alone is fitted: the score at the cut stays at the threshold
    base = np.log(threshold / (1 - threshold))
    target = np.where(y == 1, (len(good) + 1) / (len(good) + 2), 1 / (len(bad) + 2))
    spread = max(float(np.abs(u - cut).mean()), 1e-9)

    def loss(slope: float) -> float:
        z = slope * (u - cut) + base
        return float(np.mean(np.logaddexp(0, z) - target * z))

    # the loss is convex in the slope and rises again, since no target is 0 or 1
    low, high = 0.0, 100 / spread
    for _ in range(100):
        a, b = low + (high - low) * 0.382, low + (high - low) * 0.618
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return BradleyTerry(mean, scale, w, cut, (low + high) / 2, threshold)


def train(docs: DataFrame, labels: DataFrame, rows: int = MAX_TRAINING_ROWS, threshold: float = THRESHOLD) -> BradleyTerry:
    """Features of the sample are computed on the executors; only they reach the driver."""
    ids = sample_ids(labels, "quality", rows)
    found = docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("lid"))

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "y": b["y"], "x": [features(t) for t in b["text"]]})

    got = found.select("doc_id", "y", "text").mapInPandas(extract, "doc_id long, y int, x array<double>").orderBy("doc_id").toPandas()
    x = np.array(got["x"].tolist(), float).reshape(len(got), N_FEATURES)
    return fit(x, got["y"].to_numpy(int), threshold=threshold)


def sample_ids(labels: DataFrame, label: str, rows: int) -> DataFrame:
    """(lid, y) of at most ``rows`` labelled, not held-out ids: those with the smallest hash."""
    lid = F.col("doc_id").cast("long")
    return (
        labels.select(lid.alias("lid"), F.col(label).cast("int").alias("y"))
        .where(F.col("lid").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("lid")))
        .groupBy("lid").agg(F.min("y").alias("y"), F.max("y").alias("top")).where("y = top").select("lid", "y")
        .orderBy(F.xxhash64("lid"), "lid").limit(rows)
    )


def score_column(model: BradleyTerry):
    """A pandas UDF from text to score."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        x = np.array([features(t) for t in texts]).reshape(len(texts), N_FEATURES)
        return pd.Series(model.score(x))

    return score


def score_documents(docs: DataFrame, labels: DataFrame, rows: int = MAX_TRAINING_ROWS, threshold: float = THRESHOLD, name: str = "_quality") -> DataFrame:
    """``docs`` with the score as column ``name``; the threshold is where it should be cut."""
    if name != fresh(docs, name):
        raise ValueError(f"the documents have a column {name}; name another one")
    docs = bounded_batches(docs)
    model = train(docs, labels, rows, threshold)
    return docs.withColumn(name, score_column(model)(F.col("text")))


def op9_quality_bradley_terry(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels")
    scored = score_documents(docs, labels)
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        F.col("_quality").alias("score"),
        (F.col("_quality") >= THRESHOLD).cast("int").alias("predicted"),
    )
