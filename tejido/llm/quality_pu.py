"""Quality classifier by positive-unlabelled learning.

Trusted positives are labelled good (quality 1); the unlabelled sample is web text whose labels are not looked at. A
logistic model over text statistics minimises the non-negative unbiased risk

    prior * E_P[loss(g)] + max(0, E_U[loss(-g)] - prior * E_P[loss(-g)])

with the logistic loss, so that its output estimates the probability of a good text. The class prior is estimated from
the same two samples: a positive-versus-unlabelled model ranks held-back halves of both, and the prior is the smallest
ratio, over score bounds, of the unlabelled to the positive share above the bound, each with its confidence margin.

Both samples are bounded (`positives`, `unlabelled` rows: those with the smallest hash of their id) and are taken from rows
outside the held-out fold only. Where ids repeat, all their rows belong to the samples, up to twice the bound in all; beyond
it the rows of larger ids are left out. Only the text is an input of a score. Every text is scored whole.

Null and empty texts: all statistics zero, scored like any other. Repeated rows and ids give one result row each. An
empty table gives no rows; without positives the prior is 0.5 and the score that of an untrained model (0.5).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remainder, small_batches, texts
from .textstats import repeated_words

POSITIVES, UNLABELLED = 5_000, 10_000
FOLDS = 5
THRESHOLD = 0.3

#: Byte classes: other signs, spaces, line end, lower, upper, beyond ASCII, digits, full stops and commas, and rarer marks.
_GROUPS = [b" \t\r\x0b\x0c", b"\n", bytes(range(97, 123)), bytes(range(65, 91)), bytes(range(128, 256)), b"0123456789", b".,", b"!?", b"#*$%&", b"|<>", b"'\"-:;()"]
CLASSES = len(_GROUPS) + 1
_class_of = np.zeros(256, np.int64)
for _k, _chars in enumerate(_GROUPS, 1):
    _class_of[list(_chars)] = _k
WIDTH = CLASSES * CLASSES + 6


def features(text: str) -> np.ndarray:
    """Shares of byte-class pairs (square roots), and six statistics of words and lines."""
    data = text.encode()
    out = np.zeros(WIDTH)
    words = data.split()
    if not words:
        return out
    kinds = _class_of[np.frombuffer(data, np.uint8)]
    if len(kinds) > 1:
        out[: CLASSES * CLASSES] = np.sqrt(np.bincount(kinds[:-1] * CLASSES + kinds[1:], minlength=CLASSES * CLASSES) / (len(kinds) - 1))
    n = len(words)
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lines = [x for x in data.split(b"\n") if x.strip()]
    out[-6:] = (
        min(1.0, np.log1p(n) / 10),
        repeated_words(words) / n,
        max(counts.values()) / (n + 20),
        1 - len(set(lines)) / len(lines),
        min(1.0, len(lines) / n),
        min(1.0, (len(data) - len(words)) / n / 20),
    )
    return out


def _descend(x: np.ndarray, gradient, rounds: int, step: float) -> np.ndarray:
    """Adam from zero over the columns of x and a constant."""
    w, m, v = np.zeros(x.shape[1]), np.zeros(x.shape[1]), np.zeros(x.shape[1])
    for i in range(1, rounds + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= step * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.999**i)) + 1e-8)
    return w


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def estimate_prior(p: np.ndarray, u: np.ndarray) -> float:
    """The share of positives in the unlabelled rows."""
    if len(p) < 20 or len(u) < 20:
        return 0.5
    (p1, p2), (u1, u2) = (p[::2], p[1::2]), (u[::2], u[1::2])

    def gradient(w):
        return -(p1.T @ (1 - _sigmoid(p1 @ w))) / len(p1) + u1.T @ _sigmoid(u1 @ w) / len(u1) + 1e-3 * w

    w = _descend(p1, gradient, 300, 0.02)
    sp, su = np.sort(p2 @ w), np.sort(u2 @ w)
    bounds = sp[: int(len(sp) * 0.9)]
    above_p = 1 - np.searchsorted(sp, bounds, "left") / len(sp)
    above_u = 1 - np.searchsorted(su, bounds, "left") / len(su)
    margin = 0.5 * (np.sqrt(np.log(20) / (2 * len(sp))) + np.sqrt(np.log(20) / (2 * len(su))))
    best = int(np.argmin((above_u + margin) / above_p))
    return float(np.clip(above_u[best] / above_p[best], 0.05, 0.95))


def as_negatives(w: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float) -> float:
    """The negatives' share of the risk, from unlabelled rows less the positives among them; estimates can go below zero."""
    return float(np.logaddexp(0, u @ w).mean() - prior * np.logaddexp(0, p @ w).mean())


def risk(w: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float) -> float:
    """The non-negative risk of weights w."""
    return float(prior * np.logaddexp(0, -(p @ w)).mean() + max(0.0, as_negatives(w, p, u, prior)))


def risk_gradient(w: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float) -> np.ndarray:
    """The risk's gradient; where the negatives' share is below zero, the step that brings it back up."""
    sp, su = _sigmoid(p @ w), _sigmoid(u @ w)
    down = u.T @ su / len(u) - prior * (p.T @ sp) / len(p)
    if as_negatives(w, p, u, prior) < 0:
        return -down
    return down - prior * (p.T @ (1 - sp)) / len(p)


class QualityModel:
    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, prior: float):
        self.mean, self.scale, self.weights, self.prior = mean, scale, weights, prior

    def inputs(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([np.clip((x - self.mean) / self.scale, -8, 8), np.ones((len(x), 1))])

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.inputs(x) @ self.weights)

    @classmethod
    def fit(cls, p: np.ndarray, u: np.ndarray, rounds: int = 600) -> QualityModel:
        if not len(p) or not len(u):
            return cls(np.zeros(WIDTH), np.ones(WIDTH), np.zeros(WIDTH + 1), 0.5)
        model = cls(u.mean(axis=0), u.std(axis=0) + 0.02, np.zeros(WIDTH + 1), 0.5)
        p, u = model.inputs(p), model.inputs(u)
        model.prior = prior = estimate_prior(p, u)

        model.weights = _descend(p, lambda w: risk_gradient(w, p, u, prior) + 1e-3 * w, rounds, 0.02)
        return model


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED, folds: int = FOLDS) -> QualityModel:
    def smallest(rows: DataFrame, n: int) -> DataFrame:
        return rows.select(F.col("doc_id").cast("long").alias("doc_id")).where(remainder(F.col("doc_id"), folds) != 0).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(t).astype("<f4").tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("good"), pa.array(x, pa.binary())], ["doc_id", "good", "x"])

    good = smallest(labels.where("quality = 1"), positives).withColumn("good", F.lit(True))
    # The good ids go first; an id in both samples serves in both.
    picked = good.unionByName(smallest(docs, unlabelled).withColumn("good", F.lit(False)))
    sample = texts(docs).join(F.broadcast(picked), "doc_id").mapInArrow(run, "doc_id long, good boolean, x binary")
    rows = sample.orderBy("doc_id", "good", "x").limit(2 * (positives + unlabelled)).collect()
    of = lambda kind: np.array([np.frombuffer(r["x"], "<f4") for r in rows if r["good"] is kind], float).reshape(-1, WIDTH)
    return QualityModel.fit(of(True), of(False))


SCHEMA = "doc_id long, held_out boolean, score double, predicted int, prior double"


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, folds: int = FOLDS) -> DataFrame:
    """SCHEMA: one row per row of docs."""
    model = train(docs, labels, folds=folds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([features(t) for t in b.column("text").to_pylist()]).reshape(-1, WIDTH)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.score(x), pa.float64())], ["doc_id", "score"])

    scored = texts(docs).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(remainder(F.col("doc_id"), folds) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), F.lit(model.prior).alias("prior"))


def keep(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that are not rejected, with all their columns, scored where they stand: no join."""
    model = train(docs, labels)
    small_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([features(t or "") for t in b.column(at).to_pylist()]).reshape(-1, WIDTH)
            yield b.filter(pa.array(model.score(x) >= threshold, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
