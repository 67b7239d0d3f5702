"""Quality classifier: naive Bayes support vectors.

Indicators of word n-grams (here words, marks and their pairs, hashed) are
scaled by the log-count ratio of the classes; a linear hinge-loss model is fitted to
them by dual coordinate descent, and a sigmoid turns its margin into a score.

The model is fitted on at most ``max_rows`` labelled documents (those with the
smallest hash of their id); all documents are scored, on their whole text.

Defined cases: a null or empty text has no n-gram and gets the score of the
bias alone; without labels every score is 0.5, with one class only that class's
share; rows that repeat are scored alike; of several labels for an id the
smallest counts, of several texts the one of least hash; very long texts take
time in proportion to their length; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import fold, long_lists, memory, slices

BITS = 18
_TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
_CACHE = 120_000


class _Ids(dict):
    """Token to hash; capitals throughout make another token than small letters."""

    def __missing__(self, token: str) -> int:
        if len(self) > _CACHE:
            self.clear()
        mark = "^" if len(token) > 1 and token.isupper() else ""
        word = (mark + token.lower()) if token[0].isalpha() else ("0" if token[0].isdigit() else token)
        self[token] = found = zlib.crc32(word.encode("utf-8", "surrogatepass"))
        return found


def features(text: str | None) -> np.ndarray:
    """Sorted hashes of the tokens and token pairs of a whole text."""
    tokens = _TOKEN.findall(text or "")
    if not tokens:
        return np.zeros(0, dtype=np.int32)
    known = memory(_Ids, _Ids)
    one = np.array([known[t] for t in tokens], dtype=np.uint64)
    two = one[:-1] * np.uint64(0x9E3779B97F4A7C15) + one[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    runs = []  # a token that repeats itself twice to five times makes the n-gram "same token", whatever token it is
    again = one[:-1] == one[1:]
    while len(runs) < 4 and again.any():
        runs.append((len(runs) + 1) * 0x9E6C63D0676A9A99 & 0xFFFFFFFFFFFFFFFF)
        again = again[:-1] & again[1:]
    one = one * np.uint64(0xD6E8FEB86659FD93)
    return np.unique((np.concatenate([one, two, np.array(runs, dtype=np.uint64)]) >> np.uint64(64 - BITS)).astype(np.int32))


@dataclass
class Model:
    """Weights by feature (already scaled by the log-count ratio), bias and the sigmoid."""

    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def score(self, ids: np.ndarray) -> float:
        margin = self.bias
        if len(ids):
            margin += float(self.weights[ids].sum()) / np.sqrt(len(ids))
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -30, 30))))


def _ratio(rows: list[np.ndarray], y: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    p, q = (np.bincount(np.concatenate([x for x, k in zip(rows, y) if k == side] or [np.zeros(0, np.int32)]), minlength=1 << BITS) + smooth for side in (1, 0))
    return np.log((p / p.sum()) / (q / q.sum()))


def _descend(rows: list[np.ndarray], y: np.ndarray, c: float, epochs: int, seed: int) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the L1 hinge loss; classes weigh alike."""
    ratio = _ratio(rows, y)
    values = [ratio[x] / np.sqrt(max(1, len(x))) for x in rows]
    norms = np.array([float(v @ v) + 1.0 for v in values])
    sign = np.where(y == 1, 1.0, -1.0)
    cost = np.where(y == 1, c * len(y) / (2 * max(1, (y == 1).sum())), c * len(y) / (2 * max(1, (y == 0).sum())))
    alpha, w, bias, rng = np.zeros(len(rows)), np.zeros(1 << BITS), 0.0, np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            x, v = rows[i], values[i]
            gradient = sign[i] * (float(w[x] @ v) + bias) - 1
            new = min(max(alpha[i] - gradient / norms[i], 0.0), cost[i])
            if (step := (new - alpha[i]) * sign[i]) != 0:
                w[x] += step * v
                bias += step
                moved = max(moved, abs(step))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w * ratio, bias


def fit(rows: list[np.ndarray], y: np.ndarray, c: float = 1.0, epochs: int = 12, seed: int = 7) -> Model:
    """The model; the sigmoid is fitted to margins of rows that the half model hasn't seen."""
    if len(y) == 0 or y.min() == y.max():
        share = 0.5 if len(y) == 0 else float(y[0])
        return Model(np.zeros(1 << BITS), 0.0, 0.0, float(np.log((share + 1e-3) / (1 - share + 1e-3))))
    part = np.random.default_rng(seed).permutation(len(y)) % 2
    margins = np.zeros(len(y))
    for side in (0, 1):
        own = [i for i in range(len(y)) if part[i] != side]
        if len(set(y[own])) < 2:
            continue
        w, b = _descend([rows[i] for i in own], y[own], c, epochs, seed)
        for i in np.flatnonzero(part == side):
            margins[i] = b + float(w[rows[i]].sum()) / np.sqrt(max(1, len(rows[i])))
    slope, offset = _sigmoid(margins, y)
    w, b = _descend(rows, y, c, epochs, seed)
    return Model(w, b, slope, offset)


def _sigmoid(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt's scaling by Newton steps, with his smoothed labels."""
    pos, neg = float((y == 1).sum()), float((y == 0).sum())
    goal = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x = np.stack([margins, np.ones_like(margins)], axis=1)
    theta = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        theta = theta - np.linalg.solve(hessian, x.T @ (p - goal) + 1e-3 * (theta - [1.0, 0.0]))
    return max(float(theta[0]), 1e-3), float(theta[1])


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 6000) -> Model:
    """Fits the model on the labelled rows outside the held-out fold, ``max_rows`` at most."""
    chosen = (
        labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (fold() != 0))
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_rows)
    )

    def read(batches):
        for b in slices(batches):
            yield pa.record_batch(
                [b.column("doc_id"), b.column("quality"), long_lists([features(t) for t in b.column("text").to_pylist()], pa.int32())],
                names=["doc_id", "quality", "ids"],
            )

    # max_rows bounds the broadcast side, and, with one row for each id, what reaches the driver.
    own = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").withColumn("_place", F.xxhash64("text"))
    one = own.groupBy("doc_id", "quality").agg(F.min_by("text", F.struct("_place", "text")).alias("text"))
    rows = one.mapInArrow(read, "doc_id long, quality int, ids array<int>").toArrow()
    order = np.argsort(rows.column("doc_id").to_numpy(), kind="stable")
    ids, y = rows.column("ids"), rows.column("quality").to_numpy()
    return fit([np.asarray(ids[int(i)].values.to_numpy(), dtype=np.int32) for i in order], (y[order] > 0).astype(int))


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    # Float32 halves what travels to each worker: 1 MB at 2**18 features.
    small = Model(model.weights.astype(np.float32), model.bias, model.slope, model.offset)

    def run(batches):
        for b in slices(batches):
            scores = [small.score(features(t)) for t in b.column("text").to_pylist()]
            yield pa.record_batch(
                [b.column("doc_id"), b.column("held_out"), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    return docs.select("doc_id", (fold() == 0).alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def accepted(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, all columns, that score ``threshold`` or more."""
    small = Model(model.weights.astype(np.float32), model.bias, model.slope, model.offset)
    at = docs.columns.index("text")

    def run(batches):
        for b in slices(batches):
            yield b.filter(pa.array([small.score(features(t)) >= threshold for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
