"""Approximate nearest neighbours by learned partitions.

1. Of a sample of at most ``sample_rows`` vectors the graph of each one's largest
   inner products is cut into balanced parts: halving along principal directions
   gives a first cut, then vectors move to the part of most of their neighbours
   while it has room.
2. A linear softmax classifier (the placer) learns the parts; every row of the
   table is indexed under its most probable one. A second one (the router) learns
   where the neighbours of a query were placed.
3. A query goes to its most probable partitions until their probabilities sum to
   a share. The share is learnt too: on sample vectors kept from the router it is
   the least that reaches ``recall`` of their neighbours, so clustered vectors
   visit few partitions and vectors without structure many.
4. Partitions are dealt into blocks of about ``block_rows`` rows, queries into
   lots; each block reranks its queries by exact inner products in double
   precision, and the best of all blocks are ranked.

The sample is in one task, the driver holds the models. A table of at most 1,024 rows has two
partitions, of 20,000 or more 16, of more than a million up to 128.

Defined cases: vectors that are null, empty or zero or hold null or non-finite
components take no part, nor rows with a null id; shorter vectors count as filled
up with zeros; a row never finds rows of its own id; an id that repeats among the
queries is one query (its least vector), other repeated rows each count; a query
with fewer than k candidates gets all of them, in whatever partition they lie; ties
go to the smaller id; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.llm.common import checkpoint
from palimpsest.llm.vectors import dealt, matrix, meet, sampled, stacked, usable

#: Neighbours of a sample vector in the graph, and those whose partitions the router learns.
GRAPH, GOAL = 10, 20
#: Scores that a task or the driver holds at once.
_AT_ONCE = 1 << 22
_RESULT = "query_id long, rank int, vec_id long, score double"


def _most(q: np.ndarray, x: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
    """Numbers of the k rows of x of largest inner product with each row of q, ``own`` (its number in x) aside."""
    k = min(k, len(x) - 1)
    out = np.zeros((len(q), k), dtype=np.int64)
    step = max(1, _AT_ONCE // len(x))
    for at in range(0, len(q), step):
        s = q[at : at + step] @ x.T
        s[np.arange(len(s)), own[at : at + step]] = -np.inf
        out[at : at + step] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def halved(x: np.ndarray, levels: int) -> np.ndarray:
    """2**levels parts of equal size: each half again at the median of its main direction."""
    parts = [np.arange(len(x))]
    for _ in range(levels):
        below = []
        for own in parts:
            if len(own) > 1:
                main = np.linalg.eigh(np.cov(x[own].T))[1][:, -1] if x.shape[1] > 1 else np.ones(1)
                own = own[np.argsort(x[own] @ main, kind="stable")]
            below += [own[: len(own) // 2], own[len(own) // 2 :]]
        parts = below
    label = np.zeros(len(x), dtype=np.int64)
    for k, own in enumerate(parts):
        label[own] = k
    return label


def cut_graph(neighbours: np.ndarray, label: np.ndarray, parts: int, slack: float = 1.1, rounds: int = 20) -> np.ndarray:
    """Labels after moving vectors to the part that most of their neighbours are in, none beyond ``slack`` of the mean size.

    Half of the vectors may move in a round, the greatest gains first, so that neighbours don't change places for ever.
    """
    label, n = label.copy(), len(label)
    room = int(np.ceil(slack * n / parts))
    a, b = np.repeat(np.arange(n), neighbours.shape[1]), neighbours.ravel()
    for turn in range(rounds):
        votes = np.bincount(np.concatenate([a * parts + label[b], b * parts + label[a]]), minlength=n * parts).reshape(n, parts)
        best = votes.argmax(axis=1)
        gain = votes[np.arange(n), best] - votes[np.arange(n), label]
        moving = np.flatnonzero((gain > 0) & ((np.arange(n) + turn) % 2 == 0))
        moving = moving[np.argsort(-gain[moving], kind="stable")]
        sizes, moved = np.bincount(label, minlength=parts), 0
        for i in moving:
            if sizes[best[i]] < room:
                sizes[label[i]] -= 1
                sizes[best[i]] += 1
                label[i], moved = best[i], moved + 1
        if not moved and turn:
            break
    return label


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit_softmax(x: np.ndarray, goal: np.ndarray, steps: int = 150, rate: float = 0.1, penalty: float = 1e-5) -> np.ndarray:
    """Weights of a linear softmax classifier of the columns of x, fitted to rows of probabilities by Adam on all rows."""
    w = np.zeros((x.shape[1], goal.shape[1]))
    first, second = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        g = x.T @ (softmax(x @ w) - goal) / len(x) + penalty * w
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        w -= rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-9)
    return w


@dataclass
class Partitions:
    """Placer and router of columns of features, and the share of probability that a query visits."""

    scale: float
    place: np.ndarray
    route: np.ndarray
    share: float

    def _features(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([x / self.scale, np.ones((len(x), 1))])

    def placed(self, x: np.ndarray) -> np.ndarray:
        return (self._features(x) @ self.place).argmax(axis=1)

    def visits(self, x: np.ndarray, sizes: np.ndarray, least: int) -> np.ndarray:
        """Whether each query goes to each partition: up to the share, and up to ``least`` rows."""
        p = softmax(self._features(x) @ self.route)
        return (before(p, p) < self.share) | (before(p, np.broadcast_to(sizes, p.shape)) < least)


def before(p: np.ndarray, what: np.ndarray) -> np.ndarray:
    """The sum of ``what`` over the more probable partitions of each row."""
    order = np.argsort(-p, axis=1, kind="stable")
    sums = np.take_along_axis(what, order, axis=1).astype(float).cumsum(axis=1)
    sums = np.hstack([np.zeros((len(p), 1)), sums[:, :-1]])
    out = np.empty_like(p)
    np.put_along_axis(out, order, sums, axis=1)
    return out


def levels_for(n: int) -> int:
    """Binary logarithm of the number of partitions of a table of n rows."""
    return int(np.clip(np.floor(np.log2(max(1, n / 512))), 1, 4) if n < 1 << 20 else np.clip(np.floor(np.log2(n / 65536)), 4, 7))


def learn(x: np.ndarray, n: int, recall: float = 0.95) -> Partitions:
    """Partitions of a table of n rows, learnt from a sample of it in an order that says nothing."""
    scale, levels = max(1e-300, float(np.abs(x).max())) * np.sqrt(x.shape[1]), levels_for(n)
    if len(x) < 4:
        return Partitions(scale, np.zeros((x.shape[1] + 1, 1)), np.zeros((x.shape[1] + 1, 1)), 1.0)
    x, parts = x / scale, 2**levels
    spread = np.sqrt((x * x).sum(axis=1).mean()) or 1.0
    x, scale = x / spread, scale * spread
    every = np.arange(len(x))
    near = _most(x, x, every, GOAL)
    nearest = np.take_along_axis(near, np.argsort(-_of(x, near), axis=1)[:, :GRAPH], axis=1)
    label = cut_graph(nearest, halved(x, levels), parts)
    features = np.hstack([x, np.ones((len(x), 1))])
    place = fit_softmax(features, np.eye(parts)[label])
    at = (features @ place).argmax(axis=1)
    goal = np.zeros((len(x), parts))
    np.add.at(goal, (np.repeat(every, near.shape[1]), at[near].ravel()), 1 / near.shape[1])
    kept = every % 4 == 0  # kept from the router, for the share
    route = fit_softmax(features[~kept], goal[~kept])
    p = softmax(features[kept] @ route)
    needed = np.take_along_axis(before(p, p), at[near[kept]], axis=1)
    # A partition is visited if what stands before it is below the share.
    return Partitions(scale, place, route, float(np.nextafter(np.quantile(needed, recall), 2)))


def fitted(sample: DataFrame, width: int, n: int, recall: float) -> Partitions:
    """What ``learn`` makes of the sample (v), in one task, as the driver has other work."""

    def run(batches):
        m = learn(np.concatenate([matrix(b.column("v"), width) for b in batches]), n, recall)
        yield pa.record_batch([pa.array([m.scale]), pa.array([m.place.tobytes()], pa.binary()), pa.array([m.route.tobytes()], pa.binary()), pa.array([m.share])], names=["scale", "place", "route", "share"])

    m = sample.mapInArrow(run, "scale double, place binary, route binary, share double").first()
    return Partitions(m.scale, *[np.frombuffer(w).reshape(width + 1, -1) for w in (m.place, m.route)], m.share)


def _of(x: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Inner products of each row with its listed rows."""
    return np.stack([(x * x[near[:, k]]).sum(axis=1) for k in range(near.shape[1])], axis=1)


def best(q: np.ndarray, q_ids: np.ndarray, c: np.ndarray, c_ids: np.ndarray, k: int) -> tuple[list, list, list]:
    """The first k rows of c for each query: ids of queries and rows, inner products summed alike wherever a row lies."""
    queries, rows, scores = [], [], []
    step = max(1, _AT_ONCE // max(1, len(c)))
    lengths = np.sqrt((c * c).sum(axis=1).max()) if len(c) else 0
    for at in range(0, len(q), step):
        part = q[at : at + step]
        rough = part @ c.T
        rough[q_ids[at : at + step, None] == c_ids[None, :]] = -np.inf
        edge = -np.partition(-rough, k - 1, axis=1)[:, k - 1] if len(c) > k else np.full(len(part), -np.inf)
        # A margin for the order in which a matrix product sums.
        edge = edge - 1e-12 * lengths * np.sqrt((part * part).sum(axis=1))
        for i in range(len(part)):
            at_c = np.flatnonzero((rough[i] >= edge[i]) & (rough[i] > -np.inf))
            s = (c[at_c] * part[i]).sum(axis=1)
            first = np.lexsort((c_ids[at_c], -s))[:k]
            queries += [q_ids[at + i]] * len(first)
            rows += c_ids[at_c[first]].tolist()
            scores += s[first].tolist()
    return queries, rows, scores


def search(vectors: DataFrame, k: int = 20, every: int = 20, recall: float = 0.95, sample_rows: int = 8192, block_rows: int = 16384, query_rows: int = 16384) -> DataFrame:
    """The k nearest rows found of each row whose vec_id is divisible by ``every``: query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    given = vectors.filter(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v")).filter(F.exists("v", lambda x: x != 0))
    kind = "float32" if given.schema["v"].dataType.elementType.typeName() == "float" else "float64"
    n, asked, width = given.agg(F.count("*"), F.count_if(F.col("vec_id") % every == 0), F.max(F.size("v"))).first()
    if not n or not asked:
        return spark.createDataFrame([], _RESULT)
    model = fitted(sampled(given, "v", sample_rows), width, n, recall)

    def place(batches):
        for b in batches:
            x = matrix(b.column("v"), width)
            packed = pa.array([r.tobytes() for r in x.astype(kind)], pa.binary())
            yield pa.record_batch([pa.array(model.placed(x), pa.int32()), b.column("vec_id"), packed], names=["cell", "vec_id", "v"])

    placed = checkpoint(given.mapInArrow(place, "cell int, vec_id long, v binary"))
    # One row for each partition, 128 at most.
    counts = placed.groupBy("cell").count().collect()
    sizes = np.zeros(model.place.shape[1])
    sizes[[r.cell for r in counts]] = [r["count"] for r in counts]
    parts = spark.createDataFrame([(r.cell, -(-r["count"] // block_rows)) for r in counts], "cell int, parts int")

    def build(key: tuple, t: pa.Table) -> pa.Table:
        ids = t.column("vec_id").to_numpy()
        order = np.argsort(ids, kind="stable")
        made = [ids[order].tobytes(), stacked(t.column("v"), width, kind)[order].tobytes()]
        return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int32()), *[pa.array([m], pa.binary()) for m in made]], names=["cell", "part", "ids", "m"])

    blocks = dealt(placed, parts).groupBy("cell", "part").applyInArrow(build, "cell int, part int, ids binary, m binary")
    queries = placed.filter(F.col("vec_id") % every == 0).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("v"))

    def send(batches):
        for b in batches:
            x = np.frombuffer(b"".join(b.column("v").to_pylist()), dtype=kind).reshape(-1, width).astype(np.float64)
            row, to = np.nonzero(model.visits(x, sizes, k + 1))
            sent = b.take(pa.array(row))
            yield pa.record_batch([pa.array(to, pa.int32()), *sent.columns], names=["cell", *b.schema.names])

    sent = queries.mapInArrow(send, "cell int, query_id long, v binary")

    def work(q: pa.Table, b: pa.Table) -> pa.Table:
        ids = np.frombuffer(b["ids"][0].as_py(), dtype=np.int64)
        c = np.frombuffer(b["m"][0].as_py(), dtype=kind).reshape(-1, width).astype(np.float64)
        found = best(stacked(q.column("v"), width, kind).astype(np.float64), q.column("query_id").to_numpy(), c, ids, k)
        return pa.table([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64()), pa.array(found[2], pa.float64())], names=["query_id", "vec_id", "score"])

    found = meet(sent, blocks, parts, -(-asked // query_rows), work, "query_id long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
