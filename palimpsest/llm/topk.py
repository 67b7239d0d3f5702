"""Exact top-k search by distributed histogram selection.

Candidates are packed into matrices where they lie, without a shuffle, and stay
there. Queries come in groups of at most ``query_group`` rows, whose matrix is
broadcast. In each round every task scores its candidates against the group and
keeps, by query, one histogram of the scores inside the query's current range;
summed over all tasks it tells the bin that holds the k-th score, which is the
next range. When bins are one wide the k-th score is known exactly. A last pass
keeps the scores above it and, of those that equal it, the smallest ids that
still fit.

No score matrix leaves its block and no vector is shuffled: a round sends one
histogram for each query and task, the last pass at most 2 k rows for each query
and block. A group of queries is a run of jobs of its own, and its result is
written before the next begins, so a lost executor costs its tasks of one round.

Defined cases: vectors that are null or hold null or non-finite components
take no part; shorter vectors count as filled up with zeros; a query with fewer
than k candidates gets all; a row never finds rows of its own id, and an id that
repeats among the queries is one query (its least vector); rows with a null id
take no part; ties go to the smaller id; an empty table gives an empty result.
Scores beyond 2**62 are held at that bound. Other columns are ignored.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.llm.common import checkpoint, checkpoint_dir

BINS = 128
_FAR = 1 << 62


def components_of(vector: Column, scale: float) -> Column:
    """floor(scale * x) of every component, as doubles that hold integers."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("double"))


def _usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


def _pack(rows: DataFrame, block: int, width: int, kind: str) -> DataFrame:
    """One row for each block of at most ``block`` vectors of a partition: ids and matrix as bytes, by id."""

    def pack(batches):
        ids, flat = [], []

        def packed() -> pa.RecordBatch:
            order = np.argsort(np.array(ids, dtype=np.int64), kind="stable")
            m = np.stack([flat[k] for k in order]).astype(kind)
            return pa.record_batch([pa.array([np.array(ids, dtype=np.int64)[order].tobytes()], pa.binary()), pa.array([m.tobytes()], pa.binary())], names=["ids", "m"])

        for b in batches:
            vectors = b.column("v")
            for k, i in enumerate(b.column("vec_id").to_pylist()):
                v = np.zeros(width)
                own = vectors[k].values.to_numpy(zero_copy_only=False)
                v[: len(own)] = own
                ids.append(i)
                flat.append(v)
                if len(ids) == block:
                    yield packed()
                    ids, flat = [], []
        if ids:
            yield packed()

    return rows.select("vec_id", "v").mapInArrow(pack, "ids binary, m binary")


def _unpacked(batches, width: int, kind: str):
    """(ids, matrix) of each packed block."""
    for b in batches:
        for ids, m in zip(b.column("ids"), b.column("m")):
            i = np.frombuffer(ids.as_py(), dtype=np.int64)
            yield i, np.frombuffer(m.as_py(), dtype=kind).reshape(len(i), width)


def _scores(q: np.ndarray, c: np.ndarray, exact: bool) -> np.ndarray:
    """Integer inner products of queries and candidates."""
    if exact:
        return (q @ c.T).astype(np.int64)
    # Products beyond what doubles hold exactly: whole numbers of any size, held at the bound.
    whole = [[int(x) for x in row] for row in c]
    return np.array([[max(-_FAR, min(_FAR, sum(int(a) * b for a, b in zip(row, other)))) for other in whole] for row in q], dtype=np.int64).reshape(len(q), len(c))


#: Scores that a task holds at once: the rows of the query matrix are taken in parts of so many scores.
_AT_ONCE = 1 << 22


def _parts(n_queries: int, n_candidates: int):
    step = max(1, _AT_ONCE // max(1, n_candidates))
    return [slice(at, min(at + step, n_queries)) for at in range(0, n_queries, step)]


def search(vectors: DataFrame, k: int = 20, scale: float = 64.0, every: int = 20, candidate_block: int = 4096, query_group: int = 8192) -> DataFrame:
    """The k highest integer inner products of each row whose vec_id is divisible by ``every``.

    Columns: query_id, rank (from 1), vec_id, score; ties go to the smaller vec_id.
    """
    spark = vectors.sparkSession
    result = "query_id long, rank int, vec_id long, score long"
    rows = vectors.filter(_usable(F.col("embedding")) & F.col("vec_id").isNotNull()).select("vec_id", components_of(F.col("embedding"), scale).alias("v"))
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    asked = F.col("vec_id") % every == 0
    n, n_queries, width, high, norm = rows.agg(F.count("*"), F.count_if(asked), F.max(F.size("v")), F.max(F.array_max(F.transform("v", F.abs))), F.max(square)).first()
    if not n or not n_queries:
        return spark.createDataFrame([], result)
    width, high = max(1, width or 0), high or 0.0
    bound = width * high * high
    kind, exact = ("float32", True) if bound < 2**24 else ("float64", bound < 2**53)
    limit = min(int(norm) + 1, _FAR) if exact else _FAR  # no product is above the largest squared length

    blocks = checkpoint(_pack(rows, candidate_block, width, kind))
    # Groups by hash of the id; equal ids are one query.
    groups = -(-n_queries // query_group)
    queries = checkpoint(rows.filter(asked).groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("g", F.pmod(F.xxhash64("vec_id"), F.lit(groups))))
    at = f"{checkpoint_dir(spark)}/topk-{uuid.uuid4().hex}"
    for g in range(groups):
        # A group holds query_group rows on average by hash, so its size on the driver is bounded with it.
        own = queries.filter(F.col("g") == g).select("vec_id", "v").orderBy("vec_id").toArrow()
        if own.num_rows:
            _search_group(blocks, own, k, width, kind, exact, limit).write.mode("append").parquet(at)
    return spark.read.schema(result).parquet(at)


def _search_group(blocks: DataFrame, queries: pa.Table, k: int, width: int, kind: str, exact: bool, limit: int) -> DataFrame:
    """The result rows of one group of queries (vec_id, v)."""
    sc = blocks.sparkSession.sparkContext
    ids = queries.column("vec_id").to_numpy()
    m = np.zeros((len(ids), width), dtype=kind)
    for row, v in enumerate(queries.column("v").to_pylist()):
        m[row, : len(v)] = v
    shared = sc.broadcast((ids, m))
    low, need = np.full(len(ids), -limit, np.int64), np.full(len(ids), k, np.int64)
    span, step = 2 * limit + 1, -(-(2 * limit + 1) // BINS)
    while True:
        state, wide, within = sc.broadcast(low), step, span

        def histogram(batches):
            q_ids, q = shared.value
            start, total = state.value, np.zeros((len(q_ids), BINS), dtype=np.int64)
            for c_ids, c in _unpacked(batches, width, kind):
                for part in _parts(len(q_ids), len(c_ids)):
                    off = (_scores(q[part], c, exact) - start[part, None]).view(np.uint64)
                    # What is above the range has been counted before.
                    inside = (off < np.uint64(within)) & (q_ids[part, None] != c_ids[None, :])
                    bins = (off // np.uint64(wide)).astype(np.int64) + np.arange(part.stop - part.start, dtype=np.int64)[:, None] * BINS
                    total[part] += np.bincount(bins[inside], minlength=(part.stop - part.start) * BINS).reshape(-1, BINS)
            for part in range(0, len(q_ids), 1024):
                h = total[part : part + 1024]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, h.size + 1, BINS, dtype=np.int32)), pa.array(h.reshape(-1), pa.int64()))
                yield pa.record_batch([pa.array(np.arange(part, part + len(h), dtype=np.int32)), lists], names=["q", "h"])

        counted = blocks.mapInArrow(histogram, "q int, h array<long>")
        summed = counted.groupBy("q").agg(F.array(*[F.sum(F.col("h")[i]) for i in range(BINS)]).alias("h"))
        # One row for each query of the group.
        found = summed.toArrow()
        order = np.argsort(found.column("q").to_numpy())
        h = found.column("h").combine_chunks().flatten().to_numpy().reshape(-1, BINS)[order]
        above = h[:, ::-1].cumsum(axis=1)[:, ::-1]  # scores in this bin or a higher one
        # The highest bin down to which there are enough scores; the lowest bin if all are too few.
        bin_ = np.where(above[:, 0] < need, 0, BINS - 1 - (above[:, ::-1] >= need[:, None]).argmax(axis=1)).astype(np.int64)
        over = np.where(bin_ + 1 < BINS, np.take_along_axis(np.pad(above, ((0, 0), (0, 1))), (bin_ + 1)[:, None], axis=1)[:, 0], 0)
        low, need = low + bin_ * wide, need - over
        if step == 1:
            break
        span, step = step, -(-step // BINS)
    last = sc.broadcast((low, need))

    def take(batches):
        q_ids, q = shared.value
        least, fits = last.value
        for c_ids, c in _unpacked(batches, width, kind):
            for part in _parts(len(q_ids), len(c_ids)):
                s = _scores(q[part], c, exact)
                counts = q_ids[part, None] != c_ids[None, :]
                rows, at = np.nonzero(counts & (s > least[part, None]))
                ties = counts & (s == least[part, None])
                # Candidates of a block are in the order of their ids, so the first ties are the smallest ids.
                ties &= ties.cumsum(axis=1, dtype=np.int32) <= fits[part, None]
                more, other = np.nonzero(ties)
                rows, at = np.concatenate([rows, more]), np.concatenate([at, other])
                if len(rows):
                    yield pa.record_batch([pa.array(q_ids[part][rows]), pa.array(c_ids[at]), pa.array(s[rows, at])], names=["query_id", "vec_id", "score"])

    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    found = blocks.mapInArrow(take, "query_id long, vec_id long, score long").withColumn("rank", rank)
    return found.filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
