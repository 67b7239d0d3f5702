"""Hard-negative mining with a vantage-point tree over norm-augmented vectors.

With a component sqrt(M - |x|^2) added to each vector, M the largest squared
length, and 0 to a query, squared distance is |q|^2 + M - 2 <q, x>: a window of
scores is an annulus of distances around the query, and the highest scores are
the nearest rows.

1. The top of the tree is planted on a sample of at most ``sample_rows`` rows;
   every row goes down it to one of at most 128 cells. A cell is dealt into blocks
   of about ``block_rows`` rows, and each block grows a tree of its own down to
   buckets of 64 rows, which know the least and greatest distance of their rows to
   every vantage point above them.
2. An anchor first visits its own cell. The k-th score found there bounds what it
   asks of the other cells; only those whose distances to the vantage points can
   meet its annulus are visited. Inside a block buckets come nearest first from
   the annulus's inner edge, in growing waves, until no bucket left can hold a row
   as good as the k-th one found. Bounds only decide what is read; scores are
   integers and exact.
3. Positives are the nearest rows of the same label, then each positive's window
   is searched for the nearest rows of other labels, all windows of an anchor in
   one visit.

The driver holds the sample and the bounds of the cells. Groups hold one block and
a bounded lot of anchors, so neither a hot cell nor a hot vector gathers in a task.

Defined cases: rows with a null id or label, a null or empty vector, or a null or
non-finite component take no part; shorter vectors count as filled up with zeros;
a row never finds rows of its own id; an id that repeats among the anchors is one
anchor (its least label, then vector), other repeated rows each count; ties go to
the smaller id; a positive of negative score has no window; an empty table gives an
empty result; other columns are ignored. Scores beyond 2**62 are held at that bound.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.llm.common import checkpoint
from palimpsest.llm.topk import components_of
from palimpsest.llm.vectors import dealt, matrix, meet, sampled, stacked, usable

FAR = 1 << 62
BUCKET = 64
#: Levels of the top of the tree at most: 128 cells.
TOP_LEVELS = 7
_FOUND = "query_id long, mark long, vec_id long, score long"
_BLOCK = "cell int, part int, ids binary, labels binary, m binary, vantage binary, path binary, low binary, high binary, cut binary"


def augmented(x: np.ndarray, most: float) -> np.ndarray:
    """Vectors with the component that makes all of them as long as the longest."""
    return np.hstack([x, np.sqrt(np.maximum(0, most - (x * x).sum(axis=1)))[:, None]])


def _distances(points: np.ndarray, to: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, ((points - to) ** 2).sum(axis=-1)))


def _vantage(points: np.ndarray) -> np.ndarray:
    """The point furthest from the mean of all."""
    return points[_distances(points, points.mean(axis=0)).argmax()]


def plant(points: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """Vantage points and median distances of a tree in the order of a heap; a place without points has zeros."""
    vantage, radius = np.zeros((2**levels - 1, points.shape[1])), np.zeros(2**levels - 1)
    held = {0: points}
    for node in range(2**levels - 1):
        own = held.pop(node)
        if len(own):
            vantage[node] = _vantage(own)
            d = _distances(own, vantage[node])
            radius[node] = np.median(d)
            held[2 * node + 1], held[2 * node + 2] = own[d <= radius[node]], own[d > radius[node]]
        else:
            held[2 * node + 1] = held[2 * node + 2] = own
    return vantage, radius


def descend(points: np.ndarray, vantage: np.ndarray, radius: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """The cell of each point and its distances to the vantage points above it."""
    node, d = np.zeros(len(points), dtype=np.int64), np.zeros((len(points), levels))
    for level in range(levels):
        d[:, level] = _distances(points, vantage[node])
        node = 2 * node + 1 + (d[:, level] > radius[node])
    return node - (2**levels - 1), d


def _above(cell: int, levels: int) -> list[int]:
    """The places of the heap above a cell, from the top."""
    node, out = cell + 2**levels - 1, []
    while node:
        node = (node - 1) // 2
        out.append(node)
    return out[::-1]


def grow(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A block's tree: order of the rows, vantage points, path, low and high (bucket by level), cut (starts of buckets)."""
    n = len(points)
    levels = max(0, int(np.ceil(np.log2(max(1, n / BUCKET)))))
    order, segments, vantage, paths = np.arange(n), [(0, n)], [], [[]]
    for _ in range(levels):
        halves, below = [], []
        for (a, b), path in zip(segments, paths):
            own = points[order[a:b]]
            vantage.append(_vantage(own) if len(own) else np.zeros(points.shape[1]))
            order[a:b] = order[a:b][np.argsort(_distances(own, vantage[-1]), kind="stable")]
            halves += [(a, (a + b) // 2), ((a + b) // 2, b)]
            below += [[*path, len(vantage) - 1]] * 2
        segments, paths = halves, below
    vantage = np.array(vantage).reshape(-1, points.shape[1])
    path = np.array(paths, dtype=np.int32).reshape(len(segments), levels)
    low, high = np.zeros(path.shape), np.zeros(path.shape)
    for k, (a, b) in enumerate(segments):
        for level in range(levels if b > a else 0):
            d = _distances(points[order[a:b]], vantage[path[k, level]])
            low[k, level], high[k, level] = d.min(), d.max()
    return order, vantage, path, low, high, np.array([a for a, _ in segments] + [n], dtype=np.int64)


def _bounds(to_vantage: np.ndarray, path: np.ndarray, low: np.ndarray, high: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Greatest and least score that a query (rows) can have in a bucket or cell (columns), by its distances to vantage points.

    ``reach`` is |q|^2 + M of each query; a margin covers rounding.
    """
    near, far = np.zeros((len(to_vantage), len(path))), np.full((len(to_vantage), len(path)), np.inf)
    for level in range(path.shape[1]):
        d = to_vantage[:, path[:, level]]
        near = np.maximum(near, np.maximum(d - high[:, level], low[:, level] - d))
        far = np.minimum(far, d + high[:, level])
    margin = 1 + 1e-6 * reach[:, None]
    return (reach[:, None] - near**2) / 2 + margin, (reach[:, None] - far**2) / 2 - margin


def _to_vantage(q: np.ndarray, vantage: np.ndarray) -> np.ndarray:
    if not len(vantage):
        return np.zeros((len(q), 0))
    square = (q * q).sum(axis=1)[:, None] + (vantage * vantage).sum(axis=1) - 2 * (q @ vantage[:, : q.shape[1]].T)
    return np.sqrt(np.maximum(0, square))


def _scores(x: np.ndarray, q: np.ndarray, exact: bool) -> np.ndarray:
    if exact:
        return (x @ q).astype(np.int64)
    whole = [int(v) for v in q]
    return np.array([max(-FAR, min(FAR, sum(int(a) * b for a, b in zip(row, whole)))) for row in x], dtype=np.int64)


def _visit(block: dict, q: np.ndarray, q_id: int, label: int, most: np.ndarray, least: np.ndarray, tops: np.ndarray, floors: np.ndarray, k: int, differ: bool, exact: bool):
    """(window, id, score) of the first k rows in each window of one anchor; windows are [floor, top] of scores."""
    floors = floors.copy()
    meets = ((most[None, :] >= floors[:, None]) & (least[None, :] <= tops[:, None])).any(axis=0)
    order = np.flatnonzero(meets)
    order = order[np.argsort(-most[order], kind="stable")]
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in tops]
    at, wave = 0, 8
    while at < len(order) and most[order[at]] >= floors.min():
        rows = block["rows"][order[at : at + wave]].ravel()
        rows = rows[rows >= 0]
        at, wave = at + wave, wave * 2
        rows = rows[(block["ids"][rows] != q_id) & ((block["labels"][rows] == label) != differ)]
        s, ids = _scores(block["m"][rows], q, exact), block["ids"][rows]
        for w in range(len(tops)):
            fits = (s <= tops[w]) & (s >= floors[w])
            if fits.any():
                some, own = np.concatenate([found[w][0], s[fits]]), np.concatenate([found[w][1], ids[fits]])
                first = np.lexsort((own, -some))[:k]
                found[w] = some[first], own[first]
                if len(first) == k:
                    floors[w] = max(floors[w], found[w][0][-1])
    return found


def mine(
    vectors: DataFrame, scale: float = 256.0, every: int = 50, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, sample_rows: int = 8192, block_rows: int = 8192, anchor_rows: int = 16384
) -> DataFrame:
    """Hard negatives of each row whose vec_id is divisible by ``every``.

    For each anchor and each of its first ``positives`` rows of the same label the first ``negatives`` rows of other
    labels whose score is ``low`` to ``high`` percent of the positive's. Columns: anchor_id, positive_id, rank,
    negative_id, positive_score, negative_score.
    """
    spark = vectors.sparkSession
    given = vectors.filter(usable(F.col("embedding")) & F.col("vec_id").isNotNull() & F.col("label").isNotNull())
    rows = given.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), components_of(F.col("embedding"), scale).alias("v"))
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    n, asked, width, largest, most = rows.agg(F.count("*"), F.count_if(F.col("vec_id") % every == 0), F.max(F.size("v")), F.max(F.array_max(F.transform("v", F.abs))), F.max(square)).first()
    if not n or not asked:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    bound = width * largest * largest
    kind, exact = ("float32", True) if bound < 2**24 else ("float64", bound < 2**53)

    levels = int(np.clip(np.round(np.log2(max(1, n / block_rows))), 0, TOP_LEVELS))
    vantage, radius = plant(augmented(matrix(sampled(rows, "v", sample_rows).toArrow().column("v"), width), most), levels)

    def route(batches):
        for b in batches:
            x = matrix(b.column("v"), width)
            cell, d = descend(augmented(x, most), vantage, radius, levels)
            names = ["cell", "vec_id", "label", "v", "d"]
            yield pa.record_batch([pa.array(cell, pa.int32()), b.column("vec_id"), b.column("label"), pa.array([r.tobytes() for r in x.astype(kind)], pa.binary()), pa.array(list(d), pa.list_(pa.float64()))], names=names)

    routed = checkpoint(rows.mapInArrow(route, "cell int, vec_id long, label long, v binary, d array<double>"))
    # One row for each cell, 128 at most.
    ends = routed.groupBy("cell").agg(*[f(F.col("d")[i]).alias(f"{f.__name__}{i}") for i in range(levels) for f in (F.min, F.max)], F.count("*").alias("n")).orderBy("cell").collect()
    cells = np.array([r.cell for r in ends], dtype=np.int32)
    path = np.array([_above(c, levels) for c in cells], dtype=np.int32).reshape(len(cells), levels)
    near, far = (np.array([[r[f"{f}{i}"] for i in range(levels)] for r in ends]).reshape(len(cells), levels) for f in ("min", "max"))
    parts = spark.createDataFrame([(r.cell, -(-r.n // block_rows)) for r in ends], "cell int, parts int")

    def build(key: tuple, t: pa.Table) -> pa.Table:
        x = stacked(t.column("v"), width, kind)
        order, points, own_path, own_low, own_high, cut = grow(augmented(x.astype(np.float64), most))
        made = [t.column("vec_id").to_numpy()[order], t.column("label").to_numpy()[order], x[order], points, own_path, own_low, own_high, cut]
        first = [pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int32())]
        return pa.table([*first, *[pa.array([a.tobytes()], pa.binary()) for a in made]], names=[c.split(" ")[0] for c in _BLOCK.split(", ")])

    blocks = checkpoint(dealt(routed.drop("d"), parts).groupBy("cell", "part").applyInArrow(build, _BLOCK))
    anchors = routed.filter(F.col("vec_id") % every == 0).groupBy(F.col("vec_id").alias("query_id")).agg(F.min(F.struct("label", "v", "cell")).alias("a")).select("query_id", "a.*")
    lots = -(-asked // anchor_rows)

    def others(queries: DataFrame) -> DataFrame:
        """The queries at every cell but their own that their windows can meet."""
        schema = queries.schema

        def send(batches):
            for b in batches:
                q = np.frombuffer(b"".join(b.column("v").to_pylist()), dtype=kind).reshape(-1, width).astype(np.float64)
                greatest, smallest = _bounds(_to_vantage(q, vantage), path, near, far, (q * q).sum(axis=1) + most)
                go = np.zeros(greatest.shape, dtype=bool)
                for k, (tops, floors) in enumerate(zip(b.column("tops").to_pylist(), b.column("floors").to_pylist())):
                    go[k] = ((greatest[k] >= np.array(floors)[:, None]) & (smallest[k] <= np.array(tops)[:, None])).any(axis=0)
                go &= cells[None, :] != b.column("cell").to_numpy()[:, None]
                row, to = np.nonzero(go)
                sent = b.take(pa.array(row))
                yield sent.set_column(sent.schema.get_field_index("cell"), "cell", pa.array(cells[to]))

        return queries.mapInArrow(send, schema)

    def visited(queries: DataFrame, k: int, differ: bool) -> DataFrame:
        def work(q: pa.Table, b: pa.Table) -> pa.Table:
            get = lambda name, as_: np.frombuffer(b[name][0].as_py(), dtype=as_)
            block = {"ids": get("ids", np.int64), "labels": get("labels", np.int64), "m": get("m", kind).reshape(-1, width)}
            cut = get("cut", np.int64)
            sizes = np.diff(cut)
            block["rows"] = np.where(np.arange(sizes.max())[None, :] < sizes[:, None], cut[:-1, None] + np.arange(sizes.max())[None, :], -1)
            shape = (len(sizes), -1) if len(get("path", np.int32)) else (len(sizes), 0)
            own_path, own_low, own_high = (get(c, t).reshape(shape) for c, t in (("path", np.int32), ("low", np.float64), ("high", np.float64)))
            points, out = get("vantage", np.float64).reshape(-1, width + 1), []
            vs = stacked(q.column("v"), width, kind)
            for at in range(0, len(vs), 256):
                some = slice(at, at + 256)
                x = vs[some].astype(np.float64)
                greatest, smallest = _bounds(_to_vantage(x, points), own_path, own_low, own_high, (x * x).sum(axis=1) + most)
                part = q.slice(at, 256)
                for k_, (i, label, marks, tops, floors) in enumerate(zip(*(part.column(c).to_pylist() for c in ("query_id", "label", "marks", "tops", "floors")))):
                    found = _visit(block, vs[at + k_], i, label, greatest[k_], smallest[k_], np.array(tops, np.int64), np.array(floors, np.int64), k, differ, exact)
                    out += [(i, m, own, s) for m, (scores, ids) in zip(marks, found) for own, s in zip(ids.tolist(), scores.tolist())]
            columns = list(zip(*out)) or [[]] * 4
            return pa.table([pa.array(c, pa.int64()) for c in columns], names=["query_id", "mark", "vec_id", "score"])

        return meet(queries, blocks, parts, lots, work, _FOUND)

    def nearest(queries: DataFrame, k: int, differ: bool) -> DataFrame:
        """The first k rows of each window (query_id, mark, rank, vec_id, score) of (cell, query_id, label, v, marks, tops, floors)."""
        rank = F.row_number().over(W.partitionBy("query_id", "mark").orderBy(F.desc("score"), "vec_id"))
        ranked = lambda d: d.withColumn("rank", rank).filter(F.col("rank") <= k)
        home = checkpoint(ranked(visited(queries, k, differ)))
        held = home.filter(F.col("rank") == k).groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("mark", "score"))).alias("held"))
        floors = F.transform("marks", lambda m, i: F.greatest(F.coalesce(F.try_element_at("held", m), F.lit(-FAR)), F.element_at("floors", i + 1)))
        rest = queries.join(held, "query_id", "left").withColumn("floors", floors).select(*queries.columns)
        return ranked(home.drop("rank").unionByName(visited(others(rest), k, differ)))

    one = lambda x: F.array(F.lit(x).cast("long"))
    queries = anchors.select("cell", "query_id", "label", "v", one(0).alias("marks"), one(FAR).alias("tops"), one(-FAR).alias("floors"))
    near_rows = checkpoint(nearest(queries, positives, False).select("query_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    # Products in decimals, as they may pass 64 bits. A repeated id among the positives is one window for each of its scores.
    wide = F.col("positive_score").cast("decimal(20,0)")
    edge = lambda x: F.call_function("div", x, F.lit(100).cast("decimal(3,0)")).cast("long")
    marked = near_rows.filter("positive_score >= 0").withColumn("mark", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("positive_score"), "positive_id")).cast("long"))
    marked = marked.withColumn("top", edge(wide * high)).withColumn("floor", edge(wide * low + 99))
    windows = marked.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("mark", "top", "floor"))).alias("w"))
    pick = lambda c: F.transform("w", lambda x: x[c])
    queries = anchors.join(windows, "query_id").select("cell", "query_id", "label", "v", pick("mark").alias("marks"), pick("top").alias("tops"), pick("floor").alias("floors"))
    found = nearest(queries, negatives, True)
    found = found.join(marked.select("query_id", "mark", "positive_id", "positive_score"), ["query_id", "mark"])
    return found.select(F.col("query_id").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
