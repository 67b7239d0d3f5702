"""What searches over blocks of vectors share: usable rows, dealing cells into blocks, queries that meet blocks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Not null, not empty, every component there and finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(True))


def matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """A list column without nulls as a matrix of doubles; short lists are filled up with zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    out = np.zeros((len(lists), width))
    if len(lists):
        sizes = np.diff(lists.offsets.to_numpy())
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        rows = np.repeat(np.arange(len(lists)), sizes)
        out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def stacked(column: pa.ChunkedArray, width: int, kind: str) -> np.ndarray:
    """A binary column of vectors of one width as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(-1, width)


def sampled(rows: DataFrame, column: str, most: int) -> DataFrame:
    """The column of ``most`` rows at most, in one partition, drawn and ordered by hash of id and content, so that reruns agree."""
    return rows.select(column, F.xxhash64("vec_id", column).alias("draw")).orderBy("draw", column).limit(most).select(column)


def dealt(cells: DataFrame, parts: DataFrame) -> DataFrame:
    """Adds ``part``: the rows of a cell dealt by hash into ``parts`` blocks, equal rows too. ``cells`` has to be stored, as a row's part goes by its place.

    ``parts`` (cell, parts) has a row for each cell, whose number the caller's model bounds.
    """
    part = F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.col("parts")).cast("int")
    return cells.join(F.broadcast(parts), "cell").withColumn("part", part).drop("parts")


def meet(queries: DataFrame, blocks: DataFrame, parts: DataFrame, salts: int, work: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``work`` of the queries (cell, query_id, ...) of a cell with each block (cell, part, ...) of it.

    Queries are dealt into ``salts`` lots, so a group holds one block and a bounded number of queries, whatever cell
    is asked most; each block goes to every lot of its cell, each query to every block.
    """
    asked = queries.join(F.broadcast(parts), "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    asked = asked.withColumn("lot", F.pmod(F.xxhash64("query_id"), F.lit(salts)).cast("int"))
    every = blocks.withColumn("lot", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    empty = None

    def run(key: tuple, q: pa.Table, b: pa.Table) -> pa.Table:
        return work(q, b) if q.num_rows and b.num_rows else empty

    from pyspark.sql.pandas.types import to_arrow_schema

    spark = queries.sparkSession
    empty = to_arrow_schema(spark.createDataFrame([], schema).schema).empty_table()
    keys = ["cell", "part", "lot"]
    return asked.groupBy(*keys).cogroup(every.groupBy(*keys)).applyInArrow(run, schema)
