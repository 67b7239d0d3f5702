"""What several operators share: checkpoints, folds and Arrow plumbing."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a Python step turns into objects at once; bounds a worker's memory.
SLICE = 256


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that ``spark.checkpoint.dir`` names, or that was set on the context.

    A local session without one, as in tests, gets a temporary folder; anywhere
    else a machine's own disk would not do, so its lack is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
        if not named and sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="palimpsest-"))
    return sc.getCheckpointDir()


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared store."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the cluster's shared folder.

    Its files go with the last reference to it where the session sets
    ``spark.cleaner.referenceTracking.cleanCheckpoints``.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


_MEMORY: dict = {}


def memory(owner: object, make: Callable):
    """The owner's memory in this worker, made when first asked for.

    Workers live on from one stage to the next; another operator's memory goes
    then, so a worker holds one at a time.
    """
    if owner not in _MEMORY:
        _MEMORY.clear()
        _MEMORY[owner] = make()
    return _MEMORY[owner]


def fold(id_column: str = "doc_id", folds: int = 5) -> Column:
    """crc32 of the id as text, modulo ``folds``; 0 is held out. A null id is in fold 0."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % folds, F.lit(0))


def slices(batches: Iterable[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``rows`` rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def long_lists(arrays: list, value_type: pa.DataType) -> pa.ListArray:
    """A list column from numpy arrays, without a Python object for each value."""
    import numpy as np

    offsets = np.zeros(len(arrays) + 1, dtype=np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    flat = np.concatenate(arrays) if arrays else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, type=value_type))
