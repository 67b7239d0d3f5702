"""The folder that all executors share: what a job stores between its steps."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; only a local session without one gets a temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="palimpsest-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def new_table(spark: SparkSession, name: str) -> str:
    """A path of its own for a table in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(rows: DataFrame, name: str) -> DataFrame:
    """The rows, written as Parquet to the shared folder and read again: computed once, whoever reads them and however often."""
    at = new_table(rows.sparkSession, name)
    rows.write.parquet(at)
    return rows.sparkSession.read.schema(rows.schema).parquet(at)


def read_or_none(spark: SparkSession, at: str) -> DataFrame | None:
    """The Parquet table at a path, None where there is none yet."""
    try:
        return spark.read.parquet(at)
    except AnalysisException:
        return None
