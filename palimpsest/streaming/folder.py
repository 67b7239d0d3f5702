"""A folder that documents are dropped into, as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def dropped_files(spark: SparkSession, folder: str, pattern: str = "*.docx") -> DataFrame:
    """Files (path, modificationTime, length, content) as they arrive; apply the same operators as to a batch."""
    return spark.readStream.format("binaryFile").option("pathGlobFilter", pattern).schema("path string, modificationTime timestamp, length long, content binary").load(folder)
