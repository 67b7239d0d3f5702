"""Registered queries that run as streams over the driver's tables, with their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.plans.registry import ORACLE_SQL, query
from palimpsest.sources.shared import new_table
from palimpsest.streaming import rates

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@query(ORACLE_SQL["rate_windows"])
def streamed_rate_windows(spark, sf_dir):
    """W8, A12, F12, M8 on a stream: the events replayed, with a last one that lets the watermark pass them all."""
    at = new_table(spark, "rates")
    schema = "user_id bigint, event_id bigint, ts timestamp, tokens bigint"
    end = spark.read.parquet(f"{sf_dir}/events.parquet").agg(F.max("ts").alias("ts")).filter("ts is not null")
    end.selectExpr("CAST(-1 AS bigint) AS user_id", "CAST(-1 AS bigint) AS event_id", "CAST(ts AS timestamp) + INTERVAL 1 DAY AS ts", "CAST(0 AS bigint) AS tokens").write.parquet(f"{at}/end")
    known = spark.read.parquet(f"{sf_dir}/events.parquet")
    # A stream reads a folder; where the table is one file, of the folder it lies in.
    lies = known.inputFiles()
    one = len(lies) == 1 and lies[0].endswith("/events.parquet")
    source = spark.readStream.schema(known.schema).option("pathGlobFilter", "events.parquet" if one else "*.parquet")
    events = source.parquet(sf_dir if one else f"{sf_dir}/events.parquet").selectExpr("user_id", "event_id", "CAST(ts AS timestamp) AS ts", "CAST(floor(value) AS bigint) AS tokens")
    every = events.unionByName(spark.readStream.schema(schema).parquet(f"{at}/end")).selectExpr("user_id AS key", "ts", "event_id AS id", "tokens")
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        found = rates.rate_windows(every, 86_400, 2, 100, late="0 seconds")
        run = found.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
        run.awaitTermination()
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)
    rows = spark.read.schema("key bigint, ts timestamp, id bigint, tokens bigint, requests_before bigint, tokens_before bigint, limited boolean").parquet(f"{at}/out")
    return rows.filter("key >= 0").selectExpr("key AS user_id", "id AS event_id", "ts", "tokens", "requests_before", "tokens_before", "limited")
