"""The stream of rate windows against the table's; files that are committed or not there."""

import pytest
from palimpsest.operators import contexts
from palimpsest.sources import committed
from palimpsest.streaming import rates
from pyspark.sql import functions as F


def test_streamed_rate_windows_are_those_of_the_table(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    at = F.timestamp_seconds(F.lit(1_700_000_000) + (F.col("id") * 7919 % 3000) / 4)
    rows = spark.range(600).select((F.col("id") % 5).alias("key"), at.alias("ts"), "id", (F.col("id") % 37).alias("tokens"))
    last = spark.createDataFrame([(-1, 10_000)], "key long, s long").select("key", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("s")).alias("ts"), F.lit(0).cast("long").alias("id"), F.lit(0).cast("long").alias("tokens"))
    # Three files in any order of their times, then one request that moves the watermark past all.
    for k in range(3):
        rows.filter(F.col("id") % 3 == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    last.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    found = rates.rate_windows(stream, 60, 8, 200, late="3600 seconds")
    query = found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    assert query.awaitTermination(240)
    get = lambda d: sorted((r.key, r.id, r.ts, r.tokens, r.requests_before, r.tokens_before or 0, r.limited) for r in d.collect() if r.key >= 0)
    want = get(contexts.rate_windows(rows, ["key"], 60, 8, 200))
    assert get(spark.read.parquet(str(tmp_path / "out"))) == want and len({w[6] for w in want}) == 2


def test_only_committed_files_are_there(spark, tmp_path):
    at = tmp_path / "store"
    rows = spark.range(40).repartition(4).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("name"), F.encode(F.col("id").cast("string"), "utf-8").alias("content"))
    committed.write_committed(rows, str(at))
    read = lambda: {p.name: p.read_text() for p in at.iterdir() if not p.name.startswith(".")}
    want = {f"f{k}": str(k) for k in range(40)}
    assert read() == want
    newer = rows.limit(5).withColumn("content", F.encode(F.lit("new"), "utf-8"))
    twice = newer.unionByName(newer)
    for bad in (rows.withColumn("content", F.when(F.col("name") != "f7", F.col("content"))), twice, rows.withColumn("name", F.concat(F.lit("../"), "name"))):
        with pytest.raises(Exception):
            committed.write_committed(bad, str(at))
        assert read() == want
    committed.write_committed(newer, str(at))
    assert sum(x == "new" for x in read().values()) == 5 and len(read()) == 40
    committed.write_committed(rows.limit(0), str(at))
    committed.clear_staged(str(at), older=-1)
    assert len(read()) == len(list(at.iterdir())) == 40 and committed.clear_staged(str(at / "none")) == 0
