"""URL filters: captures are judged by the list entries that were active when they were fetched.

Dated list entries (list, kind, entry, action, since) become validity intervals:
an ``add`` or ``allow`` holds until the next dated action for the same entry of
the same list, a ``remove`` ends it. A capture asks for every key that could list
it: each suffix of its host on label bounds (kind host) and each single label
(kind label). An as-of join, equal on the key and with the fetch time inside the
interval, finds the active entries. The most specific one decides, hosts before
labels, longer before shorter; if allowing and blocking ones are equally
specific, blocking wins.

Most keys that captures ask for ("com") are in no list. So the lists' keys, where
they are ``known_keys`` at most, are broadcast first and only keys that are listed
go on. Both sides are then shuffled on the key, so the lists may have any size; a
listed key that a third of the captures ask for is a skewed join, which adaptive
execution splits, and the counts by capture are summed before they are shuffled.

Defined cases: a null url or fetch time is matched by nothing and not blocked;
entries with a null field are ignored; of several actions for an entry at one
time, remove comes first, then allow, then add; a host with closing dots is
judged without them; a very long host asks for as many keys as it has labels;
repeated captures give repeated rows; an empty table gives an empty result, an
empty list blocks nothing; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.llm.common import checkpoint
from palimpsest.llm.html import host_of

#: The lists that the query applies: (list, kind, entry, action, since).
ENTRIES = (
    ("adult", "label", "adult-x", "add", "2023-03-01"),
    ("adult", "host", "blog.adult-x.example.net", "allow", "2024-06-01"),
    ("gambling", "label", "casino-win", "add", "2023-05-10"),
    ("gambling", "label", "free-bets", "add", "2024-02-15"),
    ("gambling", "host", "free-bets.example.com", "remove", "2024-09-01"),
    ("pharmacy", "label", "cheap-pills", "add", "2023-01-20"),
    ("pharmacy", "label", "cheap-pills", "remove", "2024-04-01"),
    ("pharmacy", "label", "cheap-pills", "add", "2024-07-01"),
    ("spam", "host", "spam-farm.example.com", "add", "2024-01-10"),
    ("spam", "host", "spam-farm.example.org", "add", "2024-03-10"),
    ("spam", "label", "spam-farm", "add", "2024-08-01"),
    ("tracking", "host", "ads-track.example.com", "add", "2022-11-05"),
    ("tracking", "host", "m.ads-track.example.com", "allow", "2024-05-05"),
    ("tracking", "host", "m.ads-track.example.com", "remove", "2024-11-05"),
)


def entries_table(spark: SparkSession, entries: tuple = ENTRIES) -> DataFrame:
    rows = spark.createDataFrame(list(entries), "list string, kind string, entry string, action string, since string")
    return rows.withColumn("since", F.to_timestamp("since"))


def intervals(entries: DataFrame) -> DataFrame:
    """(list, kind, key, allows, valid_from, valid_to) of dated entries; valid_to is null while an entry holds."""
    order = F.when(F.col("action") == "remove", 0).when(F.col("action") == "allow", 1).otherwise(2)
    line = W.partitionBy("list", "kind", "key").orderBy("since", order)
    whole = F.concat_ws("", F.lit("")).isNotNull()
    for c in ("list", "kind", "entry", "action", "since"):
        whole = whole & F.col(c).isNotNull()
    return (
        entries.filter(whole)
        .withColumn("key", F.lower("entry"))
        .withColumn("valid_to", F.lead("since").over(line))
        .filter((F.col("action") != "remove") & (F.col("valid_to").isNull() | (F.col("valid_to") > F.col("since"))))
        .select("list", "kind", "key", (F.col("action") == "allow").alias("allows"), F.col("since").alias("valid_from"), "valid_to")
    )


def keys_of(host: Column) -> Column:
    """Keys of a host: its suffixes of two labels or more and its labels, as (kind, key) structs."""
    host = F.regexp_replace(host, r"\.+$", "")  # a host's closing dot says nothing
    labels = F.split(host, r"\.")
    count = F.size(labels)
    starts = F.when(count > 1, F.sequence(F.lit(1), count - 1)).otherwise(F.array(F.lit(1)))
    suffixes = F.transform(starts, lambda k: F.struct(F.lit("host").alias("kind"), F.array_join(F.slice(labels, k, count), ".").alias("key")))
    singles = F.transform(F.array_distinct(labels), lambda x: F.struct(F.lit("label").alias("kind"), x.alias("key")))
    return F.when(host != "", F.concat(suffixes, singles))


def judge(captures: DataFrame, entries: DataFrame, fetched: str = "fetched_at", known_keys: int = 1_000_000) -> DataFrame:
    """One row per capture: page_id, url, host, fetched_at, n_active, lists, blocked."""
    own = captures.select("page_id", "url", host_of(F.col("url")).alias("host"), F.col(fetched).alias("fetched_at"))
    asked = own.filter("fetched_at is not null").select("host", "fetched_at").distinct().withColumn("k", F.explode(keys_of(F.col("host")))).select("host", "fetched_at", "k.*")
    valid = intervals(entries)
    known = checkpoint(valid.select("kind", "key").distinct())
    if known.count() <= known_keys:
        asked = asked.join(F.broadcast(known), ["kind", "key"], "left_semi")
    inside = (asked["fetched_at"] >= valid["valid_from"]) & (valid["valid_to"].isNull() | (asked["fetched_at"] < valid["valid_to"]))
    active = asked.join(valid, (asked["kind"] == valid["kind"]) & (asked["key"] == valid["key"]) & inside).select(
        "host", "fetched_at", "list", "allows", F.struct((asked["kind"] == "host").alias("h"), F.length(asked["key"]).alias("n"), (~F.col("allows")).alias("b")).alias("rank")
    )
    found = active.groupBy("host", "fetched_at").agg(
        F.count("*").alias("n_active"), F.array_join(F.sort_array(F.collect_set(F.when(~F.col("allows"), F.col("list")))), ",").alias("lists"), F.max("rank").alias("top")
    )
    # Equal hosts and times are judged once; the captures then look their judgement up.
    return own.join(found, ["host", "fetched_at"], "left").select(
        "page_id", "url", "host", "fetched_at", F.coalesce("n_active", F.lit(0)).alias("n_active"), F.coalesce("lists", F.lit("")).alias("lists"), F.coalesce(F.col("top.b"), F.lit(False)).alias("blocked")
    )
