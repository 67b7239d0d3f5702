"""Mixing sources to target weights with Sainte-Lague apportionment, in DataFrame operations only.

Every document has a size in words. Sources get target sizes by weight, none
above ``epochs`` times its own size (what is cut off is shared again among the
rest). The mix is dealt out in blocks of ``block`` words: highest quotients
v / (2k + 1) give each source an integer number of blocks, the last one partial
where the source has no more, and in each source each shard an integer number of
their words: blocks span shards, so a source's total doesn't depend on how many
shards there are. A shard lists its documents in a seeded order; the first words
of that list up to the quota are taken, read again from its start where the quota
asks for more than one pass.

Shards are made by hash of the id, so a source with any share of the rows is
spread evenly; only sums by shard and by source meet in one place.

Defined cases: a null text has size 0 and nothing is taken of it; a null source
is a source of its own, last in order; rows that repeat an id count as documents
of their own; documents of one draw and id are in the order of their sizes; very
long texts are one row like others; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.llm.common import checkpoint

#: What a word is: a run of anything but space and the controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
_SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def word_count(text: Column) -> Column:
    """Number of matches of WORD, counted as starts of words: no list of words is built."""
    # Every white space becomes one blank, every blank that follows a blank goes: blanks then part words.
    blank = F.trim(F.translate(text, _SPACE, " " * len(_SPACE)))
    runs = F.regexp_replace(blank, " {2,}", " ")
    count = F.length(runs) - F.length(F.replace(runs, F.lit(" "), F.lit(""))) + 1
    return F.coalesce(F.when(runs == "", 0).otherwise(count), F.lit(0)).cast("long")


def sainte_lague(parties: DataFrame, by: list[str], key: list[str], votes: str, seats: str, cap: str) -> DataFrame:
    """Adds ``quota``: seats of each party of a group ``by``, ``cap`` at most, by highest quotients.

    With n parties, V votes and M seats, the divisor V / (M - n) gives no party
    too many seats and V / (M + n) none too few, so only the seats between the
    two are ranked: at most 3 n for a group, whatever M is.
    """
    group = W.partitionBy(*by)
    v, m = F.col(votes).cast("double"), F.col(seats)
    p = (
        parties.withColumn("_total", F.sum(v).over(group))
        .withColumn("_n", F.sum((v > 0).cast("long")).over(group))
        .withColumn("_low", F.when(v > 0, F.floor(v * F.greatest(m - F.col("_n"), F.lit(0)) / F.col("_total") + 0.5)).otherwise(0))
        .withColumn("_high", F.when(v > 0, F.floor(v * (m + F.col("_n")) / F.col("_total") + 0.5)).otherwise(0))
        .withColumn("_low", F.least("_low", F.col(cap)).cast("long"))
        .withColumn("_high", F.least("_high", F.col(cap)).cast("long"))
        .withColumn("_left", m - F.sum("_low").over(group))
    )
    seat = F.when(F.col("_high") > F.col("_low"), F.sequence(F.col("_low"), F.col("_high") - 1))
    ranked = p.select("*", F.explode_outer(seat).alias("_seat")).withColumn(
        "_rank", F.row_number().over(group.orderBy((v / (2 * F.col("_seat") + 1)).desc_nulls_last(), *key, "_seat"))
    )
    won = (F.col("_seat").isNotNull() & (F.col("_rank") <= F.col("_left"))).cast("long")
    kept = [c for c in parties.columns if c not in (*by, *key)]
    keys = list(dict.fromkeys([*by, *key]))
    return ranked.groupBy(*keys).agg(*[F.first(c).alias(c) for c in kept], (F.first("_low") + F.sum(won)).alias("quota"))


def targets(sources: DataFrame, weights: tuple[float, ...], share: float, epochs: float) -> DataFrame:
    """Adds ``target`` to (source, has_source, source_size): shares by weight, none above ``epochs`` sizes.

    A source is at its limit when limit / weight is below the common level; with
    sources in the order of that ratio, the level follows from running sums.
    """
    order = W.partitionBy("_all").orderBy(F.col("has_source").desc(), F.col("source"))
    pattern = F.array(*[F.lit(float(w)) for w in weights])
    s = (
        sources.withColumn("_all", F.lit(0))
        .withColumn("_place", F.row_number().over(order))
        .withColumn("_weight", F.element_at(pattern, (F.pmod(F.col("_place") - 1, F.lit(len(weights))) + 1).cast("int")))
        .withColumn("_limit", F.col("source_size") * F.lit(float(epochs)))
        .withColumn("_ratio", F.col("_limit") / F.col("_weight"))
        .withColumn("_wanted", F.sum("source_size").over(W.partitionBy("_all")) * F.lit(float(share)))
    )
    rising = W.partitionBy("_all").orderBy("_ratio", "_place")
    s = (
        s.withColumn("_before", F.coalesce(F.sum("_limit").over(rising.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("_open", F.sum("_weight").over(rising.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("_level", (F.col("_wanted") - F.col("_before")) / F.col("_open"))
        .withColumn("_level", F.first(F.when(F.col("_level") <= F.col("_ratio"), F.col("_level")), ignorenulls=True).over(rising.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    )
    target = F.when(F.col("_level").isNull(), F.col("_limit")).otherwise(F.least(F.col("_limit"), F.col("_level") * F.col("_weight")))
    return s.select("source", "has_source", "source_size", target.alias("target"))


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (5, 2, 1),
    share: float = 1.5,
    epochs: int = 2,
    block: int = 64,
    shard_rows: int = 4096,
    seed: str = "mix-1",
) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken.

    ``taken`` is the number of words that the mix takes of the document, repeats
    counted, ``epochs`` times its size at most.
    """
    shards = max(1, -(-docs.count() // shard_rows))
    sized = docs.select(
        F.col("doc_id"),
        F.coalesce(F.col("source"), F.lit("")).alias("source"),
        F.col("source").isNotNull().alias("has_source"),
        word_count(F.col("text")).alias("size"),
        F.md5(F.concat_ws("|", F.lit(seed), F.col("doc_id").cast("string")).cast("binary")).alias("_draw"),
    ).withColumn("_shard", F.pmod(F.conv(F.substring("_draw", 1, 12), 16, 10).cast("long"), F.lit(shards)))
    sized = checkpoint(sized)
    key = ["source", "has_source"]

    by_shard = sized.groupBy(*key, "_shard").agg(F.sum("size").alias("shard_size"))
    by_source = by_shard.groupBy(*key).agg(F.sum("shard_size").alias("source_size"))
    aims = targets(by_source, weights, share, epochs)
    aims = (
        aims.withColumn("_all", F.lit(0))
        .withColumn("_blocks", F.floor(F.sum("target").over(W.partitionBy("_all")) / block))
        .withColumn("_cap", F.ceil(F.col("source_size") * epochs / block))
    )
    # The last block of a source may be partial, and blocks span shards: so words, not blocks, go to shards.
    seats = F.least(F.col("quota") * block, F.col("source_size") * epochs)
    quotas = sainte_lague(aims, ["_all"], key, "target", "_blocks", "_cap").select(*key, "source_size", "target", seats.alias("_seats"))
    parts = by_shard.join(quotas, key).withColumn("_cap", F.col("shard_size") * epochs)
    parts = sainte_lague(parts, key, ["_shard"], "shard_size", "_seats", "_cap").select(
        *key, "_shard", "source_size", "target", "shard_size", F.col("quota").alias("_words")
    )

    line = W.partitionBy(*key, "_shard").orderBy("_draw", "doc_id", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = sized.join(parts, [*key, "_shard"]).withColumn("_end", F.sum("size").over(line))
    size, end, words = F.col("size"), F.col("_end"), F.col("_words")
    taken = sum(
        (F.greatest(F.lit(0), F.least(end + lap * F.col("shard_size"), words) - (end - size + lap * F.col("shard_size"))) for lap in range(epochs)),
        F.lit(0),
    )
    return placed.select(
        "doc_id", F.when(F.col("has_source"), F.col("source")).alias("source"), "size", F.col("source_size"), F.col("target"), taken.cast("long").alias("taken")
    )


def mixed(docs: DataFrame, **parameters) -> DataFrame:
    """The rows of ``docs``, each as many times as its taken words make up its size, rounded.

    Documents of which less than half is taken, or that have no word, are left out. Rows that repeat an id count
    together; rows with a null id are one such group. Columns of any name come back as they were.
    """
    plan = mix(docs, **parameters).filter("size > 0").groupBy("doc_id").agg(F.sum("taken").alias("taken"), F.sum("size").alias("size"))
    plan = plan.select(F.col("doc_id").alias("id"), F.floor(F.col("taken") / F.col("size") + 0.5).cast("int").alias("times")).filter("times > 0")
    # The rows travel as one struct, so no column of theirs can clash with one of the plan's.
    rows = docs.filter(word_count(docs["text"]) > 0).select(docs["doc_id"].alias("own"), F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))
    joined = rows.join(plan, rows["own"].eqNullSafe(plan["id"]))
    return joined.select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")
