"""Placeholders and what stands around them, over a table of paragraphs or cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions.text import PLACEHOLDER, is_heading, placeholders

NEAR = 3
WIDTH = 500


def scan(elements: DataFrame, pattern: str = PLACEHOLDER) -> DataFrame:
    """Distinct placeholder names by document."""
    return elements.select("doc_id", F.explode(placeholders(F.col("text"), pattern)).alias("name")).distinct()


def _joined(frame) -> F.Column:
    return F.array_join(F.collect_list(F.coalesce("text", F.lit(""))).over(frame), "\n")


def paragraph_contexts(paragraphs: DataFrame) -> DataFrame:
    """First occurrence of each name in (doc_id, seq, text, style_name): text before and after, heading, paragraph.

    The heading is the nearest one above; without one the document's last
    heading, without any ``Document Start``. All windows share one order by
    document, so there is one shuffle for them.
    """
    line = W.partitionBy("doc_id").orderBy("seq")
    heading = F.when(is_heading(F.col("style_name")), F.coalesce("text", F.lit("")))
    whole = line.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    around = paragraphs.select(
        "doc_id",
        "seq",
        "text",
        F.right(_joined(line.rowsBetween(-NEAR, -1)), F.lit(WIDTH)).alias("before_text"),
        F.substring(_joined(line.rowsBetween(1, NEAR)), 1, WIDTH).alias("after_text"),
        F.coalesce(F.last(heading, ignorenulls=True).over(line.rowsBetween(W.unboundedPreceding, -1)), F.last(heading, ignorenulls=True).over(whole), F.lit("Document Start")).alias("section_heading"),
    )
    named = around.withColumn("placeholder_name", F.explode(F.array_distinct(placeholders(F.col("text")))))
    return first_of_each(named, "placeholder_name", "seq").select("doc_id", "placeholder_name", "before_text", "after_text", "section_heading", F.col("text").alias("full_paragraph"))


def first_of_each(rows: DataFrame, name: str, order: str) -> DataFrame:
    """The first row of each name in each document, by a combining aggregate and no window."""
    rest = [c for c in rows.columns if c not in ("doc_id", name)]
    return rows.groupBy("doc_id", name).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_first")).select("doc_id", name, "_first.*")


def cell_contexts(cells: DataFrame) -> DataFrame:
    """Contexts of names in table cells (doc_id, table_index, row_index, cell_index, paragraph_index, text).

    Before: earlier paragraphs of the cell, up to two cells to the left, the last
    cell of the row above; after: the mirror image. The last or first 500 characters count.
    """
    own = ["doc_id", "table_index"]
    texts = cells.groupBy(*own, "row_index", "cell_index").agg(
        F.array_sort(F.collect_list(F.struct("paragraph_index", F.coalesce("text", F.lit("")).alias("text")))).alias("paragraphs")
    )
    text = F.array_join(F.transform("paragraphs", lambda p: p["text"]), "\n")
    row = W.partitionBy(*own, "row_index").orderBy("cell_index")
    texts = texts.withColumn("t", text).withColumn("left", F.collect_list("t").over(row.rowsBetween(-2, -1))).withColumn("right", F.collect_list("t").over(row.rowsBetween(1, 2)))
    ends = texts.groupBy(*own, "row_index").agg(F.max_by("t", "cell_index").alias("last"), F.min_by("t", "cell_index").alias("first"))
    above = ends.select(*own, (F.col("row_index") + 1).alias("row_index"), F.col("last").alias("above"))
    below = ends.select(*own, (F.col("row_index") - 1).alias("row_index"), F.col("first").alias("below"))
    texts = texts.join(above, [*own, "row_index"], "left").join(below, [*own, "row_index"], "left")
    p = texts.select("*", F.explode("paragraphs").alias("p")).withColumn("placeholder_name", F.explode(F.array_distinct(placeholders(F.col("p.text")))))
    earlier = F.transform(F.filter("paragraphs", lambda x: x["paragraph_index"] < F.col("p.paragraph_index")), lambda x: x["text"])
    later = F.transform(F.filter("paragraphs", lambda x: x["paragraph_index"] > F.col("p.paragraph_index")), lambda x: x["text"])
    one = lambda c: F.when(F.col(c).isNotNull(), F.array(c)).otherwise(F.array().cast("array<string>"))
    p = p.select(
        "doc_id", "placeholder_name", F.struct("table_index", "row_index", "cell_index", F.col("p.paragraph_index")).alias("at"),
        F.right(F.array_join(F.concat(earlier, F.reverse("left"), one("above")), "\n"), F.lit(WIDTH)).alias("before_text"),
        F.substring(F.array_join(F.concat(later, F.col("right"), one("below")), "\n"), 1, WIDTH).alias("after_text"),
        F.col("p.text").alias("full_paragraph"),
    )
    return first_of_each(p, "placeholder_name", "at").drop("at")


def rate_windows(requests: DataFrame, key: list[str], seconds: int = 60, most_requests: int = 450, most_tokens: int = 81_000) -> DataFrame:
    """For (key, ts, id, tokens): requests and tokens of the last minute before each, and whether a limit is reached."""
    at = F.col("ts").cast("timestamp").cast("double")
    span = W.partitionBy(*key).orderBy(at).rangeBetween(-seconds, 0)
    edge = W.partitionBy(*key, "ts").orderBy("id").rowsBetween(0, W.unboundedFollowing)
    old = W.partitionBy(*key).orderBy(at).rangeBetween(-seconds, -seconds)
    n = F.count("*").over(span) - F.count("*").over(edge) - F.count("*").over(old)
    t = F.sum("tokens").over(span) - F.sum("tokens").over(edge) - F.coalesce(F.sum("tokens").over(old), F.lit(0))
    return requests.withColumn("requests_before", n).withColumn("tokens_before", t).withColumn("limited", (n >= most_requests) | (t + F.col("tokens") >= most_tokens))
