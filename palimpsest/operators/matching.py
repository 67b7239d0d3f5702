"""Placeholders matched with content."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.text import has_extension


def by_name(names: DataFrame, mapping: DataFrame) -> DataFrame:
    """(…, name) with the content of the same name; null where there is none."""
    return names.join(mapping.select("name", "content"), "name", "left")


def with_files(mapping: DataFrame, files: DataFrame) -> DataFrame:
    """The mapping's (name, …) that a file was given for, as ``pdf_`` and the name, of an allowed sort; others are dropped.

    ``files`` (key, file_name, content).
    """
    given = files.filter(has_extension(F.col("file_name")) & F.startswith("key", F.lit("pdf_")))
    return mapping.join(given.select(F.substr("key", F.lit(5)).alias("name"), "file_name", "content"), "name")


def unfilled(names: DataFrame, mapping: DataFrame) -> DataFrame:
    return names.join(mapping.select("name"), "name", "left_anti")


def by_prefix(names: DataFrame, mapping: DataFrame) -> DataFrame:
    """(name, content): the mapping's entry of that name, else the first, by ``ord``, that the name starts with.

    A name has at most as many prefixes as characters, so both steps are one
    equi-join on the prefix; no name is compared with all entries. Names whose
    content is empty are left out.
    """
    prefixes = names.select("name").distinct().withColumn("_prefix", F.explode(F.transform(F.sequence(F.lit(0), F.length("name")), lambda k: F.substring(F.col("name"), F.lit(1), k))))
    joined = prefixes.join(mapping.select(F.col("name").alias("_prefix"), "content", "ord"), "_prefix")
    first = joined.groupBy("name").agg(F.min_by("content", F.struct(F.col("_prefix") != F.col("name"), F.col("ord"))).alias("content"))
    return first.filter(F.coalesce("content", F.lit("")) != "")


def sequences(originals: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """(doc_id, original_id, start): where the lines of an original are parts of that many paragraphs in a row, first place only.

    ``originals`` (doc_id, original_id, original), ``paragraphs`` (doc_id, seq, text), seq without gaps. Originals of
    fewer than two lines that aren't blank match nothing. Lines are compared with white space folded.
    """
    folded = lambda c: F.trim(F.regexp_replace(c, r"(?U)\s+", " "))
    lines = F.filter(F.transform(F.split("original", "\n"), folded), lambda x: x != "")
    parts = originals.withColumn("_lines", lines).filter(F.size("_lines") > 1).select("doc_id", "original_id", F.size("_lines").alias("n"), F.posexplode("_lines").alias("pos", "line"))
    own = paragraphs.select("doc_id", "seq", folded(F.col("text")).alias("t"))
    # Only first lines meet all paragraphs of their document; the others meet the one that they would stand in.
    starts = parts.filter("pos = 0").join(own, "doc_id").filter(F.contains("t", F.col("line"))).select("doc_id", "original_id", "n", F.col("seq").alias("start"))
    rest = starts.join(parts.filter("pos > 0").select("doc_id", "original_id", "pos", "line"), ["doc_id", "original_id"]).withColumn("seq", F.col("start") + F.col("pos"))
    hits = rest.join(own, ["doc_id", "seq"]).filter(F.contains("t", F.col("line")))
    runs = hits.groupBy("doc_id", "original_id", "start", "n").agg(F.countDistinct("pos").alias("k")).filter("k = n - 1")
    return runs.groupBy("doc_id", "original_id").agg(F.min("start").alias("start"))
