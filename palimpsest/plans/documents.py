"""Registered queries over whole files, and of the model's side, with their SQL counterparts.

The tables hold no files: small ones are made of ``customer`` and ``part``, the SQL side states the texts that must
come out of them.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.operators import classify, entities, files, matching
from palimpsest.plans.registry import _DUCK_LETTERS, _DUCK_MAXIMAL, _duck_hits, letters, mapping, query, table
from palimpsest.sources import docx, pdf, requests, sinks
from palimpsest.sources.shared import stored


def scripted(prompt: str) -> str:
    """A client whose reply depends on the customer's number: failures, errors, spoilt replies and detections."""
    number = re.search(r"client([0-9]+)@", prompt)
    k = int(number[1]) % 8 if number else 4
    if k == 0:
        raise OSError("no answer")
    found = {
        1: None, 2: ["text"], 3: [{"original": "Alan", "placeholder": None}], 4: [], 6: [{"original": "we take"}, {"original": "We take"}],
        5: [{"original": "Dear Mr Alan", "placeholder": "NAME", "category": "CUSTOMER_NAME"}, {"original": "Nobody", "placeholder": "{{X}}"}],
        7: [{"original": "example.com", "placeholder": "{{HOST}}", "category": "HOST", "confidence": 0.5}, {"original": "your order", "placeholder": "{{ORDER}}", "category": "ORDER", "confidence": 0.95}],
    }[k]
    body = json.dumps({"error": "limit", "replacements": []} if found is None else {"replacements": found})
    return f"As asked:\n```json\n{body}\n```\nDone." if k % 2 else body


@query(f"""WITH {_DUCK_LETTERS}, {_duck_hits('letters')},
items(k, i, original, placeholder, category, confidence) AS (VALUES (5, 0, 'Dear Mr Alan', '{{{{CUSTOMER_NAME}}}}', 'CUSTOMER_NAME', 0.9), (5, 1, 'Nobody', '{{{{X}}}}', 'UNKNOWN', 0.9),
  (6, 0, 'we take', '{{{{UNKNOWN}}}}', 'UNKNOWN', 0.9), (6, 1, 'We take', '{{{{UNKNOWN}}}}', 'UNKNOWN', 0.9), (7, 0, 'example.com', '{{{{HOST}}}}', 'HOST', 0.5), (7, 1, 'your order', '{{{{ORDER}}}}', 'ORDER', 0.95)),
told AS (SELECT l.doc_id, 1000000000000 + i AS seq, original, placeholder, category, confidence FROM letters l JOIN orders ON o_orderkey = l.doc_id JOIN items ON k = o_custkey % 8 WHERE contains(text, original)),
every AS (SELECT doc_id, seq, original, placeholder, category, 0.8 AS confidence FROM hits UNION ALL SELECT * FROM told),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(trim(original)) ORDER BY confidence DESC, seq) AS place, min(seq) OVER (PARTITION BY doc_id, lower(trim(original))) AS group_seq FROM every) WHERE place = 1),
{_DUCK_MAXIMAL}
SELECT doc_id, original, placeholder, category, CAST(confidence AS DOUBLE) AS confidence, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY length(original) DESC, group_seq) AS INTEGER) AS ord, 'classified' AS status FROM maximal""")
def scripted_classification(spark, sf_dir):
    """A client that fails, errs, spoils its reply or detects, by letter."""
    found = classify.classify_or_patterns(letters(spark, sf_dir), "Text: {text_chunk}", scripted)
    return found.select("doc_id", "original", "placeholder", "category", "confidence", "ord", "status")


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """Rows of a small table dealt to all tasks, as what is made of them is far larger than they are."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def customer_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file (doc_id, content) for each customer: two paragraphs of several runs, a table, a header."""

    def run(batches):
        for b in batches:
            made = [
                docx.made([["Account of ", n[:9], n[9:], f" in {s}"], [f"Key {k}"]], [[n, f"Segment {s}"]], f"Ref {n}")
                for k, n, s in zip(*(b.column(c).to_pylist() for c in ("c_custkey", "c_name", "c_mktsegment")))
            ]
            yield pa.record_batch([b.column("c_custkey"), pa.array(made, pa.binary())], names=["doc_id", "content"])

    own = table(spark, sf_dir, "customer").filter("c_name is not null and c_mktsegment is not null")
    return dealt(own.select("c_custkey", "c_name", "c_mktsegment"), "c_custkey").mapInArrow(run, "doc_id long, content binary")


def _replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replacements for each customer's file; the last one stands in none."""
    pair = lambda k, original, placeholder: F.struct(F.lit(k).alias("ord"), original.alias("original"), F.lit(placeholder).alias("placeholder"))
    pairs = F.array(pair(0, F.col("c_name"), "{{CUSTOMER_NAME}}"), pair(1, F.col("c_mktsegment"), "{{SEGMENT}}"), pair(2, F.lit("missing words here"), "{{MISSING}}"))
    own = table(spark, sf_dir, "customer").filter("c_name is not null and c_mktsegment is not null")
    return own.select(F.col("c_custkey").alias("doc_id"), F.explode(pairs).alias("p")).select("doc_id", "p.*")


def rebuilt_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rebuilt files, stored: filling reads them for their names and again to write them."""
    return stored(files.rebuild_files(customer_files(spark, sf_dir), _replaced(spark, sf_dir)).select("doc_id", "content"), "templates")


def reread(made: DataFrame, *rest: str) -> DataFrame:
    """(doc_id, part, seq, text, …) of the paragraphs of files, as read from their bytes. The files are stored, so they are made once."""
    made = stored(made.select("doc_id", "content", *rest), "files")
    read = docx.elements(made.select(F.col("doc_id").cast("string").alias("path"), "content"), blanks=True)
    read = read.select(F.col("path").cast("long").alias("doc_id"), F.col("element_type").alias("part"), "seq", "text")
    return read.join(made.select("doc_id", *rest), "doc_id") if rest else read


_DUCK_CUSTOMER_FILES = """paragraphs AS (SELECT c_custkey AS doc_id, unnest([
  {'part': 'paragraph', 'seq': 0, 'text': 'Account of ' || c_name || ' in ' || c_mktsegment}, {'part': 'paragraph', 'seq': 1, 'text': 'Key ' || c_custkey},
  {'part': 'table_cell', 'seq': 2, 'text': c_name}, {'part': 'table_cell', 'seq': 3, 'text': 'Segment ' || c_mktsegment}, {'part': 'header', 'seq': 4, 'text': 'Ref ' || c_name}]) AS p, c_name, c_mktsegment
  FROM customer WHERE c_name IS NOT NULL AND c_mktsegment IS NOT NULL),
rebuilt AS (SELECT doc_id, p.part AS part, CAST(p.seq AS INTEGER) AS seq, replace(replace(p.text, c_name, '{{CUSTOMER_NAME}}'), c_mktsegment, '{{SEGMENT}}') AS text FROM paragraphs)"""


@query(f"WITH {_DUCK_CUSTOMER_FILES} SELECT *, 2 AS applied, 'missing words here' AS missed FROM rebuilt")
def rebuilt_files(spark, sf_dir):
    """Files rebuilt as bytes and read again."""
    made = files.rebuild_files(customer_files(spark, sf_dir), _replaced(spark, sf_dir)).withColumn("missed", F.array_join("failed", "|"))
    return reread(made, "applied", "missed")


@query(f"WITH {_DUCK_CUSTOMER_FILES} SELECT doc_id, part, seq, replace(text, '{{{{CUSTOMER_NAME}}}}', 'Ann & Co <1>') AS text, 2 AS found, 1 AS filled, 'SEGMENT' AS unfilled FROM rebuilt")
def filled_files(spark, sf_dir):
    """Rebuilt files filled from a mapping table as bytes and read again."""
    rebuilt = rebuilt_templates(spark, sf_dir)
    content = spark.createDataFrame([("CUSTOMER_NAME", "Ann & Co <1>"), ("UNUSED", "x")], "name string, content string")
    return reread(files.fill_files(rebuilt, content).withColumn("unfilled", F.array_join("unfilled", "|")), "found", "filled", "unfilled")


def extracting(prompt: str) -> str:
    """A client that gives back the name and the source's text, in a reply broken after its content for some names."""
    name, source = prompt.split("\n")[:2]
    if name.startswith("SEG"):
        return '{"extracted_content": "' + f"{name}: {source}" + '", "reasoning": "cut'
    return json.dumps({"extracted_content": f"{name}: {source}\r\n\n\n", "reasoning": ""})


_SOURCES = ((0, "CUSTOMER", "a client", True, None), (1, "SEG", "a market", True, None), (2, "OTHER", None, False, "no such file"))


@query(f"""WITH {_DUCK_CUSTOMER_FILES} SELECT doc_id, part, seq, CASE WHEN part = 'header' THEN text ELSE replace(replace(text, '{{{{CUSTOMER_NAME}}}}', 'CUSTOMER_NAME: a client'), '{{{{SEGMENT}}}}', 'SEGMENT: a market') END AS text,
  2 AS found, 2 AS filled, 'CUSTOMER_NAME: a client' AS detail, 'not read: OTHER: no such file' AS told FROM rebuilt""")
def smart_filled_files(spark, sf_dir):
    """Rebuilt files filled by context, names matched by prefix."""
    rebuilt = rebuilt_templates(spark, sf_dir)
    sources = spark.createDataFrame(list(_SOURCES), "ord int, name string, text string, success boolean, error string")
    made = files.smart_fill(rebuilt, sources, "{placeholder_name}\n{source_text}\n{section_heading}\n{before_text}", extracting)
    return reread(made.withColumn("detail", F.col("details")["CUSTOMER_NAME"]).withColumn("told", F.array_join("errors", "|")), "found", "filled", "detail", "told")


@query(f"""WITH {_DUCK_CUSTOMER_FILES} SELECT doc_id, part, seq, CASE WHEN part = 'header' THEN text ELSE replace(text, '{{{{CUSTOMER_NAME}}}}', 'CUSTOMER_NAME: own text') END AS text,
  2 AS found, 1 AS filled, 'CUSTOMER_NAME: own text...' AS detail FROM rebuilt""")
def smart_filled_by_name(spark, sf_dir):
    """The form without prefixes, whose previews always end in an ellipsis."""
    rebuilt = rebuilt_templates(spark, sf_dir)
    sources = spark.createDataFrame([(0, "CUSTOMER_NAME", "own text", True, None), (1, "SEG", "a market", True, None)], "ord int, name string, text string, success boolean, error string")
    made = files.smart_fill(rebuilt, sources, "{placeholder_name}\n{source_text}", extracting, prefixes=False)
    return reread(made.withColumn("detail", F.col("details")["CUSTOMER_NAME"]), "found", "filled", "detail")


@query("""SELECT c_custkey AS doc_id, CASE c_custkey % 3 WHEN 0 THEN 'parsed' WHEN 1 THEN 'local' ELSE 'failed' END AS status,
  CASE c_custkey % 3 WHEN 0 THEN 'parsed elsewhere' WHEN 1 THEN 'Account of ' || c_name || ' in ' || c_mktsegment || chr(10) || chr(10) || 'Key ' || c_custkey || chr(10) || chr(10) || c_name || chr(10) || chr(10) || 'Segment ' || c_mktsegment END AS text,
  c_custkey % 3 <> 0 AS told FROM customer WHERE c_name IS NOT NULL AND c_mktsegment IS NOT NULL""")
def parsed_files(spark, sf_dir):
    """An outside parser for some files, the own reader where it fails, an error where both do."""

    def parser(content: bytes) -> str:
        if content[:1] == b"!":
            return '{"markdown": "parsed elsewhere"}'
        raise OSError("down")

    own = customer_files(spark, sf_dir)
    content = F.when(F.col("doc_id") % 3 == 0, F.lit(b"!")).when(F.col("doc_id") % 3 == 1, F.col("content")).otherwise(F.lit(b"broken"))
    read = requests.parsed(own.select(F.col("doc_id").cast("string").alias("path"), content.alias("content")), parser)
    return read.select(F.col("path").cast("long").alias("doc_id"), "status", "text", F.col("error").isNotNull().alias("told"))


@query("SELECT c_custkey AS doc_id, 'table[0]/row[0]/cell[1]' AS path, 'Segment ' || c_mktsegment AS text, 2 AS paragraphs, 1 AS tables, true AS has_headers, false AS has_footers FROM customer WHERE c_name IS NOT NULL AND c_mktsegment IS NOT NULL")
def elements_by_path(spark, sf_dir):
    """One element of each file by its path, counts, flags of headers and footers."""
    own = customer_files(spark, sf_dir).select(F.col("doc_id").cast("string").alias("path"), "content")
    found = docx.elements(own).withColumn("at", T.element_path(F.col("element_type"), F.col("paragraph_index"), F.col("table_index"), F.col("row_index"), F.col("cell_index")))
    here = F.col("at") == "table[0]/row[0]/cell[1]"
    first = found.groupBy("path").agg(
        F.min_by("text", F.when(here, F.col("seq"))).alias("text"), F.min(F.when(here, F.col("at"))).alias("at"),
        F.count_if(F.col("element_type") == "paragraph").cast("int").alias("paragraphs"), F.array_size(F.collect_set(F.when(F.col("table_index") >= 0, F.col("table_index")))).alias("tables"),
    ).filter("at is not null")
    flags = docx.properties(own).select("path", "has_headers", "has_footers")
    return first.join(flags, "path").select(F.col("path").cast("long").alias("doc_id"), F.col("at").alias("path"), "text", "paragraphs", "tables", "has_headers", "has_footers")


@query("""SELECT o_orderkey, 'template_' || strftime(o_orderdate, '%Y%m%d') || '_000000.docx' AS template, 'filled_' || strftime(o_orderdate, '%Y%m%d') || '_000000.docx' AS filled,
  'uploaded_' || strftime(o_orderdate, '%Y%m%d') || '_000000_my_report_' || o_orderkey || '.docx' AS uploaded FROM orders WHERE o_orderdate IS NOT NULL""")
def output_names(spark, sf_dir):
    """K2, K3, K5: names of written files."""
    at = F.col("o_orderdate").cast("timestamp")
    name = sinks.safe_name(F.concat(F.lit("../up/my report*"), F.col("o_orderkey").cast("string"), F.lit(".docx")))
    return table(spark, sf_dir, "orders").filter("o_orderdate is not null").select("o_orderkey", sinks.stamped("template", at).alias("template"), sinks.stamped("filled", at).alias("filled"), sinks.stamped("uploaded", at, name).alias("uploaded"))


@query("""WITH mapping(ord, name) AS (VALUES (0, 'BRA'), (1, 'BRAND_1'), (2, 'BRAN'), (3, 'PART'), (4, 'STA')),
files AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'pdf_BRA' WHEN 1 THEN 'pdf_PART' WHEN 2 THEN 'BRAN' ELSE 'pdf_NONE' END AS key, 'f' || p_partkey || CASE p_partkey % 3 WHEN 0 THEN '.PDF' WHEN 1 THEN '.exe' ELSE '.docx' END AS file_name FROM part)
SELECT name, ord, file_name FROM mapping JOIN files ON key = 'pdf_' || name WHERE NOT ends_with(file_name, '.exe')""")
def requested_files(spark, sf_dir):
    """A mapping's names with the files given for them; names without a file and other sorts of file go."""
    key = F.expr("CASE p_partkey % 4 WHEN 0 THEN 'pdf_BRA' WHEN 1 THEN 'pdf_PART' WHEN 2 THEN 'BRAN' ELSE 'pdf_NONE' END")
    file_name = F.expr("concat('f', p_partkey, CASE p_partkey % 3 WHEN 0 THEN '.PDF' WHEN 1 THEN '.exe' ELSE '.docx' END)")
    given = table(spark, sf_dir, "part").select(key.alias("key"), file_name.alias("file_name"), F.lit(None).cast("binary").alias("content"))
    asked = requests.mapping_of(spark, json.dumps({r.name: r.content for r in mapping(spark).orderBy("ord").collect()}))
    return matching.with_files(asked.select("ord", "name"), given).select("name", "ord", "file_name")


@query("""SELECT p_partkey, p_name = 'almond' AS same, coalesce(regexp_extract(t, '\\{\\{([A-Z0-9_]+)\\}\\}', 1), '') AS first_name, lower(regexp_replace(p_name || '-' || p_brand, '[^a-zA-Z0-9]', '', 'g')) AS folded,
  substr(t, 1, 6) || '--' || substr(t, 9) AS spliced, p_size % 2 = 0 AS allowed,
  CASE WHEN n = 0 THEN '' WHEN n < 1048576 THEN (floor(n * 10 / 1024 + 0.5)::BIGINT // 10) || '.' || (floor(n * 10 / 1024 + 0.5)::BIGINT % 10) || ' KB' ELSE (floor(n * 10 / 1048576 + 0.5)::BIGINT // 10) || '.' || (floor(n * 10 / 1048576 + 0.5)::BIGINT % 10) || ' MB' END AS human,
  CAST(floor(len(regexp_extract_all(p_name, '\\S+')) * CAST(1.3 AS DOUBLE) + 8192) AS INTEGER) AS request_tokens
FROM (SELECT *, 'Hello {{PART_' || p_partkey || '}}, {{NEXT}}' AS t, CAST((p_partkey % 50) * 65437 AS DOUBLE) AS n FROM part)""")
def more_expressions(spark, sf_dir):
    """F3 (equality), P11, P12, P14, P16, P17, P20."""
    t = F.concat(F.lit("Hello {{PART_"), F.col("p_partkey").cast("string"), F.lit("}}, {{NEXT}}"))
    name = F.when(F.col("p_size") % 2 == 0, F.lit("a.DocX")).otherwise(F.lit("docx"))
    return table(spark, sf_dir, "part").select(
        "p_partkey", (F.col("p_name") == "almond").alias("same"), T.first_placeholder(t).alias("first_name"), T.fold_alnum(F.concat("p_name", F.lit("-"), "p_brand")).alias("folded"),
        T.splice(t, F.lit(6), F.lit(8), F.lit("--")).alias("spliced"), T.has_extension(name).alias("allowed"), T.human_size(F.col("p_partkey") % 50 * 65437).alias("human"), T.request_estimate(F.col("p_name")).alias("request_tokens"),
    )


@query(f"""WITH {_DUCK_LETTERS}, {_duck_hits('letters')}, named AS (SELECT DISTINCT doc_id, regexp_extract(placeholder, '\\{{\\{{([A-Z0-9_]+)\\}}\\}}', 1) AS name FROM hits WHERE category IN ('DATE', 'EMAIL'))
SELECT doc_id, string_agg(name, ',' ORDER BY name) AS names FROM named GROUP BY doc_id""")
def sorted_names(spark, sf_dir):
    """The placeholder names of two categories, in the order of the alphabet, for each letter."""
    two = entities.of_category(entities.detect(letters(spark, sf_dir), entities.patterns_of("DATE", "EMAIL")), "DATE", "EMAIL")
    return two.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set(T.first_placeholder(F.col("placeholder")))), ",").alias("names"))


@query("""SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 'Account (of) ' || c_name || chr(10) || 'Balance: £5 – 10' || chr(10) || chr(10) || 'Page ' || c_custkey END AS text,
  CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE 3 END AS page_count, c_custkey % 5 <> 0 AS success, CASE WHEN c_custkey % 5 = 0 THEN 'no PDF file' END AS error FROM customer WHERE c_name IS NOT NULL""")
def pdf_pages(spark, sf_dir):
    """Files of three pages, the middle one blank, read; a damaged one tells its error."""

    def run(batches):
        for b in batches:
            made = [b"damaged" if k % 5 == 0 else pdf.made([f"Account (of) {n}\nBalance: £5 – 10", "", f"Page {k}"]) for k, n in zip(b.column("c_custkey").to_pylist(), b.column("c_name").to_pylist())]
            yield pa.record_batch([b.column("c_custkey").cast(pa.string()), pa.array(made, pa.binary())], names=["path", "content"])

    own = table(spark, sf_dir, "customer").filter("c_name is not null").select("c_custkey", "c_name")
    own = dealt(own, "c_custkey").mapInArrow(run, "path string, content binary")
    return docx.pages_text(own, pdf.pages).select(F.col("path").cast("long").alias("doc_id"), "text", "page_count", "success", "error")
