"""Registered queries of substitution and containment by joins, of calls in lanes and of contexts in tables, with their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions.catalog import PATTERNS
from palimpsest.operators import chunking, classify, contexts, entities, lanes, rebuild
from palimpsest.plans.registry import ORACLE_SQL, _DUCK_LETTERS, _DUCK_MAXIMAL, _DUCK_BEST, _duck_hits, letters, query, table


@query("""WITH c AS (SELECT c_custkey AS doc_id, unnest([
  {'seq': 0, 'text': '{{LETTERS}} {{SPACES}}'}, {'seq': 1, 'text': 'The {{BLOCK}}month.'}, {'seq': 2, 'text': '{{LINES}}'}, {'seq': 3, 'text': ''}, {'seq': 4, 'text': 'Segment ' || c_mktsegment || ' has {{KEY}}'}]) AS p
  FROM customer WHERE c_name IS NOT NULL AND c_mktsegment IS NOT NULL)
SELECT doc_id, 'body' AS part, 0 AS grp, CAST(p.seq AS INTEGER) AS seq, p.text AS text, 5 AS applied, 'no such words at all' AS failed FROM c""")
def matched_every_way(spark, sf_dir):
    """Originals that match by white space, by letters and digits, by a common block, by lines and exactly, in pairs found by a join."""
    own = table(spark, sf_dir, "customer").filter("c_name is not null and c_mktsegment is not null")
    key, name, segment = F.col("c_custkey").cast("string"), F.col("c_name"), F.col("c_mktsegment")
    texts = F.array(
        F.array(F.lit("Account of "), F.substring(name, 1, 9), F.concat(F.expr("substr(c_name, 10)"), F.lit(" in the "), segment, F.lit(" market"))),
        F.array(F.concat(F.lit("The balance of account "), key), F.lit(" is due at the end of the coming month.")),
        F.array(F.concat(F.lit("First line about "), segment)),
        F.array(F.lit("second "), F.concat(F.lit("line for "), name)),
        F.array(F.concat(F.lit("Segment "), segment, F.lit(" has "), F.lit("<"), key, F.lit(">"))),
    )
    pairs = {
        "BLOCK": F.concat(F.lit("Xbalance of account "), key, F.lit(" is due at the end of the coming quarter")),
        "LINES": F.concat(F.lit("First  line about "), segment, F.lit("\n\nsecond line  for "), name),
        "LETTERS": F.concat(F.lit("ACCOUNT-OF-"), F.replace(F.upper(name), F.lit("#"), F.lit("/"))),
        "SPACES": F.concat(F.lit("in   the\t"), segment, F.lit(" market")),
        "MISSING": F.lit("no such words at all"),
        "KEY": F.concat(F.lit("<"), key, F.lit(">")),
    }
    given = F.array(*[F.struct(F.lit(k).alias("ord"), o.alias("original"), F.lit("{{" + n + "}}").alias("placeholder")) for k, (n, o) in enumerate(pairs.items())])
    paragraphs = own.select(F.col("c_custkey").alias("doc_id"), F.lit("body").alias("part"), F.lit(0).alias("grp"), F.posexplode(texts).alias("seq", "runs"))
    replacements = own.select(F.col("c_custkey").alias("doc_id"), F.explode(given).alias("p")).select("doc_id", "p.*")
    return rebuild.rebuild_documents(paragraphs, replacements, direct=0).withColumn("failed", F.array_join("failed", "|"))


@query("""WITH t AS (SELECT DISTINCT c_nationkey AS doc_id, CASE WHEN c_custkey % 7 = 0 THEN c_mktsegment ELSE substr(c_name, 1 + c_custkey % 3, 10 + c_custkey % 9) END AS original FROM customer WHERE c_name IS NOT NULL AND c_mktsegment IS NOT NULL AND c_nationkey IS NOT NULL)
SELECT doc_id, original FROM t WHERE NOT EXISTS (SELECT 1 FROM t o WHERE o.doc_id = t.doc_id AND o.original <> t.original AND contains(o.original, t.original))""")
def maximal_texts(spark, sf_dir):
    """J1 of documents with many detections: parts of names, a document for each nation, that meet on their rarest grams."""
    text = F.expr("CASE WHEN c_custkey % 7 = 0 THEN c_mktsegment ELSE substr(c_name, CAST(1 + c_custkey % 3 AS INT), CAST(10 + c_custkey % 9 AS INT)) END")
    own = table(spark, sf_dir, "customer").filter("c_name is not null and c_mktsegment is not null and c_nationkey is not null")
    return entities.maximal(own.select(F.col("c_nationkey").alias("doc_id"), text.alias("original")).distinct(), in_row=0)


def _priority(prompt: str) -> str:
    """A client that fails for one priority."""
    if prompt.endswith("URGENT"):
        raise OSError("too urgent")
    return prompt.upper()


@query("""SELECT o_orderkey, CASE WHEN o_orderpriority NOT LIKE '%URGENT' THEN upper('Priority ' || o_orderpriority) END AS reply, CASE WHEN o_orderpriority LIKE '%URGENT' THEN 'too urgent' END AS error FROM orders""")
def answered_orders(spark, sf_dir):
    """A prompt for each order, few of them distinct; each distinct one is sent once, its reply or error joined back."""
    prompts = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("Priority "), F.col("o_orderpriority")).alias("prompt"))
    return lanes.answered(prompts, _priority, lanes=2).select("o_orderkey", "reply", "error")


_SOME = tuple((c, p, x) for c, p, x in PATTERNS if c in ("PERCENTAGE", "EMAIL"))
_WITH_BAD = (*_SOME[:2], ("BROKEN", "{{BROKEN}}", "(unclosed"), *_SOME[2:])


@query(f"""WITH {_DUCK_LETTERS}, {_duck_hits('letters', _SOME)}, {_DUCK_BEST}, {_DUCK_MAXIMAL}
SELECT doc_id, original, placeholder, category, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY length(original) DESC, group_seq) AS INTEGER) AS ord, true AS told FROM maximal""")
def classified_without_bad_patterns(spark, sf_dir):
    """M4, M5, E: a pattern that the engine doesn't understand among good ones; their hits stay, the status names it."""
    found = classify.classify_or_patterns(letters(spark, sf_dir), "{text_chunk}", patterns=_WITH_BAD)
    return found.select("doc_id", "original", "placeholder", "category", "ord", F.startswith("status", F.lit("classified; pattern of BROKEN skipped: ")).alias("told"))


@query(f"""WITH {_DUCK_LETTERS}, {_duck_hits('letters', _SOME)}
SELECT doc_id, original, placeholder, category, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS INTEGER) AS ord, true AS told FROM hits""")
def patterns_after_failed_run(spark, sf_dir):
    """M6: the run fails in its tasks, so all pattern hits come as they are."""
    own = letters(spark, sf_dir)
    failing = entities.detect(own, _SOME).withColumn("reason", F.raise_error(F.lit("no earlier phase")).cast("string"))
    found = classify.classify_or_patterns(own, "{text_chunk}", patterns=_SOME, paragraphs=failing)
    return found.select("doc_id", "original", "placeholder", "category", "ord", F.startswith("status", F.lit("patterns only: ")).alias("told"))


@query("""WITH c AS (SELECT p_partkey // 12 AS doc_id, (p_partkey % 12) // 4 AS r, p_partkey % 4 AS c, [p_name, 'size ' || p_size || CASE WHEN p_partkey % 5 = 0 THEN ' {{P' || p_partkey || '}}' ELSE '' END, p_type] AS l FROM part WHERE p_name IS NOT NULL AND p_type IS NOT NULL AND p_size IS NOT NULL),
t AS (SELECT *, array_to_string(l, chr(10)) AS t FROM c),
w AS (SELECT *, lag(t) OVER o AS l1, lag(t, 2) OVER o AS l2, lead(t) OVER o AS r1, lead(t, 2) OVER o AS r2 FROM t WINDOW o AS (PARTITION BY doc_id, r ORDER BY c)),
e AS (SELECT doc_id, r, arg_max(t, c) AS last, arg_min(t, c) AS first FROM t GROUP BY ALL)
SELECT w.doc_id, regexp_extract(l[2], '\\{\\{([A-Z0-9_]+)\\}\\}', 1) AS placeholder_name, right(array_to_string([l[1], l1, l2, a.last], chr(10)), 500) AS before_text, substr(array_to_string([l[3], r1, r2, b.first], chr(10)), 1, 500) AS after_text, l[2] AS full_paragraph
FROM w LEFT JOIN e a ON a.doc_id = w.doc_id AND a.r = w.r - 1 LEFT JOIN e b ON b.doc_id = w.doc_id AND b.r = w.r + 1 WHERE contains(l[2], '{{')""")
def table_contexts(spark, sf_dir):
    """Names in table cells with the cell's other paragraphs, two cells on either side, and the ends of the rows above and below."""
    k = F.col("p_partkey")
    named = F.concat(F.lit("size "), F.col("p_size").cast("string"), F.when(k % 5 == 0, F.concat(F.lit(" {{P"), k.cast("string"), F.lit("}}"))).otherwise(F.lit("")))
    own = table(spark, sf_dir, "part").filter("p_name is not null and p_type is not null and p_size is not null")
    cells = own.select(
        F.floor(k / 12).alias("doc_id"), F.lit(0).alias("table_index"), F.floor(k % 12 / 4).cast("int").alias("row_index"), (k % 4).cast("int").alias("cell_index"),
        F.posexplode(F.array("p_name", named, "p_type")).alias("paragraph_index", "text"),
    )
    return contexts.cell_contexts(cells)


@query("""SELECT doc_id, string_agg(line, chr(10) ORDER BY seq) AS full_text FROM (SELECT p_partkey // 6 AS doc_id, p_partkey % 6 AS seq, CASE p_partkey % 6 WHEN 0 THEN chr(10) || '[Heading 2] ' || p_name || chr(10) WHEN 1 THEN p_name
  WHEN 2 THEN '[Table1] ' || p_name WHEN 3 THEN '[Table2] ' || p_name WHEN 4 THEN '[Header] ' || p_name ELSE '[Footer] ' || p_name END AS line FROM part WHERE p_name IS NOT NULL) GROUP BY doc_id""")
def rendered_elements(spark, sf_dir):
    """P10 of every sort of element: headings, paragraphs, cells of two tables, headers and footers."""
    from palimpsest.functions import text as T

    place = F.col("p_partkey") % 6
    kind = F.element_at(F.array(*map(F.lit, ("paragraph", "paragraph", "table_cell", "table_cell", "header", "footer"))), (place + 1).cast("int"))
    line = T.render(kind, F.col("p_name"), F.when(place == 0, F.lit("Heading 2")).otherwise(F.lit("Normal")), F.when(place == 3, 1).otherwise(0))
    rows = table(spark, sf_dir, "part").filter("p_name is not null").select(F.floor(F.col("p_partkey") / 6).alias("doc_id"), place.alias("seq"), line.alias("line"))
    lines = F.array_sort(F.collect_list(F.struct("seq", "line")))
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("full_text"))


#: Where a rank file lies; a parameter of the operator.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@query()
def byte_pair_tokens(spark, sf_dir):
    """Tokens of every text by the ranks of a file; tested against merging by brute force and a library."""
    from palimpsest.functions import tokens

    return tokens.counted(table(spark, sf_dir, "documents"), tokens.Counter(RANKS))


def _file(k: int, name: str, segment: str) -> bytes:
    """A file with metadata, k modulo 3 pictures, a footer for even numbers, and a paragraph that is bold, italic or both in one of its runs."""
    import io
    import zipfile

    main = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006/relationships"
    marks = ("<w:b/>" if k % 2 else "") + ("<w:i/>" if k % 5 == 0 else "")
    foot = '<w:sectPr><w:footerReference w:type="default" r:id="rF"/></w:sectPr>' if k % 2 == 0 else ""
    body = f'<w:p><w:r><w:t xml:space="preserve">Plain </w:t></w:r><w:r><w:rPr>{marks}</w:rPr><w:t>{segment}</w:t></w:r></w:p>{foot}'
    links = "".join(f'<Relationship Id="i{n}" Type="{office}/image" Target="media/image{n}.png"/>' for n in range(k % 3)) + f'<Relationship Id="rF" Type="{office}/footer" Target="footer1.xml"/>'
    core = f'<c:coreProperties xmlns:c="urn:core" xmlns:d="urn:dc"><d:title>{name}</d:title><d:creator>{segment}</d:creator></c:coreProperties>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{main}" xmlns:r="{office}"><w:body>{body}</w:body></w:document>')
        z.writestr("word/_rels/document.xml.rels", f'<Relationships xmlns="{package}">{links}</Relationships>')
        if foot:
            z.writestr("word/footer1.xml", f'<w:ftr xmlns:w="{main}"><w:p><w:r><w:t>Foot {k}</w:t></w:r></w:p></w:ftr>')
        z.writestr("docProps/core.xml", core)
    return out.getvalue()


@query("""SELECT c_custkey AS doc_id, c_name AS title, c_mktsegment AS author, '' AS subject, CAST(c_custkey % 3 AS INTEGER) AS image_count, false AS has_headers, c_custkey % 2 = 0 AS has_footers,
  c_custkey % 2 = 1 AS is_bold, c_custkey % 5 = 0 AS is_italic, 'Plain ' || c_mktsegment || CASE WHEN c_custkey % 2 = 0 THEN '|Foot ' || c_custkey ELSE '' END AS texts FROM customer WHERE c_name IS NOT NULL AND c_mktsegment IS NOT NULL""")
def file_properties(spark, sf_dir):
    """S8c (footers), S8d, S8e, A7, P18: metadata, pictures, footers and marks of runs of each file."""
    import pyarrow as pa

    from palimpsest.plans.documents import dealt
    from palimpsest.sources import docx

    def run(batches):
        for b in batches:
            made = [_file(*x) for x in zip(*(b.column(c).to_pylist() for c in ("c_custkey", "c_name", "c_mktsegment")))]
            yield pa.record_batch([b.column("c_custkey").cast(pa.string()), pa.array(made, pa.binary())], names=["path", "content"])

    own = table(spark, sf_dir, "customer").filter("c_name is not null and c_mktsegment is not null").select("c_custkey", "c_name", "c_mktsegment")
    files = dealt(own, "c_custkey").mapInArrow(run, "path string, content binary")
    body = F.col("element_type") == "paragraph"
    lines = F.array_sort(F.collect_list(F.struct("seq", "text")))
    marks = docx.elements(files).groupBy("path").agg(F.bool_or(body & F.col("is_bold")).alias("is_bold"), F.bool_or(body & F.col("is_italic")).alias("is_italic"), F.array_join(F.transform(lines, lambda x: x["text"]), "|").alias("texts"))
    found = docx.properties(files).filter("error is null").join(marks, "path")
    get = lambda k: F.col("metadata")[k].alias(k)
    return found.select(F.col("path").cast("long").alias("doc_id"), get("title"), get("author"), get("subject"), "image_count", "has_headers", "has_footers", "is_bold", "is_italic", "texts")


@query(ORACLE_SQL["chunks"])
def chunks_in_rows(spark, sf_dir):
    """The chunks of ``chunks`` from rows of sentences, without Python."""
    return chunking.chunk_documents(table(spark, sf_dir, "documents"), "medium", overlap=100, in_rows=True)
