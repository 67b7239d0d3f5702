"""The registered queries over the driver's tables and their SQL counterparts.

The tables hold no letters, templates or runs of formatting; where an operator
needs them, the same SQL expressions make them from ``orders``, ``customer``,
``part`` and ``conversations`` in both engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.functions.catalog import CATEGORIES, PATTERNS
from palimpsest.operators import chunking, classify, contexts, entities, hits, matching, model, rebuild

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# A letter for each order. Plain SQL that both engines read alike.
_LETTER = """concat('Dear Mr Alan ', CASE c_custkey % 3 WHEN 0 THEN 'Marsh' WHEN 1 THEN 'Stone' ELSE 'Reed' END, ', your order of ',
  substr(CAST(o_orderdate AS STRING), 1, 10), ' came to £', CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING), ' or USD ', CAST(CAST(o_totalprice / 2 AS DECIMAL(18,0)) AS STRING),
  '. We take ', CAST(o_orderkey % 7 + 1 AS STRING), '.5% off in Q', CAST(o_orderkey % 4 + 1 AS STRING), ' 1996. Write to client', CAST(o_custkey AS STRING), '@example.com. Review on January ',
  CAST(o_orderkey % 28 + 1 AS STRING), ', 2024, or 2024.')"""


def letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters, dealt by doc_id: detection runs in all tasks however few files the orders are, and reconciling needs no other shuffle."""
    joined = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    made = joined.select(F.col("o_orderkey").alias("doc_id"), F.expr(_LETTER).alias("text"))
    return made.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id")


_DUCK_LETTERS = f"letters AS (SELECT o_orderkey AS doc_id, {_LETTER.replace('AS STRING', 'AS VARCHAR')} AS text FROM orders JOIN customer ON o_custkey = c_custkey)"


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _duck_hits(source: str, patterns=PATTERNS) -> str:
    """Every hit, by the same patterns (they are ones that RE2 reads alike on this input)."""
    parts = [
        f"SELECT doc_id, {k * 1_000_000_000} + i AS seq, m AS original, {_quoted(p)} AS placeholder, {_quoted(c)} AS category FROM "
        f"(SELECT doc_id, unnest(l) AS m, unnest(range(len(l))) AS i FROM (SELECT doc_id, regexp_extract_all(text, {_quoted('(?i)' + x)}) AS l FROM {source}))"
        for k, (c, p, x) in enumerate(patterns)
    ]
    return "hits AS (SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE original <> '' AND NOT starts_with(original, '{{'))"


_DUCK_BEST = """best AS (SELECT doc_id, lower(trim(original)) AS k, arg_min(original, seq) AS original, arg_min(placeholder, seq) AS placeholder, arg_min(category, seq) AS category, min(seq) AS group_seq
  FROM hits GROUP BY ALL)"""
_DUCK_MAXIMAL = "maximal AS (SELECT * FROM best b WHERE NOT EXISTS (SELECT 1 FROM best o WHERE o.doc_id = b.doc_id AND o.original <> b.original AND contains(o.original, b.original)))"

#: Patterns that read documents in several languages alike in both engines.
PLAIN = tuple(x for x in PATTERNS if x[0] in ("PERCENTAGE", "EMAIL"))


def dealt_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, dealt by doc_id as letters are: detection runs in all tasks however few row groups the table has."""
    return table(spark, sf_dir, "documents").select("doc_id", "text").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id")


@query(f"WITH d AS (SELECT doc_id, text FROM documents), {_duck_hits('d', PLAIN)}, {_DUCK_BEST}, {_DUCK_MAXIMAL} SELECT category, count(*) AS n, count(DISTINCT doc_id) AS docs FROM maximal GROUP BY category")
def entity_counts(spark, sf_dir):
    """F7, A2, J1, A1 over documents, and E with the patterns of PLAIN only; ``all_entity_counts`` has all."""
    return entities.counts_by_category(entities.reconcile_lists(entities.hit_lists(dealt_documents(spark, sf_dir), PLAIN), dealt=True))


@query(f"WITH d AS (SELECT doc_id, text FROM documents), {_duck_hits('d')}, {_DUCK_BEST}, {_DUCK_MAXIMAL} SELECT category, count(*) AS n, count(DISTINCT doc_id) AS docs FROM maximal GROUP BY category")
def all_entity_counts(spark, sf_dir):
    """E with all patterns, F7, A2, J1, A1 over documents. DuckDB's classes are those of ASCII; these texts have no hit that tells them apart."""
    return entities.counts_by_category(entities.reconcile_lists(entities.hit_lists(dealt_documents(spark, sf_dir)), dealt=True))


@query(f"WITH {_DUCK_LETTERS}, {_duck_hits('letters')} SELECT doc_id, seq, original, placeholder, category FROM hits")
def letter_entities(spark, sf_dir):
    """E with all nineteen patterns."""
    return entities.detect(letters(spark, sf_dir)).select("doc_id", "seq", "original", "placeholder", "category")


@query(f"""WITH {_DUCK_LETTERS}, {_duck_hits('letters')}, {_DUCK_BEST}, {_DUCK_MAXIMAL}
SELECT doc_id, original, placeholder, category, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY length(original) DESC, group_seq) AS INTEGER) AS ord FROM maximal""")
def reconciled_entities(spark, sf_dir):
    """A2, J1, O1, O5, P1."""
    return entities.reconcile_lists(entities.hit_lists(letters(spark, sf_dir)), dealt=True).select("doc_id", "original", "placeholder", "category", "ord")


@query("""SELECT * FROM (VALUES (0, 'DATE', 'Specific dates', '{{DATE}}', 6), (1, 'CURRENCY', 'Currency amounts', '{{CURRENCY_AMOUNT}}', 7), (2, 'CUSTOMER_NAME', 'Customer names', '{{CUSTOMER_NAME}}', 1),
  (3, 'PERCENTAGE', 'Specific percentages', '{{PERCENTAGE}}', 3), (4, 'CLIENT_PARAGRAPH', 'Whole paragraphs about a client', '{{CLIENT_PARAGRAPH}}', 0), (5, 'CLIENT_GOAL', 'Goals of a client', '{{CLIENT_GOAL}}', 0),
  (6, 'CLIENT_INSIGHT', 'Observations about a client', '{{CLIENT_INSIGHT}}', 0), (7, 'CLIENT_ADVICE', 'Advice for a client', '{{CLIENT_ADVICE}}', 0), (8, 'INVESTMENT_DETAIL', 'Holdings and funds', '{{INVESTMENT_DETAIL}}', 0),
  (9, 'ALLOCATION', 'Allocations and budget items', '{{ALLOCATION}}', 0), (10, 'RISK_STATEMENT', 'Risk warnings for a client', '{{RISK_STATEMENT}}', 0), (11, 'MEETING_SUMMARY', 'Notes of meetings', '{{MEETING_SUMMARY}}', 0),
  (12, 'ADDRESS', 'Addresses', '{{ADDRESS}}', 0), (13, 'PHONE', 'Phone numbers', '{{PHONE_NUMBER}}', 1), (14, 'EMAIL', 'Email addresses', '{{EMAIL}}', 1), (15, 'ACCOUNT_NUMBER', 'Account numbers', '{{ACCOUNT_NUMBER}}', 0)
  ) t(ord, category, description, placeholder, n_patterns)""")
def category_schema(spark, sf_dir):
    """The category dimension without its patterns."""
    return spark.createDataFrame([(k, c, d, p, len(x)) for k, (c, d, p, x) in enumerate(CATEGORIES)], "ord int, category string, description string, placeholder string, n_patterns int")


@query("""SELECT doc_id, CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '...' ELSE text END AS preview, substr(text, 1, 100) || '...' AS preview_always,
  CAST(floor(len(regexp_extract_all(text, '\\S+')) * CAST(1.3 AS DOUBLE)) AS INTEGER) AS tokens, substr(text, 1, 15000) AS cut, '{{' || upper(lang) || '}}' AS tag FROM documents""")
def text_expressions(spark, sf_dir):
    """P3, P3b, P15, O4, P22."""
    x = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", T.preview(x).alias("preview"), T.preview(x, always=True).alias("preview_always"), T.token_estimate(x).alias("tokens"), F.substring(x, 1, 15000).alias("cut"), T.tag(F.upper("lang")).alias("tag"))


@query("""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(replace(text, '. ', chr(13) || chr(10) || chr(10) || chr(10)), '\r\n?', '\n', 'g'), '\n{3,}', '\n\n', 'g'), '^\\s+|\\s+$', '', 'g') AS normal FROM documents""")
def normal_texts(spark, sf_dir):
    """P13 on texts with line ends of every sort put in."""
    return table(spark, sf_dir, "documents").select("doc_id", T.normal_text(F.replace(F.col("text"), F.lit(". "), F.lit("\r\n\n\n"))).alias("normal"))


@query("""SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'p[' || p_size || ']' WHEN p_size % 3 = 1 THEN 'table[' || p_size || ']/row[1]/cell[2]' ELSE 'header/p[' || p_size || ']' END AS path,
  CASE WHEN starts_with(p_brand, '{{') THEN p_brand ELSE '{{' || upper(p_type) || '}}' END AS placeholder, contains(p_name, 'a') AS holds, contains(lower(p_name), 'e') AS holds_any_case,
  strpos(p_name, 'a') - 1 AS place FROM part""")
def element_expressions(spark, sf_dir):
    """P2, P7, P9, F2, F3."""
    kind = F.expr("CASE p_size % 3 WHEN 0 THEN 'paragraph' WHEN 1 THEN 'table_cell' ELSE 'header' END")
    n = F.col("p_size")
    return table(spark, sf_dir, "part").select(
        "p_partkey", T.element_path(kind, n, n, F.lit(1), F.lit(2)).alias("path"), T.normal_placeholder(F.col("p_brand"), F.upper("p_type")).alias("placeholder"),
        F.contains("p_name", F.lit("a")).alias("holds"), F.contains(F.lower("p_name"), F.lit("e")).alias("holds_any_case"), T.position(F.col("p_name"), F.lit("a")).cast("long").alias("place"),
    )


_TEMPLATE = "concat('Hello {{', upper(replace(substr(p_brand, 1, 5), '#', '_')), '_', CAST(p_size % 5 AS STRING), '}}, see {{PART}} and {{', upper(substr(p_type, 1, 3)), '}}')"


def templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.expr(_TEMPLATE).alias("text"))


_DUCK_TEMPLATES = f"templates AS (SELECT p_partkey AS doc_id, {_TEMPLATE.replace('AS STRING', 'AS VARCHAR')} AS text FROM part)"


@query(f"WITH {_DUCK_TEMPLATES} SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '\\{{\\{{([A-Z0-9_]+)\\}}\\}}', 1)) AS name FROM templates")
def placeholder_scan(spark, sf_dir):
    """S11, A3, U2."""
    return contexts.scan(templates(spark, sf_dir))


@query(f"WITH {_DUCK_TEMPLATES} SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '\\{{\\{{([A-Z_]+)\\}}\\}}', 1)) AS name FROM templates")
def placeholder_scan_plain(spark, sf_dir):
    """Names with digits stay unseen."""
    return contexts.scan(templates(spark, sf_dir), T.PLACEHOLDER_NO_DIGITS)


_DUCK_MAPPING = "mapping(ord, name, content) AS (VALUES (0, 'BRA', 'first'), (1, 'BRAND_1', 'direct'), (2, 'BRAN', 'later'), (3, 'PART', 'costs $1 and {{ECO}}'), (4, 'STA', ''))"


def mapping(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(0, "BRA", "first"), (1, "BRAND_1", "direct"), (2, "BRAN", "later"), (3, "PART", "costs $1 and {{ECO}}"), (4, "STA", "")], "ord int, name string, content string")


_DUCK_NAMES = f"{_DUCK_TEMPLATES}, names AS (SELECT DISTINCT unnest(regexp_extract_all(text, '\\{{\\{{([A-Z0-9_]+)\\}}\\}}', 1)) AS name FROM templates), {_DUCK_MAPPING}"


@query(f"""WITH {_DUCK_NAMES}, m AS (SELECT n.name, x.content, row_number() OVER (PARTITION BY n.name ORDER BY (n.name = x.name) DESC, x.ord) AS k FROM names n JOIN mapping x ON starts_with(n.name, x.name))
SELECT name, content FROM m WHERE k = 1 AND content <> ''""")
def prefix_match(spark, sf_dir):
    """J2, J3."""
    return matching.by_prefix(contexts.scan(templates(spark, sf_dir)).select("name"), mapping(spark))


@query(f"WITH {_DUCK_NAMES} SELECT n.name, x.content FROM names n LEFT JOIN mapping x USING (name)")
def name_match(spark, sf_dir):
    """J2, J4."""
    return matching.by_name(contexts.scan(templates(spark, sf_dir)).select("name").distinct(), mapping(spark))


@query(f"WITH {_DUCK_NAMES} SELECT name FROM names WHERE name NOT IN (SELECT name FROM mapping)")
def unfilled_names(spark, sf_dir):
    """U3, A10."""
    return matching.unfilled(contexts.scan(templates(spark, sf_dir)).select("name").distinct(), mapping(spark))


@query(f"WITH {_DUCK_TEMPLATES} SELECT doc_id, replace(replace(text, '{{{{PART}}}}', 'costs $1 and {{{{ECO}}}}'), '{{{{ECO}}}}', 'eco') AS filled FROM templates")
def filled_templates(spark, sf_dir):
    """P19, the fold of R8: in mapping order; content brings in a later name."""
    return templates(spark, sf_dir).select("doc_id", T.fill(F.col("text"), [("{{PART}}", F.lit("costs $1 and {{ECO}}")), ("{{ECO}}", F.lit("eco"))]).alias("filled"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as paragraphs; those of the system are headings; each fourth names a placeholder."""
    tag = F.when(F.col("turn") % 4 == 1, F.concat(F.lit(" {{TURN_"), F.col("turn").cast("string"), F.lit("}}"))).otherwise(F.lit(""))
    own = table(spark, sf_dir, "conversations").filter("conv_id is not null and turn is not null").groupBy("conv_id", "turn").agg(F.min(F.struct("role", "text")).alias("m"))
    return own.select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("seq"), F.concat(F.coalesce("m.text", F.lit("")), tag).alias("text"), F.when(F.col("m.role") == "system", F.lit("Heading 1")).otherwise(F.lit("Normal")).alias("style_name"))


@query("""WITH f AS (SELECT conv_id, turn, min({'role': role, 'text': text}) AS m FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL),
p AS (SELECT conv_id AS doc_id, CAST(turn AS INTEGER) AS seq, coalesce(m.text, '') || CASE WHEN turn % 4 = 1 THEN ' {{TURN_' || turn || '}}' ELSE '' END AS text, m.role = 'system' AS heading FROM f),
w AS (SELECT *, array_to_string(list(text) OVER b, chr(10)) AS before, array_to_string(list(text) OVER a, chr(10)) AS after_,
  last_value(CASE WHEN heading THEN text END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS above,
  last_value(CASE WHEN heading THEN text END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_
  FROM p WINDOW b AS (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), a AS (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)),
n AS (SELECT *, unnest(list_distinct(regexp_extract_all(text, '\\{\\{([A-Z0-9_]+)\\}\\}', 1))) AS placeholder_name FROM w)
SELECT doc_id, placeholder_name, arg_min(coalesce(right(before, 500), ''), seq) AS before_text, arg_min(coalesce(substr(after_, 1, 500), ''), seq) AS after_text,
  arg_min(coalesce(above, last_, 'Document Start'), seq) AS section_heading, arg_min(text, seq) AS full_paragraph FROM n GROUP BY ALL""")
def placeholder_contexts(spark, sf_dir):
    """W1, W2, W3, W4, A4, A11, F9."""
    return contexts.paragraph_contexts(turns(spark, sf_dir))


@query("""WITH f AS (SELECT conv_id, turn, min({'role': role, 'text': text}) AS m FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL)
SELECT conv_id AS doc_id, string_agg(CASE WHEN m.role = 'system' THEN chr(10) || '[Heading 1] ' || t || chr(10) ELSE t END, chr(10) ORDER BY turn) AS full_text, count(*) AS paragraphs
FROM (SELECT *, coalesce(m.text, '') || CASE WHEN turn % 4 = 1 THEN ' {{TURN_' || turn || '}}' ELSE '' END AS t FROM f) GROUP BY ALL""")
def full_text(spark, sf_dir):
    """P10, A6, A8."""
    line = T.render(F.lit("paragraph"), F.col("text"), F.col("style_name"), F.lit(0))
    rows = F.array_sort(F.collect_list(F.struct("seq", line.alias("line"))))
    return turns(spark, sf_dir).groupBy("doc_id").agg(F.array_join(F.transform(rows, lambda x: x["line"]), "\n").alias("full_text"), F.count("*").alias("paragraphs"))


@query("""WITH e AS (SELECT user_id, event_id, ts, CAST(floor(value) AS BIGINT) AS tokens FROM events),
w AS (SELECT *, epoch_us(ts) / 1e6 AS s FROM e)
SELECT a.user_id, a.event_id, a.ts, a.tokens, CAST(count(b.event_id) AS BIGINT) AS requests_before, CAST(coalesce(sum(b.tokens), 0) AS BIGINT) AS tokens_before, (count(b.event_id) >= 2) OR (coalesce(sum(b.tokens), 0) + a.tokens >= 100) AS limited
FROM w a LEFT JOIN w b ON a.user_id = b.user_id AND (b.s < a.s OR (b.s = a.s AND b.event_id < a.event_id)) AND b.s > a.s - 86400 GROUP BY a.user_id, a.event_id, a.ts, a.tokens""")
def rate_windows(spark, sf_dir):
    """W8, A12, F12, M8, over a day instead of a minute, as the events are sparse."""
    own = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("id"), "ts", F.floor("value").cast("long").alias("tokens"))
    return contexts.rate_windows(own, ["user_id"], 86400, 2, 100).select("user_id", F.col("id").alias("event_id"), "ts", "tokens", F.col("requests_before").cast("long"), F.coalesce("tokens_before", F.lit(0)).cast("long").alias("tokens_before"), "limited")


def _duck_whole(limit: int) -> str:
    """Texts with their words and estimate; those within the limit are one chunk."""
    return f"""d AS (SELECT doc_id, text, regexp_extract_all(text, '\\S+') AS words FROM documents WHERE text IS NOT NULL AND regexp_matches(text, '\\S')),
e AS (SELECT *, CAST(floor(len(words) * CAST(1.3 AS DOUBLE)) AS INTEGER) AS n FROM d),
whole AS (SELECT doc_id, 0 AS chunk_index, text, 0 AS start_position, CAST(length(text) AS INTEGER) AS end_position, n AS token_count FROM e WHERE n <= {limit})"""


def _duck_chunks(limit: int) -> str:
    """``base``: chunks of whole sentences of texts above the limit, with the chunk before."""
    return f"""{_duck_whole(limit)},
cut AS (SELECT doc_id, unnest(string_split(regexp_replace(regexp_replace(text, '([.!?])\\s+', '\\1\x01', 'g'), '\n\n+', '\x01', 'g'), '\x01')) AS t, generate_subscripts(string_split(regexp_replace(regexp_replace(text, '([.!?])\\s+', '\\1\x01', 'g'), '\n\n+', '\x01', 'g'), '\x01'), 1) AS k FROM e WHERE n > {limit}),
stripped AS (SELECT doc_id, k, regexp_replace(t, '^\\s+|\\s+$', '', 'g') AS t FROM cut),
s AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS i, t, regexp_extract_all(t, '\\S+') AS words FROM stripped WHERE t <> ''),
sized AS (SELECT *, len(words) AS w, CAST(floor(len(words) * CAST(1.3 AS DOUBLE)) AS INTEGER) AS n, coalesce(sum(length(t) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM s),
-- Where each sentence goes: the chunk that is open or the next one; one above the limit takes chunks of its own.
placed(doc_id, i, chunk, free, tokens) AS (
  SELECT doc_id, CAST(0 AS BIGINT), CAST(-1 AS BIGINT), CAST(0 AS BIGINT), CAST(-1 AS BIGINT) FROM (SELECT DISTINCT doc_id FROM sized)
  UNION ALL
  SELECT p.doc_id, z.i, CASE WHEN z.n > {limit} THEN p.free WHEN p.tokens >= 0 AND p.tokens + z.n <= {limit} THEN p.free - 1 ELSE p.free END,
    CASE WHEN z.n > {limit} THEN p.free + (z.w + {limit - 1}) // {limit} WHEN p.tokens >= 0 AND p.tokens + z.n <= {limit} THEN p.free ELSE p.free + 1 END,
    CASE WHEN z.n > {limit} THEN -1 WHEN p.tokens >= 0 AND p.tokens + z.n <= {limit} THEN p.tokens + z.n ELSE z.n END
  FROM placed p JOIN sized z ON z.doc_id = p.doc_id AND z.i = p.i + 1),
j AS (SELECT z.*, p.chunk FROM placed p JOIN sized z USING (doc_id, i)),
packed AS (SELECT doc_id, chunk, string_agg(t, ' ' ORDER BY i) AS text, min(place) AS a, max(place + length(t) + 1) AS b, sum(n) AS tokens FROM j WHERE n <= {limit} GROUP BY ALL),
pieces AS (SELECT doc_id, chunk + k AS chunk, array_to_string(words[k * {limit} + 1 : k * {limit} + {limit}], ' ') AS text, place + length(array_to_string(words[1 : k * {limit}], ' ')) + CASE WHEN k > 0 THEN 1 ELSE 0 END AS a,
  place + length(array_to_string(words[1 : k * {limit} + {limit}], ' ')) + 1 AS b, len(words[k * {limit} + 1 : k * {limit} + {limit}]) AS tokens FROM (SELECT *, unnest(range((w + {limit - 1}) // {limit})) AS k FROM j WHERE n > {limit})),
base AS (SELECT *, lag(text) OVER (PARTITION BY doc_id ORDER BY chunk) AS before FROM (SELECT * FROM packed UNION ALL SELECT * FROM pieces))"""


@query(f"""WITH RECURSIVE {_duck_chunks(548)},
lapped AS (SELECT doc_id, chunk, CASE WHEN before IS NULL THEN text ELSE array_to_string(list_reverse(list_reverse(regexp_extract_all(before, '\\S+'))[1:76]), ' ') || ' ' || text END AS text, a, b, tokens, before IS NULL AS first FROM base)
SELECT doc_id, CAST(chunk AS INTEGER) AS chunk_index, text, CAST(a AS INTEGER) AS start_position, CAST(b AS INTEGER) AS end_position,
  CAST(CASE WHEN first THEN tokens ELSE floor(len(regexp_extract_all(text, '\\S+')) * CAST(1.3 AS DOUBLE)) END AS INTEGER) AS token_count FROM lapped UNION ALL SELECT * FROM whole""")
def chunks(spark, sf_dir):
    """Medium chunks with overlap."""
    return chunking.chunk_documents(table(spark, sf_dir, "documents"), "medium", overlap=100)


@query(f"""WITH {_duck_whole(548)},
-- A word alone counts 1, so a chunk has as many words as its limit.
k AS (SELECT *, unnest(range((len(words) + 547) // 548)) AS k FROM e WHERE n > 548),
parts AS (SELECT doc_id, k, words[k * 548 + 1 : k * 548 + 548] AS own, array_to_string(words[1 : k * 548], ' ') AS before FROM k)
SELECT doc_id, CAST(k AS INTEGER) AS chunk_index, array_to_string(own, ' ') AS text, CAST(length(before) + CASE WHEN k > 0 THEN 1 ELSE 0 END AS INTEGER) AS start_position,
  CAST(length(before) + CASE WHEN k > 0 THEN 1 ELSE 0 END + length(array_to_string(own, ' ')) + 1 AS INTEGER) AS end_position, CAST(len(own) AS INTEGER) AS token_count FROM parts
UNION ALL SELECT * FROM whole""")
def word_chunks(spark, sf_dir):
    """C3, C5."""
    return chunking.chunk_documents(table(spark, sf_dir, "documents"), "medium", preserve_sentences=False)


@query(f"""WITH RECURSIVE {_DUCK_LETTERS}, {_duck_hits('letters')}, {_DUCK_BEST}, {_DUCK_MAXIMAL},
ordered AS (SELECT doc_id, original, placeholder, row_number() OVER (PARTITION BY doc_id ORDER BY length(original) DESC, group_seq) AS ord FROM maximal),
-- One replacement after the other; each sees what those before it left.
fold AS (
  SELECT doc_id, CAST(0 AS BIGINT) AS ord, string_split(replace(text, '. ', '.' || chr(1)), chr(1)) AS texts, 0 AS applied, CAST([] AS VARCHAR[]) AS failed FROM letters
  UNION ALL
  SELECT f.doc_id, o.ord, list_transform(f.texts, lambda x: replace(x, o.original, o.placeholder)), f.applied + CASE WHEN len(list_filter(f.texts, lambda x: contains(x, o.original))) > 0 THEN 1 ELSE 0 END,
    CASE WHEN len(list_filter(f.texts, lambda x: contains(x, o.original))) > 0 THEN f.failed ELSE list_append(f.failed, o.original) END
  FROM fold f JOIN ordered o ON o.doc_id = f.doc_id AND o.ord = f.ord + 1),
last AS (SELECT * FROM fold QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY ord DESC) = 1)
SELECT doc_id, 'body' AS part, 0 AS grp, CAST(k AS INTEGER) AS seq, texts[k + 1] AS text, CAST(applied AS INTEGER) AS applied, array_to_string(failed, '|') AS failed FROM (SELECT *, unnest(range(len(texts))) AS k FROM last)""")
def rebuilt_letters(spark, sf_dir):
    """Letters with their detections replaced."""
    lines = F.transform(F.split("text", r"(?<=\.) "), lambda t, k: F.struct(F.lit("body").alias("part"), F.lit(0).alias("grp"), k.alias("seq"), F.array(t).alias("runs")))
    docs = letters(spark, sf_dir).select("doc_id", lines.alias("own"), hits.found_in(F.col("text")).alias("found"))
    return rebuild.rebuild_found(docs).withColumn("failed", F.array_join("failed", "|"))


@query("""WITH p AS (SELECT conv_id AS doc_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS seq, trim(regexp_replace(m.text, '\\s+', ' ', 'g')) AS t FROM
  (SELECT conv_id, turn, min({'role': role, 'text': text}) AS m FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL))
SELECT a.doc_id, min(a.seq) AS start FROM p a JOIN p b ON a.doc_id = b.doc_id AND b.seq = a.seq + 1 JOIN p x ON x.doc_id = a.doc_id AND x.seq = 0 JOIN p y ON y.doc_id = a.doc_id AND y.seq = 1
WHERE x.t <> '' AND y.t <> '' AND contains(a.t, x.t) AND contains(b.t, y.t) GROUP BY ALL""")
def paragraph_sequences(spark, sf_dir):
    """The first two turns of each conversation as a two-line original."""
    from pyspark.sql import Window as W

    folded = F.trim(F.regexp_replace("m.text", r"\s+", " "))
    own = table(spark, sf_dir, "conversations").filter("conv_id is not null and turn is not null").groupBy("conv_id", "turn").agg(F.min(F.struct("role", "text")).alias("m"))
    own = own.select(F.col("conv_id").alias("doc_id"), (F.row_number().over(W.partitionBy("conv_id").orderBy("turn")) - 1).alias("seq"), folded.alias("text"))
    firsts = own.filter("seq < 2 and text <> ''").groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "\n").alias("original")).withColumn("original_id", F.lit(0))
    return matching.sequences(firsts, own).select("doc_id", F.col("start").cast("int").alias("start"))


@query("""SELECT doc_id, lang AS original, '{{' || upper(source) || '}}' AS placeholder, CAST(0.9 AS DOUBLE) AS confidence FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL""")
def model_replies(spark, sf_dir):
    """Replies with a fence and text around it."""
    docs = table(spark, sf_dir, "documents").filter("lang is not null and source is not null")
    reply = F.concat(F.lit("Here it is:\n```json\n"), F.to_json(F.struct(F.array(F.struct(F.col("lang").alias("original"), T.tag(F.upper("source")).alias("placeholder"))).alias("replacements"))), F.lit("\n```\nDone."))
    return docs.select("doc_id", F.explode(model.replacements_in(reply)).alias("r")).select("doc_id", "r.original", "r.placeholder", F.coalesce("r.confidence", F.lit(0.9)).alias("confidence"))


@query(f"""WITH RECURSIVE {_duck_chunks(2596)}
SELECT doc_id, CAST(chunk AS INTEGER) AS chunk_index, 0 AS found, CAST(NULL AS VARCHAR) AS error FROM base UNION ALL SELECT doc_id, 0, 0, NULL FROM whole""")
def model_answers(spark, sf_dir):
    """M1: chunks sent to the default client, its reply parsed."""
    chunks_ = chunking.chunk_documents(table(spark, sf_dir, "documents"), "max").withColumn("prompt", model.prompt_for_chunk('Reply as {{"replacements": []}}. Text: {text_chunk}', F.col("text")))
    return model.ask(chunks_, model.silent).select("doc_id", "chunk_index", F.size(model.replacements_in(F.col("reply"))).alias("found"), "error")


@query(f"""WITH d AS (SELECT doc_id, text FROM documents), {_duck_hits('d')}, {_DUCK_BEST}, {_DUCK_MAXIMAL}
SELECT doc_id, original, placeholder, category, CAST(0.8 AS DOUBLE) AS confidence, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY length(original) DESC, group_seq) AS INTEGER) AS ord FROM maximal""")
def classified_documents(spark, sf_dir):
    """Detections of patterns and of the default client over documents, reconciled."""
    found = classify.classify(table(spark, sf_dir, "documents"), 'Reply as {{"replacements": []}}. Text: {text_chunk}')
    return found.select("doc_id", "original", "placeholder", "category", "confidence", "ord")


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN text WHEN 2 THEN text || chr(10) || chr(10) || lang ELSE '' END AS resolved FROM documents WHERE text IS NOT NULL AND text <> '' AND lang IS NOT NULL""")
def resolved_texts(spark, sf_dir):
    """Parsed documents under several keys."""
    x, lang = F.col("text"), F.col("lang")
    parsed = (
        F.when(F.col("doc_id") % 4 == 0, F.to_json(F.struct(x.alias("markdown"))))
        .when(F.col("doc_id") % 4 == 1, F.to_json(F.struct(F.struct(x.alias("text")).alias("document"))))
        .when(F.col("doc_id") % 4 == 2, F.to_json(F.struct(F.struct(F.array(F.struct(x.alias("content")), F.struct(lang.alias("content"))).alias("elements")).alias("document"))))
        .otherwise(F.lit("{broken"))
    )
    return table(spark, sf_dir, "documents").filter("text is not null and text <> '' and lang is not null").select("doc_id", model.resolve_parsed(parsed).alias("resolved"))


@query("""SELECT to_json({'doc_id': doc_id, 'lang': lang}) AS value FROM documents WHERE lang IS NOT NULL""")
def json_rows(spark, sf_dir):
    """K8."""
    from palimpsest.sources.sinks import as_json

    return as_json(table(spark, sf_dir, "documents").filter("lang is not null").select("doc_id", "lang"))
