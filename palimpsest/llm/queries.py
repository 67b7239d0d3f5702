"""The registered queries of this subpackage, with the parameters of production."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import ann, hardneg, html, jaccard, langid, media, mixing, phrases, pieces, pii, quality, topk, urlfilter

#: Where the vocabulary file of the pieces lies; a parameter of the operator.
PIECES = "/opt/tokenizers/piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_documents(table(spark, sf_dir, "documents"))


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(table(spark, sf_dir, "documents"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"), PIECES)


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(table(spark, sf_dir, "pages"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op9_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages`` has no fetch time; a date of 2024 by page_id stands in for it."""
    day = F.date_add(F.to_date(F.lit("2024-01-01")), F.pmod(F.col("page_id"), F.lit(366)).cast("int"))
    captures = table(spark, sf_dir, "pages").withColumn("fetched_at", day.cast("timestamp"))
    return urlfilter.judge(captures, urlfilter.entries_table(spark))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardneg.mine(table(spark, sf_dir, "embeddings").withColumn("label", label))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(table(spark, sf_dir, "documents"))


def op13_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_langid": op1_langid,
    "op2_ngram_jaccard": op2_ngram_jaccard,
    "op3_topk": op3_topk,
    "op4_pii": op4_pii,
    "op5_media": op5_media,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_html": op7_html,
    "op8_mixing": op8_mixing,
    "op9_urlfilter": op9_urlfilter,
    "op10_quality": op10_quality,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_phrases": op12_phrases,
    "op13_neighbours": op13_neighbours,
}

_CAPTURES = r"""
  SELECT page_id, url, coalesce(lower(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)', 1)), '') AS host,
         CAST(DATE '2024-01-01' + CAST(((page_id % 366) + 366) % 366 AS INTEGER) AS TIMESTAMP) AS fetched_at
  FROM pages"""

ORACLE_SQL: dict[str, str] = {
    # The k-th score from the full join: a brute-force restatement.
    "op3_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "op9_urlfilter": f"""
WITH entries(list, kind, key, action, since) AS (VALUES {", ".join(f"('{a}','{b}','{c}','{d}',TIMESTAMP '{e} 00:00:00')" for a, b, c, d, e in urlfilter.ENTRIES)}),
dated AS (SELECT *, lead(since) OVER (PARTITION BY list, kind, key ORDER BY since) AS valid_to FROM entries),
valid AS (SELECT list, kind, key, action = 'allow' AS allows, since AS valid_from, valid_to FROM dated WHERE action <> 'remove'),
captures AS ({_CAPTURES}),
labels AS (SELECT *, string_split(regexp_replace(host, '[.]+$', ''), '.') AS l FROM captures),
asked AS (
  SELECT DISTINCT host, fetched_at, 'host' AS kind, array_to_string(l[k:], '.') AS key FROM (SELECT *, unnest(range(1, greatest(len(l), 2))) AS k FROM labels)
  UNION SELECT DISTINCT host, fetched_at, 'label', unnest(l) FROM labels),
active AS (SELECT a.host, a.fetched_at, v.list, v.allows, (a.kind = 'host') AS h, length(a.key) AS n
           FROM asked a JOIN valid v ON a.kind = v.kind AND a.key = v.key AND a.fetched_at >= v.valid_from AND (v.valid_to IS NULL OR a.fetched_at < v.valid_to)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY host, fetched_at ORDER BY h DESC, n DESC, allows) AS place FROM active),
found AS (SELECT host, fetched_at, count(*) AS n_active, bool_or(NOT allows AND place = 1) AS blocked,
                 coalesce(string_agg(DISTINCT list, ',' ORDER BY list) FILTER (WHERE NOT allows), '') AS lists FROM ranked GROUP BY ALL)
SELECT page_id, url, host, fetched_at, coalesce(n_active, 0) AS n_active, coalesce(lists, '') AS lists, coalesce(blocked, false) AS blocked
FROM captures LEFT JOIN found USING (host, fetched_at)""",
    # Every quotient of every party ranked: a brute-force restatement of the apportionment, by source and by shard.
    "op8_mixing": r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS source, source IS NOT NULL AS has_source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5(concat_ws('|', 'mix-1', CAST(doc_id AS VARCHAR))) AS draw FROM documents),
n AS (SELECT greatest(1, (count(*) + 4095) // 4096) AS shards FROM d),
p AS (SELECT d.*, CAST('0x' || substr(draw, 1, 12) AS BIGINT) % shards AS shard FROM d, n),
sources AS (SELECT source, has_source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY has_source DESC, source) AS place FROM p GROUP BY source, has_source),
weighed AS (SELECT *, CAST([5, 2, 1][(place - 1) % 3 + 1] AS DOUBLE) AS weight, source_size * CAST(2 AS DOUBLE) AS most, CAST(sum(source_size) OVER () AS DOUBLE) * CAST(1.5 AS DOUBLE) AS wanted FROM sources),
ratios AS (SELECT *, most / weight AS ratio FROM weighed),
levels AS (SELECT *, (wanted - coalesce(sum(most) OVER (ORDER BY ratio, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY ratio, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM ratios),
common AS (SELECT (SELECT level FROM levels WHERE level <= ratio ORDER BY ratio, place LIMIT 1) AS level),
aims AS (SELECT l.source, l.has_source, l.source_size, CASE WHEN c.level IS NULL THEN most ELSE least(most, c.level * weight) END AS target FROM levels l, common c),
blocks AS (SELECT *, unnest(range(CAST(ceil(source_size * 2 / 64) AS BIGINT))) AS seat FROM aims),
won AS (SELECT source, has_source, count(*) AS quota FROM (SELECT *, row_number() OVER (ORDER BY target / (2 * seat + 1) DESC, source, has_source, seat) AS rank FROM blocks WHERE target > 0)
  WHERE rank <= (SELECT floor(sum(target) / 64) FROM aims) GROUP BY ALL),
seats AS (SELECT a.*, least(coalesce(quota, 0) * 64, source_size * 2) AS words FROM aims a LEFT JOIN won USING (source, has_source)),
shards AS (SELECT source, has_source, shard, CAST(sum(size) AS BIGINT) AS shard_size FROM p GROUP BY ALL),
ranked AS (SELECT source, has_source, shard, row_number() OVER (PARTITION BY source, has_source ORDER BY CAST(shard_size AS DOUBLE) / (2 * seat + 1) DESC, shard, seat) AS rank FROM (SELECT *, unnest(range(shard_size * 2)) AS seat FROM shards)),
given AS (SELECT r.source, r.has_source, shard, count(*) AS words FROM ranked r JOIN seats s USING (source, has_source) WHERE rank <= s.words GROUP BY ALL),
placed AS (SELECT p.*, s.source_size, s.target, h.shard_size, coalesce(g.words, 0) AS words, sum(size) OVER (PARTITION BY p.source, p.has_source, p.shard ORDER BY draw, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ends
  FROM p JOIN seats s USING (source, has_source) JOIN shards h USING (source, has_source, shard) LEFT JOIN given g USING (source, has_source, shard))
SELECT doc_id, CASE WHEN has_source THEN source END AS source, size, source_size, target,
  CAST(greatest(0, least(ends, words) - (ends - size)) + greatest(0, least(ends + shard_size, words) - (ends - size + shard_size)) AS BIGINT) AS taken FROM placed""",
    # The full join: a brute-force restatement.
    "op11_hard_negatives": """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label = c.label AS same, c.vec_id AS vec_id, CAST(list_dot_product(a.e, c.e) AS BIGINT) AS score FROM v a JOIN v c ON a.vec_id % 50 = 0 AND a.vec_id <> c.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score QUALIFY rank <= 3""",
    # Every phrase of every piece counted as text: no list, no level.
    "op12_phrases": r"""WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS p FROM d)),
lengths(k) AS (VALUES (1), (2), (3), (4)),
f AS (SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase, count(*) AS f FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM pieces, lengths) GROUP BY ALL),
total AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 30),
cuts AS (SELECT c.lang, c.k, c.phrase, a, cut, x.f AS l, y.f AS r, CAST(CAST(2000000 AS HUGEINT) * a // (x.f + y.f) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM c) c JOIN f x ON x.lang = c.lang AND x.k = cut AND x.phrase = array_to_string(w[: cut], ' ')
  JOIN f y ON y.lang = c.lang AND y.k = c.k - cut AND y.phrase = array_to_string(w[cut + 1 :], ' ')),
scored AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, k, phrase ORDER BY score, cut) = 1),
parts AS (SELECT lang, n, array_to_string(w[i : i + n - 1], ' ') AS phrase, max(a) AS around FROM (SELECT *, unnest(range(1, k - n + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS n FROM c)) GROUP BY ALL),
kept AS (SELECT s.* FROM scored s LEFT JOIN parts p ON p.lang = s.lang AND p.n = s.k AND p.phrase = s.phrase WHERE p.around IS NULL OR CAST(100 AS HUGEINT) * around < CAST(80 AS HUGEINT) * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept JOIN total USING (lang)
QUALIFY rank <= 2000""",
    # All classes that share a shingle are compared on their full sets; no band is looked at.
    "op2_ngram_jaccard": r"""
WITH RECURSIVE d AS (SELECT doc_id, text, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents WHERE text IS NOT NULL AND text <> ''),
cut AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [chr(1) || text] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k : k + 4], ' ')) END)) AS s FROM d),
keyed AS (SELECT doc_id, s, md5(array_to_string(s, chr(2))) AS k FROM cut),
classes AS (SELECT k, min(doc_id) AS cid, count(*) AS n, any_value(s) AS s FROM keyed GROUP BY k),
parts AS (SELECT cid, len(s) AS size, unnest(s) AS x FROM classes),
common AS (SELECT a.cid AS u, b.cid AS v, a.size AS p, b.size AS q, count(*) AS met FROM parts a JOIN parts b ON a.x = b.x AND a.cid < b.cid AND least(a.size, b.size) >= 0.8 * greatest(a.size, b.size) GROUP BY ALL),
half AS (SELECT u, v FROM common WHERE met >= 0.8 * (p + q - met)),
links AS (SELECT u, v FROM half UNION ALL SELECT v, u FROM half),
reach AS (SELECT u, v FROM links UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u),
roots AS (SELECT u AS cid, least(u, min(v)) AS root FROM reach GROUP BY u),
counted AS (SELECT u AS cid, count(*) AS texts, CAST(sum(n) AS BIGINT) AS docs FROM links JOIN classes ON cid = v GROUP BY u)
SELECT o.doc_id, coalesce(root, c.cid, o.doc_id) AS class_id, coalesce(c.cid, o.doc_id) AS text_class, coalesce(n, 1) AS n_copies, coalesce(n, 1) - 1 + coalesce(docs, 0) AS n_links, coalesce(texts, 0) AS n_text_links
FROM documents o LEFT JOIN keyed USING (doc_id) LEFT JOIN classes c ON c.k = keyed.k LEFT JOIN counted USING (cid) LEFT JOIN roots r ON r.cid = c.cid""",
}
