"""The operators over small tables with nulls, empties, ties, repeats and clashing columns."""

import hashlib
import math
import re

import pytest
from palimpsest.llm import html, jaccard, langid, media, mixing, pieces, pii, quality, topk, urlfilter
from pyspark.sql import functions as F

PIECES = "/opt/tokenizers/piece_bpe_32k.model"
LONG = "word " * 50_000
BASE = " ".join(f"w{k}" for k in range(200))
ROWS = [
    (1, BASE, "en", "a", 0), (2, BASE, "en", "a", 0), (3, BASE.replace("w100", "other"), "en", None, 0), (4, None, None, "b", None), (5, "", "de", "b", 0),
    (6, "ein kleiner Satz mit Wort", "de", "c", 0), (6, "ein kleiner Satz mit Wort", "de", "c", 0), (None, "no id a@b.com", "en", None, 1), (8, "!!!", "fr", "a", 1), (9, LONG, "en", "a", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    d = spark.createDataFrame(ROWS, SCHEMA)
    for name in ("k", "v", "cid", "n", "score", "_shard", "_mixed_x", "host"):
        d = d.withColumn(name, F.lit("x"))
    return d.cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_similarity(docs, nothing):
    got = by_id(jaccard.similar_documents(docs))
    assert {got[i].class_id for i in (1, 2, 3)} == {1} and got[1].n_links == 2 and got[3].n_links == 2 and got[3].n_text_links == 1
    assert got[4].class_id == 4 and got[4].n_links == 0 and got[None].n_links == 0
    assert jaccard.similar_documents(nothing).count() == 0
    kept = [r.doc_id for r in jaccard.deduplicate(docs).collect()]
    assert sorted(x for x in kept if x) == [1, 4, 5, 6, 8, 9] and kept.count(None) == 1


def test_mixing(docs, nothing):
    rows = mixing.mix(docs, block=4).collect()
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted(r.size for r in rows) == sorted(words(r[1]) for r in ROWS)
    sizes, aims, taken = {}, {}, {}
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
        sizes[r.source], aims[r.source] = r.source_size, r.target
        taken[r.source] = taken.get(r.source, 0) + r.taken
    order, want = ["a", "b", "c", None], {}
    weight, left, open_ = dict(zip(order, (5, 2, 1, 5))), 1.5 * sum(sizes.values()), set(order)
    while True:
        level = left / sum(weight[s] for s in open_) if open_ else 0
        over = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not over:
            break
        for s in over:
            want[s] = 2 * sizes[s]
            left -= want[s]
        open_ -= over
    want |= {s: level * weight[s] for s in open_}
    assert all(math.isclose(aims[s], want[s], abs_tol=1e-6) for s in order)
    assert all(abs(taken[s] - aims[s]) <= 8 for s in order)
    assert mixing.mix(nothing).count() == 0
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs, block=4).collect()))


def test_pii_and_pieces(docs, nothing):
    got = by_id(pii.find(docs))
    assert got[None].n_email == 1 and got[None].base_sha256 == hashlib.sha256(b"email:6:13").hexdigest()
    assert got[4].spans == "" and pii.find(nothing).count() == 0
    enc = by_id(pieces.encode(docs, PIECES))
    assert enc[4].ids is None and enc[5].n_tokens == 0 and all(r.round_trip for r in enc.values() if r.ids is not None)
    assert enc[9].decoded_sha256 == hashlib.sha256(LONG.encode()).hexdigest()
    assert pieces.encode(nothing, PIECES).count() == 0


def test_language(docs, nothing):
    got = by_id(langid.identify(docs, langid.train(docs)))
    assert got[4].lang_pred == got[5].lang_pred == got[8].lang_pred == "und" and got[4].score == 0
    assert all(0 <= r.score <= 1 for r in got.values())
    assert langid.identify(nothing, langid.train(nothing)).count() == 0
    assert by_id(langid.identify(docs, langid.train(nothing)))[1].lang_pred == "und"


def test_quality(spark, docs, nothing):
    labels = spark.createDataFrame([(1, 1, 0), (3, 1, 0), (6, 0, 0), (6, 1, 0), (9, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    rows = quality.score(docs, quality.train(docs, labels)).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert quality.score(docs, quality.train(nothing, labels.limit(0))).first().score == pytest.approx(0.5)


def test_media(docs, nothing):
    got = by_id(media.media_columns(docs))
    assert len(got) == 9 and got[4].n_bytes == 0 and got[4].payload_bytes == 192 and got[1].media_sha256 == got[2].media_sha256
    p = LONG.encode() + b" " * (-len(LONG) % 192)
    assert got[9].payload_sha256 == hashlib.sha256(p).hexdigest() and got[9].media_bytes > got[9].payload_bytes
    assert media.media_columns(nothing).count() == 0


@pytest.mark.parametrize("scale", [1.0, 1e12])
def test_top_k(spark, scale):
    vectors = [(i, [((i * 7919 + j * 31) % 41 - 20) / 10 * scale for j in range(4)], 0) for i in range(90)]
    vectors += [(100 + i, [scale] * 4, 0) for i in range(60)] + [(40, None, 0), (60, [None, 1.0], 0), (80, [float("nan")], 0), (None, [1.0], 0), (200, [scale], 0)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>, label int")
    clean = [(i, [math.floor(64 * x) for x in v]) for i, v, _ in vectors if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for q, a in clean:
        if q % 20 == 0:
            best = sorted((-max(-(1 << 62), min(1 << 62, sum(x * y for x, y in zip(a, b)))), i) for i, b in clean if i != q)[:20]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    got = topk.search(df, candidate_block=32, query_group=5)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert topk.search(df.limit(0)).count() == 0


def test_site_style_trees(spark):
    page = lambda k: f"<html><body><div><p>Same words on all pages</p></div><div class='b'><p>Story {k} told {k * 7}</p></div></body></html>"
    rows = [(k, "http://h.example/x", page(k)) for k in range(8)] + [(100, None, page(3)), (101, "u", None), (102, "http://one.example/", page(1))]
    got = {r.page_id: r for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3].text == "Story 3 told 21" and got[3].n_chars == 15 and got[101].text == ""
    assert got[102].text == "Same words on all pages\n\nStory 1 told 7"
    assert html.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_url_lists(spark):
    rows = [(1, "http://a.bad.example/x", "2024-01-01"), (2, "http://a.bad.example/x", "2024-03-01"), (3, "http://ok.bad.example", "2024-03-01"), (4, None, "2024-03-01"), (5, "http://bad.example", None), (6, "http://a.bad.example/y", "2024-06-01")]
    captures = spark.createDataFrame(rows, "page_id long, url string, fetched_at string").withColumn("fetched_at", F.to_timestamp("fetched_at"))
    entries = (("l", "host", "bad.example", "add", "2024-02-01"), ("l", "host", "ok.bad.example", "allow", "2024-02-01"), ("l", "host", "bad.example", "remove", "2024-05-01"), ("m", "label", "a", "add", "2024-01-15"))
    got = {r.page_id: (r.blocked, r.n_active, r.lists) for r in urlfilter.judge(captures, urlfilter.entries_table(spark, entries)).collect()}
    assert got == {1: (False, 0, ""), 2: (True, 2, "l,m"), 3: (False, 2, "l"), 4: (False, 0, ""), 5: (False, 0, ""), 6: (True, 1, "m")}


def test_branches_with_several_shared_blocks(spark):
    shared = "".join(f"<p>Shared line {j} of every page</p>" for j in range(5))
    rows = [(k, "http://h.example/x", f"<html><body><div>{shared}</div><div class='b'><p>Story {k}</p></div></body></html>") for k in range(8)]
    rows += [(100 + k, "http://i.example/x", f"<html><body><div>{shared}<p>Tale {k}</p></div></body></html>") for k in range(8)]
    got = {r.page_id: r.text for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: f"Story {k}" for k in range(8)} | {100 + k: f"Tale {k}" for k in range(8)}


def test_the_tree_decides_on_marked_pages_too(spark):
    page = lambda k: f"<html><body><div>All rights and links</div><article><h1>Title {k}</h1><p>Story {k}</p><p>Written by the staff</p></article><div class='more'><p>Body outside {k}</p></div></body></html>"
    rows = [(k, "http://h.example/x", page(k)) for k in range(8)] + [(100, "http://one.example/", page(1))]
    got = {r.page_id: r.text for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: f"Title {k}\n\nStory {k}\n\nBody outside {k}" for k in range(8)} | {100: "Title 1\n\nStory 1\n\nWritten by the staff"}
    same = [(k, "http://h.example/x", page(1)) for k in range(8)]
    assert {r.text for r in html.main_text(spark.createDataFrame(same, "page_id long, url string, html string")).collect()} == {"Title 1\n\nStory 1\n\nWritten by the staff"}


def test_names_are_evidence_only(spark):
    widget = lambda text: f"<div class='elementor-widget elementor-widget-text-editor'><p>{text}</p></div>"
    assert html.extract("<body>" + widget("One long paragraph") + widget("Another one") + "</body>") == "One long paragraph\n\nAnother one"
    assert html.extract("<article>" + widget("All of it") + "</article>") == "All of it"
    assert html.extract("<p>Long story</p><div class='cookie-notice'>We use cookies</div><p>The <span class='share-it'>s</span> end</p>") == "Long story\n\nThe end"
    page = lambda k: f"<article><h1>T {k}</h1><div id='social-history'><p>Own {k}</p></div><div class='share-line'>Share this</div><div class='comments'><p>me {k}</p></div></article>"
    rows = [(k, "http://h.example/x", page(k)) for k in range(8)]
    got = {r.page_id: r.text for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: f"T {k}\n\nOwn {k}" for k in range(8)}


def test_the_mix_does_not_depend_on_the_number_of_shards(spark):
    rows = [(k, "word " * 40, "a" if k < 20 else "b") for k in range(220)] + [(900, "word " * 30, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    totals = []
    for shard_rows in (4096, 2):
        got = mixing.mix(docs, weights=(5, 1, 5), shard_rows=shard_rows).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
        assert all(abs(r.taken - r.target) < 2 * 64 for r in got)
        totals.append({r.source: r.taken for r in got})
    assert totals[0] == totals[1] and totals[0]["a"] == 1600 and totals[0]["c"] == 60
