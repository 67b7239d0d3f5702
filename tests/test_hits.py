"""Detections worked as Python lists give what the engine's lists give."""

import random

import pyarrow as pa
from palimpsest.operators import chunking, classify, entities, hits, model, rebuild
from palimpsest.sources.batches import objects
from pyspark.sql import functions as F

BITS = ["3%", "4.5 PerCent", "a@b.com", "A@B.com", "12 per cent", ". ", "\n\n", " ", "word ", "é ", "{{X}}", "x@y.de ", "7 % ", "£3.20 ", " ", "Mr Ann Lee "]


def documents(spark):
    draw = random.Random(7)
    rows = [(None, "5% null id"), (None, "65% null id"), (1, None), (2, ""), (3, " \n "), (4, "3%"), (4, "3% and 4%"), (4, None), (5, "w " * 6000 + "3%. x@y.com " + "v " * 3000)]
    rows += [(10 + k, "".join(draw.choices(BITS, k=draw.choice([1, 3, 40, 9000 if k % 25 == 0 else 20])))) for k in range(60)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def asking():
    nothing = model.NOTHING

    def client(prompt: str) -> str:
        """Fails, errs, spoils its reply, finds nothing or something, by the text's length."""
        k = len(prompt) % 6
        if k == 0:
            raise OSError("no answer")
        return ["", '{"error": 1}', nothing, '{"replacements": [1]}', '{"replacements": [{"original": "word"}, {"original": "3%", "placeholder": "P", "confidence": 0.95}, {"original": "WORD"}]}', "no json"][k]

    return client


def rows(d):
    return sorted(map(repr, d.select("doc_id", "original", "placeholder", "category", "confidence", "reason", "seq", "group_seq", "ord").collect()))


def test_lists_in_python_are_reconciled_as_in_the_engine(spark):
    """Repeated, null, blank and long documents; a pattern whose placeholder has no braces; an earlier phase."""
    patterns = (*entities.PATTERNS, ("WORD", "plain", r"\bword\b"))
    docs = documents(spark)
    earlier = spark.createDataFrame([(4, 0, "3% and", "{{E}}", "E", 0.99, ""), (77777, 1, "alone", "{{E}}", "E", None, None)], "doc_id long, seq long, original string, placeholder string, category string, confidence double, reason string")
    made = classify.classify(docs, "{text_chunk}", asking(), patterns=patterns, paragraphs=earlier)
    chunks = classify._chunk_hits(chunking.chunk_documents(docs), "{text_chunk}", asking(), patterns, {})
    moved = F.transform(entities.grounded_hits(F.col("hits"), F.col("text")), lambda h: h.withField("seq", classify._chunk_seq(h["seq"])))
    phase = F.struct((F.col("seq") - classify._CHUNK_STRIDE).alias("seq"), "original", "placeholder", "category", "confidence", "reason")
    lists = entities.hit_lists(docs, patterns).unionByName(chunks.select("doc_id", moved.alias("hits"))).unionByName(earlier.select("doc_id", F.array(phase).alias("hits")))
    want = rows(entities.reconcile_lists(lists))
    assert rows(made) == want and len(want) > 100


def test_equal_detections_rank_as_in_the_engine(spark):
    draw = random.Random(1)
    own = [(d, [(draw.randint(0, 3), draw.choice([" a", "A", "a ", "ab", "", None, "B", "cab"]), draw.choice([None, "p", "q"]), "c", draw.choice([None, 0.5, float("nan"), 0.9]), None) for _ in range(draw.randint(0, 7))]) for d in range(300)]
    lists = spark.createDataFrame(own, f"doc_id long, hits array<{entities.HIT}>")
    want = {r.doc_id: [repr(tuple(h)) for h in r.hits] for r in entities.distinct_maximal_lists(lists).collect()}
    assert {d: [repr(h) for h in hits.reconciled(some)] for d, some in own} == want


def test_a_text_is_searched_once(spark):
    """Of a document of one chunk neither a failing call nor reconciling searches the text again: patterns stand only where chunks of longer ones fail."""
    docs = spark.createDataFrame([(k, f"{k}% of a@b.com") for k in range(20)], "doc_id long, text string")
    made = classify.classify(docs, "{text_chunk}", asking())
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and plan.count("MapInArrow") == 1 and made.count() > 20


def test_documents_are_folded_where_they_are_reconciled(spark):
    """In one go, or reconciled only where there are many pairs, the fold gives what it gives for replacements reconciled before."""
    docs = documents(spark)
    own = F.transform(F.split("text", r"(?<=\.) "), lambda t, k: F.struct(F.lit("body").alias("part"), F.lit(0).alias("grp"), k.alias("seq"), F.array(t).alias("runs")))
    given = F.transform("hits", lambda h, i: F.struct((i + 1).alias("ord"), h["original"].alias("original"), h["placeholder"].alias("placeholder")))
    paragraphs = docs.select("doc_id", own.alias("own")).select("doc_id", F.inline("own"))
    want = sorted(map(repr, rebuild.rebuild_documents(paragraphs, entities.reconciled_lists(entities.hit_lists(docs)).select("doc_id", given.alias("given"))).collect()))
    found = docs.select("doc_id", own.alias("own"), hits.found_in(F.col("text")).alias("found"))
    for direct in (1_000_000, 20, 0):
        assert sorted(map(repr, rebuild.rebuild_found(found, direct=direct).collect())) == want
    plan = rebuild.rebuild_found(found)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan and "Join" not in plan


def test_columns_become_objects():
    column = pa.array([[["a", None], None, []], None, [["é"]]], pa.list_(pa.list_(pa.string())))
    assert objects(column) == column.to_pylist() and objects(column.slice(1)) == column.to_pylist()[1:]
    for own in (pa.array([1, None, 3]), pa.array([1, 2]), pa.array([1.5, float("inf")]), pa.array(["a", None]), pa.array([], pa.string()), pa.array([True, None])):
        assert objects(own) == own.to_pylist()


def test_letters_and_blocks_are_found_as_by_brute_force():
    import difflib

    draw = random.Random(9)
    for _ in range(3000):
        text = "".join(draw.choices(["a", "B", " ", "ß", "É", "²", "-", "€", "Σ", "İ", "3"], k=draw.randint(0, 12)))
        assert rebuild._letters(text) == "".join(c.lower() for c in text if c.isalnum())
        o, t = ("".join(draw.choices("ab -", k=draw.randint(1, 14))) for _ in range(2))
        block = difflib.SequenceMatcher(None, o, t).find_longest_match(0, len(o), 0, len(t))
        if not rebuild._letters(o) or (rebuild._letters(o) not in rebuild._letters(t) and not rebuild._spaced(o.split() or [o], t)):
            if rebuild._letters(o):
                assert rebuild.span_of(o, t) == ((block.b, block.b + block.size) if block.size / len(o) > 0.7 else None)
