import random

from palimpsest.operators import chunking, classify, entities, model
from pyspark.sql import functions as F


def test_documents_are_read_once(spark):
    """One reading, one call to Python and one deal to all tasks give what patterns and reconciling alone give, on repeated, null, blank and long documents."""
    draw = random.Random(5)
    bits = ["3%", "4.5 PerCent", "a@b.com", "A@B.com", "12 per cent", ". ", "\n\n", " ", "word ", "é ", "{{X}}", "x@y.de ", "7 % "]
    rows = [(None, "5% null id"), (None, "65% null id"), (1, None), (2, ""), (3, " \n "), (4, "3%"), (4, "3% and 4%"), (4, None), (5, "w " * 6000 + "3%. x@y.com " + "v " * 3000)]
    rows += [(10 + k, "".join(draw.choices(bits, k=draw.choice([1, 3, 40, 9000 if k % 25 == 0 else 20])))) for k in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    get = lambda d: sorted(map(repr, d.select("doc_id", "original", "placeholder", "category", "confidence", "ord").collect()))
    made = classify.classify(docs, "{text_chunk}")
    plain = entities.longest_first(entities.maximal(entities.best_of_each(entities.detect(docs))))
    assert get(made) == get(plain) and len(get(plain)) > 100
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Union" not in plan and plan.count("LogicalRDD") + plan.count("LocalRelation") == 1
    assert "RepartitionByExpression [doc_id#" in plan and ", 4\n" in plan[plan.index("RepartitionByExpression"):]


def test_short_texts_are_one_chunk():
    """No text within the bound is cut, however many words it has; some beyond it is."""
    for size in ("max", "medium", "small"):
        n = chunking.always_whole(size)
        for text in ("a " * 10_000)[: max(n, 0)], ("a" * 20_000)[: max(n, 0)]:
            assert [c[0] for c in chunking.chunk_text(text, size)] in ([text], [])
        assert n < 0 or len(chunking.chunk_text("a. " * n, size)) > 1


def test_replies_of_every_sort_are_told_apart(spark):
    """The reply that finds nothing is known as it is; one near it is parsed, one with an error or of a failed call is not good."""
    replies = [model.NOTHING, " " + model.NOTHING, "```json\n" + model.NOTHING + "\n```", 'x {"replacements": []} y', '{"error": 1, "replacements": []}', "no json", None, '{"replacements": [1]}', "``` {", '{"a": 1}']
    rows = [(k, "text", r, None) for k, r in enumerate(replies)] + [(99, "text", model.NOTHING, "failed")]
    got = model.good_replacements(spark.createDataFrame(rows, "k int, text string, reply string, error string"), "found")
    assert {r.k for r in got.filter(F.size("found") == 0).collect()} == {0, 1, 2, 3, 9}
    assert {r.k for r in got.filter("found is null").collect()} == {4, 5, 6, 7, 8, 99}


def test_lists_without_equal_keys_are_not_sorted_by_them(spark):
    lists = spark.createDataFrame([(1, [(0, "Ann"), (1, " ann "), (2, "Anna Lee")]), (2, [(3, "b"), (1, "ab"), (0, "cc")]), (3, [(7, "x")]), (4, [])], "doc_id int, hits array<struct<seq:long,original:string>>")
    lists = lists.withColumn("hits", F.transform("hits", lambda h: h.withField("confidence", F.lit(0.8))))
    got = {r.doc_id: [(h.original, h.group_seq) for h in r.hits] for r in entities.distinct_maximal_lists(lists).collect()}
    assert got == {1: [("Anna Lee", 2)], 2: [("cc", 0), ("ab", 1)], 3: [("x", 7)], 4: []}
