import pytest
from palimpsest.operators import entities, model
from pyspark.sql import functions as F


def test_retries_wait_longer_and_longer():
    waits, calls = [], []

    def client(prompt):
        calls.append(prompt)
        if len(calls) < 4:
            raise OSError("429 too many") if len(calls) % 2 else ConnectionError("lost")
        return "fine"

    ask = model.Retrying(client, sleep=waits.append, jitter=(0, 0))
    assert ask("p") == "fine" and [w for w in waits if w] == [2.0, 2.0, 4.0]
    with pytest.raises(model.RateLimited):
        model.Retrying(lambda _: (_ for _ in ()).throw(model.RateLimited("slow")), attempts=2, sleep=waits.append)("p")
    calls.clear()
    with pytest.raises(ValueError):
        model.Retrying(lambda p: (calls.append(p), int("x"))[1], sleep=waits.append)("p")
    assert len(calls) == 1


def test_limiter_holds_to_its_window():
    now = [0.0]

    def sleep(s):
        now[0] += s

    limit = model.Limiter(requests=2, tokens=100, seconds=60, clock=lambda: now[0], sleep=sleep)
    for want in (0, 0, 60):
        limit.wait(10)
        assert now[0] == want
        limit.record(10)
    limit.wait(95)  # the request at 60 holds 10 tokens
    assert now[0] == 120
    limit.wait(1000)
    assert model.request_tokens("a b c", 10) == 13


def test_broken_extraction_replies():
    get = model.extracted_content
    assert get('{"extracted_content"  :  "a", b", "reasoning": "x') == "a"
    assert get('x "extracted_content" - : "say \\"hi\\" there", "reasoning": 1') == 'say "hi" there'
    assert get('```json\n["a", "b"]\n```') is None
    assert get('```json\n{"extracted_content": "a"}\n```') == "a"
    assert get('"extracted_content": "no end') is None


def test_columns_of_replies_are_replaced(spark):
    rows = spark.createDataFrame([("p", "old", "old", "old", 1)], "prompt string, reply string, error string, content string, k int")
    r = model.contents(model.ask(rows, lambda p: '{"extracted_content": "' + p + '"}')).first()
    assert (r.reply, r.error, r.content, r.k) == ('{"extracted_content": "p"}', None, "p", 1)


def test_spoilt_replies(spark):
    rows = [('{"replacements": [{"original": "A"}]}', False), ('{"replacements": ["A"]}', True), ('{"replacements": [{"original": "A", "placeholder": null}]}', True),
            ('{"replacements": [{"original": "Z", "placeholder": null}]}', False), ("no", False), (None, False), ('{"replacements": []}', False)]
    d = spark.createDataFrame(rows, "reply string, want boolean").withColumn("text", F.lit("an A"))
    assert all(r.got == r.want for r in d.withColumn("got", model.spoilt_reply(F.col("reply"), F.col("text"))).collect())


def test_only_maximal_texts_stay(spark):
    texts = ["2024", "May 2024", "5 May 2024", "aa", "aaa", "x.y", "x", "a b", "A B!"]
    rows = [(d, k, t, "{{P}}", "C", 0.8, "") for d in (1, 2) for k, t in enumerate(texts) if d == 1 or k != 2]
    d = spark.createDataFrame(rows, "doc_id long, seq long, original string, placeholder string, category string, confidence double, reason string")
    got = {(r.doc_id, r.original) for r in entities.maximal(entities.best_of_each(d)).collect()}
    own = {i: {r[2] for r in rows if r[0] == i} for i in (1, 2)}
    assert got == {(i, t) for i in own for t in own[i] if not any(t in o and t != o for o in own[i])}


def test_gates_lose_no_hit(spark):
    import re

    from palimpsest.functions.catalog import PATTERNS

    texts = ["£, and €,5 and $, p.a.", "5 per cent, 7percent 8%", "a@b.com", "none", ", euros USD ,", "٣/٤/٢٠٢٤ and ٥%", "Dr Ann Lee", "1-2-3"]
    found = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").select("doc_id", F.explode(entities.hits_in(F.col("text"))).alias("h")).select("doc_id", "h.category", "h.original")
    want = sorted((i, c, m[0]) for i, t in enumerate(texts) for c, _, x in PATTERNS for m in re.finditer(x, t, re.IGNORECASE))
    assert sorted(map(tuple, found.collect())) == want
