"""Calls in lanes: each prompt once, the whole at its rate, windows of calls in order."""

import time
from pathlib import Path

import pytest
from palimpsest.operators import classify, entities, lanes, model
from pyspark.sql import functions as F


def counting(folder: Path):
    """A client that leaves a file for each call, with its time; prompts of 3 fail."""

    def client(prompt: str) -> str:
        (folder / f"{time.time_ns()}-{prompt}").touch()
        if prompt == "3":
            raise ValueError("three")
        return f"<{prompt}>"

    return client


def test_each_distinct_prompt_is_asked_once(spark, tmp_path):
    calls, store = tmp_path / "calls", str(tmp_path / "store")
    calls.mkdir()
    rows = spark.range(400).select("id", F.when(F.col("id") % 8 < 7, (F.col("id") % 8).cast("string")).alias("prompt"), F.lit("old").alias("reply"))
    ask = lambda **more: lanes.answered(rows.repartition(8), counting(calls), lanes=3, **more)
    found = ask(store=store)
    for _ in range(2):  # reading twice asks nobody
        got = {(r.prompt, r.reply, r.error) for r in found.collect()}
        assert got == {(str(k), f"<{k}>", None) for k in range(7) if k != 3} | {("3", None, "three"), (None, None, None)}
    assert found.count() == 400 and len(list(calls.iterdir())) == 7
    assert ask(store=store, wave=2).count() == 400
    assert len(list(calls.iterdir())) == 8  # only the failed one again
    assert ask(wave=2).filter("reply is not null").count() == 300 and len(list(calls.iterdir())) == 15


def test_no_prompt_is_no_call(spark):
    none = spark.createDataFrame([(1, None)], "id long, prompt string")
    assert [tuple(r) for r in lanes.answered(none, str.upper).collect()] == [(1, None, None, None)]
    assert lanes.answered(none.limit(0), str.upper).count() == 0


@pytest.mark.parametrize("count", [1, 2])
def test_tasks_hold_the_limit_together(spark, tmp_path, count):
    calls = tmp_path / "calls"
    calls.mkdir()
    rows = spark.range(8).select(F.col("id").cast("string").alias("prompt")).repartition(8)
    limit = model.Limiter(requests=2, tokens=1_000_000, seconds=2.0)
    assert lanes.answered(rows, counting(calls), lanes=count, allowance=limit, wave=3).count() == 8
    at = sorted(int(p.name.split("-")[0]) / 1e9 for p in calls.iterdir())
    # A call begins a moment after the limiter lets it go.
    assert len(at) == 8 and all(b - a > 1.8 for a, b in zip(at, at[2:]))


def test_calls_in_flight_keep_order_and_bound():
    drawn, done = [], []

    def items():
        for k in range(20):
            drawn.append(k)
            yield k

    def call(k: int) -> int:
        time.sleep(0.05 if k % 3 else 0.15)
        if k == 7:
            raise KeyError(k)
        return -k

    began = time.time()
    for item, result, error in lanes.in_order(items(), call, 5):
        assert len(drawn) - len(done) <= 6
        assert (result, type(error)) == ((None, KeyError) if item == 7 else (-item, type(None)))
        done.append(item)
    assert done == list(range(20)) and time.time() - began < 1.2  # one after the other they take 1.7 s


def test_limiter_of_a_process_counts_calls_of_others_once():
    now = [100.0]
    limit = model.Limiter(requests=3, tokens=1000, seconds=60, clock=lambda: now[0], sleep=lambda s: now.__setitem__(0, now[0] + s))
    limit.remember({"a": (50, 1), "b": (10, 1)})
    limit.remember({"a": (50, 1), "b": (10, 1)})
    limit.wait(1)
    limit.wait(1)  # when a leaves the window
    assert now[0] == 110
    share = limit.share(2)
    assert (share.requests, share.tokens, share.name) == (1, 500, limit.name)
    share.spend()
    share.wait(1)
    assert now[0] == 170


def test_a_bad_pattern_leaves_the_others(spark):
    patterns = [("DATE", "{{DATE}}", r"\d{4}"), ("BAD", "{{BAD}}", "(open"), ("EMAIL", "{{EMAIL}}", r"\w+@\w+")]
    docs = spark.createDataFrame([(1, "in 2024 a@b"), (2, None)], "doc_id long, text string")
    good, bad = entities.usable_patterns(spark, patterns)
    assert [x[0] for x in good] == [0, 2] and [x[:2] for x in bad] == [("BAD", "(open")]
    got = classify.classify_or_patterns(docs, "{text_chunk}", patterns=patterns).collect()
    assert {(r.original, r.seq) for r in got} == {("2024", 0), ("a@b", 2_000_000_000)} and all(r.status.startswith("classified; pattern of BAD skipped: ") for r in got)
    assert classify.classify_or_patterns(docs, "{text_chunk}", patterns=patterns[1:2]).count() == 0


def test_a_failing_run_gives_the_patterns(spark):
    docs = spark.createDataFrame([(1, "2024 and 2024")], "doc_id long, text string")
    failing = entities.detect(docs).withColumn("reason", F.raise_error(F.lit("broken")).cast("string"))
    got = classify.classify_or_patterns(docs, "{text_chunk}", patterns=[("DATE", "{{DATE}}", r"\d{4}")], paragraphs=failing).collect()
    assert [(r.original, r.ord) for r in got] == [("2024", 1), ("2024", 2)] and got[0].status.startswith("patterns only: ")


def test_names_of_many_words_end(spark):
    import re

    from palimpsest.functions.catalog import PATTERNS

    pattern = next(x for c, _, x in PATTERNS if c == "CUSTOMER_NAME")
    texts = ["Mr Ann Lee9 x", "Mr Ann Lee Bo_", "mr ann lee é", "Mrs. A Bb", "Dr  Ann\nLee Poé", "Ms Ann Lee", "Mr " + "Aa " * 20_000 + "9", "Miss Ann Lee1 Bo"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted((r.doc_id, r.original) for r in entities.detect(d).filter("category = 'CUSTOMER_NAME'").collect())
    assert got == sorted((k, m[0]) for k, t in enumerate(texts) for m in re.finditer(pattern, t, re.IGNORECASE))


def test_a_large_document_meets_in_a_join(spark):
    """Both ways to find maximal texts agree, and the texts of one document lie in many tasks."""
    import random

    draw = random.Random(3)
    rows = [(d, k, "".join(draw.choices("ab c.é", k=draw.choice([1, 2, 3, 4, 6, 9, 14]))), "{{P}}", "C", 0.8, "") for d in (1, 2) for k in range(300)]
    d = entities.best_of_each(spark.createDataFrame(rows, "doc_id long, seq long, original string, placeholder string, category string, confidence double, reason string"))
    d = d.filter("original <> ''")
    get = lambda x: sorted((r.doc_id, r.original, r.seq) for r in x.collect())
    own = {i: {r.original for r in d.filter(F.col("doc_id") == i).collect()} for i in (1, 2)}
    want = {(i, t) for i in own for t in own[i] if not any(t in o and t != o for o in own[i])}
    direct = get(entities.maximal(d))
    assert {x[:2] for x in direct} == want
    assert get(entities.maximal(d, in_row=0)) == direct
    many = spark.range(100_000).select(F.lit(1).alias("doc_id"), F.concat(F.lit("number "), F.col("id").cast("string"), F.lit(" of many")).alias("original"))
    spread = entities.inside_others(many.unionByName(many.limit(50).select("doc_id", F.substring("original", 1, 9).alias("original"))))
    assert 10 <= spread.count() <= 50


def test_each_wave_reads_only_its_prompts(spark):
    """Waves lie in folders of their own that hold each prompt once, so many waves read no more than one."""
    import glob

    from palimpsest.sources.shared import shared_dir

    before = set(glob.glob(f"{shared_dir(spark)}/waves-*"))
    prompts = spark.createDataFrame([(f"p{k % 50}",) for k in range(100)], "prompt string")
    got = lanes.answered(prompts, str.upper, lanes=2, wave=7).collect()
    assert sorted((r.prompt, r.reply) for r in got) == sorted((f"p{k % 50}", f"P{k % 50}") for k in range(100))
    (made,) = set(glob.glob(f"{shared_dir(spark)}/waves-*")) - before
    assert len(glob.glob(f"{made}/turn=*")) > 1 and spark.read.parquet(made).count() == 50


def test_quick_calls_need_no_thread():
    import threading

    here, seen = threading.get_ident(), []

    def call(k: int) -> int:
        seen.append(threading.get_ident() == here)
        if k % 100 == 50:
            raise KeyError(k)
        return -k

    got = list(lanes.in_order(range(1000), call, 3))
    assert [(i, r) for i, r, e in got] == [(k, None if k % 100 == 50 else -k) for k in range(1000)] and sum(isinstance(e, KeyError) for *_, e in got) == 10
    assert sum(seen) > 500
