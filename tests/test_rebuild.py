from palimpsest.operators.model import extracted_content
from palimpsest.operators.rebuild import rebuild, replace_in, sequence_at


def test_cascade():
    assert replace_in(["say John Smith twice: John Smith", "John Smith"], "John Smith", "X") == ["say X twice: X", "John Smith"]
    assert replace_in(["from Jo", "hn  Sm", "ith on"], "John Smith", "X") == ["from X", "", " on"]
    assert replace_in(["Ref: A-B.C 12!"], "abc12", "X") == ["Ref: X!"]
    assert replace_in(["nothing here"], "John", "X") is None
    assert replace_in(["$1 cost"], "$1", r"\g<0>") == [r"\g<0> cost"]


def test_sequence():
    assert sequence_at("one line\n\nsecond  line", ["zero", "has one line in", "second line", "x"]) == (1, 2)
    assert sequence_at("one line", ["one line"]) is None
    rows = [("body", 0, k, [t]) for k, t in enumerate(["alpha", "beta", "gamma"])]
    runs, applied, failed = rebuild(rows, [("alpha\nbeta", "{{P}}"), ("missing text", "{{M}}")])
    assert runs == [["{{P}}"], [""], ["gamma"]] and applied == 1 and failed == ["missing text"]


def test_longest_first():
    runs, applied, _ = rebuild([("body", 0, 0, ["5 May 2024 and 2024"])], [("2024", "{{Y}}"), ("5 May 2024", "{{D}}")])
    assert runs == [["{{D}} and {{Y}}"]] and applied == 2


def test_extraction_replies():
    assert extracted_content('```json\n{"extracted_content": "a"}\n```') == "a"
    assert extracted_content('["a", "b"]') == "a\n\nb"
    assert extracted_content("[]") == "[]"
    assert extracted_content('{"other": 1}') is None
    assert extracted_content('noise "extracted_content": "a \\"b\\"\\n" and {broken') == 'a "b"\n'
    assert extracted_content(None) is None


def test_pairs_found_by_seeds_lose_no_match(spark):
    """The fold over seeded pairs gives what the fold over all pairs gives, whichever way an original matches."""
    import random

    from palimpsest.operators.rebuild import candidate_pairs, rebuild_documents

    draw = random.Random(5)
    words = "account balance of the client Márton Nagy was paid on 12 May 2024 by card No. 4411-22".split(" ")
    paragraphs, given = [], []
    for doc in range(12):
        texts = [" ".join(draw.choices(words, k=draw.randint(0, 14))) for _ in range(15)]
        for k, t in enumerate(texts):
            cut = draw.randint(0, len(t))
            paragraphs.append((doc, draw.choice(["body", "cell", "footer"]), k % 3, k, [t[:cut], t[cut:]]))
        for k in range(14):
            t = draw.choice(texts)
            a = draw.randint(0, max(0, len(t) - 20))
            o = t[a : a + draw.randint(1, 45)]
            o = [o, o.replace(" ", "  \n "), o.upper().replace(" ", "-"), o + "zz", "Q" + o[1:] + "?", t + "\n" + draw.choice(texts), "DATE", "", "..."][k % 9]
            given.append((doc, k, o, "{{DATE}}" if k % 2 else "{{" + "X" * k + "}}"))
    p = spark.createDataFrame(paragraphs, "doc_id long, part string, grp int, seq int, runs array<string>")
    r = spark.createDataFrame(given, "doc_id long, ord int, original string, placeholder string")
    rows = lambda d: sorted((x.doc_id, x.part, x.grp, x.seq, x.text, x.applied, x.failed) for x in d.collect())
    want = rows(rebuild_documents(p, r))
    assert rows(rebuild_documents(p, r, direct=0)) == want and any(x[5] > 3 for x in want)
    pairs = candidate_pairs(p, r).filter("seeded").collect()
    assert pairs and sum(len(x.near) for x in pairs) < 0.5 * 15 * len(pairs)


def test_nothing_of_a_document_is_broadcast(spark):
    from palimpsest.operators.rebuild import rebuild_documents

    p = spark.createDataFrame([(1, "body", 0, 0, ["the balance ", "of account 7"]), (2, "body", 0, 0, ["none"])], "doc_id long, part string, grp int, seq int, runs array<string>")
    r = spark.createDataFrame([(1, 0, "Balance-of-account", "{{B}}")], "doc_id long, ord int, original string, placeholder string")
    for direct in (0, 1_000_000):
        made = rebuild_documents(p, r, direct=direct)
        assert sorted((x.doc_id, x.text, x.applied) for x in made.collect()) == [(1, "the {{B}} 7", 1), (2, "none", 0)]
        assert "Broadcast" not in made._jdf.queryExecution().executedPlan().toString()


def test_documents_are_made_once(spark):
    """What paragraphs and replacements are made of is stored as one row a document: the fold's plan joins and groups nothing."""
    from palimpsest.operators.rebuild import rebuild_documents

    p = spark.createDataFrame([(1, "body", 0, 0, ["Ann ", "Lee"]), (1, "body", 0, 1, ["x"]), (2, "body", 0, 0, ["Bo"])], "doc_id long, part string, grp int, seq int, runs array<string>")
    lists = spark.createDataFrame([(1, [(1, "Ann Lee", "{{N}}"), (2, "Zoe", "{{Z}}")])], "doc_id long, given array<struct<ord:int,original:string,placeholder:string>>")
    made = rebuild_documents(p, lists)
    assert sorted((r.doc_id, r.seq, r.text, r.applied, r.failed) for r in made.collect()) == [(1, 0, "{{N}}", 1, ["Zoe"]), (1, 1, "x", 1, ["Zoe"]), (2, 0, "Bo", 0, [])]
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan


def test_words_meet_white_space_as_the_pattern_says():
    import random
    import re

    from palimpsest.operators.rebuild import _spaced

    draw = random.Random(5)
    for _ in range(3000):
        text = "".join(draw.choices(["a", "b", " ", "\t", "\x1c", "\xa0", "ab"], k=draw.randint(0, 12)))
        words = ["".join(draw.choices("ab", k=draw.randint(1, 2))) for _ in range(draw.randint(1, 3))]
        m = re.search(r"\s*".join(map(re.escape, words)), text)
        assert _spaced(words, text) == (m.span() if m else None)
