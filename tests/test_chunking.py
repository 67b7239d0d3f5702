from palimpsest.operators.chunking import chunk_text, estimate, overlapped


def test_blank_and_fitting():
    assert chunk_text("  \n ") == [] and chunk_text(None) == []
    assert chunk_text(" a b ") == [(" a b ", 0, 5, 2)]


def test_sentences_are_packed_whole():
    s = "word " * 99 + "end."
    text = " ".join([s] * 12)
    chunks = chunk_text(text, "medium")
    assert len(chunks) == 3 and all(t <= 548 for *_, t in chunks)
    assert " ".join(c[0] for c in chunks) == text
    assert [c[1] for c in chunks[1:]] == [c[2] for c in chunks[:-1]]


def test_oversized_sentence_is_split_by_words():
    text = "Short one. " + "x " * 1000 + ". Short two."
    chunks = chunk_text(text, "medium")
    assert " ".join(c[0] for c in chunks).split() == text.split()
    assert all(t <= 548 for *_, t in chunks)


def test_small_is_degenerate():
    chunks = chunk_text("one two three", "small")
    assert [c[0] for c in chunks] == ["", "one", "two", "three"]


def test_overlap_takes_the_words_before():
    out = overlapped([("a b c", 0, 5, 3), ("d e", 6, 9, 2)], 2)
    assert out[1][0] == "c d e" and out[1][3] == estimate("c d e")


def test_rows_give_the_chunks_of_the_walk(spark):
    """The form in rows and the plain walk agree, for every size, with overlap, long sentences and odd white space."""
    import random

    from palimpsest.operators.chunking import chunk_documents

    draw = random.Random(4)
    word = lambda: "".join(draw.choices("abéß日x1", k=draw.randint(1, 7)))
    texts = [None, "", " \n  ", "one", " kept as it is. \x1c", "x " * 900, "日本 " * 600 + ". End!"]
    for _ in range(12):
        sentences = [" ".join(word() for _ in range(draw.choice([1, 3, 12, 40, 90] if k % 9 else [700]))) + draw.choice([".", "!", "?", ""]) for k in range(draw.randint(1, 60))]
        texts.append("".join(x + draw.choice([" ", "  ", "\n", "\n\n", "\n\n\n ", " ", "\x1d "]) for x in sentences))
    rows = [(k, t) for k, t in enumerate(texts)] + [(9, texts[9]), (9, texts[10])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for size, preserve, overlap in (("medium", True, 0), ("medium", True, 100), ("small", True, 0), ("medium", False, 0), ("medium", False, 7), ("max", True, 3), ("other", True, 0)):
        got = chunk_documents(docs, size, preserve, overlap, in_rows=True)
        assert "Python" not in (plan := got._jdf.queryExecution().toString()) and "InArrow" not in plan
        want = sorted((d, k, *c) for d, t in rows for k, c in enumerate(chunk_text(t, size, preserve, overlap)))
        have = sorted(map(tuple, got.collect()))
        assert len(have) == len(want) and [(a, b) for a, b in zip(have, want) if a != b][:1] == [], (size, preserve, overlap)
        assert size != "medium" or sorted(map(tuple, chunk_documents(docs, size, preserve, overlap).collect())) == want
    by_letters = chunk_documents(docs, "medium", count=len)
    assert sorted(map(tuple, by_letters.collect())) == sorted((d, k, *c) for d, t in rows for k, c in enumerate(chunk_text(t, "medium", count=len)))


def test_rows_of_many_sentences_and_null_ids(spark):
    """A text of many sentences, a row without an id and one repeated give the chunks of the walk."""
    from palimpsest.operators.chunking import chunk_documents

    texts = [(1, " ".join(f"w{k} x." for k in range(20_000))), (None, "one two three. " * 400), (2, "\u3000" + "a b. " * 700), (2, "\u3000" + "a b. " * 700)]
    got = chunk_documents(spark.createDataFrame(texts, "doc_id long, text string"), "medium", overlap=100, in_rows=True)
    want = [(d, k, *c) for d, t in texts for k, c in enumerate(chunk_text(t, "medium", overlap=100))]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_white_space_and_words_are_all_characters():
    """Each character is white space or of a word, as Python splits a text."""
    import re

    from palimpsest.operators.chunking import _BLANKS, _OTHERS, _TRIMMED

    blank, other = re.compile(f"[{_BLANKS}]"), re.compile(f"[{_OTHERS}]".replace(r"\x{10ffff}", r"\U0010ffff"))
    for c in map(chr, range(0x110000)):
        assert bool(blank.match(c)) == c.isspace() == (c in _TRIMMED) != bool(other.match(c))
