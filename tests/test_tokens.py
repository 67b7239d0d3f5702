"""Token counts against merging by brute force and against a library; chunks within their budget by that count."""

import os
import random

import pytest
from palimpsest.functions import tokens
from palimpsest.operators.chunking import chunk_documents
from pyspark.sql import functions as F

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
with_ranks = pytest.mark.skipif(not os.path.exists(RANKS), reason="needs a rank file")


def plain(piece: bytes, ranks: dict[bytes, int]) -> int:
    parts = [piece[k : k + 1] for k in range(len(piece))]
    while True:
        pairs = [(ranks[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not pairs:
            return len(parts)
        _, k = min(pairs)
        parts[k : k + 2] = [parts[k] + parts[k + 1]]


def test_merging_by_ranks():
    draw = random.Random(2)
    for _ in range(300):
        ranks = {bytes(draw.choices(b"abc", k=draw.randint(2, 4))): k for k in range(draw.randint(0, 25))}
        piece = bytes(draw.choices(b"abc", k=draw.randint(1, 30)))
        assert tokens.merged(piece, ranks) == plain(piece, ranks)
    assert tokens.merged(b"a" * 20_000, {b"aa": 0, b"aaaa": 1}) == 5000


@with_ranks
def test_counts_equal_the_library(spark):
    tiktoken = pytest.importorskip("tiktoken")
    own = tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=tokens.ranks_of(RANKS), special_tokens={})
    texts = ["", " ", "Don't we'll  stop\n\n  now", "é日本語𐍈" * 20, "x" * 3000, "12 345,67 € — \t\r\n", "the quick brown fox " * 40]
    docs = spark.createDataFrame([*enumerate(texts), (99, None)], "doc_id long, text string")
    got = {r.doc_id: r.tokens for r in tokens.counted(docs, tokens.Counter(RANKS)).collect()}
    assert got == {k: len(own.encode_ordinary(t)) for k, t in enumerate(texts)} | {99: None}


@with_ranks
def test_chunks_keep_their_budget_by_that_count(spark):
    docs = spark.range(3).select(F.col("id").alias("doc_id"), F.concat(F.repeat(F.lit("Ein etwas längerer Satz, unvorhergesehen. "), 400), F.col("id").cast("string")).alias("text"))
    count = tokens.Counter(RANKS)
    rows = chunk_documents(docs, "medium", count=count).collect()
    assert len(rows) > 15 and all(r.token_count <= 548 for r in rows)
    assert all(abs(count(r.text) - r.token_count) <= r.text.count(".") for r in rows)
