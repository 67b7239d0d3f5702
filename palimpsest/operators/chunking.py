"""Token-bounded chunks of a text: sentences packed in order, words where a sentence is too long.

A text is walked where it lies, in Python over Arrow batches, without a shuffle.

For texts too large for that there is a form in rows. Sentences are rows then: a walk
over their numbers of tokens only says which of them begin a chunk, a window gives each
sentence the last chunk that has begun, and sentences meet again by document and chunk.
"""

from __future__ import annotations

import re

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions.catalog import CHUNK_TOKENS, PROMPT_TOKENS
from palimpsest.sources.shared import stored

_BREAK = re.compile(r"(?<=[.!?])\s+|\n\n+")
SCHEMA = "doc_id long, chunk_index int, text string, start_position int, end_position int, token_count int"


def estimate(text: str) -> int:
    return int(len(text.split()) * 1.3)


def always_whole(size: str = "max") -> int:
    """Characters up to which a text is one chunk by the estimate whatever its words are, as no two of them touch."""
    return 2 * int((CHUNK_TOKENS.get(size, CHUNK_TOKENS["max"]) - PROMPT_TOKENS) / 1.3) - 1


class _Packer:
    """Collects pieces into chunks; positions advance by each piece's length and one."""

    def __init__(self, limit: int, count):
        self.limit, self.count = limit, count
        self.chunks: list[tuple[str, int, int, int]] = []
        self.pending: list[str] = []
        self.tokens = self.start = self.at = 0

    def flush(self) -> None:
        self.chunks.append((" ".join(self.pending), self.start, self.at, self.tokens))
        self.pending, self.tokens, self.start = [], 0, self.at

    def words(self, text: str) -> None:
        """Words packed from here on. A first word above the limit gives an empty chunk before it."""
        inner = _Packer(self.limit, self.count)
        inner.start = inner.at = self.at
        for word in text.split():
            n = self.count(word)
            if inner.tokens + n > self.limit:
                inner.flush()
            inner.pending.append(word)
            inner.tokens += n
            inner.at += len(word) + 1
        if inner.pending:
            inner.flush()
        self.chunks += inner.chunks

    def sentence(self, text: str) -> None:
        n = self.count(text)
        if n > self.limit:
            if self.pending:
                self.flush()
            self.words(text)
            self.at += len(text) + 1
            self.start = self.at
            return
        if self.tokens + n > self.limit and self.pending:
            self.flush()
        elif not self.pending:
            self.start = self.at
        self.pending.append(text)
        self.tokens += n
        self.at += len(text) + 1


def chunk_text(text: str | None, size: str = "max", preserve_sentences: bool = True, overlap: int = 0, count=estimate) -> list[tuple[str, int, int, int]]:
    """(text, start, end, tokens) of each chunk of a text; blank texts have none."""
    if not text or not text.strip():
        return []
    limit = CHUNK_TOKENS.get(size, CHUNK_TOKENS["max"]) - PROMPT_TOKENS
    if (n := count(text)) <= limit:
        return [(text, 0, len(text), n)]
    packer = _Packer(limit, count)
    if preserve_sentences:
        for part in _BREAK.split(text):
            if part := part.strip():
                packer.sentence(part)
        if packer.pending:
            packer.flush()
    else:
        packer.words(text)
    return overlapped(packer.chunks, overlap, count) if overlap else packer.chunks


def overlapped(chunks: list[tuple[str, int, int, int]], tokens: int, count=estimate) -> list[tuple[str, int, int, int]]:
    """Each chunk but the first with the last words of the chunk before it."""
    words, out = max(1, int(tokens / 1.3)), chunks[:1]
    for before, (text, start, end, _) in zip(chunks, chunks[1:]):
        joined = " ".join(before[0].split()[-words:]) + " " + text
        out.append((joined, start, end, count(joined)))
    return out


# White space as Python has it, and all else. Words are named by the ranges that they hold, as the engine tests
# a class that is the opposite of another seven times slower.
_BLANKS = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_OTHERS = r"\x21-\x84\x00-\x08\x0e-\x1b\x86-\x9f\xa1-\u167f\u1681-\u1fff\u200b-\u2027\u202a-\u202e\u2030-\u205e\u2060-\u2fff\u3001-\x{10ffff}"
_SPACE, _WORD = f"[{_BLANKS}]", f"[{_OTHERS}]"
_TRIMMED = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"{_WORD}+"), F.lit(0))


def _tokens(words: Column) -> Column:
    """The estimate of so many words."""
    return F.floor(words * F.lit(1.3)).cast("int")


def chunk_documents(docs: DataFrame, size: str = "max", preserve_sentences: bool = True, overlap: int = 0, count: Callable[[str], int] | None = None, in_rows: bool = False) -> DataFrame:
    """The chunks of every document (doc_id, text); blank texts have none, repeated rows have theirs each, numbered alike.

    ``count`` counts the tokens of a text; without it words times 1.3 are. ``in_rows`` makes rows of sentences, for texts
    whose walk one task should not make alone; for ordinary ones it takes several times as long.
    """
    if count is not None or not in_rows:
        return _walked(docs, size, preserve_sentences, overlap, count or estimate)
    limit = CHUNK_TOKENS.get(size, CHUNK_TOKENS["max"]) - PROMPT_TOKENS
    own = docs.select("doc_id", "text").filter(F.rlike("text", F.lit(_WORD))).withColumn("n", _tokens(F.size(_words(F.col("text")))))
    whole = own.filter(F.col("n") <= limit).select("doc_id", F.lit(0).alias("chunk_index"), "text", F.lit(0).alias("start_position"), F.length("text").alias("end_position"), F.col("n").alias("token_count"))
    long = own.filter(F.col("n") > limit)
    base = _packed(long, limit) if preserve_sentences else _cut(long.groupBy("doc_id", F.xxhash64("text").alias("h")).agg(F.first("text").alias("t"), F.count("*").alias("copies"), F.lit(0).alias("ord"), F.lit(0).cast("long").alias("place")), limit)
    line = W.partitionBy("doc_id", "h").orderBy("ord", "piece")
    base = base.withColumn("chunk_index", F.row_number().over(line) - 1)
    if overlap:
        last = F.slice(F.reverse(_words(F.col("_before"))), 1, max(1, int(overlap / 1.3)))
        base = base.withColumn("_before", F.lag("text").over(line)).withColumn("_last", F.reverse(last))
        # The words of a joined text are those of its parts.
        base = base.withColumn("token_count", F.when(F.col("_last").isNull(), F.col("token_count")).otherwise(_tokens(F.size("_last") + F.col("words"))))
        base = base.withColumn("text", F.when(F.col("_last").isNull(), F.col("text")).otherwise(F.concat(F.array_join("_last", " "), F.lit(" "), F.col("text"))))
    each = base.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return whole.unionByName(each.select("doc_id", "chunk_index", "text", *[F.col(c).cast("int").alias(c) for c in ("start_position", "end_position", "token_count")]))


def _packed(long: DataFrame, limit: int) -> DataFrame:
    """Chunks (doc_id, h, ord, piece, text, start_position, end_position, token_count, words, copies) of texts above the limit.

    Sentences are stored, as their numbers are walked first and their texts meet the chunks after.
    """
    # The text is left behind before its sentences are rows: neither read nor carried by each of them.
    split = long.select("doc_id", F.xxhash64("text").alias("h"), F.split("text", rf"(?<=[.!?]){_SPACE}+|\n\n+").alias("split"))
    parts = split.select("doc_id", "h", F.posexplode("split").alias("k", "t"))
    parts = parts.withColumn("t", F.btrim("t", F.lit(_TRIMMED))).filter("t <> ''").repartition("doc_id", "h")
    # Equal rows of one id share their sentences.
    parts = parts.groupBy("doc_id", "h", "k").agg(F.first("t").alias("t"), F.count("*").alias("copies"))
    line = W.partitionBy("doc_id", "h").orderBy("k")
    parts = parts.withColumn("words", F.size(_words(F.col("t"))))
    parts = parts.select(
        "doc_id", "h", "t", "words", _tokens(F.col("words")).alias("n"), "copies",
        (F.row_number().over(line) - 1).alias("i"),
        (F.sum(F.length("t") + 1).over(line) - F.length("t") - 1).alias("place"),
    )
    parts = stored(parts, "sentences")
    # The sentences that begin a chunk: a walk over whole numbers. After one above the limit nothing is open.
    state = F.struct(F.lit(-1).alias("open"), F.array().cast("array<int>").alias("starts"))

    def step(a: Column, x: Column) -> Column:
        fits = (a["open"] >= 0) & (a["open"] + x["n"] <= limit)
        left = F.when(fits, a["open"] + x["n"]).when(x["n"] > limit, F.lit(-1)).otherwise(x["n"])
        return F.struct(left.alias("open"), F.when(fits, a["starts"]).otherwise(F.array_append(a["starts"], x["i"])).alias("starts"))

    walked = parts.groupBy("doc_id", "h").agg(F.sort_array(F.collect_list(F.struct("i", "n"))).alias("line"))
    starts = walked.select("doc_id", "h", F.posexplode(F.aggregate("line", state, step)["starts"]).alias("ord", "i"))
    # A sentence is of the last chunk that has begun.
    begun = W.partitionBy("doc_id", "h").orderBy("i", F.col("ord").isNull()).rowsBetween(W.unboundedPreceding, 0)
    placed = parts.unionByName(starts, allowMissingColumns=True).withColumn("ord", F.last("ord", ignorenulls=True).over(begun)).filter("t is not null")

    packed = placed.filter(F.col("n") <= limit).groupBy("doc_id", "h", "ord").agg(
        F.array_join(F.sort_array(F.collect_list(F.struct("i", "t")))["t"], " ").alias("text"),
        F.min("place").alias("start_position"), F.max(F.col("place") + F.length("t") + 1).alias("end_position"), F.sum("n").alias("token_count"), F.sum("words").alias("words"), F.max("copies").alias("copies"),
    )
    return packed.withColumn("piece", F.lit(0)).unionByName(_cut(placed.filter(F.col("n") > limit).select("doc_id", "h", "ord", "t", "place", "copies"), limit))


def _cut(texts: DataFrame, limit: int) -> DataFrame:
    """Chunks of as many words as there are tokens, as a word alone counts one; with no room at all each word is one, and an empty one comes first."""
    rows = texts.withColumn("w", _words(F.col("t")))
    step = max(1, limit)
    starts = F.sequence(F.lit(0), F.size("w") - 1, F.lit(step))
    if limit < 1:
        starts = F.concat(F.array(F.lit(-1)), starts)
    total = lambda x: F.aggregate(x, F.lit(0), lambda a, y: a + y)
    rows = rows.select("doc_id", "h", "ord", "place", "copies", F.posexplode(F.transform(starts, lambda k: F.when(k < 0, F.array().cast("array<string>")).otherwise(F.slice("w", k + 1, F.lit(step))))).alias("piece", "own"))
    line = W.partitionBy("doc_id", "h", "ord").orderBy("piece")
    length = total(F.transform("own", lambda x: F.length(x) + 1))
    ends = F.col("place") + F.sum(length).over(line)
    return rows.select("doc_id", "h", "ord", "piece", F.array_join("own", " ").alias("text"), (ends - length).alias("start_position"), ends.alias("end_position"), F.size("own").cast("long").alias("token_count"), F.size("own").cast("long").alias("words"), "copies")


def _walked(docs: DataFrame, size: str, preserve_sentences: bool, overlap: int, count: Callable[[str], int]) -> DataFrame:
    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                rows = [
                    (d, k, *c)
                    for d, t in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist())
                    for k, c in enumerate(chunk_text(t, size, preserve_sentences, overlap, count))
                ]
                kinds = (pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32())
                columns = list(zip(*rows)) or [[]] * 6
                yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds)], names=["doc_id", "chunk_index", "text", "start_position", "end_position", "token_count"])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
