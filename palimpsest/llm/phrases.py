"""Phrase collocation mining with vertical positional inverted lists.

Texts are cut at piece ends and become blocks of word numbers, each block of one
language. A phrase's list is the sorted positions at which it begins. A frequent
phrase of k words is extended by merging its positions with those of its
successors: where frequent phrases of k words begin at s and at s + 1, the phrase
of k + 1 words at s is a candidate, made of the first phrase and the posting of
the word at s + k. The length of a list, summed over the blocks, is the exact
frequency.

1. ``blocks``: texts to blocks, at most ``block_words`` words each; a longer piece
   is cut, and the next words, up to three, are repeated behind the cut as
   positions that start phrases but are not counted.
2. Of every level, each block sends its distinct phrases as (phrase of one word
   less, last word, length of its list), numbers throughout. One window by phrase
   sums the lengths and names the phrase by one of its places; frequent phrases
   go back to the blocks that have them.
3. Scores, the test against longer candidates and the first 2,000 of each
   language are joins and windows over the frequent phrases.

Nothing is broadcast or collected. A block holds one key of a phrase, so the rows
of one phrase are as many as the blocks that have it. Blocks and levels are
Parquet tables in the checkpoint folder, deleted when the next is written; the
last, the frequent phrases, stay for the caller.

Defined cases: a null text counts as empty, a null language as ``und``; repeated
rows count as often as they stand; a phrase never crosses a piece end or a
document; ties go to more occurrences, then to the phrase in byte order; an empty
table, or one without a frequent phrase, gives an empty result; other columns,
doc_id too, are ignored.
"""

from __future__ import annotations

import uuid
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.llm.common import checkpoint_dir, delete

LONGEST = 4
#: Bits of a place for the number of a phrase in its block and of a block in its task; the task has the rest.
_PHRASE_BITS, _BLOCK_BITS = 22, 21
#: Phrases in a row of a block's list.
_CHUNK = 1 << 15
#: Row groups of tables of blocks, whose rows are wide: what a task holds at once.
_WIDE = {"parquet.block.size": 1 << 24, "parquet.block.row.count.limit": 64, "parquet.page.size.row.check.min": 1}
# A block is a row of its own (chunk -1) and rows of its list of phrases; the list of words is that of the first level.
_BLOCK = "block long, lang string, chunk int, size int, seq binary, tail binary, words array<string>, n array<long>"
_LEVEL = "block long, lang string, chunk int, size int, w binary, wid binary, tail binary, loc binary, left array<long>, right array<long>, n array<long>"

# What ends a piece, as bytes; a tab is a space.
_ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
_CUT = bytes.maketrans(_ENDS + b"\t", b"\n" * len(_ENDS) + b" ")


class _Numbers(dict):
    """Numbers words as they are first asked for."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


class _Builder:
    """The block of one language that is being filled."""

    def __init__(self):
        self.number = _Numbers()
        self.seq, self.tail = array("i"), array("i")

    def add(self, words: list[bytes], own: int) -> None:
        start = len(self.seq)
        self.seq.extend(map(self.number.__getitem__, words))
        self.tail.extend(range(start + own, start + len(words)))
        self.seq.append(-1)

    def counts(self) -> np.ndarray:
        seq = np.frombuffer(self.seq, dtype=np.int32)
        own = np.ones(len(seq), dtype=bool)
        own[np.frombuffer(self.tail, dtype=np.int32)] = False
        return np.bincount(seq[own & (seq >= 0)], minlength=len(self.number))


_KINDS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}


def _rows(schema: str, block: int, lang: str, state: list[np.ndarray], lists: list, size: int) -> dict[str, pa.Array]:
    """The row of a block (its arrays as bytes) and those of its lists, as columns of Arrow."""
    columns = [c.split(" ") for c in schema.split(", ")]
    chunks = range(0, size, _CHUNK)
    values = [[block], [lang], [-1], [size], *[[a.tobytes()] for a in state], *[[None] for _ in lists]]
    for column, more in zip(values, [[block] * len(chunks), [lang] * len(chunks), list(range(len(chunks))), [size] * len(chunks), *[[None] * len(chunks) for _ in state], *[[x[at : at + _CHUNK] for at in chunks] for x in lists]]):
        column += more
    return {name: pa.array(x, _KINDS[kind]) for (name, kind), x in zip(columns, values)}


def blocks(docs: DataFrame, block_words: int = 1 << 20) -> DataFrame:
    """Blocks of word numbers: block, lang, seq (-1 ends a piece), tail (places not counted); words and n (occurrences of each word) in rows of their own."""
    piece = min(block_words, 1 << 20)  # so a block has less than 2**22 words

    def run(batches):
        task, made, open_, held = TaskContext.get().partitionId(), 0, {}, 0

        def closed(lang: str) -> pa.RecordBatch:
            nonlocal made
            b = open_.pop(lang)
            seq, tail = np.frombuffer(b.seq, dtype=np.int32), np.frombuffer(b.tail, dtype=np.int32)
            columns = _rows(_BLOCK, (task << _BLOCK_BITS) | made, lang, [seq, tail], [[w.decode("utf-8") for w in b.number], b.counts()], len(b.number))
            made += 1
            return pa.record_batch(list(columns.values()), names=list(columns))

        for batch in batches:
            for lang, text in zip(batch.column("lang"), batch.column("text")):
                raw = text.as_py()
                if not raw:
                    continue
                lang = lang.as_py()
                lang = "und" if lang is None else lang
                for part in raw.encode("utf-8").lower().translate(_CUT).split(b"\n"):
                    words = part.split()
                    for at in range(0, len(words), piece):
                        if lang not in open_:
                            open_[lang] = _Builder()
                        b, before = open_[lang], len(open_[lang].seq)
                        b.add(words[at : at + piece + LONGEST - 1], min(piece, len(words) - at))
                        held += len(b.seq) - before
                        if len(b.seq) >= block_words:
                            held -= len(b.seq)
                            yield closed(lang)
                # Many languages at once: the fullest block goes, so a task holds a few blocks at most.
                while held > 4 * block_words and open_:
                    most = max(open_, key=lambda x: len(open_[x].seq))
                    held -= len(open_[most].seq)
                    yield closed(most)
        for lang in list(open_):
            yield closed(lang)

    return docs.select("lang", "text").mapInArrow(run, _BLOCK)


def _extended(block: pa.Table, positions: np.ndarray, phrase: np.ndarray, ids: np.ndarray, w: np.ndarray, wid: np.ndarray, tail: np.ndarray, k: int) -> pa.Table:
    """A block with the lists of its phrases of k + 1 words.

    ``positions`` are those where frequent phrases of k words begin, in order; ``phrase`` their numbers in ``ids``.
    """
    loc, own = np.full(len(w), -1, dtype=np.int32), np.ones(len(w), dtype=bool)
    own[tail] = False
    # The merge of two sorted lists, s and s + 1, is a test of neighbours in one.
    both = np.flatnonzero(positions[1:] == positions[:-1] + 1)
    at = positions[both]
    key = phrase[both].astype(np.int64) * max(1, len(wid)) + w[at + k]
    met, number = np.unique(key, return_inverse=True)
    loc[at] = number
    n = np.bincount(number[own[at]], minlength=len(met))
    lists = [ids[met // max(1, len(wid))], wid[met % max(1, len(wid))], n]
    return pa.table(_rows(_LEVEL, block["block"][0].as_py(), block["lang"][0].as_py(), [w, wid, tail, loc], lists, len(met)))


def _ids(known: pa.Table, size: int) -> np.ndarray:
    """The id of each of a block's phrases; 0 for one that is not frequent."""
    ids = np.zeros(size, dtype=np.int64)
    ids[known.column("idx").to_numpy()] = known.column("id").to_numpy()
    return ids


def _pairs(block: pa.Table, known: pa.Table) -> pa.Table:
    """Level 2 of one block, from its frequent words."""
    seq, words = np.frombuffer(block["seq"][0].as_py(), dtype=np.int32), block["size"][0].as_py()
    ids = _ids(known, words)
    frequent = np.flatnonzero(ids)
    local = np.full(words + 1, -1, dtype=np.int32)  # the last one is for -1
    local[frequent] = np.arange(len(frequent), dtype=np.int32)
    w, wid = local[seq], ids[frequent]
    positions = np.flatnonzero(w >= 0)
    return _extended(block, positions, w[positions], wid, w, wid, np.frombuffer(block["tail"][0].as_py(), dtype=np.int32), 1)


def _longer(k: int):
    def step(block: pa.Table, known: pa.Table) -> pa.Table:
        """Level k + 1 of one block, from its frequent phrases of k words."""
        w, wid, tail, loc = (np.frombuffer(block[name][0].as_py(), dtype=kind) for name, kind in (("w", np.int32), ("wid", np.int64), ("tail", np.int32), ("loc", np.int32)))
        ids = _ids(known, block["size"][0].as_py())
        positions = np.flatnonzero(loc >= 0)
        positions = positions[ids[loc[positions]] > 0]
        return _extended(block, positions, loc[positions], ids, w, wid, tail, k)

    return step


def _known(level: DataFrame, least: int, *key: str) -> DataFrame:
    """The frequent phrases at each of their places: lang, key, at, f, id (one of their places, plus 1)."""
    rows = level.filter("chunk >= 0").select("block", "chunk", "lang", F.posexplode(F.arrays_zip(*key, "n")).alias("idx", "x"))
    rows = rows.select("lang", *[F.col("x")[c].alias(c) for c in key], (F.shiftleft("block", _PHRASE_BITS) + F.col("chunk") * _CHUNK + F.col("idx")).alias("at"), F.col("x")["n"].alias("n"))
    same = W.partitionBy("lang", *key)
    return rows.withColumn("f", F.sum("n").over(same)).filter(F.col("f") >= least).withColumn("id", F.min("at").over(same) + 1).drop("n")


def _met(level: DataFrame, known: DataFrame, step) -> DataFrame:
    """The next level: each block with its own frequent phrases."""
    back = known.select(F.shiftright("at", _PHRASE_BITS).alias("block"), F.col("at").bitwiseAND((1 << _PHRASE_BITS) - 1).alias("idx"), "id")

    empty = pa.table({c.split(" ")[0]: pa.array([], _KINDS[c.split(" ")[1]]) for c in _LEVEL.split(", ")})

    def run(key: tuple, block: pa.Table, own: pa.Table) -> pa.Table:
        return step(block, own) if block.num_rows and own.num_rows else empty

    state = level.filter("chunk < 0").select([c for c in level.columns if c not in ("words", "left", "right", "n")])
    return state.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(run, _LEVEL)


def frequent(docs: DataFrame, least: int, block_words: int, at: str) -> list[DataFrame]:
    """For 1 to 4 words the frequent phrases: id, lang, f and word, or left (id of the phrase without its last word) and right (id of that word)."""
    spark = docs.sparkSession

    def stored(rows: DataFrame, name: str, **options) -> DataFrame:
        rows.write.options(compression="zstd", **options).parquet(f"{at}/{name}")
        return spark.read.parquet(f"{at}/{name}")

    level, out = stored(blocks(docs, block_words), "blocks", **_WIDE), []
    stored(level.filter("chunk >= 0").groupBy("lang").agg(F.sum(F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")), "totals")
    for k in range(1, LONGEST + 1):
        key = ("words",) if k == 1 else ("left", "right")
        known = stored(_known(level, least, *key), f"known{k}")
        out.append(known.filter(F.col("at") + 1 == F.col("id")).drop("at"))
        if k < LONGEST:
            after = stored(_met(level, known, _pairs if k == 1 else _longer(k)), f"level{k + 1}", **_WIDE)
        delete(spark, f"{at}/{'blocks' if k == 1 else f'level{k}'}")
        level = after
    out[0] = out[0].withColumnRenamed("words", "word")
    return out


def _score(a: Column, whole: Column) -> Column:
    """floor(2,000,000 a / whole), in decimals that hold every product."""
    wide = F.lit(2_000_000).cast("decimal(7,0)") * a.cast("decimal(20,0)")
    return F.call_function("div", wide, whole.cast("decimal(20,0)"))


def _cut(a: Column, parts: list[tuple[Column, Column]]) -> Column:
    """The cut of the lowest score, the first of equal ones, as (score, k, l, r)."""
    return F.array_min(F.array(*[F.struct(_score(a, left + right).alias("score"), F.lit(k).alias("k"), left.alias("l"), right.alias("r")) for k, (left, right) in enumerate(parts, 1)]))


def candidates(levels: list[DataFrame]) -> DataFrame:
    """All candidates: lang, w1 to w4 (ids of words, null beyond the phrase), a, cut (score, k, l, r), around.

    ``around`` is the greatest frequency of a candidate one word longer that holds it. One that is two words longer
    and frequent enough implies such a one, as frequencies only grow towards parts.
    """
    one, two, three, four = levels
    word = one.select(F.col("id").alias("w"), F.col("f").alias("fw"))
    of = lambda n: word.select(F.col("w").alias(f"w{n}"), F.col("fw").alias(f"f{n}"))
    two = two.select("id", "lang", F.col("left").alias("w1"), F.col("right").alias("w2"), F.col("f").alias("a")).join(of(1), "w1").join(of(2), "w2")
    three = three.select("id", "lang", F.col("left").alias("p12"), F.col("right").alias("w3"), F.col("f").alias("a"))
    before = two.select(F.col("id").alias("p12"), "w1", "w2", F.col("a").alias("f12"), "f1")
    behind = two.select(F.col("id").alias("p23"), F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("a").alias("f23"), F.col("f2").alias("f3"))
    three = three.join(before, "p12").join(behind, ["w2", "w3"])
    four = four.select("id", "lang", F.col("left").alias("t123"), F.col("right").alias("w4"), F.col("f").alias("a"))
    before = three.select(F.col("id").alias("t123"), "w1", "w2", "w3", F.col("a").alias("f123"), "f1", "f12", "p23")
    behind = three.select(F.col("id").alias("t234"), F.col("p12").alias("p23"), F.col("w3").alias("w4"), F.col("a").alias("f234"), F.col("f23").alias("f34"), F.col("f3").alias("f4"))
    four = four.join(before, "t123").join(behind, ["p23", "w4"])

    def inside(longer: DataFrame, *parts: str) -> DataFrame:
        return longer.select(F.explode(F.array(*parts)).alias("id"), "a").groupBy("id").agg(F.max("a").alias("around"))

    def row(phrases: DataFrame, words: int, *parts: tuple[str, str]) -> DataFrame:
        ids = [F.col(f"w{k}") if k <= words else F.lit(None).cast("long").alias(f"w{k}") for k in range(1, LONGEST + 1)]
        return phrases.select("lang", *ids, "a", _cut(F.col("a"), [(F.col(x), F.col(y)) for x, y in parts]).alias("cut"), "around")

    two = row(two.join(inside(three, "p12", "p23"), "id", "left"), 2, ("f1", "f2"))
    three = row(three.join(inside(four, "t123", "t234"), "id", "left"), 3, ("f1", "f23"), ("f12", "f3"))
    four = row(four.withColumn("around", F.lit(None).cast("long")), 4, ("f1", "f234"), ("f12", "f34"), ("f123", "f4"))
    return two.unionByName(three).unionByName(four)


def mine(docs: DataFrame, least: int = 30, keep: int = 2000, covered: int = 80, block_words: int = 1 << 20) -> DataFrame:
    """The first ``keep`` collocations of each language: lang, rank, phrase, a, l, r, n, score.

    Candidates are phrases of 2 to 4 words that stand ``least`` times; one that a longer candidate covers in
    ``covered`` of 100 of its places is left out.
    """
    at = f"{checkpoint_dir(docs.sparkSession)}/phrases-{uuid.uuid4().hex}"
    levels = frequent(docs, least, block_words, at)
    totals = docs.sparkSession.read.parquet(f"{at}/totals")
    wide = lambda c, times: F.col(c).cast("decimal(20,0)") * times
    kept = candidates(levels).filter(F.col("around").isNull() | (wide("around", 100) < wide("a", covered)))
    for k in range(1, LONGEST + 1):
        kept = kept.join(levels[0].select(F.col("id").alias(f"w{k}"), F.col("word").alias(f"word{k}")), f"w{k}", "left")
    kept = kept.withColumn("phrase", F.concat_ws(" ", *[f"word{k}" for k in range(1, LONGEST + 1)]))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase"))
    first = kept.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= keep)
    return first.join(totals, "lang").select("lang", "rank", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
