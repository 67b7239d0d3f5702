"""Language identification, word first.

A known word scores each language by its log frequency there. An unseen word
backs off to character n-grams, from the longest order down to the first whose
n-grams are known, and scores by their mean. What a language lacks costs a fixed
penalty. A document takes the language of the least mean cost of its words.

The tables are learnt from a bounded sample: about ``per_language`` documents
of each language by hash of their id, outside the held-out fold; of them, each
language keeps its ``words`` most frequent words and ``grams`` most frequent
n-grams of each order. None in place of a bound learns from, or keeps, all.
A word or n-gram holds only the languages that have it, so tables grow with what
was learnt and not with the number of languages squared. Every document is
scored on its whole text.

Defined cases: a null text or one without a letter gives ``und`` and score 0;
so does every text if nothing could be learnt. Ties go to the first language by
name. Rows with a null lang or text teach nothing. Repeated rows are scored
alike; very long texts take time and memory in proportion to their length; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.llm.common import checkpoint, fold, slices

ORDERS = (5, 4, 3, 2, 1)
_WORD = re.compile(r"[^\W\d_]+")
_CACHE = 200_000


@dataclass
class Tables:
    """Languages in order; for each known word (order 0) and n-gram the costs of the languages that have it."""

    languages: list[str]
    costs: dict[int, dict[str, dict[int, float]]]


def ngrams(word: str, order: int) -> list[str]:
    s = f" {word} "
    return [s[k : k + order] for k in range(len(s) - order + 1)] if order > 1 else list(word)


class Scorer(dict):
    """Places of words in a sparse matrix of gains (the penalty less the cost): first the known words, then, bounded, unseen ones."""

    def __init__(self, tables: Tables, penalty: float):
        self.tables, self.penalty = tables, penalty
        self.reset()

    def reset(self) -> None:
        """Forget the unseen words."""
        self.clear()
        self.ends, self.language, self.gain = array("q", [0]), array("i"), array("d")
        for word, costs in self.tables.costs[0].items():
            self._add(word, costs)

    def _add(self, word: str, costs: dict[int, float]) -> int:
        at = self[word] = len(self)
        self.language.extend(costs)
        self.gain.extend([self.penalty - c for c in costs.values()])
        self.ends.append(len(self.language))
        return at

    def cost(self, word: str) -> dict[int, float]:
        """Costs of a word that is not known, for the languages that don't cost the penalty."""
        for order in ORDERS:
            get = self.tables.costs[order].get
            found = [c for g in ngrams(word, order) if (c := get(g)) is not None]
            if found:
                gains: dict[int, float] = {}
                for c in found:
                    for k, x in c.items():
                        gains[k] = gains.get(k, 0.0) + self.penalty - x
                return {k: self.penalty - x / len(found) for k, x in gains.items()}
        return {}

    def __missing__(self, word: str) -> int:
        return self._add(word, self.cost(word))

    def predict(self, text: str | None) -> tuple[str, float]:
        words = _WORD.findall((text or "").lower())
        if not words or not self.tables.languages:
            return "und", 0.0
        if len(self) > len(self.tables.costs[0]) + _CACHE:
            self.reset()
        at = np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))
        ends = np.frombuffer(self.ends, dtype=np.int64)
        start, count = ends[at], ends[at + 1] - ends[at]
        flat = np.repeat(start - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        if len(flat):
            gains = np.bincount(np.frombuffer(self.language, dtype=np.int32)[flat], np.frombuffer(self.gain, dtype=np.float64)[flat], len(self.tables.languages))
        else:
            gains = np.zeros(len(self.tables.languages))
        mean = self.penalty - gains / len(words)
        best = int(mean.argmin())
        odds = np.exp((mean[best] - mean) * np.log(10) * min(len(words), 50) ** 0.5)
        return self.tables.languages[best], float(1 / odds.sum())


def train(docs: DataFrame, per_language: int | None = 1500, words: int | None = 20_000, grams: int | None = 5_000, known_languages: int = 100_000) -> Tables:
    """Counts words and n-grams of the sample in Spark and collects the tables, which ``words`` and ``grams`` bound."""
    own = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold() != 0))
    sample = own.select("lang", "text")
    if per_language is not None:
        # One row for each language: as many as are known are broadcast, so no text is shuffled by its language.
        sizes = checkpoint(own.groupBy("lang").count().select("lang", (F.lit(float(per_language)) / F.col("count")).alias("_share")))
        if sizes.count() <= known_languages:
            sizes = F.broadcast(sizes)
        draw = (F.xxhash64(F.lit("language"), "doc_id").bitwiseAND((1 << 30) - 1) / float(1 << 30)).alias("_draw")
        sample = own.select("*", draw).join(sizes, "lang").filter("_draw < _share").select("lang", "text")

    def count(batches):
        # One row for each word and slice of the sample: bounded by per_language.
        for b in slices(batches):
            seen: dict[str, Counter] = {}
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
                seen.setdefault(lang, Counter()).update(_WORD.findall(text.lower()))
            for lang, c in seen.items():
                yield pa.record_batch([pa.array([lang] * len(c), pa.string()), pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], names=["lang", "gram", "n"])

    def split(batches):
        # N-grams are made from each distinct word once, with its count.
        for b in slices(batches, 4096):
            seen: Counter = Counter()
            for lang, word, n in zip(*(b.column(c).to_pylist() for c in ("lang", "gram", "n"))):
                for order in ORDERS:
                    for g in ngrams(word, order):
                        seen[lang, order, g] += n
            columns = list(zip(*seen)) or [[], [], []]
            kinds = (pa.string(), pa.int32(), pa.string())
            yield pa.record_batch([*[pa.array(c, t) for c, t in zip(columns, kinds)], pa.array(list(seen.values()), pa.int64())], names=["lang", "order", "gram", "n"])

    whole = checkpoint(sample.mapInArrow(count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    parts = whole.mapInArrow(split, "lang string, order int, gram string, n long").groupBy("lang", "order", "gram").agg(F.sum("n").alias("n"))
    counts = parts.unionByName(whole.select("lang", F.lit(0).alias("order"), "gram", "n"))
    kind = W.partitionBy("lang", "order")
    kept = (
        counts.withColumn("total", F.sum("n").over(kind))
        .withColumn("place", F.row_number().over(kind.orderBy(F.desc("n"), "gram")))
        .filter(F.col("place") <= F.when(F.col("order") == 0, _least(words)).otherwise(_least(grams)))
        .select("lang", "order", "gram", (F.log10("total") - F.log10("n")).cast("float").alias("cost"))
    )
    found = kept.toArrow()
    languages = sorted(set(found.column("lang").to_pylist()))
    place = {lang: k for k, lang in enumerate(languages)}
    costs: dict[int, dict[str, dict[int, float]]] = {o: {} for o in (0, *ORDERS)}
    for lang, order, gram, cost in sorted(zip(*(found.column(c).to_pylist() for c in ("lang", "order", "gram", "cost")))):
        costs[order].setdefault(gram, {})[place[lang]] = cost
    return Tables(languages, costs)


def _least(bound: int | None) -> int:
    return (1 << 31) - 1 if bound is None else bound


def identify(docs: DataFrame, tables: Tables, penalty: float = 7.0) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(tables)  # bounded by words and grams of each language

    def run(batches):
        scorer = Scorer(shared.value, penalty)
        for b in slices(batches):
            found = [scorer.predict(t) for t in b.column("text").to_pylist()]
            yield pa.record_batch(
                [b.column("doc_id"), b.column("held_out"), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    return docs.select("doc_id", (fold() == 0).alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
