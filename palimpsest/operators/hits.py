"""Detections of documents worked as Python lists, where a document's rows come to Python anyway.

The same as ``entities.reconcile_lists``, whose lists the engine works item by item without compiling: patterns run in the engine and
give plain lists of texts, all else is made of them here. Small letters are those of Python.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.catalog import PATTERNS
from palimpsest.functions.text import WHITE
from palimpsest.operators import entities
from palimpsest.sources.batches import objects, slices

FOUND = "array<array<string>>"


def found_in(text: Column, patterns=PATTERNS) -> Column:
    """The texts that each pattern finds, a list for each; null for one whose gate a text doesn't pass."""
    if not patterns:
        return F.array().cast(FOUND)
    return F.array(*[entities.found_by(text, category, pattern) for _, category, _, pattern in entities.placed(patterns)])


def maker(patterns=PATTERNS) -> Callable[[list | None, int, bool], list[tuple]]:
    """What makes ``found_in`` a list of hits (in the order of ``entities.HIT``), from a ``seq`` on, with the placeholders as they are or normal ones."""
    told = []
    for k, category, placeholder, _ in entities.placed(patterns):
        normal = placeholder if placeholder.startswith("{{") else "{{" + category + "}}"
        told.append((k * entities.STRIDE, (placeholder, normal), category))

    def made(found: list | None, start: int = 0, normal: bool = False) -> list[tuple]:
        return [
            (start + at + i, x, placeholders[normal], category, entities.PATTERN_CONFIDENCE, entities.PATTERN_REASON)
            for own, (at, placeholders, category) in zip(found or (), told) if own
            for i, x in enumerate(own) if x and not x.startswith("{{")
        ]

    return made


def _rank(hit: tuple) -> tuple:
    """Of equal detections the one that ranks highest stays. Null ranks below all, what is no number above all numbers, as in the engine."""
    seq, original, placeholder, category, c, reason = hit
    sure = (0, 0.0) if c is None else (2, 0.0) if math.isnan(c) else (1, c)
    return *sure, -seq, original, *[(x is not None, x or "") for x in (placeholder, category, reason)]


def reconciled(hits: list[tuple]) -> list[tuple]:
    """(-length, group_seq, *hit) of the best of each group of equal detections, without those that are part of another, longest first."""
    groups: dict[str, list] = {}
    for h in hits:
        if (x := h[1]) is not None:
            key = x.strip()
            groups.setdefault((key if len(key) == len(x) else x.strip(WHITE)).lower(), []).append(h)
    best = [(g[0], g[0][0]) if len(g) == 1 else (max(g, key=_rank), min([h[0] for h in g])) for g in groups.values()]
    count = ("\x00" + "\x00".join([h[1] for h, _ in best]) + "\x00").count
    return sorted([(-len(h[1]), first, *h) for h, first in best if count(h[1]) <= 1 or not h[1]])


def by_document(batches: Iterable[pa.RecordBatch], names: list[str]) -> Iterator[tuple[int | None, list[tuple]]]:
    """(doc_id, rows) of batches whose rows are sorted by ``doc_id``, one document at a time."""
    rows = (row for b in slices(batches, 256) for row in zip(*(objects(b.column(c)) for c in ["doc_id", *names])))
    for doc, own in groupby(rows, key=lambda row: row[0]):
        yield doc, [row[1:] for row in own]


def sorted_by_document(rows: DataFrame) -> DataFrame:
    """Rows dealt to all tasks by document, those of one document beside each other."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id").sortWithinPartitions("doc_id")


def reconcile_found(rows: DataFrame, patterns=PATTERNS, stride: int = 0) -> DataFrame:
    """``entities.reconcile`` of rows (doc_id, whole, chunk_index, found, told).

    ``found`` are hits of a text (``found_in``), of the document if it is ``whole``, and of its chunk too if there is a ``chunk_index``
    and nothing was ``told``; what was told are hits themselves. Those of a chunk come after by ``stride``, chunk after chunk.
    """
    made = maker(patterns)
    schema = "doc_id long, group_seq long, seq long, original string, placeholder string, category string, confidence double, reason string, ord int"
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.string(), pa.int32())
    names = [c.split(" ")[0] for c in schema.split(", ")]

    def run(batches):
        out: list[list] = [[] for _ in kinds]
        for doc, own in by_document(batches, ["whole", "chunk_index", "found", "told"]):
            hits = []
            for whole, chunk, found, told in own:
                start = 0 if chunk is None else (chunk + 1) * stride
                if whole:
                    hits += made(found)
                if told is not None:
                    hits += [(start + h[0], *h[1:]) for h in told]
                elif chunk is not None and not whole:
                    # Those of a whole document's chunk are its own again, which come first.
                    hits += made(found, start, True)
            if kept := reconciled(hits):
                n = len(kept)
                for column, x in zip(out, ([doc] * n, *list(zip(*kept))[1:], range(1, n + 1))):
                    column += x
            if len(out[0]) >= 1024:
                yield pa.record_batch([pa.array(x, t) for x, t in zip(out, kinds)], names=names)
                out = [[] for _ in kinds]
        yield pa.record_batch([pa.array(x, t) for x, t in zip(out, kinds)], names=names)

    return sorted_by_document(rows.select("doc_id", "whole", "chunk_index", "found", "told")).mapInArrow(run, schema)
