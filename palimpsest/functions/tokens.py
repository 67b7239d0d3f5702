"""Token counts by byte-pair ranks from a rank file."""

from __future__ import annotations

import base64
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from palimpsest.sources.batches import slices

#: Fixed value: how common rank files cut a text into pieces before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces whose counts a worker remembers.
REMEMBERED = 200_000


@lru_cache(maxsize=4)
def ranks_of(path: str) -> dict[bytes, int]:
    """The ranks of a file with a token in base 64 and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}


def merged(piece: bytes, ranks: dict[bytes, int]) -> int:
    """Into how many tokens a piece falls: the pair of least rank merges, the first of equal ones, until none has a rank.

    Pairs wait in a heap and neighbours in a list, so a piece of n bytes takes n log n steps.
    """
    import heapq

    n = len(piece)
    end, before, after, alive = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
    waiting: list[tuple[int, int, int]] = []

    def offer(a: int) -> None:
        b = after[a]
        if b < n and (rank := ranks.get(piece[a : end[b]])) is not None:
            heapq.heappush(waiting, (rank, a, end[b]))

    for a in range(n - 1):
        offer(a)
    left = n
    while waiting:
        _, a, to = heapq.heappop(waiting)
        if not alive[a] or after[a] >= n or end[after[a]] != to:
            continue
        b = after[a]
        alive[b], end[a], after[a] = False, end[b], after[b]
        if after[b] < n:
            before[after[b]] = a
        left -= 1
        offer(a)
        if before[a] >= 0:
            offer(before[a])
    return left


class Counter:
    """Counts the tokens of a text; a parameter for ``chunk_documents``. Sent to a worker, it brings the path and not the ranks."""

    def __init__(self, path: str, pattern: str = PATTERN):
        self.path, self.pattern = path, pattern

    def __call__(self, text: str) -> int:
        known = _pieces(self.path)
        total = 0
        for piece in _cutter(self.pattern).findall(text):
            if (n := known.get(piece)) is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                ranks, raw = ranks_of(self.path), piece.encode("utf-8", "replace")
                n = known[piece] = 1 if raw in ranks else merged(raw, ranks)
            total += n
        return total


@lru_cache(maxsize=4)
def _cutter(pattern: str) -> regex.Pattern:
    return regex.compile(pattern)


@lru_cache(maxsize=4)
def _pieces(path: str) -> dict[str, int]:
    return {}


def counted(docs: DataFrame, count: Callable[[str], int]) -> DataFrame:
    """(doc_id, tokens) of every text; a null text has a null."""

    def run(batches):
        for b in slices(batches):
            tokens = [None if t is None else count(t) for t in b.column("text").to_pylist()]
            yield pa.record_batch([b.column("doc_id"), pa.array(tokens, pa.int64())], names=["doc_id", "tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, tokens long")
