"""Similarity join of documents on word shingles: MinHash banding, verified on full sets.

1. Each text becomes its set of five-word shingles (64-bit hashes; words are
   runs of letters, digits and underscores in lower case). Documents with equal
   sets are one *text class*; from here on a class is one item.
2. Band and row counts follow from the threshold and the wanted recall
   (``bands_for``). Classes are shuffled on band hashes; buckets of two or more
   give the candidate graph, its connected parts are found by star steps.
3. The classes of a part meet in blocks of ``block`` classes. In a pair of
   blocks, two classes that agree in any band are verified on their full sets.
   Parts beyond ``wide`` blocks are divided by bucket, and there a pair is
   verified in its first common bucket only. Every pair is so verified once.
4. Pairs of similarity ``threshold`` or more are links. Per class the links are
   counted and a spanning set of them gives the connected groups.

A pair is never a row: blocks return one row per class with its count of links
and the least class it reached, so a group of m texts costs rows in proportion
to m (times m / ``block``), though each of its pairs is verified.

Defined cases: a text with fewer than five words has one shingle, all its
words; a text without words but with marks has one, the text itself; null and
empty texts and rows with a null id are alone (class of their own id, no link).
Rows that repeat a document are copies of it. Rows with one id and different texts
are documents of their own, each in its own text class. Very long texts are one set
like others. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.llm.common import checkpoint, long_lists, memory, slices
from palimpsest.llm.components import components

_WORD = re.compile(r"\w+")
_CACHE = 100_000
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def recall_of(bands: int, rows: int, similarity: float) -> float:
    """How likely two sets of that similarity agree in a band."""
    return 1 - (1 - similarity**rows) ** bands


def bands_for(threshold: float, recall: float, most: int = 200) -> tuple[int, int]:
    """(bands, rows): the most rows, so the fewest false candidates, that reach the recall at the threshold with ``most`` hashes.

    Raises ValueError where no choice reaches it.
    """
    best = None
    for rows in range(1, 33):
        for bands in range(1, most // rows + 1):
            if recall_of(bands, rows, threshold) >= recall:
                best = (bands, rows)
                break
    if best is None:
        raise ValueError(f"{most} hashes reach a recall of {recall_of(most, 1, threshold):.4f} at {threshold}, not {recall}")
    return best


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > _CACHE:
            self.clear()
        self[word] = found = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        return found


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def shingles(text: str | None, words: int = 5) -> np.ndarray:
    """The sorted set of 64-bit shingle hashes of a whole text."""
    if not text:
        return np.zeros(0, dtype=np.uint64)
    known = memory(_Hashes, _Hashes)
    found = _WORD.findall(text.lower())
    if not found:
        return np.array([known["\x00" + text]] if len(text) < 1000 else [int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")], dtype=np.uint64)
    h = np.array([known[w] for w in found], dtype=np.uint64)
    n = min(words, len(h))
    total = np.full(len(h) - n + 1, n, dtype=np.uint64)
    for k in range(n):
        total = _mixed(total * _M[k % 5] + h[k : len(h) - n + 1 + k])
    return np.unique(total)


class Signer:
    """Band hashes of a shingle set: minima under ``bands * rows`` multiplicative hashes, folded by band."""

    def __init__(self, bands: int, rows: int, seed: int = 11):
        self.bands, self.rows = bands, rows
        rng = np.random.default_rng(seed)
        self.a = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        least = np.full(len(self.a), np.iinfo(np.uint64).max, dtype=np.uint64)
        for at in range(0, len(hashes), 4096):
            part = hashes[at : at + 4096]
            least = np.minimum(least, (part[None, :] * self.a[:, None] + self.b[:, None]).min(axis=1))
        band = np.arange(1, self.bands + 1, dtype=np.uint64) * _M[0]
        for k in range(self.rows):
            band = _mixed(band * _M[1] + least[k :: self.rows])
        return band.view(np.int64)


def _key(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


class _Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)


def _overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Sizes of the common part for each pair (index into left, index into right)."""
    if len(pairs) <= 4 * (len(left) + len(right)):
        return np.array([len(np.intersect1d(sets[left[i]], sets[right[j]], assume_unique=True)) for i, j in pairs], dtype=np.int64)
    # Many pairs: incidence of the shingles that a row of either side shares, multiplied in column slices.
    rows = np.unique(np.concatenate([left, right]))
    values, at = np.unique(np.concatenate([sets[i] for i in rows]), return_inverse=True)
    owner = np.repeat(np.arange(len(rows)), [len(sets[i]) for i in rows])
    often = np.bincount(at, minlength=len(values))
    common = int((often == len(rows)).sum())
    column = np.full(len(values), -1, dtype=np.int64)
    used = (often > 1) & (often < len(rows))
    column[used] = np.arange(used.sum())
    owner, at = owner[column[at] >= 0], column[at[column[at] >= 0]]
    place = {int(r): k for k, r in enumerate(rows)}
    l, r = np.array([place[int(i)] for i in left]), np.array([place[int(i)] for i in right])
    out = np.full((len(left), len(right)), float(common), dtype=np.float32)
    width = 4096
    for start in range(0, int(used.sum()), width):
        take = (at >= start) & (at < start + width)
        m = np.zeros((len(rows), min(width, int(used.sum()) - start)), dtype=np.float32)
        m[owner[take], at[take] - start] = 1
        out += m[l] @ m[r].T
    return out[pairs[:, 0], pairs[:, 1]].astype(np.int64)


def verify_block(ids: np.ndarray, weight: np.ndarray, side: np.ndarray, bands: np.ndarray, sets: list[np.ndarray], threshold: float, inner: bool, band: int = -1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links of a pair of blocks: by row the number of linked classes, of linked documents, the least id reached.

    ``inner``: one block with itself. ``band``: only pairs whose first common band this is.
    """
    left = np.arange(len(ids)) if inner else np.flatnonzero(side == 0)
    right = left if inner else np.flatnonzero(side == 1)
    texts, docs = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
    union = _Union(len(ids))
    if len(left) and len(right):
        met = np.zeros((len(left), len(right)), dtype=bool)
        for k in range(bands.shape[1]):
            same = bands[left, k][:, None] == bands[right, k][None, :]
            if band < 0:
                met |= same
            elif k < band:
                met |= same
            elif k == band:
                met = same & ~met
                break
        if inner:
            met = np.triu(met, 1)
        pairs = np.argwhere(met)
        sizes = np.array([len(s) for s in sets], dtype=np.int64)
        if len(pairs):
            a, b = sizes[left[pairs[:, 0]]], sizes[right[pairs[:, 1]]]
            pairs = pairs[np.minimum(a, b) >= threshold * np.maximum(a, b) - 1e-9]
        if len(pairs):
            both = _overlaps(sets, left, right, pairs)
            a, b = sizes[left[pairs[:, 0]]], sizes[right[pairs[:, 1]]]
            pairs = pairs[both >= threshold * (a + b - both) - 1e-9]
            i, j = left[pairs[:, 0]], right[pairs[:, 1]]
            for own, other in ((i, j), (j, i)):
                np.add.at(texts, own, 1)
                np.add.at(docs, own, weight[other])
            order = np.argsort(ids, kind="stable")
            rank = np.empty(len(ids), dtype=np.int64)
            rank[order] = np.arange(len(ids))
            for x, y in zip(rank[i].tolist(), rank[j].tolist()):
                union.join(x, y)
            roots = ids[order][[union.find(int(x)) for x in rank]]
            return texts, docs, roots
    return texts, docs, ids.copy()


def similar_documents(docs: DataFrame, threshold: float = 0.8, recall: float = 0.995, words: int = 5, block: int = 1024, wide: int = 32) -> DataFrame:
    """One row per document: doc_id, class_id, text_class, n_copies, n_links, n_text_links.

    ``class_id`` is the least id of the connected group of similar documents,
    ``text_class`` the least id with the same shingles, ``n_copies`` how many
    documents have them. ``n_links`` counts the other documents of similarity
    ``threshold`` or more, copies included; ``n_text_links`` the other text classes.
    """
    return _similar(docs, threshold, recall, words, block, wide).drop("node", "text_hash")


def _similar(docs: DataFrame, threshold: float = 0.8, recall: float = 0.995, words: int = 5, block: int = 1024, wide: int = 32) -> DataFrame:
    """Adds to ``similar_documents`` the group's node, of its own for each group (null: alone), and a hash of the text."""
    bands, rows = bands_for(threshold, recall)
    signer = Signer(bands, rows)

    def sign(batches):
        for b in slices(batches):
            keys, sizes, signs = [], [], []
            for text in b.column("text").to_pylist():
                s = shingles(text, words)
                keys.append(_key(s) if len(s) else None)
                sizes.append(len(s))
                signs.append(signer(s) if len(s) else np.zeros(0, np.int64))
            yield pa.record_batch([b.column("doc_id"), b.column("text_hash"), pa.array(keys, pa.binary()), long_lists(signs, pa.int64())], names=["doc_id", "text_hash", "k", "bands"])

    hashed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    signed = checkpoint(hashed.mapInArrow(sign, "doc_id long, text_hash long, k binary, bands array<long>"))
    members = signed.select("doc_id", "text_hash", "k")
    classes = signed.filter("k is not null and doc_id is not null").groupBy("k").agg(F.min("doc_id").alias("real"), F.count("*").alias("n_copies"), F.first("bands").alias("bands"))
    classes = checkpoint(classes.withColumn("cid", F.col("real")))
    # Classes are nodes by their least id. Where an id has several texts it may be that of several classes: the others get nodes of their own.
    shared = bool(classes.groupBy("real").agg(F.count("*").alias("n")).filter("n > 1").limit(1).count())
    if shared:
        place = F.row_number().over(W.partitionBy("real").orderBy("k"))
        classes = checkpoint(classes.withColumn("place", place).withColumn("cid", F.when(F.col("place") == 1, F.col("real")).otherwise(F.xxhash64(F.lit("node"), "k"))).drop("place"))

    # Candidate graph: each member of a bucket with the least member of it.
    banded = classes.select("cid", F.posexplode("bands").alias("band", "hash"))
    buckets = banded.groupBy("band", "hash").agg(F.min("cid").alias("least"), F.count("*").alias("n")).filter("n > 1")
    edges = banded.join(buckets, ["band", "hash"]).filter("cid <> least").select(F.col("cid").alias("u"), F.col("least").alias("v")).distinct()
    parts = components(edges)
    sizes = parts.groupBy("root").agg(F.count("*").alias("n"))
    placed = checkpoint(parts.join(sizes, "root").select(F.col("node").alias("cid"), "root", "n"))

    def tasks(rows: DataFrame) -> DataFrame:
        """Each row of a group (key, band) of n once for every pair of blocks that its block is in."""
        count = F.ceil(F.col("n") / block).cast("int")
        own = F.pmod(F.xxhash64("cid"), count).cast("int")
        return rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), count - 1))).select(
            "cid", "key", "band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side")
        )

    most = wide * block
    narrow = tasks(placed.filter(F.col("n") <= most).select("cid", F.col("root").alias("key"), F.lit(-1).alias("band"), "n"))
    vast = placed.filter(F.col("n") > most).select("cid")
    vast = tasks(banded.join(vast, "cid").join(buckets, ["band", "hash"]).select("cid", F.col("hash").alias("key"), "band", "n"))
    work = narrow.unionByName(vast).groupBy("cid").agg(F.collect_list(F.struct("key", "band", "i", "j", "side")).alias("tasks"))
    work = work.join(classes.select("cid", "real", "n_copies", "bands", "k"), "cid")

    found = (
        docs.select(F.col("doc_id").alias("real"), "text")
        .join(work, "real")
        .select("cid", "text", "k", "n_copies", "bands", F.explode("tasks").alias("task"))
        .select("cid", "text", "k", "n_copies", "bands", "task.*")
    )

    def verify(table: pa.Table) -> pa.Table:
        texts, keys, ids = table.column("text"), table.column("k"), table.column("cid").to_pylist()
        sets, take, seen = [], [], set()
        for at in range(len(ids)):
            s = shingles(texts[at].as_py(), words)
            if ids[at] not in seen and _key(s) == keys[at].as_py():  # rows that repeat an id: once, and the text meant
                seen.add(ids[at])
                sets.append(s)
                take.append(at)
        table = table.take(pa.array(take, pa.int64()))
        cid = table.column("cid").to_numpy()
        n, d, root = verify_block(
            cid, table.column("n_copies").to_numpy(), table.column("side").to_numpy(), np.array(table.column("bands").to_pylist(), dtype=np.int64).reshape(len(cid), -1), sets,
            threshold, table.column("i")[0].as_py() == table.column("j")[0].as_py() if len(cid) else True, table.column("band")[0].as_py() if len(cid) else -1,
        )
        return pa.table({"cid": pa.array(cid, pa.int64()), "texts": pa.array(n, pa.int64()), "docs": pa.array(d, pa.int64()), "root": pa.array(root, pa.int64())})

    links = found.groupBy("key", "band", "i", "j").applyInArrow(verify, "cid long, texts long, docs long, root long")
    links = checkpoint(links.filter("texts > 0"))
    groups = components(links.select(F.col("cid").alias("u"), F.col("root").alias("v")))
    counts = links.groupBy("cid").agg(F.sum("texts").alias("texts"), F.sum("docs").alias("docs"))
    known = classes.select("k", "cid", "real", "n_copies").join(counts, "cid", "left").join(groups.withColumnRenamed("node", "cid"), "cid", "left")
    known = known.withColumn("node", F.coalesce("root", "cid"))
    if shared:
        known = known.join(known.groupBy("node").agg(F.min("real").alias("least")), "node")
    else:
        known = known.withColumn("least", F.col("node"))
    own = F.col("doc_id")
    return members.join(known, "k", "left").select(
        "doc_id",
        F.coalesce("least", own).alias("class_id"),
        F.coalesce("real", own).alias("text_class"),
        F.coalesce("n_copies", F.lit(1)).alias("n_copies"),
        (F.coalesce("n_copies", F.lit(1)) - 1 + F.coalesce("docs", F.lit(0))).alias("n_links"),
        F.coalesce("texts", F.lit(0)).alias("n_text_links"),
        "node",
        "text_hash",
    )


def deduplicate(docs: DataFrame, **parameters) -> DataFrame:
    """The document with the least id of each group of similar ones, in the columns of ``docs``.

    Of several texts with that id in one group that of the least hash stays; rows that repeat it stay once. Texts
    without a shingle stay once for each id; rows with a null id all stay.
    """
    found = _similar(docs, **parameters).filter("doc_id is not null")
    # One row for each group: minima combine before the shuffle, so a group of any size meets as few rows.
    alone = F.when(F.col("node").isNull(), F.col("doc_id"))
    keep = found.groupBy("node", alone.alias("alone")).agg(F.min(F.struct("doc_id", "text_hash")).alias("m")).select(F.col("m.doc_id").alias("_id"), F.col("m.text_hash").alias("_hash")).distinct()
    own = docs.join(keep, (docs["doc_id"] == keep["_id"]) & (F.xxhash64(docs["text"]) == keep["_hash"]), "left_semi")
    own = own.withColumn(_spare(docs), F.xxhash64("text")).dropDuplicates(["doc_id", _spare(docs)]).drop(_spare(docs))
    return own.unionByName(docs.filter("doc_id is null"))


def _spare(docs: DataFrame) -> str:
    """A name that no column of ``docs`` has."""
    taken = {c.lower() for c in docs.columns}
    return next(n for k in range(len(taken) + 1) if (n := f"_hash_{k}") not in taken)
