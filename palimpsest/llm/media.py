"""Media columns: payloads as 8-bit images, kept as deduplicated content-defined chunks.

A text's UTF-8 bytes, filled up with blanks to a positive multiple of 192, are
the samples of a grey image of 192 columns (binary PGM, lossless). The image
file is cut where a rolling gear hash of the last 32 bytes says so, so equal
passages give equal chunks wherever they stand. A chunk's digest is its key:
Spark joins keep one copy of each chunk, an image is its ordered list of
digests, and joining list and chunks gives the bytes back. Each chunk and each
image is verified against its digest before features are computed from it.

Only unique chunks, compressed, and the lists of unique images are shuffled;
copies of an image share its list. Chunks are compressed with a dictionary that
is made from a bounded sample of them (``SAMPLE`` documents, 8 chunks each); it
affects their size alone.

Defined cases: a null text counts as empty (192 blanks); repeated rows give
repeated rows, each with its own doc_id, null ones too; very long texts are one
image of more rows; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import checkpoint, slices

COLUMNS = 192
LEAST, MOST, MASK_BITS = 1024, 16384, 12
SAMPLE, DICTIONARY_BYTES, LEVEL = 1000, 112_640, 19
#: Bytes of an image's SHA-256 that serve as its key in joins.
KEY = 16
_GEAR = np.random.default_rng(20240229).integers(0, 1 << 32, 256, dtype=np.uint32)
_HEAD = re.compile(rb"P5\n(\d+) (\d+)\n255\n")


def to_media(text: str | None) -> tuple[bytes, int]:
    """(image file, number of bytes of the text)."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    rows = max(1, -(-len(raw) // COLUMNS))
    return b"P5\n%d %d\n255\n" % (COLUMNS, rows) + raw + b" " * (rows * COLUMNS - len(raw)), len(raw)


def from_media(media: bytes) -> bytes:
    """The samples of an image file."""
    head = _HEAD.match(media)
    if not head or len(media) - head.end() != int(head[1]) * int(head[2]):
        raise ValueError("not a whole grey image")
    return media[head.end() :]


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks: h = 2 h + gear[byte] over 32 bits, cut where its top bits are 0; LEAST to MOST bytes each."""
    n = len(data)
    if n <= LEAST:
        return [n] if n else []
    h = _GEAR[np.frombuffer(data, dtype=np.uint8)]
    for span in (1, 2, 4, 8, 16):  # sums over windows of 2, 4, ... 32 bytes
        h[span:] += h[:-span] << np.uint32(span)
    marks = np.flatnonzero(h >> np.uint32(32 - MASK_BITS) == 0) + 1
    ends, at = [], 0
    while n - at > LEAST:
        k = np.searchsorted(marks, at + LEAST)
        at = min(int(marks[k]) if k < len(marks) else n, at + MOST, n)
        ends.append(at)
    if at < n:
        ends.append(n)
    return ends


def chunks(data: bytes) -> list[bytes]:
    ends = cuts(data)
    return [data[a:b] for a, b in zip([0, *ends], ends)]


def digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def features(samples: bytes) -> str:
    """Whole-number features of an image: rows, sum, sum of squares, step between neighbours, 16-bin histogram."""
    x = np.frombuffer(samples, dtype=np.uint8)
    wide = x.astype(np.int64)
    steps = int(np.abs(np.diff(wide)).sum())
    bins = np.bincount(x >> 4, minlength=16)
    return f"rows={len(x) // COLUMNS};sum={int(wide.sum())};squares={int(wide @ wide)};steps={steps};hist=" + ",".join(map(str, bins.tolist()))


def chunk_lists(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media_key, digests) of every document."""

    def run(batches):
        for b in slices(batches):
            made = [to_media(t) for t in b.column("text").to_pylist()]
            yield pa.record_batch(
                [
                    b.column("doc_id"),
                    pa.array([n for _, n in made], pa.int64()),
                    pa.array([hashlib.sha256(m).digest()[:KEY] for m, _ in made], pa.binary()),
                    pa.array([[digest(c) for c in chunks(m)] for m, _ in made], pa.list_(pa.binary())),
                ],
                names=["doc_id", "n_bytes", "media_key", "digests"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, media_key binary, digests array<binary>")


def dictionary(docs: DataFrame) -> bytes:
    """A compression dictionary from a bounded sample of chunks; empty if there are too few to make one."""
    import zstandard

    share = min(1.0, SAMPLE / max(1, docs.count()))
    drawn = docs.filter(F.xxhash64(F.lit("dictionary"), "doc_id").bitwiseAND((1 << 30) - 1) < int(share * (1 << 30))).select("text").limit(2 * SAMPLE)

    def run(batches):
        for b in slices(batches):
            yield pa.record_batch([pa.array([c for t in b.column("text").to_pylist() for c in chunks(to_media(t)[0])[:8]], pa.binary())], names=["chunk"])

    found = sorted({r.chunk for r in drawn.mapInArrow(run, "chunk binary").collect()})
    if sum(map(len, found)) < 8 * DICTIONARY_BYTES:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [bytes(c) for c in found]).as_bytes()
    except zstandard.ZstdError:
        return b""


def _zstd(words: bytes) -> dict:
    import zstandard

    return {"dict_data": zstandard.ZstdCompressionDict(words)} if words else {}


def chunk_store(docs: DataFrame, words: bytes) -> DataFrame:
    """(digest, packed): every chunk once, compressed with the dictionary ``words``."""

    def run(batches):
        import zstandard

        pack = zstandard.ZstdCompressor(level=LEVEL, **_zstd(words)).compress
        for b in slices(batches):
            seen: dict[bytes, bytes] = {}
            for t in b.column("text").to_pylist():
                for c in chunks(to_media(t)[0]):
                    if (d := digest(c)) not in seen:
                        seen[d] = pack(c)
            yield pa.record_batch([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.binary())], names=["digest", "packed"])

    return docs.select("text").mapInArrow(run, "digest binary, packed binary").groupBy("digest").agg(F.first("packed").alias("packed"))


def reconstruct(lists: DataFrame, store: DataFrame, words: bytes) -> DataFrame:
    """(media_key, media) of the distinct lists (media_key, digests), every chunk and every image verified."""
    parts = lists.select("media_key", F.size("digests").alias("of"), F.posexplode("digests").alias("seq", "digest"))
    # Sorted by image within a partition, the chunks of an image are read one after the other.
    parts = parts.join(store, "digest").select("media_key", "of", "seq", "digest", "packed").repartition("media_key").sortWithinPartitions("media_key", "seq")

    def run(batches):
        import zstandard

        unpack = zstandard.ZstdDecompressor(**_zstd(words)).decompress
        now, of, held = None, 0, []

        def whole() -> bytes:
            media = b"".join(held)
            if len(held) != of or hashlib.sha256(media).digest()[:KEY] != now:
                raise ValueError(f"chunks of image {now.hex()} are missing or damaged")
            return media

        for b in slices(batches, 512):
            keys, files = [], []
            for key, count, name, packed in zip(*(b.column(c).to_pylist() for c in ("media_key", "of", "digest", "packed"))):
                if key != now:
                    if now is not None:
                        keys.append(now)
                        files.append(whole())
                    now, of, held = key, count, []
                held.append(unpack(packed))
                if digest(held[-1]) != name:
                    raise ValueError(f"chunk {name.hex()} is damaged")
            yield pa.record_batch([pa.array(keys, pa.binary()), pa.array(files, pa.binary())], names=["media_key", "media"])
        if now is not None:
            yield pa.record_batch([pa.array([now], pa.binary()), pa.array([whole()], pa.binary())], names=["media_key", "media"])

    return parts.mapInArrow(run, "media_key binary, media binary")


def describe(media: DataFrame) -> DataFrame:
    """What the columns of the result need of each image read back; digests as bytes."""

    def run(batches):
        for b in slices(batches):
            rows = [[], [], [], [], [], []]
            for m in b.column("media").to_pylist():
                p = from_media(m)
                for out, x in zip(rows, (len(p), hashlib.sha256(p).digest(), zlib.crc32(p[-16:]), len(m), hashlib.sha256(m).digest(), features(p))):
                    out.append(x)
            kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.string())
            names = ["media_key", "payload_bytes", "payload_sha", "tail_crc32", "media_bytes", "media_sha", "feature"]
            yield pa.record_batch([b.column("media_key"), *[pa.array(x, t) for x, t in zip(rows, kinds)]], names=names)

    return media.mapInArrow(run, "media_key binary, payload_bytes long, payload_sha binary, tail_crc32 long, media_bytes long, media_sha binary, feature string")


def media_columns(docs: DataFrame) -> DataFrame:
    """One row per document: sizes, digests and features of its image, as read back from the chunks."""
    words = dictionary(docs)
    listed = checkpoint(chunk_lists(docs))
    lists = listed.groupBy("media_key").agg(F.first("digests").alias("digests"))
    back = describe(reconstruct(lists, chunk_store(docs, words), words))
    hexed = lambda c: F.lower(F.hex(c)).alias(f"{c}256")
    return listed.select("doc_id", "n_bytes", "media_key").join(back, "media_key").select(
        "doc_id", "n_bytes", "payload_bytes", hexed("payload_sha"), "tail_crc32", "media_bytes", hexed("media_sha"), "feature"
    )
