"""Classification of documents by patterns and a language model."""

from __future__ import annotations

import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions.catalog import PATTERNS
from palimpsest.operators import chunking, entities, hits, lanes, model
from palimpsest.sources.batches import slices
from palimpsest.sources.shared import stored

#: Detections of a chunk come after those of the whole document, chunk after chunk.
_CHUNK_STRIDE = 1_000_000_000_000


def _chunk_hits(chunks: DataFrame, template: str, client: model.Client, patterns, calls: dict) -> DataFrame:
    """(doc_id, chunk_index, text, hits): of each chunk the reply's detections, or its pattern hits where there is no good reply."""
    prompted = lambda d: d.withColumn("prompt", model.prompt_for_chunk(template, F.col("text")))
    # What is asked and what is answered are two readings of the chunks, so they are stored.
    answers = model.ask(prompted(chunks), client) if client is model.silent else lanes.answered(prompted(stored(chunks, "chunks")), client, **calls)
    return _answer_hits(answers, patterns).select("doc_id", "chunk_index", "text", "hits")


def _answer_hits(answers: DataFrame, patterns) -> DataFrame:
    """Answers (text, reply, error, …) with their ``hits``."""
    answers = model.good_replacements(answers, "_replaced")
    by_pattern = entities.hit_list(F.col("text"), patterns)
    return answers.withColumn("hits", F.when(F.col("_replaced").isNotNull(), _model_hits(F.col("_replaced"))).otherwise(by_pattern)).drop("_replaced")


def _model_hits(replaced: Column) -> Column:
    """The replacements of a good reply as a list of ``entities.HIT``."""
    return F.transform(
        replaced,
        lambda r, i: F.struct(i.cast("long"), r["original"], r["placeholder"], F.coalesce(r["category"], F.lit("UNKNOWN")), F.coalesce(r["confidence"], F.lit(0.9)), F.coalesce(r["reason"], F.lit(""))).cast(entities.HIT),
    )


def _parts(docs: DataFrame, size: str, call=None) -> DataFrame:
    """(doc_id, chunk_index, whole, text) of the parts of each document, with reply and error where there is a ``call`` for its chunks.

    A part that is ``whole`` is the text of its document; one without a chunk_index is no chunk. So a document of one chunk is one row.
    """
    short = chunking.always_whole(size)
    schema = "doc_id long, chunk_index int, whole boolean, text string" + (", reply string, error string" if call else "")
    kinds = (pa.int64(), pa.int32(), pa.bool_(), pa.string(), pa.string(), pa.string())
    names = [c.split(" ")[0] for c in schema.split(", ")]

    def parts(batch: pa.RecordBatch) -> list[list]:
        ids, index, whole, own = [], [], [], []
        for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            if t is None:
                continue
            more, first = [], 0
            if len(t) > short or t.isspace() or not t:
                more = [c[0] for c in chunking.chunk_text(t, size)]
                more, first = ([], 0) if more == [t] else (more, None)
            ids.append(d)
            index.append(first)
            whole.append(True)
            own.append(t)
            if more:
                ids += [d] * len(more)
                index += range(len(more))
                whole += [False] * len(more)
                own += more
        return [ids, index, whole, own, *(call([None if k is None else t for k, t in zip(index, own)]) if call else ())]

    def run(batches):
        for b in slices(batches, 256):
            yield pa.record_batch([pa.array(c, t) for c, t in zip(parts(b), kinds)], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _asked_in_lanes(docs: DataFrame, template: str, client: model.Client, size: str, patterns, calls: dict) -> DataFrame:
    """(doc_id, whole, chunk_index, found, told) of the parts of each document, its chunks asked in lanes.

    Parts are stored with what patterns find in whole ones, so each text is searched once: where a document is one chunk, that is its
    pattern hits and those of a chunk without a good reply. Chunks of longer documents are searched only where they have no good reply.
    """
    prompt = F.when(F.col("chunk_index").isNotNull(), model.prompt_for_chunk(template, F.col("text")))
    parts = stored(_parts(docs, size).withColumn("found", F.when(F.col("whole"), hits.found_in(F.col("text"), patterns))), "parts")
    answers = model.good_replacements(lanes.answered(parts.withColumn("prompt", prompt), client, **calls).drop("prompt"), "_replaced")
    told = entities.grounded_hits(_model_hits(F.col("_replaced")), F.col("text"))
    own = F.when(F.col("whole"), F.col("found")).when(F.col("_replaced").isNull(), hits.found_in(F.col("text"), patterns))
    return answers.select("doc_id", "whole", "chunk_index", own.alias("found"), told.alias("told"))


def _chunk_seq(hit_seq):
    return (F.col("chunk_index").cast("long") + 1) * _CHUNK_STRIDE + hit_seq


def chunk_detections(chunks: DataFrame, template: str, client: model.Client = model.silent, patterns=PATTERNS, **calls) -> DataFrame:
    """The model's grounded detections of each chunk; pattern hits of a chunk whose call fails, or whose reply is an error or spoilt.

    Equal chunks are sent once, when this is called; ``calls`` are parameters of ``lanes.answered``. Both cases are one
    projection of the reply.
    """
    found = _chunk_hits(chunks, template, client, patterns, calls).select("doc_id", "chunk_index", "text", F.explode("hits").alias("hit"))
    found = found.select("doc_id", "chunk_index", "text", _chunk_seq(F.col("hit.seq")).alias("seq"), "hit.original", "hit.placeholder", "hit.category", "hit.confidence", "hit.reason")
    return entities.grounded(found).drop("text")


def classify(docs: DataFrame, template: str, client: model.Client = model.silent, size: str = "max", patterns=PATTERNS, paragraphs: DataFrame | None = None, **calls) -> DataFrame:
    """Detections of patterns in whole documents and of the model in their chunks, reconciled.

    ``paragraphs``, detections of an earlier phase in the same columns, come first of all. Documents of a client that needs no lanes are
    read once: patterns run where its replies are.
    """
    row = F.struct((F.col("seq").cast("long") - _CHUNK_STRIDE).alias("seq"), "original", "placeholder", "category", "confidence", "reason")
    if client is not model.silent:
        found = _asked_in_lanes(docs, template, client, size, patterns, calls)
        if paragraphs is not None:
            earlier = paragraphs.select("doc_id", F.lit(False).alias("whole"), F.lit(None).cast("int").alias("chunk_index"), F.lit(None).cast(hits.FOUND).alias("found"), F.array(row.cast(entities.HIT)).alias("told"))
            found = earlier.unionByName(found)
        return hits.reconcile_found(found, patterns, _CHUNK_STRIDE)
    call = model.chunk_caller(template, client)
    by_chunk = _answer_hits(_parts(docs, size, call), patterns)
    by_chunk = by_chunk.withColumn("hits", entities.grounded_hits(F.col("hits"), F.col("text")))
    moved = F.transform("hits", lambda h: h.withField("seq", _chunk_seq(h["seq"])))
    none = F.array().cast(f"array<{entities.HIT}>")
    by_document = F.when(F.col("whole"), entities.hit_list(F.col("text"), patterns)).otherwise(none)
    found = by_chunk.select("doc_id", F.concat(by_document, F.when(F.col("chunk_index").isNull(), none).otherwise(moved)).alias("hits"))
    if paragraphs is not None:
        # Their tasks run first, so a failure there ends the run before the rest is worked.
        found = paragraphs.select("doc_id", F.array(row).alias("hits")).unionByName(found)
    return entities.reconcile_lists(found)


def classify_or_patterns(docs: DataFrame, template: str, client: model.Client = model.silent, patterns=PATTERNS, **parameters) -> DataFrame:
    """What ``classify`` finds, run and stored here, with ``status``; where the run fails, all pattern hits as they are, and why.

    Patterns that the engine does not understand are left out and named in the status; those left keep their places in
    the order of detections.
    """
    good, bad = entities.usable_patterns(docs.sparkSession, patterns)
    skipped = "".join(f"; pattern of {category} skipped: {why}" for category, _, why in bad)
    try:
        found = stored(classify(docs, template, client, patterns=good, **parameters), "classified")
        return found.withColumn("status", F.lit("classified" + skipped))
    except Exception as e:  # noqa: BLE001 - what fails is told in the rows
        hits = entities.detect(docs, good)
        order = F.row_number().over(W.partitionBy("doc_id").orderBy("seq"))
        why = e.getCondition() if isinstance(e, PySparkException) and e.getCondition() else type(e).__name__
        return hits.withColumn("group_seq", F.col("seq")).withColumn("ord", order).withColumn("status", F.lit(f"patterns only: {why}{skipped}"))
