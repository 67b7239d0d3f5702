"""A corpus pipeline of five stages; each calls one operator on all rows that its predecessor kept.

Every stage takes rows with any of the columns of ``documents`` null, empty and very long texts, rows that repeat
and columns of any name, and gives the columns that it was given (the last one: those of the encoding). An empty
table goes through all stages as an empty one. What each makes of such rows is said at the stage; the operator's
own module says the rest.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import jaccard, mixing, pieces, pii, quality
from palimpsest.llm.common import checkpoint_dir, delete
from palimpsest.llm.queries import PIECES, table

#: The last stage has no SQL form, nor have the classifier and the similarity join.
ORACLE_SQL = None


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, learnt from ``labels``, doesn't reject.

    A null or empty text has the score of the bias alone; without labels nothing is rejected.
    """
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.accepted(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group of similar ones.

    Null and empty texts are alone and stay, rows with a null id too.
    """
    return jaccard.deduplicate(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars follows the text. A null text stays null, with n_chars null."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as its taken words make up its size, rounded; twice at most.

    Texts without a word have no size and are left out.
    """
    return mixing.mixed(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text of the mix; a null text would have null ids."""
    return pieces.encode(docs, PIECES)


STAGES = [
    ("quality_classifier", filter_quality),
    ("ngram_jaccard_join", drop_near_copies),
    ("pii", redact_personal_data),
    ("mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written as Parquet in the checkpoint folder and read again.

    What a stage read is deleted when its successor is written; the last stage's rows stay for the caller.
    """
    at = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
        if before:
            delete(spark, before)
        before = f"{at}/{name}"
    return docs
