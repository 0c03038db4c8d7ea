"""A training corpus from raw documents: five stages, each a table that the next one reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake.llm import exact_lsm, jaccard, langid, mixing, sentencepiece_dropout
from notelake.llm.common import discard, materialize


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Names every document's language in ``lang`` and drops those that fit none better than all others.

    That is: null texts, texts without a letter, and texts (of a word or two) that no one language
    takes more than half of the likelihood for.
    """
    return langid.keep_identified(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents equal but for the case of A-Z, keeps the one with the largest doc_id.

    Null texts count as empty; rows without an id stay where no equal one has an id; equal rows with one id all stay.
    """
    return exact_lsm.drop_duplicates(docs, keep="largest")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies (5-word Jaccard of 0.8 or more, or op1's rule), keeps the smallest doc_id.

    Null texts count as empty; rows without an id stay where no row of their component has one; equal rows with one id all stay.
    """
    return jaccard.keep_one(docs, shingle=5, similarity=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Raises small sources towards large ones: every document is used, none more than twice.

    Null sources are one source; null and empty texts, rows without an id and repeated rows are used like others.
    """
    return mixing.mixed_documents(docs, seed=1, repetition=2.0, cover=True)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document, with a check that they decode to its text; each use of a document has its own draws.

    A null text has no ids, an empty one the piece of the leading space.
    """
    return sentencepiece_dropout.encode(docs, dropout=0.1, seed=1).withColumn("n_ids", F.size("ids").cast("long"))


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("encode", encode),
]

#: The stages learn a language model and hash shingles, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written and read again."""
    docs, made = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(*made)  # what the stage before wrote has been read
        made = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
