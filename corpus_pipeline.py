"""From raw documents to packed training sequences, stage by stage.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the next one's documents.  All but the last keep the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.llm import mixing, near_copies, packing, perplexity, pii, queries
from basketry.llm.common import Scratch, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is within their language's quantile of trusted text.

    Texts without words (null, empty) go; a null language takes the common threshold; rows with a null
    id are judged like any other; repeated rows stay or go together.
    """
    return perplexity.kept(docs, table(spark, sf_dir, "labels")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (5-word shingles, similarity 0.8 or more).

    The smallest id stays, a row without one only where no member has one; of repeated rows one stays.
    Texts without words are copies of each other.
    """
    return near_copies.keep_one(docs).select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars follows the new text.

    Null texts count as empty; repeated rows are treated alike.
    """
    clean = pii.redacted(docs.select(*COLUMNS))
    return clean.withColumn("n_chars", F.char_length("text").cast("bigint"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the sources' mixing weights ask for.

    A null source is a source of its own; texts without words go with every epoch of their source.
    """
    return mixing.mixed(docs).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences; null texts count as empty, repeated rows are packed each time."""
    return packing.pack(docs, public_tokenizers.path(queries.TOKENIZER))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("personal_data", personal_data), ("mix", mix), ("pack", pack)]

# Model scores, fingerprints and token ids can't be had in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; each result is written to the shared folder."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, _ = scratch.pin(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
