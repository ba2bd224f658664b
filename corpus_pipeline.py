"""Corpus pipeline: toxicity filter, exact dedup, near-duplicate join,
substring dedup, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows its
predecessor kept; ``run`` writes each result as Parquet below the shared
checkpoint folder and reads it back as the next stage's input.  All stages
but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmap.llm import exact_dedup, jaccard_join, packing, sentence_dedup, toxicity
from docmap.llm.common import read_table, stored
from docmap.llm.queries import TOKENIZER, toxicity_model

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject (score below 0.3)."""
    return toxicity.drop_toxic(docs, toxicity_model(spark, sf_dir))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id."""
    return exact_dedup.drop_exact_copies(docs, keep="largest")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the least doc_id) of each group of near duplicates:
    sets of five-word shingles with a Jaccard similarity of 0.8 or more."""
    return jaccard_join.keep_one_of_each(docs, k=5, percent=80)


def repeated_sentences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without sentences that repeat a passage of an earlier document."""
    cut = sentence_dedup.drop_repeated_sentences(docs)
    return cut.withColumn("n_chars", F.char_length("text").cast("bigint"))


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens, with their ids."""
    return packing.pack_texts(docs, public_tokenizers.path(TOKENIZER))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity_filter),
    ("exact_dedup", exact_copies),
    ("jaccard_join", near_copies),
    ("sentence_dedup", repeated_sentences),
    ("packing", packed_sequences),
]

# The classifier and the packing order are beyond SQL; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
