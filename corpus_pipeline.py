"""A training-data pipeline over `documents`: language, near copies, benchmark leaks, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a frame that is written and read again for the next. All but the last return
the columns of documents. No SQL twin: language models and tokenizers cannot be said in SQL; tests compare with plain code.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docledger.llm.decontaminate import drop_contaminated
from docledger.llm.language import drop_unknown, fit, fold_of
from docledger.llm.packing import pack
from docledger.llm.personal import mask
from docledger.llm.similarity import one_of_each
from docledger.session import keep


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language go; a missing lang is filled in."""
    return drop_unknown(docs, fit(docs.filter(fold_of("doc_id", 4) != 2)))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that near-copy links connect, the document with the smallest doc_id stays. Two documents are near copies
    when their sets of five-word shingles have 80 hundredths of their union in common."""
    return one_of_each(docs, k=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten words in a row of a benchmark item, or a whole shorter item, go."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data become the name of their kind; n_chars follows the text."""
    masked = mask(docs)
    return masked.withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences with their ids, one per power-of-two piece."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id),
    ("near_copies", near_copies),
    ("decontaminate", decontaminate),
    ("personal_data", personal_data),
    ("packing", packing),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
