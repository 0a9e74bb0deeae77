"""A corpus from documents to training windows, stage by stage; every stage is written and read again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from cairnbook.llm import decontaminate, langid, packing, secret_scan, simhash
from cairnbook.llm.common import written
from cairnbook.session import tune


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; learned from the labelled rows among them.

    Null texts and texts without a letter go; a table in which no row has a label goes on whole.
    """
    return langid.accepted(docs, langid.language_model(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one of smallest id; null ids count last, repeated rows are one."""
    return simhash.one_of_each(docs)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item; null and empty texts hold none, repeated rows stay repeated."""
    return decontaminate.uncontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark; null texts stay null, and rows without a secret are as they were."""
    return secret_scan.redacted(docs, secret_scan.field_of(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of 1024 ids; a null or empty text is one id, an empty table has no pieces."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("benchmark_free", benchmark_free),
          ("secrets", secrets), ("packed", packed)]

# Trained models and a tokenizer decide; SQL cannot express them.  Tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of the documents that pass all stages."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(tune(spark), docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
