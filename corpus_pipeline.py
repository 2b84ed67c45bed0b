"""Corpus pipeline: quality rules, language ID, near copies, benchmark decontamination, packing.

Each stage gets the documents that its predecessor kept, written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontamination, jaccard_join, language_id, line_frequency, packing
from tidemark.llm.queries import table, tokenizer
from tidemark.shared import materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go; lines that are boilerplate of their host go from the others."""
    return line_frequency.clean_documents(docs)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language, or with one that is less likely than not, go."""
    return language_id.keep_identified(docs, language_id.fit_model(docs))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document with the smallest id stays."""
    return jaccard_join.keep_first(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens."""
    return packing.pack_documents(docs, tokenizer("byte_bpe_50k.json"), 2048)


STAGES = [("quality", quality), ("language", language), ("near_copies", near_copies), ("leaks", leaks), ("packing", packed)]

#: Language ID learns by floating-point steps and packing tokenizes: SQL expresses neither.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
