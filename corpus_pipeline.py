"""A corpus made ready for training: five stages, each one of the operators of ``ledgerloom.llm``.

Each stage takes all rows that the one before kept, written as Parquet and read again. All but the last return the
columns of ``documents``; the last returns the packed pieces. No stage fails on nulls in any column, on empty or very long
texts, on rows that repeat or on columns beyond those of ``documents``, whatever their names: they are carried along. Ids
are whole numbers. A table without rows gives one without rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm._common import materialise
from ledgerloom.llm.binpack import pack
from ledgerloom.llm.curriculum_mix import mixed_documents
from ledgerloom.llm.exact_dedup import drop_copies
from ledgerloom.llm.lang_id import reject_undetermined
from ledgerloom.llm.ngram_join import drop_near_copies


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; null texts, texts without letters and texts between languages go.

    Rows that repeat are judged alike; where no row names a language, nothing is learnt and no document stays."""
    return reject_undetermined(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with the same text: the smallest id, a null id last, and of rows that repeat it one.

    A null text is an empty one."""
    return drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word n-grams at a Jaccard similarity of 0.8, the smallest id.

    Null and blank texts are like nothing and stay; rows without an id are not told apart and stay."""
    return drop_near_copies(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks for, in the order of their training positions.

    A null source is one of its own; texts without words take no part of the mix."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences; an empty or null text has its end token alone."""
    return pack(docs)


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("source_mix", source_mix), ("packing", packing)]

#: Models and hash orders have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
