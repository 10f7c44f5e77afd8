"""The corpus pipeline: quality, exact duplicates, near-duplicates, source mix, tokens.

STAGES run in order, each on the Parquet that its predecessor wrote; all but the last return the columns of documents,
whatever further columns these have. Null texts are empty ones in every stage, and very long texts are read whole. An empty
table passes through, and gives an empty result. Rows repeated under one id are rows of their own, told apart by their
texts; ties go to the smaller id, a null id counting as the largest. What each stage does with them is said there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm import byte_bpe, exact_dedup, mixing, near_dedup, quality, registry
from tidewire.runtime import materialise, workers_see_package


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from all labelled ones.

    Empty texts have a score like others, and go if it is low. An id that repeats is one row of the fit (its largest label,
    the text of the smallest hash); rows are judged one by one, so equal ones go or stay together. Without labels all stay.
    """
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), F.lit(True))
    return quality.accepted(docs, model)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the longest, of equals that of the smallest id.

    White space aside all empty texts are equal, so one of them stays; of rows of one id and text one stays.
    """
    return exact_dedup.distinct_rows(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of the smallest id, then of the smallest text hash.

    Texts without words and rows without an id are no one's near-duplicates: all of them stay.
    """
    return near_dedup.one_of_each(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix by target weights: documents as many times as it takes them, none to two times.

    Texts without words are taken no time. A null source is a source of its own, the last one.
    """
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix, as digests, with the decoded bytes' digest: a row for each row.

    Empty texts have no ids and the digests of nothing.
    """
    return byte_bpe.digests(docs, registry.tokenizer_path(), registry.tokenizer_pattern())


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_duplicates),
    ("near-duplicates", near_duplicates),
    ("source mix", source_mix),
    ("byte BPE", tokens),
]

#: Classifier, sampling signatures and merges are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    workers_see_package(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
