"""Bounded samples of labelled rows for fitting classifiers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id_column: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % folds


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: dict[int, int], fits: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(y, text) of at most per_class[y] labelled rows of each class y: those of the smallest id hashes among which `fits` holds.

    An id is one row: of repeated labels the largest counts, of texts repeated under one id that of the smallest hash. The
    chosen ids are the bounded broadcast side, so that only their texts move.
    """
    known = labels.select(F.col(id_col).alias("_id"), F.col(label).cast("int").alias("y")).where(F.col("_id").isNotNull() & F.col("y").isNotNull()).where(fits).groupBy("_id").agg(F.max("y").alias("y"))
    chosen = [known.where(F.col("y") == y).orderBy(F.xxhash64("_id"), "_id").limit(n) for y, n in per_class.items()]
    ids = reduce(DataFrame.unionByName, chosen)
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    met = rows.join(F.broadcast(ids), "_id").groupBy("_id", "y").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("one"))
    return met.select("y", "one.text")
