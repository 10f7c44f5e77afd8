"""Importance resampling towards a target corpus: hashed n-gram weights, Gumbel scores, exact distributed selection.

Features are runs of 1 to `runs` consecutive words; each falls into one of `buckets` by the crc32 of its UTF-8 bytes. The
counts of all documents and of all target texts give every bucket an integer gain, the smoothed log ratio; a document's
weight is the sum over its features, taken from the array of gains for a whole Arrow slice at once. Weight plus a Gumbel
number drawn from the id's digest is the score, and the highest scores are drawn: a sample without replacement whose odds
follow exp(weight / 1000).

The last key drawn is found by radix selection: the composite key (score downwards, id, number of features, row number) is
read digit by digit, from the highest bit in which the keys that are left differ. A digit's counts are at most 2**DIGIT_BITS
rows, made map-side; nothing is sorted for it. Only drawn rows are then dealt by ranges of the key and numbered: a row's
rank is its place in its range plus the rows of the ranges before.

Null texts have no features and weight 0, as do texts without words. A null id counts as the empty text where it is hashed
and as the largest id in ties. Rows repeated under one id are rows of their own; equal ones tie, and as many of them are
drawn as there is room for. Texts of any length are read whole. Empty documents give an empty result, an empty target has
no counts. Extra columns are ignored, whatever their names; drawn() keeps them.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm import buffers
from tidewire.runtime import materialise, workers_see_package

BUCKETS = 10_000
SEED = 2024
LEAST_WORDS = 20
PERCENT = 10
#: Bits of a digit of the radix selection: a round returns at most 4,096 counts.
DIGIT_BITS = 12
#: Longer features are hashed one by one, shorter ones together, byte by byte.
LONG_BYTES = 64

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = _WORD[0x80:] = True
_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, (_CRC >> 1) ^ np.uint32(0xEDB88320), _CRC >> 1)

_LOW = -(1 << 63)


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends, document) of the lower-case words of a slice; in bytes, one space follows each word."""
    data = _LOWER[data]
    inside = _WORD[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    starts = np.flatnonzero(inside & (edge[:-1] | ~np.concatenate([[False], inside[:-1]])))
    ends = np.flatnonzero(inside & (edge[1:] | ~np.concatenate([inside[1:], [False]]))) + 1
    doc = np.searchsorted(at, starts, side="right") - 1
    length = ends - starts
    fresh = np.cumsum(length + 1) - length - 1
    joined = np.full(int(length.sum()) + len(length), 32, np.uint8)
    joined[np.flatnonzero(inside) - np.repeat(starts - fresh, length)] = data[inside]
    return joined, fresh, fresh + length, doc


def crc32(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """crc32 of each span of bytes, of spans sorted by length: one byte of all those that reach it at a time."""
    length = ends - starts
    out = np.zeros(len(starts), np.uint32)
    for i in np.flatnonzero(length > LONG_BYTES).tolist():
        out[i] = zlib.crc32(data[starts[i] : ends[i]])
    order = np.flatnonzero(length <= LONG_BYTES)
    order = order[np.argsort(-length[order], kind="stable")]
    begin, size = starts[order], length[order]
    value = np.full(len(order), 0xFFFFFFFF, np.uint32)
    reach = len(order) - np.searchsorted(size[::-1], np.arange(LONG_BYTES), side="right")
    for k in range(int(size[0]) if len(size) else 0):
        now = value[: reach[k]]
        value[: reach[k]] = _CRC[(now ^ data[begin[: reach[k]] + k]) & 255] ^ (now >> 8)
    out[order] = ~value
    return out


def features(data: np.ndarray, at: np.ndarray, runs: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each feature, its document, number of words of each document) of a slice of texts."""
    joined, starts, ends, doc = words(data, at)
    number = np.bincount(doc, minlength=len(at) - 1)
    value, owner = [], []
    for k in range(runs):
        whole = np.flatnonzero(doc[: len(doc) - k] == doc[k:]) if len(doc) > k else np.zeros(0, np.int64)
        value.append(crc32(joined, starts[whole], ends[whole + k]) % buckets)
        owner.append(doc[whole])
    return np.concatenate(value).astype(np.int64), np.concatenate(owner), number


def counted(texts: DataFrame, text_col: str, runs: int, buckets: int) -> np.ndarray:
    """Features of all texts by bucket; a task sends at most `buckets` sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in buffers.slices(batch, "text"):
                sums += np.bincount(features(*buffers.utf8(part.column("text")), runs, buckets)[0], minlength=buckets)
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(sums[some])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for row in texts.select(F.col(text_col).alias("text")).mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row["bucket"]] = row["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))) of each bucket."""
    more, all_of = float(corpus.sum() + len(corpus)), float(target.sum() + len(target))
    return np.array([math.floor(1000 * math.log((t + 1) * more / ((s + 1) * all_of))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def gumbel(id_column: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln u)), u from the first 32 bits of the digest of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_column.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def scored(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", runs: int = 1, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """One row per document: id, h (hash of its text), n_words, n_features, weight, score."""
    workers_see_package(docs.sparkSession)
    gain = gains(counted(docs, text_col, runs, buckets), counted(target, target_col, runs, buckets))
    key = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in buffers.slices(batch, "text"):
                bucket, owner, number = features(*buffers.utf8(part.column("text")), runs, buckets)
                found = np.bincount(owner, minlength=part.num_rows)
                weight = np.zeros(part.num_rows, np.int64)
                np.add.at(weight, owner, gain[bucket])
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("h"), pa.array(number), pa.array(found), pa.array(weight)], ["id", "h", "n_words", "n_features", "weight"])

    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    weighed = rows.mapInArrow(run, f"id {key}, h bigint, n_words bigint, n_features bigint, weight bigint")
    return weighed.withColumn("score", F.col("weight") + gumbel(F.col("id"), seed))


def upto(rows: DataFrame, parts: list[str], k: int) -> Column:
    """The condition that holds for exactly the k least rows by the bigint columns `parts` (together unique), 0 < k < rows.

    Each round counts the next digit of the keys that may still be the k-th.
    """
    held: list[Column] = []
    below: list[Column] = []
    for part in parts:
        unsigned = F.col(part).bitwiseXOR(F.lit(_LOW))
        left = reduce(lambda df, c: df.where(c), held, rows)
        same, either = left.agg(F.bit_and(unsigned), F.bit_or(unsigned)).first()
        differ = (same ^ either) & (1 << 64) - 1
        high, value = differ.bit_length(), same & (1 << 64) - 1
        value = value >> high << high
        while high:
            shift = max(0, high - DIGIT_BITS)
            digit = F.shiftrightunsigned(unsigned, shift).bitwiseAND((1 << (high - shift)) - 1)
            here = [F.shiftrightunsigned(unsigned, high) == F.lit(value >> high)] if high < 64 else []
            counts = sorted(map(tuple, reduce(lambda df, c: df.where(c), here, left).groupBy(digit.alias("digit")).count().collect()))
            for d, n in counts:
                if k <= n:
                    break
                k -= n
            value |= d << shift
            high = shift
            if k == n:
                return reduce(lambda a, b: a | b, [*below, _all(held, F.col(part) <= F.lit(_signed(value | (1 << shift) - 1)))])
        this = F.lit(_signed(value))
        below.append(_all(held, F.col(part) < this))
        held.append(F.col(part) == this)
    return reduce(lambda a, b: a | b, [*below, _all(held)])


def _signed(value: int) -> int:
    return value + _LOW


def _all(conditions: list[Column], *more: Column) -> Column:
    return reduce(lambda a, b: a & b, [*conditions, *more])


def ranked(rows: DataFrame, parts: list[str]) -> DataFrame:
    """rows with rank: their place, from 1, by `parts`; dealt by ranges and numbered inside each."""
    dealt = rows.repartitionByRange(*parts).sortWithinPartitions(*parts).withColumn("_place", F.monotonically_increasing_id())
    placed = materialise(dealt)
    sizes = sorted(map(tuple, placed.groupBy(F.shiftright("_place", 33).alias("_range")).count().collect()))
    before, table = 0, []
    for number, n in sizes:
        table.append((number, before))
        before += n
    offsets = F.broadcast(placed.sparkSession.createDataFrame(table, "_range bigint, _before bigint"))
    return placed.join(offsets, F.shiftright("_place", 33) == F.col("_range")).withColumn("rank", F.col("_before") + F.col("_place").bitwiseAND((1 << 33) - 1) + 1).drop("_place", "_range", "_before")


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, id_col: str = "doc_id", **options) -> DataFrame:
    """One row per document: id, h, n_words, n_features, weight, score, rank (null where not drawn)."""
    rows = scored(docs, target, id_col=id_col, **options)
    keyed = rows.withColumn("_down", -F.col("score")).withColumn("_id", F.coalesce(F.col("id").cast("bigint"), F.lit((1 << 63) - 1))).withColumn("_row", F.monotonically_increasing_id())
    keyed = materialise(keyed)
    parts = ["_down", "_id", "n_features", "_row"]
    eligible = keyed.where(F.col("n_words") >= least_words)
    n = eligible.count()
    k = percent * n // 100
    own = keyed.columns[:6]
    none = F.lit(None).cast("bigint").alias("rank")
    if not k:
        return keyed.select(*own, none).withColumnRenamed("id", id_col)
    drawn_rows = (F.col("n_words") >= least_words) & (upto(eligible, parts, k) if k < n else F.lit(True))
    out = ranked(keyed.where(drawn_rows), parts).select(*own, "rank").union(keyed.where(~drawn_rows).select(*own, none))
    return out.withColumnRenamed("id", id_col)


def drawn(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The drawn documents with all their columns, and _rank; equal rows (id and text) come together, with their best rank."""
    some = resampled(docs, target, id_col=id_col, text_col=text_col, **options).where("rank IS NOT NULL")
    some = some.groupBy(F.col(id_col).alias("_id"), F.col("h").alias("_h")).agg(F.min("rank").alias("_rank"))
    return docs.join(some, F.col(id_col).eqNullSafe(F.col("_id")) & (F.xxhash64(text_col) == F.col("_h"))).drop("_id", "_h")
