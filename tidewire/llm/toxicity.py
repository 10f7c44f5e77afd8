"""Toxicity by multiple-instance learning: sentences are scored, documents combine them by noisy-or.

A sentence's probability is a logistic function of the hashed words it holds; a document's is 1 - prod(1 - p_sentence).
Only documents carry labels, so the weights are trained through the noisy-or; the sentences that reach half the
document's cut are the offending ones, with their places in the text.

The fit uses at most SAMPLE labelled rows of each class; its vocabulary is the VOCABULARY word hashes that tell the
classes apart best. Every sentence of every whole text is scored, whatever its length. Null texts count as empty and
score the prior of a document without sentences. With no labelled rows of one class the score is constant (that class's).
Rows repeated under one id each get a score, and equal texts get equal ones, so ties need no order. An empty table gives
an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm import buffers, sampling
from tidewire.runtime import materialise, workers_see_package

#: Labelled rows that a fit uses at most: of class 1, of class 0.
SAMPLE = {1: 4_000, 0: 8_000}
VOCABULARY = 4_000
#: Besides whole words, their first so many bytes count as words, since endings vary.
BEGINNINGS = (4, 5, 6)
BUCKETS = 1 << 20
STEPS = 300

_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".!?\n"]] = True


def features_of(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of lower-case text, for each word and each of its longer beginnings: document, sentence (counted through the batch), hash bucket."""
    inside = _IN_WORD[data]
    for k in range(3):
        inside[_wide_ends(data) - k] = False
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    starts = np.flatnonzero(inside & (edge[:-1] | ~np.concatenate([[False], inside[:-1]])))
    ends = np.flatnonzero(inside & (edge[1:] | ~np.concatenate([inside[1:], [False]]))) + 1
    breaks = _breaks(data, at)
    sentence = np.cumsum(breaks)[starts] if len(starts) else np.zeros(0, np.int64)
    doc = np.searchsorted(at, starts, side="right") - 1
    prefix = buffers.prefix_hash(data)
    parts = [(doc, sentence, buffers.span_hash(prefix, starts, ends))]
    for n in BEGINNINGS:
        long = ends - starts > n
        parts.append((doc[long], sentence[long], buffers.span_hash(prefix, starts[long], starts[long] + n) ^ np.uint64(n << 50)))
    doc, sentence, bucket = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(doc, kind="stable")
    return doc[order], sentence[order], (bucket[order] % np.uint64(BUCKETS)).astype(np.int64)


def _wide_ends(data: np.ndarray) -> np.ndarray:
    """Last bytes of the sentence ends beyond ASCII: 。 ！ ？ …"""
    last = np.flatnonzero((data == 0x82) | (data == 0x81) | (data == 0x9F) | (data == 0xA6))
    last = last[last >= 2]
    three = (data[last - 2].astype(np.int64) << 16) | (data[last - 1].astype(np.int64) << 8) | data[last]
    return last[(three == 0xE38082) | (three == 0xEFBC81) | (three == 0xEFBC9F) | (three == 0xE280A6)]


def _breaks(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where a sentence begins: behind an end mark, and with another text."""
    marks = _ENDS[data]
    marks[_wide_ends(data)] = True
    breaks = np.zeros(len(data), bool)
    breaks[1:] = marks[:-1]
    inner = at[1:-1]
    breaks[inner[inner < len(data)]] = True
    return breaks


def tally(doc: np.ndarray, bucket: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, documents of class 1 that hold it, documents of class 0)."""
    pairs = np.unique(doc * BUCKETS + bucket)
    buckets, place = np.unique(pairs % BUCKETS, return_inverse=True)
    toxic = y[pairs // BUCKETS] == 1
    return buckets, np.bincount(place[toxic], minlength=len(buckets)), np.bincount(place[~toxic], minlength=len(buckets))


def fit(doc: np.ndarray, sentence: np.ndarray, word: np.ndarray, y: np.ndarray, buckets: np.ndarray, odds: np.ndarray) -> dict:
    """Weights from the sample's vocabulary words (document, sentence, place in buckets) and a label per document."""
    n1, n0 = int((y == 1).sum()), int((y == 0).sum())
    if not n1 or not n0:
        return {"only": float(n1 > 0)}
    size = len(buckets)
    s_ids, s_of = np.unique(sentence, return_inverse=True)
    s_doc = np.zeros(len(s_ids), np.int64)
    s_doc[s_of] = doc
    cells = np.unique(s_of * (size + 1) + word)
    rows, cols = cells // (size + 1), cells % (size + 1)
    weight, bias = np.clip(odds, -2, 4) * 0.3, -4.0
    m = [np.zeros(size), 0.0]
    v = [np.zeros(size), 0.0]
    n = len(y)
    for step in range(1, STEPS + 1):
        z = np.clip(bias + np.bincount(rows, weight[cols], len(s_ids)), -30, 30)
        p = 1 / (1 + np.exp(-z))
        none = np.bincount(s_doc, np.log1p(-np.minimum(p, 1 - 1e-12)), n)  # log of no offending sentence
        whole = np.maximum(1 - np.exp(none), 1e-9)
        #: d loss / d z: p for a clean document, -p (1 - P) / P for a toxic one; classes weigh alike.
        pull = np.where(y == 1, -(1 - whole) / whole / n1, 1 / n0)
        dz = p * pull[s_doc]
        g = [np.bincount(cols, dz[rows], size) + 1e-5 * weight, dz.sum()]
        for k in range(2):
            m[k] = 0.9 * m[k] + 0.1 * g[k]
            v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
            move = 0.05 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-9)
            if k == 0:
                weight = weight - move
            else:
                bias = min(bias - move, -3.0)
    model = {"buckets": buckets, "weights": weight, "bias": float(bias), "shift": 0.0}
    z = bias + np.bincount(rows, weight[cols], len(s_ids))
    none = np.bincount(s_doc, np.log1p(-np.minimum(1 / (1 + np.exp(-np.clip(z, -30, 30))), 1 - 1e-12)), n)
    logit = _logit(none)
    order = np.argsort(-logit, kind="stable")
    hits, false = np.cumsum(y[order] == 1), np.cumsum(y[order] == 0) * (n1 / n0) * 4
    last = np.append(np.diff(logit[order]) != 0, True)
    f1 = np.where(last, 2 * hits / (hits + false + n1), 0)
    k = int(np.argmax(f1))
    model["shift"] = float((logit[order][k] + logit[order][min(k + 1, n - 1)]) / 2)
    return model


def _logit(none: np.ndarray) -> np.ndarray:
    """Log odds of 1 - exp(none)."""
    none = np.minimum(none, -1e-12)
    return np.log(-np.expm1(none)) - none


def in_vocabulary(doc: np.ndarray, sentence: np.ndarray, bucket: np.ndarray, buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The features among `buckets` (sorted), with their places there."""
    if not len(buckets):
        return doc[:0], sentence[:0], bucket[:0]
    at = np.minimum(np.searchsorted(buckets, bucket), len(buckets) - 1)
    hit = buckets[at] == bucket
    return doc[hit], sentence[hit], at[hit]


def sentence_logits(doc: np.ndarray, sentence: np.ndarray, bucket: np.ndarray, model: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, sentence, log odds) of the sentences that hold a word of the vocabulary."""
    doc, sentence, word = in_vocabulary(doc, sentence, bucket, model["buckets"])
    if not len(doc):
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    order = np.lexsort((word, sentence))
    doc, sentence, word = doc[order], sentence[order], word[order]
    once = np.append(True, (sentence[1:] != sentence[:-1]) | (word[1:] != word[:-1]))
    doc, sentence, word = doc[once], sentence[once], word[once]
    first = np.flatnonzero(np.append(True, sentence[1:] != sentence[:-1]))
    return doc[first], sentence[first], model["bias"] + np.add.reduceat(model["weights"][word], first)


def score_of(docs: int, doc: np.ndarray, logits: np.ndarray, model: dict) -> np.ndarray:
    """Noisy-or of the sentences' probabilities, moved so that the fit's best cut is at 0.5."""
    p = 1 / (1 + np.exp(-np.clip(logits, -30, 30)))
    none = np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-12)), docs)
    return 1 / (1 + np.exp(-np.clip(_logit(none) - model["shift"], -30, 30)))


def train(docs: DataFrame, labels: DataFrame, fits: Column, id_col: str = "doc_id", text_col: str = "text", sample: dict[int, int] | None = None) -> dict:
    """Fit on a bounded sample of the labelled rows among which `fits` (a condition on `_id`) holds."""
    workers_see_package(docs.sparkSession)
    rows = sampling.labelled_sample(docs, labels, "toxic", sample or SAMPLE, fits, id_col, text_col).withColumn("text", F.lower("text"))

    rows = materialise(rows)
    sizes = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return {"only": float(n1 > 0)}

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in buffers.slices(batch, "text"):
                doc, _, bucket = features_of(*buffers.utf8(part.column("text")))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in tally(doc, bucket, part.column("y").to_numpy())], ["bucket", "ones", "zeros"])

    both, share = F.col("ones") + F.col("zeros"), n1 / (n1 + n0)
    expected = both * F.lit(share)
    gain = F.pow(F.col("ones") - expected, 2) / (expected * (1 - both / F.lit(float(n1 + n0))) + 1e-9)
    counts = rows.mapInArrow(counted, "bucket bigint, ones bigint, zeros bigint").groupBy("bucket").agg(F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros"))
    top = counts.where(both >= 5).withColumn("gain", gain).where("gain > 8").orderBy(F.desc("gain"), "bucket").limit(VOCABULARY).toPandas().sort_values("bucket")
    ones, zeros, buckets = (top[c].to_numpy() for c in ("ones", "zeros", "bucket"))
    odds = np.log((ones + 0.2) / (n1 - ones + 0.2)) - np.log((zeros + 0.2) / (n0 - zeros + 0.2))

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in buffers.slices(batch, "text"):
                doc, sentence, word = in_vocabulary(*features_of(*buffers.utf8(part.column("text"))), buckets)
                for k in range(part.num_rows):
                    own = slice(np.searchsorted(doc, k), np.searchsorted(doc, k, side="right"))
                    base = sentence[own].min() if own.stop > own.start else 0
                    yield pa.RecordBatch.from_arrays([part.column("y").slice(k, 1), pa.array([np.unique((sentence[own] - base) * BUCKETS + word[own]).tobytes()], pa.binary())], ["y", "cells"])

    got = rows.mapInArrow(held, "y int, cells binary").toPandas().sort_values(["y", "cells"])
    cells = [np.frombuffer(c, np.int64) for c in got["cells"]]
    offset = np.cumsum([0, *[int(c[-1] // BUCKETS) + 1 if len(c) else 1 for c in cells]])[:-1]
    flat = np.concatenate([*cells, np.zeros(0, np.int64)])
    doc = np.repeat(np.arange(len(cells)), [len(c) for c in cells])
    return fit(doc, flat // BUCKETS + offset[doc], flat % BUCKETS, got["y"].to_numpy(), buckets, odds)


def scored(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, score, offending (array of {start, length, probability}; places in code points of the text)."""
    #: Lower case keeps every place: the one letter that becomes two is replaced first.
    rows = docs.select(F.col(id_col).alias("id"), F.lower(F.translate(F.coalesce(F.col(text_col), F.lit("")), "İ", "i")).alias("text"))
    key = rows.schema["id"].dataType.simpleString()
    span = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("probability", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in buffers.slices(batch, "text"):
                n = part.num_rows
                if "only" in model:
                    yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(np.full(n, model["only"])), pa.array([[]] * n, pa.list_(span))], ["id", "score", "offending"])
                    continue
                data, at = buffers.utf8(part.column("text"))
                doc, sentence, logits = sentence_logits(*features_of(data, at), model)
                score = score_of(n, doc, logits, model)
                found = [[] for _ in range(n)]
                bad = np.flatnonzero(logits >= model["shift"] - np.log(2))
                if len(bad):
                    number = np.cumsum(_breaks(data, at))
                    for k in bad:
                        a, b = np.searchsorted(number, sentence[k]), np.searchsorted(number, sentence[k], side="right")
                        a, b = max(a, at[doc[k]]), min(b, at[doc[k] + 1])
                        chars = lambda i, j: len(bytes(data[i:j]).decode("utf-8", "ignore"))
                        found[doc[k]].append({"start": chars(at[doc[k]], a), "length": chars(a, b), "probability": float(1 / (1 + np.exp(-logits[k])))})
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(score), pa.array(found, pa.list_(span))], ["id", "score", "offending"])

    return rows.mapInArrow(run, f"id {key}, score double, offending array<struct<start:bigint,length:bigint,probability:double>>").withColumnRenamed("id", id_col)
