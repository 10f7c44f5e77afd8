"""Language identification by the nearest of several centroids per language.

A text's letters (lower case, everything else one space) become byte n-grams of 1 to 4 bytes, hashed into DIMENSIONS
slots; weights are log(1 + count) times an inverse document frequency counted over all learning rows, normalised. Each
language's sample is clustered into CENTROIDS centroids (spherical k-means); the nearest centroid by cosine gives the
language. Texts farther from it than nearly all of that centroid's own members are marked rejected.

Fits use at most SAMPLE rows per language, those of the smallest id hashes. Texts that are null or have no letter are
`und` with score 0. With no learning rows everything is `und`. Whole texts are read, whatever their length; rows repeated
under one id each get a row, and of equally near centroids the language that sorts first wins. An empty table gives an
empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.llm import buffers
from tidewire.runtime import workers_see_package

DIMENSIONS = 1 << 13
CENTROIDS = 4
SAMPLE = 400
SHARPNESS = 20.0
#: Documents per dense block.
BLOCK = 256


def letters(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}]+", " "))


def counts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A dense row of n-gram counts for each text of the concatenated bytes."""
    docs = len(at) - 1
    owner = np.repeat(np.arange(docs), np.diff(at))
    out = np.zeros(docs * DIMENSIONS)
    value = np.zeros(len(data), np.uint64)
    for n in range(1, 5):
        if len(data) < n:
            break
        value = (value[: len(data) - n + 1] << np.uint64(8)) | data[n - 1 :]
        inside = owner[n - 1 :] == owner[: len(data) - n + 1]
        slot = ((value + np.uint64(n << 40)) * np.uint64(buffers.BASE)) >> np.uint64(64 - 13)
        out += np.bincount((owner[: len(slot)] * DIMENSIONS + slot.astype(np.int64))[inside], minlength=len(out))
    return out.reshape(docs, DIMENSIONS)


def vectors(tally: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(tally, dtype=np.float64).astype(np.float32) * idf.astype(np.float32)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in buffers.slices(batch, "text"):
            for k in range(0, part.num_rows, BLOCK):
                yield part.slice(k, BLOCK)


def cluster(x: np.ndarray, k: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from far-apart rows; (centroids, least cosine that 99.5 % of a centroid's rows reach)."""
    seeds = [0]
    for _ in range(1, min(k, len(x))):
        seeds.append(int(np.argmin((x @ x[seeds].T).max(1))))
    centres = x[seeds]
    for _ in range(rounds):
        near = (x @ centres.T).argmax(1)
        sums = np.stack([x[near == c].sum(0) if (near == c).any() else centres[c] for c in range(len(centres))])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    cosine = x @ centres.T
    near = cosine.argmax(1)
    floor = np.array([np.quantile(cosine[near == c, c], 0.005) if (near == c).any() else 0.0 for c in range(len(centres))])
    return centres, floor


def train(docs: DataFrame, fits: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, centroids: int = CENTROIDS) -> dict:
    """Learn from the rows of non-null language among which `fits` (a condition on `_id`) holds.

    Centroids come from at most `sample` different rows (id and text) of each language, those of the least hashes; however
    often a row or an id repeats, every language with rows is learned.
    """
    workers_see_package(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(lang_col).alias("lang"), letters(F.col(text_col)).alias("text")).where(F.col("lang").isNotNull()).where(fits)

    def frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, docs_seen = np.zeros(DIMENSIONS, np.int64), 0
        for part in blocks(batches):
            found += (counts(*buffers.utf8(part.column("text"))) > 0).sum(0)
            docs_seen += part.num_rows
        slots = np.append(np.flatnonzero(found), -1)
        yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(np.append(found[found > 0], docs_seen))], ["slot", "docs"])

    df = {r["slot"]: r["docs"] for r in rows.select("text").mapInArrow(frequency, "slot bigint, docs bigint").groupBy("slot").agg(F.sum("docs").alias("docs")).collect()}
    total = df.pop(-1, 0)
    idf = np.log((total + 1) / (np.array([df.get(k, 0) for k in range(DIMENSIONS)]) + 1.0)) + 0.1
    hashed = rows.withColumn("h", F.xxhash64("_id", "text"))
    per_lang = {r["lang"]: max(1, r["n"]) for r in hashed.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()}
    #: The smallest hashes of each language: a share of the hash range that holds some more than `sample` different rows.
    share = F.lit(0.0)
    for lang, n in sorted(per_lang.items()):
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, (sample + 6 * sample**0.5 + 20) / n))).otherwise(share)
    some = hashed.where(F.pmod("h", F.lit(1 << 30)) / float(1 << 30) < share).groupBy("lang", "h").agg(F.min("text").alias("text"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 30)), "h"))
    some = some.withColumn("place", place).where(F.col("place") <= sample).select("lang", "place", "text")

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches):
            x = vectors(counts(*buffers.utf8(part.column("text"))), idf)
            packed = [(np.flatnonzero(r).astype("<u2").tobytes(), r[r != 0].astype("<f4").tobytes()) for r in x]
            yield pa.RecordBatch.from_arrays([part.column("lang"), part.column("place"), pa.array([p[0] for p in packed], pa.binary()), pa.array([p[1] for p in packed], pa.binary())], ["lang", "place", "slots", "weights"])

    chosen = some.mapInArrow(sparse, "lang string, place int, slots binary, weights binary").toPandas()
    centres, floors, langs = [np.zeros((0, DIMENSIONS), np.float32)], [np.zeros(0)], []
    for lang, own in chosen.sort_values(["lang", "place"]).groupby("lang", sort=True):
        x = np.zeros((len(own), DIMENSIONS), np.float32)
        for k, (s, w) in enumerate(zip(own["slots"], own["weights"], strict=True)):
            x[k, np.frombuffer(s, "<u2")] = np.frombuffer(w, "<f4")
        c, f = cluster(x, centroids)
        centres.append(c)
        floors.append(f)
        langs += [lang] * len(c)
    return {"idf": idf.astype(np.float32), "centres": np.concatenate(centres).astype(np.float32), "floors": np.concatenate(floors), "langs": langs}


def predicted(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, lang_pred, score, cosine (to the nearest centroid), rejected."""
    rows = docs.select(F.col(id_col).alias("id"), letters(F.col(text_col)).alias("text"))
    key = rows.schema["id"].dataType.simpleString()
    names = sorted(set(model["langs"]))
    member = np.array([names.index(x) for x in model["langs"]], int)
    shared = docs.sparkSession.sparkContext.broadcast((model["idf"], model["centres"], model["floors"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, centres, floors = shared.value
        for part in blocks(batches):
            data, at = buffers.utf8(part.column("text"))
            known = (np.diff(at) > 0) & bool(names)
            score, cosine, far, pred = np.zeros(part.num_rows), np.zeros(part.num_rows), np.ones(part.num_rows, bool), np.zeros(part.num_rows, int)
            if names:
                all_cosines = vectors(counts(data, at), idf) @ centres.T
                near = all_cosines.argmax(1)
                best = np.stack([all_cosines[:, member == k].max(1) for k in range(len(names))], 1)
                pred, cosine = best.argmax(1), best.max(1).astype(float)
                odds = np.exp(SHARPNESS * (best - best.max(1, keepdims=True)))
                score, far = (odds.max(1) / odds.sum(1)).astype(float), cosine < floors[near]
            label = [names[p] if k else "und" for p, k in zip(pred, known, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(label, pa.string()), pa.array(np.where(known, score, 0.0)), pa.array(np.where(known, cosine, 0.0)), pa.array(np.where(known, far, True))], ["id", "lang_pred", "score", "cosine", "rejected"])

    return rows.mapInArrow(run, f"id {key}, lang_pred string, score double, cosine double, rejected boolean").withColumnRenamed("id", id_col)
