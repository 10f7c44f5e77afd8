"""Document quality by a regularised quadratic discriminant over transformed document statistics.

Statistics of every whole text (lengths, character classes, repetition of words, word triples and lines, entropy) are
log-transformed and standardised. Each class has a mean and a covariance shrunk towards the pooled diagonal; the score
comes from the difference of the two log densities, whose Mahalanobis terms use Cholesky factors inverted once per fit.
Shrinkage is chosen on a split of the sample; a one-dimensional logistic fit maps the difference to (0, 1) so that the
best cut of the sample lies at `threshold`.

The fit uses at most SAMPLE labelled rows per class. Null texts count as empty; every row, repeated ones too, gets a
score, and equal texts get equal ones, so ties need no order. Texts of any length are read whole. With no labelled rows of
one class the score is that of the class that there is (1.0 or 0.0). An empty table gives an empty result; accepted()
keeps extra columns, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.llm import buffers, sampling
from tidewire.runtime import workers_see_package

#: Labelled rows per class that a fit uses at most.
SAMPLE = 12_000
THRESHOLD = 0.7
STATISTICS = (
    "words", "word_bytes", "word_bytes_spread", "short_words", "long_words", "upper", "digits", "symbols", "marks", "stops", "wide",
    "distinct_words", "adjacent_repeats", "top_word", "repeated_triples", "repeated_lines", "line_words", "entropy", "symbol_ends", "letters",
)

#: Byte classes: 0 other, 1 white space, 2 lower case, 3 upper case, 4 digit, 5 symbol, 6 mark, 7 stop, 8 beyond ASCII.
_KIND = np.zeros(256, np.uint8)
_KIND[[32, 9, 10, 11, 12, 13]] = 1
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 2, 3, 4, 8
_KIND[[ord(c) for c in "#$%&*@^~|<>{}[]\\/_=+`"]] = 5
_KIND[[ord(c) for c in "!?"]] = 6
_KIND[[ord(c) for c in ".,;:"]] = 7


def statistics(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row of STATISTICS for each text of the concatenated bytes."""
    docs = len(at) - 1
    size = np.maximum(np.diff(at), 1).astype(float)
    owner = np.repeat(np.arange(docs), np.diff(at))
    kind = _KIND[data]
    kinds = np.bincount(owner * 9 + kind, minlength=docs * 9).reshape(docs, 9).astype(float)
    out = np.zeros((docs, len(STATISTICS)))
    visible = kind != 1
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    starts = np.flatnonzero(visible & (edge[:-1] | ~np.concatenate([[False], visible[:-1]])))
    ends = np.flatnonzero(visible & (edge[1:] | ~np.concatenate([visible[1:], [False]]))) + 1
    word_doc = owner[starts] if len(starts) else np.zeros(0, int)
    words = np.bincount(word_doc, minlength=docs).astype(float)
    some = np.maximum(words, 1)
    length = (ends - starts).astype(float)
    per = lambda w: np.bincount(word_doc, w, docs) / some
    prefix = buffers.prefix_hash(data)
    word_hash = buffers.span_hash(prefix, starts, ends)
    mean = per(length)
    letters = np.maximum(kinds[:, 2] + kinds[:, 3] + kinds[:, 8], 1)
    same_doc = word_doc[1:] == word_doc[:-1]
    #: Distinct words and the most frequent one, from the runs of the sorted (document, hash) pairs.
    order = np.lexsort((word_hash, word_doc))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (word_hash[order][1:] != word_hash[order][:-1]) | (word_doc[order][1:] != word_doc[order][:-1])
    run_at = np.flatnonzero(fresh)
    run_size = np.diff(np.append(run_at, len(order)))
    top = np.zeros(docs)
    np.maximum.at(top, word_doc[order][run_at], run_size)
    triples = np.zeros(docs)
    if len(starts) > 2:
        key = buffers.mix64(buffers.mix64(word_hash[:-2]) + word_hash[1:-1]) + word_hash[2:]
        inside = word_doc[2:] == word_doc[:-2]
        triple_doc, key = word_doc[2:][inside], key[inside]
        triples = _repeats(key, triple_doc, np.ones(len(key)), docs) / np.maximum(np.bincount(triple_doc, minlength=docs), 1)
    #: Lines: what stands between line feeds; a repeated one counts by its bytes.
    breaks = np.flatnonzero(data == 10)
    line_start = np.unique(np.concatenate([at[:-1], breaks + 1]))
    line_start = line_start[line_start < len(data)]
    line_end = np.minimum(np.append(line_start[1:], len(data)), len(data))
    line_doc = owner[line_start] if len(line_start) else np.zeros(0, int)
    trimmed = np.maximum(line_end - (data[line_end - 1] == 10) if len(line_start) else line_end, line_start)
    lines = np.maximum(np.bincount(line_doc, minlength=docs), 1)
    repeated = _repeats(buffers.span_hash(prefix, line_start, trimmed), line_doc, (trimmed - line_start).astype(float), docs)
    counts = np.bincount(owner * 256 + data, minlength=docs * 256).reshape(docs, 256)
    share = counts / size[:, None]
    columns = {
        "words": words, "word_bytes": mean, "word_bytes_spread": np.sqrt(np.maximum(per(length**2) - mean**2, 0)), "short_words": per((length <= 3).astype(float)), "long_words": per((length >= 12).astype(float)),
        "upper": kinds[:, 3] / letters, "digits": kinds[:, 4] / size, "symbols": kinds[:, 5] / size, "marks": kinds[:, 6] / size, "stops": kinds[:, 7] / some, "wide": kinds[:, 8] / size,
        "distinct_words": np.bincount(word_doc[order][run_at], minlength=docs) / some**0.8, "adjacent_repeats": np.bincount(word_doc[1:], same_doc & (word_hash[1:] == word_hash[:-1]), docs) / some if len(starts) else np.zeros(docs), "top_word": top / some,
        "repeated_triples": triples, "repeated_lines": repeated / size, "line_words": words / lines, "entropy": -(share * np.log(np.maximum(share, 1e-12))).sum(1),
        "symbol_ends": per(np.isin(kind[ends - 1], (5, 6)).astype(float)) if len(ends) else np.zeros(docs), "letters": letters / size,
    }
    for k, name in enumerate(STATISTICS):
        out[:, k] = columns[name] if name == "entropy" else np.log(columns[name] + (1.0 if name in ("words", "word_bytes", "line_words") else 0.003))
    return out


def _repeats(key: np.ndarray, doc: np.ndarray, weight: np.ndarray, docs: int) -> np.ndarray:
    """Per document, the weight of the keys that stand earlier in it too."""
    order = np.lexsort((key, doc))
    again = np.zeros(len(key), bool)
    again[1:] = (key[order][1:] == key[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    return np.bincount(doc[order][again], weight[order][again], docs)


def fit(x: np.ndarray, y: np.ndarray, threshold: float = THRESHOLD) -> dict:
    """Means, inverse Cholesky factors, log determinants and the mapping of the density difference."""
    if len(set(y.tolist())) < 2:
        return {"only": float(y[0]) if len(y) else 1.0}
    centre, scale = x.mean(0), x.std(0) + 1e-6
    z = np.clip((x - centre) / scale, -8, 8)
    test = np.arange(len(y)) % 4 == 0
    best, loss = 0.1, np.inf
    for shrink in (0.01, 0.03, 0.1, 0.2, 0.4):
        parts = _densities(z[~test], y[~test], shrink)
        d = difference(z[test], parts)
        a, b = _logistic(d, y[test])
        p = 1 / (1 + np.exp(-np.clip(a * d + b, -30, 30)))
        got = -np.mean(np.where(y[test] == 1, np.log(p + 1e-9), np.log(1 - p + 1e-9)))
        if got < loss:
            best, loss = shrink, got
    parts = _densities(z, y, best)
    d = difference(z, parts)
    a, b = _logistic(d, y)
    order = np.argsort(d)
    ones = np.cumsum(y[order] == 1) / max((y == 1).sum(), 1)
    zeros = np.cumsum(y[order] == 0) / max((y == 0).sum(), 1)
    k = int(np.argmax(zeros - 2 * ones))  # a good document lost weighs twice a bad one kept
    cut = (d[order][k] + d[order][min(k + 1, len(d) - 1)]) / 2
    a = max(a, 0.02)
    return {"centre": centre, "scale": scale, "parts": parts, "a": a, "b": float(np.log(threshold / (1 - threshold)) - a * cut), "shrink": best}


def _densities(z: np.ndarray, y: np.ndarray, shrink: float) -> list[tuple[np.ndarray, np.ndarray, float]]:
    pooled = sum(np.cov(z[y == c].T, bias=True) * (y == c).sum() for c in (0, 1)) / len(y)
    target = np.diag(np.diag(pooled)) + 1e-4 * np.eye(z.shape[1])
    out = []
    for c in (0, 1):
        cov = (1 - shrink) * np.cov(z[y == c].T, bias=True) + shrink * target
        factor = np.linalg.cholesky(cov)
        out.append((z[y == c].mean(0), np.linalg.inv(factor), float(2 * np.log(np.diag(factor)).sum())))
    return out


def difference(z: np.ndarray, parts: list) -> np.ndarray:
    """log density of class 1 less that of class 0, clipped."""
    logs = [-0.5 * ((((z - mean) @ inverse.T) ** 2).sum(1) + logdet) for mean, inverse, logdet in parts]
    return np.clip(logs[1] - logs[0], -60, 60)


def _logistic(d: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    a, b = 0.1, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * d + b, -30, 30)))
        w = p * (1 - p) + 1e-6
        grad = np.array([((p - y) * d).sum() + 1e-3 * a, (p - y).sum()])
        hess = np.array([[(w * d * d).sum() + 1e-3, (w * d).sum()], [(w * d).sum(), w.sum()]])
        step = np.linalg.solve(hess, grad)
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -5, 5)
    return float(a), float(b)


def score_of(x: np.ndarray, model: dict) -> np.ndarray:
    if "only" in model:
        return np.full(len(x), model["only"])
    z = np.clip((x - model["centre"]) / model["scale"], -8, 8)
    return 1 / (1 + np.exp(-np.clip(model["a"] * difference(z, model["parts"]) + model["b"], -30, 30)))


def train(docs: DataFrame, labels: DataFrame, fits: Column, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> dict:
    """Fit on at most `sample` labelled rows of each class among which `fits` (a condition on `_id`) holds."""
    workers_see_package(docs.sparkSession)
    rows = sampling.labelled_sample(docs, labels, "quality", {0: sample, 1: sample}, fits, id_col, text_col)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in buffers.slices(batch, "text"):
                x = statistics(*buffers.utf8(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("y"), pa.array(list(x), pa.list_(pa.float64()))], ["y", "x"])

    got = rows.mapInArrow(measured, "y int, x array<double>").toPandas()
    x = np.stack(got["x"].to_numpy()) if len(got) else np.zeros((0, len(STATISTICS)))
    y = got["y"].to_numpy()
    order = np.lexsort((*x.T, y)) if len(y) else np.arange(0)  # the same whatever the order of the partitions
    return fit(x[order], y[order])


def scored(docs: DataFrame, model: dict, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs' columns (or those of keep) and `score`."""
    keep = docs.columns if keep is None else keep
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in buffers.slices(batch, "text"):
                x = statistics(*buffers.utf8(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(score_of(x, model))], ["row", "score"])

    schema = T.StructType([T.StructField("row", rows.schema["row"].dataType), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(run, schema).select("row.*", "score")


def accepted(docs: DataFrame, model: dict, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows that the model doesn't reject, with docs' columns."""
    kept = scored(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text_col).alias("text")), model, keep=["row"])
    return kept.where(F.col("score") >= threshold).select("row.*")
