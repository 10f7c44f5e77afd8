"""Vector similarity, edit similarity, and blocked similarity joins."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.functions.text import gram_text
from tidewire.runtime import checked, materialise, workers_see_package

#: Vectors of a block that are multiplied with another block, and how many rows of it at once.
BLOCK_ROWS = 4096
BLOCK_SLICE = 256

#: Rows of a block of the base that queries are searched in.
MATCH_ROWS = 32_768


def dot(a: Column, b: Column) -> Column:
    """Dot product of unit vectors in double precision; 0 if one is null."""
    return F.coalesce(F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x), F.lit(0.0))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """The vector at length 1; null for null and zero vectors."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n))


def cosine(a: Column, b: Column) -> Column:
    """True cosine; 0 for lengths that differ and for zero vectors."""
    return F.when((F.size(a) == F.size(b)) & (norm(a) > 0) & (norm(b) > 0), dot(a, b) / (norm(a) * norm(b))).otherwise(F.lit(0.0))


def centroids(rows: DataFrame, group: str, vector: str) -> DataFrame:
    """Normalised mean vector per group, summed by component before the shuffle; groups of zero norm have none."""
    flat = rows.select(group, F.posexplode(vector).alias("i", "x")).groupBy(group, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    mean = flat.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("mean"))
    return mean.withColumn("n", norm(F.col("mean"))).where("n > 0").select(group, F.transform("mean", lambda x: x / F.col("n")).alias("centroid"))


def vector_pairs(rows: DataFrame, key: str, vector: str, least: float, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(a, b, cosine) of all pairs a < b of unit vectors whose dot product is at least `least` > 0, by blocks against blocks.

    Every block meets every other once. Matrix products only choose; cosines are summed as `dot` does. Keys are bigint, one row each.
    """
    held = materialise(rows.where(F.col(vector).isNotNull()).select(F.col(key).cast("bigint").alias("k"), F.col(vector).cast("array<double>").alias("v"), F.lit(0).cast("bigint").alias("t")))
    blocks = max(1, -(-held.count() // block_rows))
    table = _blocks(held.withColumn("g", F.lit(0).cast("bigint")).withColumn("blocks", F.lit(blocks)))
    #: Around the ring of blocks: each meets itself and the half that follows it; of an even ring the first half meets its opposite.
    steps = F.explode(F.sequence(F.lit(0), F.when(F.col("i") < blocks - blocks // 2, blocks // 2).otherwise((blocks - 1) // 2)))
    left = table.withColumn("step", steps).select("d", "i", F.pmod(F.col("i") + F.col("step"), F.lit(blocks)).alias("j"), *[F.col(c).alias(f"{c}i") for c in "gktv"])
    met = left.join(table.select(F.col("i").alias("j"), "d", *[F.col(c).alias(f"{c}j") for c in "gktv"]), ["j", "d"])
    return _multiplied(met.repartition(min(blocks * (blocks + 1) // 2, 1000), "i", "j"), least, None)


def bucketed_pairs(rows: DataFrame, key: str, vector: str, bucket: Column, least: float, time: Column | None = None, within: int = 0, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(a, b, cosine) of the pairs a < b of one bucket (a bigint) whose dot product is at least `least`, by blocks against blocks.

    With a time (bigint), rows of neighbouring buckets meet too, and pairs are at most `within` apart. A bucket of any size
    is dealt into blocks. Rows without bucket, vector or time take no part.
    """
    t = F.lit(0) if time is None else time
    held = rows.select(bucket.cast("bigint").alias("g"), F.col(key).cast("bigint").alias("k"), F.col(vector).cast("array<double>").alias("v"), t.cast("bigint").alias("t"))
    held = materialise(held.where("g IS NOT NULL AND v IS NOT NULL AND t IS NOT NULL"))
    sizes = materialise(held.groupBy("g").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks")))
    table = _blocks(held.join(checked(sizes), "g"))
    targets = F.array("g") if time is None else F.array("g", F.col("g") + 1)
    left = table.withColumn("target", F.explode(targets)).select("d", "i", "target", *[F.col(c).alias(f"{c}i") for c in "gktv"])
    right = table.select(F.col("g").alias("target"), "d", F.col("i").alias("j"), *[F.col(c).alias(f"{c}j") for c in "gktv"])
    met = left.join(right, ["target", "d"]).where("gi <> gj OR i <= j")
    return _multiplied(met.repartition("gi", "i", "j"), least, within if time is not None else None)


def _blocks(dealt: DataFrame) -> DataFrame:
    """Of (g, k, t, v, blocks): a row for each block of a bucket, keys, times and vectors packed."""
    workers_see_package(dealt.sparkSession)

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        data = np.stack(pdf["v"].to_numpy())
        return pd.DataFrame({"g": [pdf["g"].iloc[0]], "i": [pdf["i"].iloc[0]], "d": [data.shape[1]], "k": [pdf["k"].to_numpy(np.int64).tobytes()], "t": [pdf["t"].to_numpy(np.int64).tobytes()], "v": [data.tobytes()]})

    rows = dealt.withColumn("i", F.pmod(F.xxhash64("k"), F.col("blocks")).cast("bigint")).withColumn("d", F.size("v")).where("d > 0").drop("blocks")
    return materialise(rows.groupBy("g", "i", "d").applyInPandas(packed, "g bigint, i bigint, d int, k binary, t binary, v binary"))


def best_matches(queries: DataFrame, base: DataFrame, least: float, shared_least: float | None = None, bonus: tuple[float, int] = (0.0, 1), block_rows: int = MATCH_ROWS, window: int = 0, others: bool = False, vectors: DataFrame | None = None) -> DataFrame:
    """(k, h, cosine, score): each query's best row of its bucket by cosine and recency; ties to the first row.

    Both sides have g (bucket), k (bigint, one row each), v (unit vector), t (day number, may be null) and c (names). Rows
    whose names are not empty need a common one, and then `shared_least` instead of `least`. bonus is (most, days): what a
    row of the query's day or later gains, falling to nothing in so many days. With a window, buckets are days, and a query
    meets the base's rows of so many days before its own. `others`: a row of the query's key is no match.

    Neighbouring buckets share heaps of about block_rows rows; a larger heap is dealt into a grid of blocks. Rows travel once,
    to the cells of the grid, with their vectors as they are; a task holds one block of the base and keeps the best row of
    each query that passes. Only these are put out and compared again: never the pairs.

    With `vectors` (r, one row each, and v) both sides name their vector by r (a bigint) in place of v. Rows then travel without
    vectors, dealt by r, and each vector travels once to every cell that names it, however many rows and buckets do.
    """
    bar = least if shared_least is None else shared_least
    held_by = [queries, base] if vectors is None else [vectors]
    kind = "float" if all(side.schema["v"].dataType.elementType == T.FloatType() for side in held_by) else "double"
    named = None if vectors is None else vectors.where("r IS NOT NULL AND v IS NOT NULL AND size(v) > 0").select(F.col("r").cast("bigint").alias("r"), F.col("v").cast(f"array<{kind}>").alias("v"))
    sizes = None if vectors is None else checked(materialise(named.select("r", F.size("v").alias("d"))))

    def narrow(side: DataFrame) -> DataFrame:
        own = [F.col("g").cast("bigint").alias("g"), F.col("k").cast("bigint").alias("k"), F.col("t").cast("bigint").alias("t"), F.coalesce("c", F.array().cast("array<string>")).alias("c")]
        if vectors is not None:
            return side.where("g IS NOT NULL").select(*own, F.col("r").cast("bigint").alias("r")).join(sizes, "r").withColumn("v", F.lit(None).cast(f"array<{kind}>"))
        return side.where("v IS NOT NULL AND g IS NOT NULL AND size(v) > 0").select(*own, F.col("v").cast(f"array<{kind}>").alias("v"), F.size("v").alias("d"), F.lit(0).cast("bigint").alias("r"))

    asking, known = narrow(queries), narrow(base)
    low, high, n = asking.agg(F.min("g"), F.max("g"), F.count("*")).first()
    span = max(1, -(-(high - low + 1) * block_rows // n)) if n else 1
    heap = lambda g: F.floor(g / span).cast("bigint")
    asking = asking.withColumn("heap", heap(F.col("g")))
    ahead = F.sequence(heap(F.col("g") + 1), heap(F.col("g") + window)) if window else F.array(heap(F.col("g")))
    known = known.withColumn("heap", F.explode(ahead))
    counted = lambda side, name: side.groupBy("heap").agg(F.ceil(F.count("*") / block_rows).cast("int").alias(name))
    grid = materialise(counted(asking, "rows").join(counted(known, "columns"), "heap"))
    cells = grid.agg(F.sum(F.col("rows").cast("bigint") * F.col("columns"))).first()[0] or 1
    dealt = lambda side, n: side.join(checked(grid), "heap").withColumn("_n", F.pmod(F.xxhash64("k" if vectors is None else "r"), F.col(n)))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["heap", "d", F.col("i").cast("int"), F.col("j").cast("int"), "asks", "g", "k", "r", "v", "t", "c"]
    by_row = lambda rows: rows.withColumn("i", F.col("_n")).withColumn("j", each("columns"))
    by_column = lambda rows: rows.withColumn("j", F.col("_n")).withColumn("i", each("rows"))
    left, right = dealt(asking, "rows"), dealt(known, "columns")
    met = by_row(left).withColumn("asks", F.lit(1)).select(*columns).union(by_column(right).withColumn("asks", F.lit(0)).select(*columns))
    if vectors is not None:
        once = lambda rows: rows.select("heap", "d", "r", "_n", "rows", "columns").distinct()
        met = met.union(by_row(once(left)).select("heap", "d", "i", "j", "r").union(by_column(once(right)).select("heap", "d", "i", "j", "r")).join(named, "r").withColumns({"asks": F.lit(-1), "g": F.lit(0).cast("bigint"), "k": F.col("r"), "t": F.lit(0).cast("bigint"), "c": F.array().cast("array<string>")}).select(*columns))
    met = met.repartition(max(1, min(cells, 2000)), "heap", "d", "i", "j").sortWithinPartitions("heap", "d", "i", "j", "asks", "g")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, known_vectors = None, [], []
        for own, batch in _cells(batches):
            if own[:4] != cell:
                cell, held, known_vectors = own[:4], [], []
            if own[4] < 0:
                known_vectors.append(batch)
                continue
            if known_vectors:
                if len(known_vectors) > 1 or "at" not in known_vectors[0]:
                    refs, first = np.unique(np.concatenate([x["r"] for x in known_vectors]), return_index=True)
                    known_vectors = [{"at": refs, "v": np.concatenate([x["v"] for x in known_vectors])[first]}]
                batch["v"] = known_vectors[0]["v"][np.searchsorted(known_vectors[0]["at"], batch["r"])]
            if not own[4]:
                held.append(batch)
                continue
            if len(held) > 1:
                held = [{c: np.concatenate([x[c] for x in held]) if c != "c" else sum((x[c] for x in held), []) for c in held[0]}]
            if held:
                best: dict[int, tuple[float, int, float]] = {}
                _keep_best(best, batch, held[0], least, bar, *bonus, window, others)
                if best:
                    yield _best_rows(best)

    found = met.mapInArrow(run, "k bigint, score double, h bigint, cosine double")
    return found.groupBy("k").agg(F.max(F.struct("score", (-F.col("h")).alias("h"), "cosine")).alias("b")).select("k", (-F.col("b.h")).alias("h"), "b.cosine", "b.score")


#: Stands for an unknown day inside blocks.
NO_DAY = -(1 << 40)


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, dict]]:
    """The parts of batches that belong to one side of one cell, as arrays."""
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy() for c in ("heap", "d", "i", "j", "asks")], 1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            part = batch.slice(a, b - a)
            day = part.column("t").fill_null(NO_DAY).to_numpy()
            flat = part.column("v").flatten().to_numpy(zero_copy_only=False).astype(float)
            yield tuple(keys[a].tolist()), {"g": part.column("g").to_numpy(), "k": part.column("k").to_numpy(), "r": part.column("r").to_numpy(), "t": day, "v": flat.reshape(b - a, -1 if len(flat) else 0), "c": part.column("c").to_pylist()}


def _keep_best(best: dict[int, tuple[float, int, float]], asking: dict, known: dict, least: float, bar: float, most: float, days: int, window: int, others: bool) -> None:
    """Compare queries with a block of the base, both in the order of buckets, and keep each query's best (score, -key, cosine)."""
    for g in np.unique(asking["g"]).tolist():
        a, b = np.searchsorted(asking["g"], [g, g + 1]).tolist()
        x, y = np.searchsorted(known["g"], [g - window, g] if window else [g, g + 1]).tolist()
        if x < y:
            parts = [side[c][u:v] for side, u, v in ((asking, a, b), (known, x, y)) for c in "ktvc"]
            _compare(best, *parts, least, bar, most, days, others)


def _compare(best: dict[int, tuple[float, int, float]], ki, ti, vi, ci, kj, tj, vj, cj, least: float, bar: float, most: float, days: int, others: bool = False) -> None:
    names = {n: x for x, n in enumerate(sorted({n for c in cj for n in c}))}
    marks = []
    for side in (ci, cj) if names else ():
        m = np.zeros((len(side), len(names)), np.float32)
        for x, own in enumerate(side):
            for n in own:
                if n in names:
                    m[x, names[n]] = 1
        marks.append(m)
    named = marks[1].any(1) if names else None
    for at in range(0, len(ki), BLOCK_SLICE):
        score = vi[at : at + BLOCK_SLICE] @ vj.T
        bars = np.broadcast_to(np.float64(least), score.shape)
        if names:
            shared = marks[0][at : at + BLOCK_SLICE] @ marks[1].T > 0
            bars = np.where(shared, bar, np.where(named, np.inf, least))
        out = score < bars - 1e-9
        gain = np.zeros((1, 1))
        if most:
            old = np.maximum(ti[at : at + BLOCK_SLICE, None] - tj[None], 0)
            unknown = (ti[at : at + BLOCK_SLICE, None] == NO_DAY) | (tj[None] == NO_DAY)
            gain = np.where(unknown, 0.0, np.maximum(0.0, (days - old) / days) * most)
            score += gain
        gain = np.broadcast_to(gain, score.shape)
        if others:
            out |= ki[at : at + BLOCK_SLICE, None] == kj[None]
        score[out] = -np.inf
        top = score.max(1) if score.shape[1] else np.full(len(score), -np.inf)
        #: Products only choose: those within rounding of the best are summed in order, as dot() does; if none reaches its bar, the next are.
        open_rows = np.flatnonzero(top > -np.inf)
        while len(open_rows):
            x, y = np.nonzero(score[open_rows] >= top[open_rows, None] - 2e-9)
            x = open_rows[x]
            cosine = np.zeros(len(x))
            for c in range(vi.shape[1]):
                cosine += vi[at + x, c] * vj[y, c]
            good = cosine >= bars[x, y]
            for q, h, cos, plus in zip(ki[at + x[good]].tolist(), kj[y[good]].tolist(), cosine[good].tolist(), gain[x[good], y[good]].tolist(), strict=True):
                new = (cos + plus, -h, cos)
                if q not in best or new > best[q]:
                    best[q] = new
            score[x, y] = -np.inf
            missed = np.setdiff1d(open_rows, x[good])
            top[missed] = score[missed].max(1)
            open_rows = missed[top[missed] > -np.inf]


def _best_rows(best: dict[int, tuple[float, int, float]]) -> pa.RecordBatch:
    score, h, cosine = zip(*best.values(), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(list(best), pa.int64()), pa.array(score), pa.array([-x for x in h], pa.int64()), pa.array(cosine)], ["k", "score", "h", "cosine"])


def _multiplied(met: DataFrame, least: float, within: int | None) -> DataFrame:
    """(a, b, cosine) of the block pairs (gi, i, ki, ti, vi, gj, j, kj, tj, vj)."""

    def multiplied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ki, kj = np.frombuffer(r["ki"], np.int64), np.frombuffer(r["kj"], np.int64)
                ti, tj = np.frombuffer(r["ti"], np.int64), np.frombuffer(r["tj"], np.int64)
                vi, vj = np.frombuffer(r["vi"]).reshape(len(ki), -1), np.frombuffer(r["vj"]).reshape(len(kj), -1)
                for at in range(0, len(ki), BLOCK_SLICE):
                    x, y = np.nonzero(vi[at : at + BLOCK_SLICE] @ vj.T >= least - 1e-9)
                    x += at
                    fit = ki[x] < kj[y] if (r["gi"], r["i"]) == (r["gj"], r["j"]) else ki[x] != kj[y]
                    if within is not None:
                        fit &= np.abs(ti[x] - tj[y]) <= within
                    x, y = x[fit], y[fit]
                    cosine = np.zeros(len(x))
                    for c in range(vi.shape[1]):
                        cosine += vi[x, c] * vj[y, c]
                    fit = cosine >= least
                    a, b = ki[x[fit]], kj[y[fit]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(cosine[fit])], ["a", "b", "cosine"])

    return met.mapInArrow(multiplied, "a bigint, b bigint, cosine double")


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence by bit-parallel rows."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & masks.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - bin(row).count("1")


def indel_ratio(a: str | None, b: str | None) -> float:
    """100 * 2 LCS / (lengths); 100 for two empty texts, 0 against null."""
    if a is None or b is None:
        return 0.0
    total = len(a) + len(b)
    return 100.0 * 2 * lcs_length(a, b) / total if total else 100.0


def token_set_ratio(a: str | None, b: str | None) -> float:
    """The best ratio among the sorted common tokens and these with either rest; 0 if a side has no tokens."""
    left, right = set((a or "").split()), set((b or "").split())
    if not left or not right:
        return 0.0
    common = " ".join(sorted(left & right))
    only_a, only_b = " ".join(sorted(left - right)), " ".join(sorted(right - left))
    if common and (not only_a or not only_b):
        return 100.0
    with_a, with_b = (f"{common} {x}".strip() for x in (only_a, only_b))
    best = indel_ratio(with_a, with_b)
    return max(best, indel_ratio(common, with_a), indel_ratio(common, with_b)) if common else best


@F.pandas_udf(T.DoubleType())
def token_set_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([token_set_ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


#: Rows of a block of texts that are compared with another block's.
TEXT_ROWS = 4096

#: Longest text that a machine word holds, and pairs that are compared at once.
WORD_BITS = 64
PAIRS_AT_ONCE = 65_536


def text_cells(rows: DataFrame, key: str, text: str, group: str, block_rows: int = TEXT_ROWS) -> DataFrame:
    """(cell, i, j, side, k, text): each pair of rows of a group meets in one cell, for a function of mapInArrow().

    Groups of any size are dealt into blocks by keys (bigint, one row each), and block i meets block j >= i in a cell: a row
    travels once to each block of its group. Rows lie by cell, left (0) before right (1); a block that meets itself is
    there once. Rows without group or text and groups of one row take no part.
    """
    held = materialise(rows.select(F.col(group).alias("g"), F.col(key).cast("bigint").alias("k"), F.col(text).alias("text")).where("g IS NOT NULL AND text IS NOT NULL"))
    sizes = held.groupBy("g").agg(F.count("*").alias("n")).where("n > 1")
    sizes = materialise(sizes.select("g", F.monotonically_increasing_id().alias("cell"), F.ceil(F.col("n") / block_rows).cast("int").alias("blocks")))
    cells = sizes.agg(F.sum(F.col("blocks").cast("bigint") * (F.col("blocks") + 1) / 2)).first()[0] or 1
    dealt = held.join(checked(sizes), "g").withColumn("own", F.pmod(F.xxhash64("k"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("cell", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("other") < F.col("own")).cast("int").alias("side"), "k", "text")
    return dealt.repartition(max(1, min(int(cells), 2000)), "cell", "i", "j").sortWithinPartitions("cell", "i", "j", "side")


def met_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[str], np.ndarray, list[str], bool]]:
    """Of each cell of text_cells(): keys and texts of either side, and whether they are one block."""
    cell, sides = None, ([], [])

    def out():
        tables = [pa.Table.from_batches(side) if side else None for side in sides]
        left, right = tables[0], tables[1] if tables[1] is not None else tables[0]
        return left.column("k").to_numpy(), left.column("text").to_pylist(), right.column("k").to_numpy(), right.column("text").to_pylist(), tables[1] is None

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy() for c in ("cell", "i", "j", "side")], 1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if tuple(keys[a, :3].tolist()) != cell:
                if sides[0] and (sides[1] or cell[1] == cell[2]):
                    yield out()
                cell, sides = tuple(keys[a, :3].tolist()), ([], [])
            sides[keys[a, 3]].append(batch.slice(a, b - a))
    if sides[0] and (sides[1] or cell[1] == cell[2]):
        yield out()


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts one after the other, and lengths."""
    return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32), np.array([len(t) for t in texts], np.int64)


class Coded:
    """Texts of two sides as numbers: letters by frequency from 1, bit masks and counts of letters, for LCS of many pairs at once."""

    def __init__(self, left: list[str], right: list[str]):
        points, self.length = _points([*left, *right])
        _, number, often = np.unique(points, return_inverse=True, return_counts=True)
        rank = np.empty(len(often), np.int64)
        rank[np.argsort(-often, kind="stable")] = np.arange(1, len(often) + 1)
        self.letters, self.n = len(often) + 1, len(left)
        row = np.repeat(np.arange(len(self.length)), self.length)
        place = np.arange(len(points)) - np.repeat(np.cumsum(self.length) - self.length, self.length)
        code = rank[number]
        self.short = self.length <= WORD_BITS
        fits = self.short[row]
        self.row, self.place, self.code = row[fits], place[fits], code[fits]
        #: Letters of the second side, a line for each place.
        self.lines = np.zeros((WORD_BITS, len(right)), np.int32)
        own = self.row >= self.n
        self.lines[self.place[own], self.row[own] - self.n] = self.code[own]
        #: How often each letter stands in a text; rare letters share counters.
        self.counts = np.zeros((len(self.length), 64), np.int32)
        np.add.at(self.counts, (row, np.where(code < 48, code, 48 + code % 16)), 1)
        most = self.counts[self.short].max(0) if self.short.any() else np.zeros(64, np.int32)
        letter, level = np.repeat(np.arange(64), most), np.concatenate([np.arange(m) for m in most.tolist()])
        #: Counts as 0-1 digits, so that products add up the lesser of two counts.
        self.digits = lambda a, b: (self.counts[a:b, letter] > level).astype(np.float32)
        self.right_digits = self.digits(self.n, None)

    def common(self, a: int, b: int) -> np.ndarray:
        """How many letters the texts a to b of the first side have in common with each of the second, in any order: at least their LCS."""
        out = self.digits(a, b) @ self.right_digits.T
        own, others = self.counts[a:b], self.counts[self.n :]
        for x in np.flatnonzero(~self.short[a:b]).tolist():
            out[x] = np.minimum(own[x], others).sum(1)
        for y in np.flatnonzero(~self.short[self.n :]).tolist():
            out[:, y] = np.minimum(own, others[y]).sum(1)
        return out

    def masks(self, a: int, b: int) -> np.ndarray:
        """For each text a to b of the first side and each letter: a bit for each place where it stands."""
        out = np.zeros((b - a, self.letters), np.uint64)
        p, q = np.searchsorted(self.row, [a, b])
        np.bitwise_or.at(out, (self.row[p:q] - a, self.code[p:q]), np.uint64(1) << self.place[p:q].astype(np.uint64))
        return out

    def lcs(self, masks: np.ndarray, x: np.ndarray, y: np.ndarray, without_x: np.ndarray | None = None, without_y: np.ndarray | None = None) -> np.ndarray:
        """LCS lengths of pairs (row of masks, text of the second side), by bit-parallel rows as in lcs_length(). Bits in `without` take places out."""
        out = np.zeros(len(x), np.int64)
        flat, one = masks.ravel(), np.uint64(1)
        for at in range(0, len(x), PAIRS_AT_ONCE):
            part = slice(at, at + PAIRS_AT_ONCE)
            base, who = x[part] * masks.shape[1], y[part]
            keep = None if without_x is None else ~without_x[part]
            row = np.full(len(who), ~np.uint64(0))
            for k in range(int(self.length[self.n + who].max())):
                hit = row & flat[base + self.lines[k, who]]
                if keep is not None:
                    hit &= keep & ((without_y[part] >> np.uint64(k) & one) - one)
                row = (row + hit) | (row - hit)
            out[part] = WORD_BITS - np.bitwise_count(row)
        return out


def ratio_pairs(left: list[str], right: list[str], least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (place in left, place in right) whose indel_ratio is at least `least`: bounds from lengths and letters by matrix products, then LCS of many pairs at once."""
    coded = Coded(left, right)
    la, lb = coded.length[: coded.n], coded.length[coded.n :]
    for at in range(0, len(left), BLOCK_SLICE):
        end = min(at + BLOCK_SLICE, len(left))
        total = la[at:end, None] + lb[None]
        need = least * total / 200 - 1e-9
        x, y = np.nonzero((np.minimum(la[at:end, None], lb[None]) >= need) & (coded.common(at, end) >= need))
        fits = coded.short[at + x] & coded.short[coded.n + y]
        lcs = np.zeros(len(x), np.int64)
        lcs[fits] = coded.lcs(coded.masks(at, end), x[fits], y[fits])
        for k in np.flatnonzero(~fits).tolist():
            lcs[k] = lcs_length(left[at + x[k]], right[y[k]])
        total = total[x, y]
        good = np.where(total > 0, 100.0 * 2 * lcs / np.maximum(total, 1), 100.0) >= least
        yield at + x[good], y[good]


def ngram_pairs(rows: DataFrame, key: str, text: str, block: str, least: float, block_rows: int = TEXT_ROWS) -> DataFrame:
    """D04 join: pairs (k1 < k2) of one block with n-gram Jaccard of at least `least` > 0; keys are bigint, one row each.

    Rows travel as their texts, once to each block of text_cells(). A task counts the grams in common through the lists of
    one side's grams, and puts out the pairs that pass, not the candidates.
    """
    clean = rows.select(F.col(key).alias("k"), F.col(block).alias("b"), gram_text(F.col(text)).alias("c")).where("c <> ''")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ka, ta, kb, tb, same in met_texts(batches):
            for x, y, m, u in gram_overlaps(ta, tb, least):
                a, b = ka[x], kb[y]
                fit = a < b if same else a != b
                a, b = a[fit], b[fit]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(m[fit]), pa.array(u[fit])], ["k1", "k2", "m", "u"])

    workers_see_package(rows.sparkSession)
    met = text_cells(clean, "k", "c", "b", block_rows).mapInArrow(run, "k1 bigint, k2 bigint, m bigint, u bigint")
    return met.select("k1", "k2", F.round(F.col("m") / F.col("u"), 4).alias("overlap"))


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text, gram) of the distinct 3-grams of each text, three code points in a number; shorter texts are their own grams."""
    points, length = _points(texts)
    row, start = np.repeat(np.arange(len(texts)), length), np.cumsum(length) - length
    padded = np.concatenate([points.astype(np.int64), np.zeros(2, np.int64)])
    ends = np.repeat(start + length, length) - np.arange(len(points))
    second, third = (np.where(ends > n, padded[n : n + len(points)], 0) for n in (1, 2))
    first = np.where(length[row] >= 3, ends >= 3, ends == length[row])
    both = np.unique(np.stack([row, points.astype(np.int64) << 42 | second << 21 | third], 1)[first], axis=0)
    return both[:, 0], both[:, 1]


def gram_overlaps(left: list[str], right: list[str], least: float, rows: int = 64) -> Iterator[tuple[np.ndarray, ...]]:
    """(place in left, place in right, grams in common, grams of either) of the pairs whose Jaccard overlap is at least `least` > 0."""
    (ra, ga), (rb, gb) = _grams(left), _grams(right)
    na, nb = np.bincount(ra, minlength=len(left)), np.bincount(rb, minlength=len(right))
    order = np.argsort(gb, kind="stable")
    known, holders = gb[order], rb[order]
    low, high = np.searchsorted(known, ga, "left"), np.searchsorted(known, ga, "right")
    cuts = np.searchsorted(ra, np.arange(0, len(left) + rows, rows))
    for n, at in enumerate(range(0, len(left), rows)):
        own = slice(cuts[n], cuts[n + 1])
        many = high[own] - low[own]
        where = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low[own], many)
        common = np.bincount(np.repeat(ra[own] - at, many) * len(right) + holders[where], minlength=min(rows, len(left) - at) * len(right))
        met = np.flatnonzero(common)
        x, y, m = at + met // len(right), met % len(right), common[met]
        u = na[x] + nb[y] - m
        good = m / u >= least
        yield x[good], y[good], m[good], u[good]


def mean_pairwise(rows: DataFrame, group: str, vector: str) -> DataFrame:
    """Mean cosine over the pairs of a group of unit vectors, from the norm of their sum: no pairs are made. 1 below two."""
    sums = rows.select(group, F.posexplode(vector).alias("i", "x")).groupBy(group, "i").agg(F.sum(F.col("x").cast("double")).alias("s"), F.sum(F.col("x").cast("double") * F.col("x").cast("double")).alias("q"), F.count("*").alias("n"))
    g = sums.groupBy(group).agg(F.sum(F.col("s") * F.col("s")).alias("ss"), F.sum("q").alias("qq"), F.max("n").alias("n"))
    return g.select(group, F.when(F.col("n") < 2, F.lit(1.0)).otherwise((F.col("ss") - F.col("qq")) / (F.col("n") * (F.col("n") - 1))).alias("mean_cosine"))


def tokens(text: str) -> list[str]:
    return re.findall(r"\w+", text.lower())
