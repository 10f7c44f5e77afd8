"""Approximate nearest neighbours by learned partitions.

On a bounded sample a neighbour graph is cut into balanced parts (recursive halving, then moves along the graph within a
size limit), and a small network learns to tell a vector's part. Every row is indexed under its most probable part; a
query is sent to its most probable parts, as many as a held-out part of the sample needs for the wanted recall, and its
candidates there are ranked by the exact Euclidean distance in double precision.

The number of parts grows with the square root of the vectors' number, as far as the sample can tell parts apart; the
number of visits is what recall asks for, so it depends on the data: few where vectors form clusters, half of the parts
or more where neighbours are hardly nearer than others.

Equal vectors are one candidate with their k + 1 smallest ids (a query can use no more). Parts are searched in blocks
of bounded size against blocks of queries, dealt over salts, so a part of any size is spread. Vectors that are null,
zero, or hold null or non-finite components take no part; a vector's neighbours are those of its own length. Rows
repeated under one id count once per different vector. With fewer candidates than k all of them are returned; ties go by
smaller id. An empty table gives an empty result. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.runtime import materialise, workers_see_package

#: Vectors that the partition and its classifier are fitted on at most, and the share of them held out for the routing.
SAMPLE = 4_096
HELD_OUT = 512
#: Sample vectors of a part at least, and the square root of the vectors' number for each part.
LEAST_OF_PART = 40
ROOT_OF_PART = 6
GRAPH_DEGREE = 16
RECALL = 0.96
HIDDEN = 128
STEPS = 250
BLOCK_ROWS = 4_096
BLOCK_QUERIES = 512
SALTS = 8


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v array<double>) of the vectors that take part, repeated rows once."""
    v = F.col(vector_col).cast("array<double>")
    rows = rows.select(F.col(id_col).alias("id"), v.alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    rows = rows.where("forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(v, x -> x <> 0)")
    return rows.dropDuplicates(["id", "v"])


def parts_for(vectors: int) -> int:
    """A power of two near the square root of the number of vectors, over ROOT_OF_PART."""
    return 1 << max(0, round(np.log2(max(vectors, 1) ** 0.5 / ROOT_OF_PART)))


def cut_graph(x: np.ndarray, parts: int, degree: int = GRAPH_DEGREE, slack: float = 1.1, rounds: int = 8) -> np.ndarray:
    """Part of each row: the neighbour graph's nodes in parts of about equal size with few edges between."""
    n = len(x)
    part = np.zeros(n, int)
    groups = [np.arange(n)]
    while len(groups) < parts:
        groups = [half for g in groups for half in _halves(x, g)]
    for k, g in enumerate(groups):
        part[g] = k
    d = (x**2).sum(1)[:, None] + (x**2).sum(1)[None] - 2 * x @ x.T
    np.fill_diagonal(d, np.inf)
    near = np.argpartition(d, min(degree, n - 1) - 1, axis=1)[:, :degree] if n > 1 else np.zeros((n, 0), int)
    source, target = np.repeat(np.arange(n), near.shape[1]), near.ravel()
    limit = int(np.ceil(slack * n / parts))
    for _ in range(rounds):
        tally = np.bincount(np.concatenate([source * parts + part[target], target * parts + part[source]]), minlength=n * parts).reshape(n, parts)
        best = tally.argmax(1)
        gain = tally[np.arange(n), best] - tally[np.arange(n), part]
        sizes = np.bincount(part, minlength=parts)
        moved = 0
        for node in np.argsort(-gain, kind="stable"):
            if gain[node] <= 0:
                break
            if sizes[best[node]] < limit:
                sizes[part[node]] -= 1
                sizes[best[node]] += 1
                part[node] = best[node]
                moved += 1
        if not moved:
            break
    return part


def _halves(x: np.ndarray, group: np.ndarray) -> list[np.ndarray]:
    """The group in two halves along its main direction."""
    centred = x[group] - x[group].mean(0) if len(group) else x[group]
    direction = np.linalg.svd(centred, full_matrices=False)[2][0] if len(group) > 1 else np.ones(x.shape[1])
    order = group[np.argsort(centred @ direction, kind="stable")]
    return [order[: len(order) // 2], order[len(order) // 2 :]]


def learn(x: np.ndarray, part: np.ndarray, parts: int, seed: int = 3) -> list[np.ndarray]:
    """A network of one hidden layer that gives the parts' probabilities (full-batch Adam)."""
    rng = np.random.default_rng(seed)
    p = [rng.normal(size=(x.shape[1], HIDDEN)) / np.sqrt(x.shape[1]), np.zeros(HIDDEN), rng.normal(size=(HIDDEN, parts)) / np.sqrt(HIDDEN), np.zeros(parts)]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    goal = np.eye(parts)[part]
    for step in range(1, STEPS + 1):
        hidden = np.maximum(x @ p[0] + p[1], 0)
        prob = _softmax(hidden @ p[2] + p[3])
        out = (prob - goal) / len(x)
        back = (out @ p[2].T) * (hidden > 0)
        grads = [x.T @ back + 1e-4 * p[0], back.sum(0), hidden.T @ out + 1e-4 * p[2], out.sum(0)]
        for k, g in enumerate(grads):
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            p[k] = p[k] - 0.01 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return p


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def probabilities(x: np.ndarray, model: dict) -> np.ndarray:
    z = (x - model["centre"]) / model["scale"]
    p = model["net"]
    return _softmax(np.maximum(z @ p[0] + p[1], 0) @ p[2] + p[3])


def fit(x: np.ndarray, held: np.ndarray, k: int, parts: int, recall: float = RECALL) -> dict:
    """Partition, classifier and the number of parts that a query has to visit (measured on the held-out vectors)."""
    while parts > 1 and len(x) < LEAST_OF_PART * parts:
        parts //= 2
    centre, scale = (x.mean(0), x.std() + 1e-12) if len(x) else (0.0, 1.0)
    model = {"centre": centre, "scale": scale, "parts": parts, "visits": parts}
    if parts == 1:
        return model
    z, zh = (x - centre) / scale, (held - centre) / scale
    model["net"] = learn(z, cut_graph(z, parts), parts)
    if not len(held):
        return model
    home = probabilities(x, model).argmax(1)
    d = (zh**2).sum(1)[:, None] + (z**2).sum(1)[None] - 2 * zh @ z.T
    near = np.argsort(d, 1, kind="stable")[:, :k]
    order = np.argsort(-probabilities(held, model), 1, kind="stable")
    place = np.argsort(order, 1)  # after how many visits a part is reached
    reached = np.take_along_axis(place, home[near], 1)
    shares = [(reached < visits).mean() for visits in range(1, parts + 1)]
    model["visits"] = int(np.argmax(np.array(shares) >= recall)) + 1
    model["measured"] = float(shares[model["visits"] - 1])
    return model


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(rows, -1) if rows else np.zeros((0, 1))


def nearest_in_block(q_ids: np.ndarray, q: np.ndarray, x: np.ndarray, ids: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, distance): at most k per query, of a block whose row j has counts[j] ids."""
    #: The screen works on differences from the block's middle; its slack is beyond what rounding can do.
    middle = x.mean(0)
    a, b = q - middle, x - middle
    far = (a**2).sum(1), (b**2).sum(1)
    d = far[0][:, None] + far[1][None] - 2 * a @ b.T
    if d.shape[1] > k + 1:
        slack = 4 * np.finfo(float).eps * (x.shape[1] + 8) * (far[0] + far[1].max())
        bound = np.partition(d, k, axis=1)[:, k] + 2 * slack
        i, j = np.nonzero(d <= bound[:, None])
    else:
        i, j = np.nonzero(np.ones(d.shape, bool))
    exact = np.sqrt(((q[i] - x[j]) ** 2).sum(1))
    offset = np.cumsum(counts) - counts
    n = counts[j]
    at = np.repeat(offset[j], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    i, exact, found = np.repeat(i, n), np.repeat(exact, n), ids[at]
    other = found != q_ids[i]
    i, exact, found = i[other], exact[other], found[other]
    order = np.lexsort((found, exact, i))
    i, exact, found = i[order], exact[order], found[order]
    rank = np.arange(len(i)) - np.searchsorted(i, i)
    return q_ids[i[rank < k]], found[rank < k], exact[rank < k]


def search(rows: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", parts: int | None = None, recall: float = RECALL, sample: int = SAMPLE) -> DataFrame:
    """Per query (a row where is_query, a condition on `id`, holds): query_id, rank, vec_id, score of its k nearest found."""
    workers_see_package(rows.sparkSession)
    vectors = materialise(usable(rows, id_col, vector_col))
    lengths = [r[0] for r in vectors.select(F.size("v")).distinct().collect()] or [0]
    found = [_searched(vectors.where(F.size("v") == n) if len(lengths) > 1 else vectors, is_query, k, parts, recall, sample) for n in sorted(lengths)]
    return reduce(DataFrame.unionByName, found)


def _searched(vectors: DataFrame, is_query: Column, k: int, parts: int | None, recall: float, sample: int) -> DataFrame:
    """search() of vectors (id, v) of one length."""
    spark = vectors.sparkSession
    first_ids = Window.partitionBy("v").orderBy("id")
    distinct = vectors.withColumn("r", F.row_number().over(first_ids)).where(F.col("r") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    distinct = materialise(distinct.select("ids", "v"))
    chosen = distinct.orderBy(F.xxhash64("v"), F.element_at("ids", 1)).limit(sample).select("v").toPandas()
    drawn = np.array(chosen["v"].tolist(), float) if len(chosen) else np.zeros((0, 1))
    cut = min(HELD_OUT, len(drawn) // 4)
    model = fit(drawn[cut:], drawn[:cut], k, parts or parts_for(distinct.count()), recall)
    shared = spark.sparkContext.broadcast(model)

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of a part's vectors: part, salt, ids and their numbers, vectors."""
        m, turn = shared.value, 0
        for batch in batches:
            x = _matrix(batch.column("v"), batch.num_rows)
            home = probabilities(x, m).argmax(1) if m["parts"] > 1 else np.zeros(len(x), int)
            lists = batch.column("ids").to_pylist()
            for part in np.unique(home):
                own = np.flatnonzero(home == part)
                for a in range(0, len(own), BLOCK_ROWS):
                    some = own[a : a + BLOCK_ROWS]
                    turn += 1
                    ids = np.array([i for j in some for i in lists[j]], np.int64)
                    salt = int((ids[0] * 2654435761 + turn) % SALTS)
                    yield pa.RecordBatch.from_arrays([pa.array([int(part)], pa.int32()), pa.array([salt], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([np.array([len(lists[j]) for j in some], np.int64).tobytes()], pa.binary()), pa.array([x[some].tobytes()], pa.binary())], ["part", "salt", "ids", "counts", "x"])

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of queries for each part that they visit."""
        m = shared.value
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK_QUERIES):
                piece = batch.slice(a, BLOCK_QUERIES)
                q, ids = _matrix(piece.column("v"), piece.num_rows), piece.column("id").to_numpy().astype(np.int64)
                order = np.argsort(-probabilities(q, m), 1, kind="stable")[:, : m["visits"]] if m["parts"] > 1 else np.zeros((len(q), 1), int)
                for part in np.unique(order):
                    some = np.flatnonzero((order == part).any(1))
                    yield pa.RecordBatch.from_arrays([pa.array([int(part)], pa.int32()), pa.array([ids[some].tobytes()], pa.binary()), pa.array([q[some].tobytes()], pa.binary())], ["part", "q_ids", "q"])

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                q_ids, ids, counts = (np.frombuffer(batch.column(c)[row].as_py(), np.int64) for c in ("q_ids", "ids", "counts"))
                q, x = (np.frombuffer(batch.column(c)[row].as_py(), float) for c in ("q", "x"))
                got = nearest_in_block(q_ids, q.reshape(len(q_ids), -1), x.reshape(len(counts), -1), ids, counts, k)
                yield pa.RecordBatch.from_arrays([pa.array(g) for g in got], ["query_id", "vec_id", "score"])

    index = distinct.mapInArrow(indexed, "part int, salt int, ids binary, counts binary, x binary")
    queries = vectors.where(is_query).mapInArrow(routed, "part int, q_ids binary, q binary").withColumn("salt", F.explode(F.array(*[F.lit(s) for s in range(SALTS)])))
    found = index.join(queries.hint("shuffle_hash"), ["part", "salt"]).select("q_ids", "q", "ids", "counts", "x").mapInArrow(ranked, "query_id bigint, vec_id bigint, score double")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    found = found.dropDuplicates(["query_id", "vec_id", "score"]).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return found.select("query_id", "rank", "vec_id", "score")
