"""Event clustering: time-banded similarity edges, pruning, ordering."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions.text import char_ngrams, jaccard
from tidewire.operators.rounds import dense_places
from tidewire.operators.similarity import bucketed_pairs, dot
from tidewire.runtime import checked, materialise


def event_edges(articles: DataFrame, vector: str = "embedding", hours: int = 48, least: float = 0.72, strong: float = 0.86, overlap: float = 0.12) -> DataFrame:
    """(a, b, cosine) of real articles at most `hours` apart and similar; ids a < b.

    Time buckets meet themselves and the next one, in blocks. Pairs under `strong` also need titles of n-gram overlap
    `overlap` (none without a title column); strong = least leaves titles out.
    """
    seconds = F.unix_timestamp("published_at")
    near = bucketed_pairs(articles, "id", vector, F.floor(seconds / (hours * 3600)), least, seconds, hours * 3600)
    if strong <= least:
        return near
    title = F.col("title") if "title" in articles.columns else F.lit(None).cast("string")
    named = lambda key, name: articles.select(F.col("id").alias(key), title.alias(name))
    met = near.join(named("a", "ta"), "a").join(named("b", "tb"), "b")
    return met.where((F.col("cosine") >= strong) | (jaccard(char_ngrams(F.col("ta")), char_ngrams(F.col("tb"))) >= overlap)).select("a", "b", "cosine")


def one_per_source(articles: DataFrame, component: DataFrame, edges: DataFrame) -> DataFrame:
    """Each component's best article per source: most neighbours in it, then longest content, then newest, then first id."""
    degree = edges.select(F.col("a").alias("id")).unionAll(edges.select("b")).groupBy("id").agg(F.count("*").alias("degree"))
    met = articles.join(component, "id").join(degree, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    order = Window.partitionBy("component", "source_name").orderBy(F.desc("degree"), F.desc(F.length("content")), F.desc("published_at"), "id")
    return met.withColumn("_r", F.row_number().over(order)).where("_r = 1").select("component", "id", "source_name", "degree")


def cluster_order(members: DataFrame, regions: DataFrame) -> DataFrame:
    """Clusters by regions, sources and articles, largest first."""
    met = members.join(regions.select(F.col("name").alias("source_name"), "region"), "source_name", "left")
    g = met.groupBy("component").agg(F.countDistinct(F.nullif(F.col("region"), F.lit(""))).alias("regions"), F.countDistinct("source_name").alias("sources"), F.count("*").alias("articles"))
    return dense_places(g, F.desc("regions"), F.desc("sources"), F.desc("articles"), F.col("component")).withColumn("place", F.col("place").cast("int"))


def validate_cluster(rows: DataFrame, group: str, key: str, vector: str, least: float, title: str | None = None, overlap: float = 0.05, pair: float = 0.50, pair_overlap: float = 0.03) -> DataFrame:
    """Members whose mean cosine to the others is below `least`, from the group's vector sum: no pairs are made for it.

    With `title`, an outlier's mean title overlap is also below `overlap`, and two members part below `pair` and `pair_overlap`;
    titles are compared only for members that their cosine leaves open. Without it the cosine decides alone.
    """
    flat = rows.select(group, key, F.posexplode(vector).alias("i", "x"))
    total = flat.groupBy(group, "i").agg(F.sum(F.col("x").cast("double")).alias("s"), F.count("*").alias("n"))
    own = flat.join(total, [group, "i"]).groupBy(group, key).agg(F.sum(F.col("x") * F.col("s")).alias("xs"), F.sum(F.col("x") * F.col("x")).alias("xx"), F.max("n").alias("n"))
    mean = (F.col("xs") - F.col("xx")) / F.nullif(F.col("n") - 1, F.lit(0))
    if title is None:
        return own.select(group, key, F.round(mean, 4).alias("mean_cosine"), F.coalesce(mean < least, F.lit(False)).alias("outlier"))
    judged = own.select(group, key, "n", mean.alias("mean"), F.coalesce(mean < F.when(F.col("n") == 2, pair).otherwise(least), F.lit(False)).alias("open"))
    grams = rows.select(group, key, char_ngrams(F.col(title)).alias("g"))
    titles = mean_overlaps(judged.where("open").select(group, key).join(grams, [group, key]), grams, group, key)
    unlike = F.col("o") < F.when(F.col("n") == 2, pair_overlap).otherwise(overlap)
    return judged.join(titles, [group, key], "left").select(group, key, F.round("mean", 4).alias("mean_cosine"), F.coalesce(F.col("open") & unlike, F.lit(False)).alias("outlier"))


def mean_overlaps(asking: DataFrame, known: DataFrame, group: str, key: str, block_rows: int = 4096) -> DataFrame:
    """(group, key, o): each asking row's mean Jaccard of its set g with those of the other rows (by key) of its group; none without others.

    A group of any size is dealt into a grid of blocks. A task counts common elements by products of 0-1 matrices, over some
    elements at a time, and puts out one sum per asking row: no pairs are made.
    """
    asking, known = (materialise(x.select(group, key, "g").where(F.col("g").isNotNull())) for x in (asking, known))
    sizes = materialise(known.groupBy(group).agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks")))
    cells = sizes.agg(F.sum(F.col("blocks").cast("bigint") * F.col("blocks"))).first()[0] or 1
    own, each = F.pmod(F.xxhash64(key), F.col("blocks")), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - F.lit(1).cast("bigint")))
    columns = [group, "i", "j", "asks", key, "g"]
    left = asking.join(checked(sizes), group).withColumn("i", own).withColumn("j", each).withColumn("asks", F.lit(1)).select(*columns)
    right = known.join(checked(sizes), group).withColumn("j", own).withColumn("i", each).withColumn("asks", F.lit(0)).select(*columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, []
        for batch in batches:
            marks = list(zip(*(batch.column(c).to_pylist() for c in (group, "i", "j", "asks")), strict=True))
            cuts = [0, *(n for n in range(1, len(marks)) if marks[n] != marks[n - 1]), len(marks)] if marks else [0]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if marks[a][:3] != cell:
                    cell, held = marks[a][:3], []
                if not marks[a][3]:
                    held.append(batch.slice(a, b - a))
                    continue
                for at in range(a, b if held else a, 1024):
                    part = batch.slice(at, min(1024, b - at))
                    total, n = _overlap_sums(part, held, key)
                    yield pa.RecordBatch.from_arrays([part.column(group), part.column(key), pa.array(total), pa.array(n)], [group, key, "total", "n"])

    dealt = left.union(right).repartition(max(1, min(cells, 2000)), group, "i", "j").sortWithinPartitions(group, "i", "j", "asks")
    kinds = known.schema
    found = dealt.mapInArrow(run, f"`{group}` {kinds[group].dataType.simpleString()}, `{key}` {kinds[key].dataType.simpleString()}, total double, n bigint")
    summed = found.groupBy(group, key).agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    return summed.where("n > 0").select(group, key, (F.col("total") / F.col("n")).alias("o"))


def _overlap_sums(part: pa.RecordBatch, held: list[pa.RecordBatch], key: str, width: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of part: the sum of its overlaps with the held rows of other keys, and their number."""
    sides = [part.column("g")], [x.column("g") for x in held]
    sizes = [np.concatenate([pc.list_value_length(x).to_numpy() for x in side]) for side in sides]
    words = pa.concat_arrays([x.flatten() for side in sides for x in side]).dictionary_encode().indices.to_numpy(zero_copy_only=False)
    cut = int(sizes[0].sum())
    at = []
    for own, size in ((words[:cut], sizes[0]), (words[cut:], sizes[1])):
        row, order = np.repeat(np.arange(len(size)), size), np.argsort(own, kind="stable")
        at.append((row[order], own[order]))
    common = np.zeros((len(sizes[0]), len(sizes[1])), np.float32)
    for low in range(0, int(words[:cut].max()) + 1 if cut else 0, width):
        flags = []
        for (row, own), size in zip(at, sizes, strict=True):
            a, b = np.searchsorted(own, [low, low + width])
            m = np.zeros((len(size), width), np.float32)
            m[row[a:b], own[a:b] - low] = 1
            flags.append(m)
        common += flags[0] @ flags[1].T
    overlap = common / np.maximum(sizes[0][:, None] + sizes[1][None] - common.astype(float), 1)
    other = part.column(key).to_numpy()[:, None] != np.concatenate([x.column(key).to_numpy() for x in held])[None]
    return (overlap * other).sum(1), other.sum(1).astype(np.int64)
