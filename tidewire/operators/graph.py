"""Graph operators over edge DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.runtime import checked, materialise, small_enough


#: Edges that are at most so many are joined in one task, which is sooner done than a round over the cluster.
FINISH_ROWS = 200_000


def connected_components(nodes: DataFrame, edges: DataFrame, finish_rows: int = FINISH_ROWS) -> DataFrame:
    """(id, component), the component named by its smallest id; nodes without edges are their own.

    Label spreading with pointer jumping over written tables: rounds grow with the logarithm of the diameter. At most
    `finish_rows` edges of numbered nodes are joined in one task instead.
    """
    one_way = materialise(edges.select("a", "b").where("a <> b"))
    if isinstance(one_way.schema["a"].dataType, T.LongType) and small_enough(one_way, finish_rows):
        joined = checked(materialise(one_way.coalesce(1).mapInArrow(_joined, "id bigint, component bigint")), finish_rows)
        return nodes.select("id").distinct().join(joined, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
    both = materialise(one_way.union(one_way.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = materialise(nodes.select("id", F.col("id").alias("component")).distinct())
    while True:
        heard = both.join(checked(labels.select(F.col("id").alias("b"), F.col("component").alias("c"))), "b").groupBy("a").agg(F.min("c").alias("c"))
        spread = labels.join(heard, F.col("id") == F.col("a"), "left").select("id", F.col("component").alias("was"), F.least("component", F.coalesce("c", "component")).alias("component"))
        spread = materialise(spread)
        if spread.where("component <> was").isEmpty():
            return spread.select("id", "component")
        root = checked(spread.select(F.col("id").alias("component"), F.col("component").alias("further")))
        jumped = materialise(spread.join(root, "component", "left").select("id", F.least("component", F.coalesce("further", "component")).alias("component")))
        labels = jumped


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, component) of the ends of all edges (a, b)."""
    parts = [np.stack([b.column(c).to_numpy() for c in ("a", "b")]) for b in batches if b.num_rows]
    if not parts:
        return
    ids, ends = np.unique(np.concatenate(parts, 1), return_inverse=True)
    a, b = ends.reshape(2, -1)
    label = np.arange(len(ids))
    while True:
        before = label.copy()
        np.minimum.at(label, a, before[b])
        np.minimum.at(label, b, before[a])
        np.minimum.at(label, before, label.copy())  # whoever led a node hears of its new lead
        label = label[label]
        if (label == before).all():
            break
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[label])], ["id", "component"])


def split_coherently(vectors: np.ndarray, least: float) -> list[list[int]]:
    """The medoid, then greedily the member that keeps the mean pairwise cosine highest while at least `least`; the rest again.

    A member's sum of cosines with a group is its product with the sum of the group's vectors, so no matrix of pairs is
    held: memory is linear in the members.
    """
    size = np.linalg.norm(vectors, axis=1, keepdims=True)
    unit = np.divide(vectors, size, out=np.zeros_like(vectors, dtype=float), where=size > 0)
    rest, out = np.arange(len(unit)), []
    while len(rest):
        own = unit[rest]
        group = [int(np.argmax(np.round(own @ own.sum(0) - (own * own).sum(1), 9)))]  # equal sums go to the first member
        inside = np.zeros(len(rest), bool)
        inside[group] = True
        gain, total = own @ own[group[0]], 0.0
        while len(group) < len(rest):
            best = int(np.argmax(np.where(inside, -np.inf, np.round(gain, 9))))
            count = len(group) + 1
            if (total + gain[best]) / (count * (count - 1) / 2) < least:
                break
            total += gain[best]
            group.append(best)
            inside[best] = True
            gain += own @ own[best]
        out.append(rest[group].tolist())
        rest = rest[~inside]
    return out


def coherent_split(rows: DataFrame, component: str, key: str, vector: str, least: float = 0.60) -> DataFrame:
    """D15 per component of at least three members (components are small by construction): key, component, part."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        x = np.array(pdf[vector].tolist(), float)
        part = np.zeros(len(pdf), int)
        if len(pdf) >= 3:
            for k, own in enumerate(split_coherently(x, least)):
                part[own] = k
        return pd.DataFrame({key: pdf[key], component: pdf[component], "part": part})

    return rows.select(key, component, vector).groupBy(component).applyInPandas(run, f"{key} {rows.schema[key].dataType.simpleString()}, {component} {rows.schema[component].dataType.simpleString()}, part bigint")
