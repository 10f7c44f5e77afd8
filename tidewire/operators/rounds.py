"""Order-dependent keep-or-drop rules in parallel rounds, instead of one task per connected component."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.runtime import checked, materialise, small_enough

#: What is left after some rounds is finished in one task if it has at most so many rows.
FINISH_ROWS = 200_000


def first_come(speaks: DataFrame, listens: DataFrame, finish_rows: int = FINISH_ROWS) -> DataFrame:
    """Ids (bigint, column id) that a first-come rule drops: in ascending order, each id is kept unless an earlier kept id speaks on a key it listens to.

    speaks (key, id) and listens (key, id) are distinct; whoever neither speaks nor listens is kept. Keys may be shared by
    any number of ids: a key passes on its least id only. Each round keeps the ids that hear no earlier undecided one and
    drops whom they reach, so rounds follow the longest chain of decisions, not the number of ids. What is left at the end
    (at most `finish_rows`) is decided in one task.
    """
    speaks, listens = materialise(speaks.select("key", "id")), materialise(listens.select("key", "id"))
    dropped: DataFrame | None = None
    while not small_enough(speaks.union(listens), finish_rows):
        least = speaks.groupBy("key").agg(F.min("id").alias("least"))
        heard = listens.join(least, "key").groupBy("id").agg(F.min("least").alias("least")).where("least < id")
        waiting = materialise(heard.select("id"))
        kept = materialise(speaks.join(checked(waiting), "id", "left_anti"))
        loud = materialise(kept.groupBy("key").agg(F.min("id").alias("by")))
        gone = materialise(listens.join(checked(waiting), "id", "left_semi").join(checked(loud), "key").where("by < id").select("id").distinct())
        dropped = gone if dropped is None else dropped.union(gone)
        decided = checked(materialise(gone.union(kept.select("id").distinct())))
        speaks = materialise(speaks.join(decided, "id", "left_anti"))
        of_kept = checked(materialise(listens.select("id").distinct().join(checked(waiting), "id", "left_anti")))
        listens = listens.join(decided, "id", "left_anti").join(of_kept, "id", "left_anti")
        listens = materialise(listens.join(checked(materialise(speaks.select("key").distinct())), "key", "left_semi"))
    last = _in_one_task(speaks, listens)
    return last if dropped is None else dropped.union(last)


def _in_one_task(speaks: DataFrame, listens: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        table = pa.Table.from_batches(batches)
        key, who, says = (table.column(c).to_numpy() for c in ("key", "id", "says"))
        number = np.unique(key, return_inverse=True)[1]
        taken = np.zeros(number.max() + 1, bool)
        order = np.lexsort((says, who))  # an id listens before it speaks
        gone = []
        at = np.append(np.flatnonzero(np.append(True, who[order][1:] != who[order][:-1])), len(order))
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            own = order[a:b]
            speaking = says[own].astype(bool)
            if taken[number[own[~speaking]]].any():
                gone.append(who[own[0]])
            else:
                taken[number[own[speaking]]] = True
        yield pa.RecordBatch.from_arrays([pa.array(gone, pa.int64())], ["id"])

    rows = speaks.withColumn("says", F.lit(1)).unionByName(listens.withColumn("says", F.lit(0)))
    return rows.coalesce(1).mapInArrow(run, "id bigint")


def displacing(edges: DataFrame, finish_rows: int = FINISH_ROWS) -> DataFrame:
    """(id, kept, met) of the ids of edges (a, b, wa, wb), a < b: the first similar row still kept decides; a heavier newcomer takes its place.

    A row is decided once its first similar row that may still be kept is known to be: that one is decided itself, and so
    are its heavier neighbours between the two, which could have taken its place. `met` is the row that it met. A round
    looks at each edge once and passes on one row per id.
    """
    edges = materialise(edges.select("a", "b", "wa", "wb").distinct())
    ids = edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct()
    starts = ids.join(edges.select(F.col("b").alias("id")).distinct(), "id", "left_anti")
    settled = materialise(starts.select("id", F.lit(True).alias("entered"), F.lit(None).cast("bigint").alias("met"), F.lit(None).cast("bigint").alias("end")))
    left = edges
    while not left.isEmpty():
        #: Of every row, the first undecided heavier neighbour behind it.
        threat = left.where("wb > wa").groupBy("a").agg(F.min("b").alias("threat"))
        known = settled.select(F.col("id").alias("a"), "entered", "end")
        seen = left.join(checked(known), "a", "left").join(checked(materialise(threat)), "a", "left")
        seen = seen.where("entered IS NULL OR (entered AND (end IS NULL OR end > b))")
        sure = F.col("entered").isNotNull() & (F.col("threat").isNull() | (F.col("threat") >= F.col("b")))
        first = seen.groupBy("b").agg(F.min(F.struct("a", sure.alias("sure"), "wa", "wb")).alias("f"))
        waiting = left.select("b").distinct().join(first, "b", "left").select(F.col("b").alias("id"), "f")
        now = materialise(waiting.where("f IS NULL OR f.sure").select("id", (F.col("f").isNull() | (F.col("f.wb") > F.col("f.wa"))).alias("entered"), F.col("f.a").alias("met"), F.lit(None).cast("bigint").alias("end")))
        ended = now.where("entered AND met IS NOT NULL").select(F.col("met"), F.col("id").alias("_by")).groupBy(F.col("met").alias("id")).agg(F.min("_by").alias("_end"))
        settled = settled.join(checked(materialise(ended)), "id", "left").select("id", "entered", "met", F.coalesce("end", "_end").alias("end"))
        settled = materialise(settled.union(now))
        left = materialise(left.join(checked(now.select(F.col("id").alias("b"))), "b", "left_anti"))
    return settled.select("id", (F.col("entered") & F.col("end").isNull()).alias("kept"), "met")


def numbered(rows: DataFrame, *order: Column) -> DataFrame:
    """rows (written) with place: ascending numbers in the given order, with gaps; dealt by ranges, so that no task holds all."""
    return materialise(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()))


def dense_places(rows: DataFrame, *order: Column, name: str = "place") -> DataFrame:
    """rows (written) with their places 1, 2, 3 ... in the given order: numbered inside ranges, plus the rows of the ranges before. Ties take any order."""
    placed = numbered(rows, *order)
    before, table = 0, []
    for number, n in sorted(map(tuple, placed.groupBy(F.shiftright("place", 33).alias("range")).count().collect())):
        table.append((number, before))
        before += n
    offsets = F.broadcast(placed.sparkSession.createDataFrame(table, "_range bigint, _before bigint"))
    met = placed.join(offsets, F.shiftright("place", 33) == F.col("_range"))
    return met.select(*rows.columns, (F.col("_before") + F.col("place").bitwiseAND((1 << 33) - 1) + 1).alias(name))
