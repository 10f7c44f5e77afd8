"""N-gram Jaccard join by T-occurrence search: which documents share so many shingles that their similarity reaches 0.85.

A document's set holds its different runs of four words (maximal runs of visible characters, A-Z in lower case; a text of
fewer words is one run). Two sets are linked when 100 * |x & y| >= 85 * |x | y|, that is, when they share at least
ceil(17 * (|x| + |y|) / 37) shingles: the occurrences T that a document needs in the inverted lists of the other's shingles.

Texts of equal sets are one node. All shingles have one order: by their number in a sketch of all rows (whose counters
grow with the rows, so that what is common still stands out), then by hash. Similar nodes share at least one of their first |x| - ceil(0.85 |x|) + 1 shingles, so only these are listed,
and lists of one node are dropped. What is left is settled exactly, in steps, none of which puts out the pairs of a list:

1. Lists of up to LIST_MEMBERS nodes go to their members; each member merges its lists, and is near the nodes that occur in
   as many as its own and their first shingles ask for. Nodes near no other one, and in no longer list, are done.
2. Every other node goes, with its whole set, to the longest of its lists, in cells of bounded size; a cell is searched by
   T-occurrence, and puts out a forest of links. Families of near copies become one component here.
3. Lists of up to LIST_MEMBERS nodes that still hold several components go to their members again, and nodes that are near
   one of another component are compared whole.
4. In longer lists that still hold several components, nodes outside the largest one are searched in the list, by blocks.

T-occurrence search is DivideSkip: up to T - 1 of the longest lists are set aside; the short ones are merged, and
documents that occur often enough there to reach T are looked up in the long ones by binary search.

Shingles are 48-bit hashes: two different shingles of one pair of documents count as the same with a probability of about
1e-9. Texts without words and null texts have no shingles, and are linked with nothing: their component is their own id.
Rows repeated under one id are documents of their own that share their id's name; rows with a null id take part, and name
no component unless it has no other id. Ties need no order, as components are named by their smallest id. Texts of any
length are read whole. An empty table gives an empty result, extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm import buffers
from tidewire.llm.near_dedup import _binary, components, shingles
from tidewire.runtime import checked, materialise, small_enough, workers_see_package

WORDS = 4
#: Links have at least OF_UNION hundredths of the union in common: SHARE[0] / SHARE[1] of the sum of both sizes.
OF_UNION = 85
SHARE = (17, 37)
#: Counters of the sketch that orders shingles: at least, at most, and for each row between; and how many travel together.
SKETCH = 1 << 22
MOST_SKETCH = 1 << 24
ROW_COUNTERS = 16
SKETCH_CHUNK = 1 << 15
#: Lists of ids or shingles of up to so many rows (16 bytes each) are broadcast.
NARROW_ROWS = 1_000_000
#: Longer lists of shingles: so many low bits tell first which rows may meet one.
SHARED_BITS = 1 << 27
#: Members and shingles of a cell at most (a longer text is a cell's only one, or one of two).
CELL_MEMBERS = 512
CELL_SHINGLES = 1_000_000
#: Longer lists are not sent to their members.
LIST_MEMBERS = 256
SLICE = 120_000



def needed(x, y):
    """Shingles that sets of sizes x and y must share to be linked."""
    return (SHARE[0] * (x + y) + SHARE[1] - 1) // SHARE[1]


def listed(n):
    """How many of a set's first shingles are listed."""
    return n - (OF_UNION * n + 99) // 100 + 1


def slot(value: np.ndarray, counters: int) -> np.ndarray:
    return (value & np.uint64(counters - 1)).astype(np.int64)


def counters_for(rows: int) -> int:
    """A power of two."""
    return min(max(SKETCH, 1 << max(0, rows * ROW_COUNTERS - 1).bit_length()), MOST_SKETCH)


def counted(texts: DataFrame, counters: int) -> np.ndarray:
    """The sketch of all rows: by counter, how often its shingles occur (65,535 at most)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(counters, np.uint16)
        for batch in batches:
            for part in buffers.slices(batch, "text", SLICE):
                at, n = np.unique(slot(shingles(*buffers.utf8(part.column("text")), WORDS)[1], counters), return_counts=True)
                sketch[at] = np.minimum(sketch[at] + n, 65535)
        for k in range(0, counters, SKETCH_CHUNK):
            yield pa.RecordBatch.from_arrays([pa.array([k // SKETCH_CHUNK]), pa.array([zlib.compress(sketch[k : k + SKETCH_CHUNK].tobytes(), 1)], pa.binary())], ["chunk", "counts"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, counts in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                own = np.frombuffer(zlib.decompress(counts), np.uint16)
                sums[chunk] = np.minimum(sums[chunk].astype(np.uint32) + own, 65535).astype(np.uint16) if chunk in sums else own
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["chunk", "counts"])

    parts = texts.select("text").mapInArrow(run, "chunk bigint, counts binary").repartition("chunk").mapInArrow(summed, "chunk bigint, counts binary").collect()
    out = np.zeros((counters // SKETCH_CHUNK, SKETCH_CHUNK), np.uint16)
    for row in parts:
        out[row["chunk"]] = np.frombuffer(row["counts"], np.uint16)
    return out.reshape(-1)


def sets(texts: DataFrame, sketch) -> DataFrame:
    """Per row: id, n, shape (16 bytes naming its set), first (its listed shingles, 64-bit numbers in the order of all shingles) and whole (its set, six bytes each)."""
    key = texts.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sketch.value
        for batch in batches:
            for part in buffers.slices(batch, "text", SLICE):
                owner, value, _ = shingles(*buffers.utf8(part.column("text")), WORDS)
                n = np.bincount(owner, minlength=part.num_rows)
                at = np.append(0, np.cumsum(n))
                some = np.flatnonzero(n)
                shape = np.zeros((part.num_rows, 2), np.uint64)
                for k, seed in enumerate((0xA5A5, 0x5A5A5A)):
                    if len(some):
                        shape[some, k] = np.add.reduceat(buffers.mix64(value ^ np.uint64(seed << 48 & (1 << 64) - 1)), at[some])
                number = counts[slot(value, len(counts))].astype(np.uint64) << np.uint64(48) | value
                order = np.lexsort((number, owner))
                number = number[order]
                first = np.where(n > 0, listed(n), 0)
                of_first = np.arange(len(number)) - np.repeat(at[:-1], n) < np.repeat(first, n)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(n), _binary(shape), packed(number[of_first], np.append(0, np.cumsum(first))), packed(value.view(np.uint16).reshape(-1, 4)[:, :3], at)], ["id", "n", "shape", "first", "whole"])

    return texts.mapInArrow(run, f"id {key}, n bigint, shape binary, first binary, whole binary")


def packed(values: np.ndarray, at: np.ndarray) -> pa.Array:
    """values[at[i] : at[i + 1]] as bytes, for each i."""
    width = values.itemsize * (values.shape[1] if values.ndim > 1 else 1)
    return pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer((at * width).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def unpacked(column: pa.Array, kind: str = "<u8") -> tuple[np.ndarray, np.ndarray]:
    """(all numbers, borders of the rows) of a column that packed() made."""
    raw, at = buffers.utf8(column)
    return raw.view(kind), at // np.dtype(kind).itemsize


def whole_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all shingles, borders of the rows) of a column of six bytes a shingle."""
    raw, at = buffers.utf8(column)
    out = np.zeros((len(raw) // 6, 4), "<u2")
    out[:, :3] = raw.view("<u2").reshape(-1, 3)
    return out.reshape(-1).view("<u8"), at // 6


class Index:
    """Inverted lists over some sets: each shingle's documents, ascending."""

    def __init__(self, values: np.ndarray, at: np.ndarray):
        size = np.diff(at)
        owner = np.repeat(np.arange(len(size)), size)
        shingle, place = np.unique(values, return_inverse=True)
        order = np.lexsort((owner, place))
        self.size, self.shingle, self.documents = size, shingle, owner[order]
        self.starts = np.append(0, np.cumsum(np.bincount(place, minlength=len(shingle))))
        #: (list, document) as one ascending number: what a binary search looks up.
        self.keys = place[order] * len(size) + self.documents

    def lists(self, query: np.ndarray) -> np.ndarray:
        """Numbers of the query's lists that aren't empty."""
        at = np.searchsorted(self.shingle, query)
        at[at == len(self.shingle)] = 0
        return at[self.shingle[at] == query] if len(self.shingle) else at[:0]

    def search(self, query: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Documents (ascending) among those marked in `wanted` that are linked with the query's set: DivideSkip."""
        n = len(query)
        open_sizes = self.size[wanted & (100 * np.minimum(self.size, n) >= OF_UNION * np.maximum(self.size, n))]
        if not len(open_sizes):
            return np.zeros(0, np.int64)
        least = int(needed(n, int(open_sizes.min())))
        lists = self.lists(query)
        if len(lists) < least:
            return np.zeros(0, np.int64)
        length = self.starts[lists + 1] - self.starts[lists]
        lists = lists[np.argsort(length, kind="stable")]
        aside = least - 1
        short, long = lists[: len(lists) - aside], lists[len(lists) - aside :]
        found = np.zeros(len(self.size), np.int64)
        for k in short.tolist():
            found[self.documents[self.starts[k] : self.starts[k + 1]]] += 1
        near = np.flatnonzero(wanted & (found > 0) & (100 * np.minimum(self.size, n) >= OF_UNION * np.maximum(self.size, n)))
        goal = needed(n, self.size[near])
        count = found[near]
        for part in np.array_split(long[::-1], max(1, len(long) // 64)):  # the shortest of the long ones tell most
            left = len(long)
            keep = count + left >= goal
            near, goal, count = near[keep], goal[keep], count[keep]
            if not len(near):
                return near
            asked = (part[:, None] * len(self.size) + near[None]).ravel()
            at = np.searchsorted(self.keys, asked)
            at[at == len(self.keys)] = 0
            count = count + (self.keys[at] == asked).reshape(len(part), -1).sum(0)
            long = long[: len(long) - len(part)]
        return near[count >= goal]


def occurring(lists: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, in how many lists) of those that occur in at least `least` of some ascending lists: DivideSkip by a heap."""
    lists = sorted(lists, key=len)
    aside = min(least - 1, len(lists) - 1)
    short, long = lists[: len(lists) - aside], lists[len(lists) - aside :]
    found, last, times = [], None, 0
    for value in heapq.merge(*(x.tolist() for x in short)):
        if value == last:
            times += 1
            continue
        if times and times + aside >= least:
            found.append((last, times))
        last, times = value, 1
    if times and times + aside >= least:
        found.append((last, times))
    number, count = (np.array(x, np.int64) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    for x in long:
        at = np.minimum(np.searchsorted(x, number), len(x) - 1)
        count = count + (x[at] == number)
    return number[count >= least], count[count >= least]


def in_groups(batches: Iterator[pa.RecordBatch], names: list[str], most: int = 1) -> Iterator[tuple[list[tuple[int, int]], pa.Table]]:
    """(begin and end of each group, rows) of whole groups of rows sorted by `names`: at least `most` rows at once."""
    held: list[pa.RecordBatch] = []
    count = 0

    def whole(last: bool) -> tuple[list[tuple[int, int]], pa.Table, int]:
        table = pa.Table.from_batches(held).combine_chunks()
        keys = np.stack([table.column(c).to_numpy() for c in names], 1)
        begin = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(1)))
        upto = len(table) if last else int(begin[-1])
        begin = begin[begin < upto]
        return list(zip(begin.tolist(), [*begin[1:].tolist(), upto][: len(begin)], strict=True)), table, upto

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            count += batch.num_rows
        if count >= most and held:
            groups, table, upto = whole(False)
            if upto:
                yield groups, table.slice(0, upto)
                held = table.slice(upto).to_batches()
                count = len(table) - upto
            else:
                count = 0  # one group so far: look again after as many more rows
    if held:
        groups, table, _ = whole(True)
        yield groups, table


def _column(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def marked(rows: DataFrame, wanted: DataFrame, key: str = "row") -> DataFrame:
    """The rows whose number (key) is among those of `wanted`: exact, and no row travels. A number is a bit in the map of its 32,768 neighbours; maps (4 KB) are few enough to go everywhere."""
    bit = F.bitmap_bit_position(key)
    maps = wanted.groupBy(F.bitmap_bucket_number(key).alias("_bucket")).agg(F.bitmap_construct_agg(bit).alias("_map"))
    byte = F.conv(F.hex(F.substring("_map", (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    met = rows.join(F.broadcast(materialise(maps)), F.bitmap_bucket_number(key) == F.col("_bucket"))
    return met.where(F.getbit(byte, (bit % 8).cast("int")) == 1).select(*rows.columns)


def with_sets(asked: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """asked (written) with the sets of its rows, which `key` names. Sets of other rows don't travel, however many are asked for."""
    held = rows.select(F.col("row").alias(key), "whole")
    if small_enough(asked, NARROW_ROWS):
        return held.join(F.broadcast(asked), key)
    return marked(held, asked, key).join(asked, key)


def linked(cells: DataFrame, rows: DataFrame) -> DataFrame:
    """Edges (a, b) of a forest over the links in each cell of (bucket, cell, node, asks, label).

    Nodes that ask are searched among the cell's nodes of other labels; rows have the sets. Nodes that a link has joined
    already are not compared again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for groups, table in in_groups(batches, ["bucket", "cell"]):
            a, b = [], []
            for begin, end in groups:
                own = table.slice(begin, end - begin).combine_chunks()
                node, label, asks = (_column(own, c) for c in ("node", "label", "asks"))
                values, at = whole_sets(own.column("whole").chunk(0))
                index = Index(values, at)
                group = np.unique(label, return_inverse=True)[1]
                for i in np.flatnonzero(asks).tolist():
                    wanted = group != group[i]
                    if not wanted.any():
                        continue
                    for j in index.search(values[at[i] : at[i + 1]], wanted).tolist():
                        if group[j] != group[i]:
                            group[group == group[j]] = group[i]
                            a.append(node[i])
                            b.append(node[j])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    asked = materialise(cells)
    dealt = with_sets(asked, rows, "node").repartition("bucket", "cell").sortWithinPartitions("bucket", "cell")
    return materialise(dealt.select("bucket", "cell", "node", "asks", "label", "whole").mapInArrow(run, "a bigint, b bigint").distinct())


def _labelled(entries: DataFrame, edges: DataFrame) -> DataFrame:
    """entries with label: the component of the node."""
    label = checked(materialise(components(edges, "node", "label")))
    return entries.join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))


def _open_lists(entries: DataFrame) -> DataFrame:
    """Of entries with labels: those of lists that hold several components, with `main`, a list's largest one."""
    sizes = entries.groupBy("shingle", "label").count().groupBy("shingle").agg(F.count("*").alias("labels"), F.max(F.struct("count", "label")).alias("most"))
    several = materialise(sizes.where("labels > 1").select("shingle", F.col("most.label").alias("main")))
    return materialise(entries.join(checked(several), "shingle"))


def _sent(entries: DataFrame) -> DataFrame:
    """What each list sends to its members: (node, n, others, sizes), the smaller nodes of other components that can be similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for groups, table in in_groups(batches, ["shingle"], 8192):
            every = [_column(table, c) for c in ("node", "n", "label")]
            heads, others, sizes = [], [], []
            for begin, end in groups:
                node, n, label = (x[begin:end] for x in every)
                order = np.lexsort((node, n))
                node, n, label = node[order], n[order], label[order]
                low = np.searchsorted(n, (OF_UNION * n + 99) // 100)
                for i in range(1, len(node)):
                    near = low[i] + np.flatnonzero(label[low[i] : i] != label[i])
                    if len(near):
                        near = near[np.argsort(node[near])]
                        heads.append((node[i], n[i]))
                        others.append(node[near])
                        sizes.append(n[near])
            if heads:
                at = np.append(0, np.cumsum([len(x) for x in others])).astype(np.int64)
                own = np.array(heads, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(own[:, 0]), pa.array(own[:, 1]), packed(np.concatenate(others), at), packed(np.concatenate(sizes), at)], ["node", "n", "others", "sizes"])

    dealt = entries.select("shingle", "node", "n", "label").repartition("shingle").sortWithinPartitions("shingle")
    return dealt.mapInArrow(run, "node bigint, n bigint, others binary, sizes binary")


def _near(sent: DataFrame) -> DataFrame:
    """Nodes (node) that are near another one."""
    return _candidates(sent).select(F.explode(F.array("node", "other")).alias("node")).distinct()


def _candidates(sent: DataFrame) -> DataFrame:
    """(node, other) that share as many listed shingles as linked sets of their sizes do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for groups, table in in_groups(batches, ["node"], 4096):
            node, n = _column(table, "node"), _column(table, "n")
            others, at = unpacked(table.column("others").combine_chunks(), "<i8")
            sizes, _ = unpacked(table.column("sizes").combine_chunks(), "<i8")
            found = []
            for begin, end in groups:
                known, where = np.unique(others[at[begin] : at[end]], return_index=True)
                size = sizes[at[begin] : at[end]][where]
                both = needed(n[begin], size)
                goal = np.maximum(1, np.minimum(listed(n[begin]) - (n[begin] - both), listed(size) - (size - both)))
                number, count = occurring([others[at[i] : at[i + 1]] for i in range(begin, end)], int(goal.min()))
                near = number[count >= goal[np.searchsorted(known, number)]]
                if len(near):
                    found.append(np.stack([np.full(len(near), node[begin]), near]))
            if found:
                pairs = np.concatenate(found, 1)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["node", "other"])

    return sent.repartition("node").sortWithinPartitions("node").mapInArrow(run, "node bigint, other bigint")


def _compared(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """The linked ones (a, b) of pairs (node, other), by whole sets: a node's candidates are indexed, and it is searched."""
    pairs = materialise(pairs)
    asked = materialise(pairs.groupBy("node").count())
    #: A node of very many candidates is searched in blocks of them.
    dealt = pairs.join(checked(asked), "node").withColumn("block", F.pmod(F.xxhash64("other"), F.ceil(F.col("count") / CELL_MEMBERS)))
    queries = dealt.select(F.col("node").alias("row"), "node", "block", F.lit(-1).cast("bigint").alias("other")).distinct()
    wanted = materialise(queries.unionByName(dealt.select(F.col("other").alias("row"), "node", "block", "other")))
    both = with_sets(wanted, rows, "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for groups, table in in_groups(batches, ["node", "block"], 64):
            node, other = _column(table, "node"), _column(table, "other")
            a, b = [], []
            for begin, end in groups:
                values, at = whole_sets(table.column("whole").slice(begin, end - begin).combine_chunks())
                query = int(np.flatnonzero(other[begin:end] < 0)[0])
                found = Index(values, at).search(values[at[query] : at[query + 1]], other[begin:end] >= 0)
                a += [node[begin]] * len(found)
                b += other[begin:end][found].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return materialise(both.repartition("node", "block").sortWithinPartitions("node", "block").mapInArrow(run, "a bigint, b bigint"))


def _cells(entries: DataFrame, most_members: int, most_shingles: int) -> DataFrame:
    """entries (bucket, node, n) with cell, of bounded size."""
    cells = F.least(F.col("m"), F.ceil(F.greatest(F.col("m") / most_members, F.col("all_n") / most_shingles)).cast("bigint"))
    sizes = entries.groupBy("bucket").agg(F.count("*").alias("m"), F.sum("n").alias("all_n")).where("m > 1").select("bucket", cells.alias("cells"))
    return entries.join(checked(materialise(sizes)), "bucket").withColumn("cell", F.pmod(F.xxhash64("node", "bucket"), F.col("cells")))


def _in_blocks(crowded: DataFrame, rows: DataFrame, most_members: int, most_shingles: int) -> DataFrame:
    """Edges between nodes outside the largest component of a long list and the list's other nodes: every block of the ones with every block of the others."""
    here = crowded.withColumnRenamed("shingle", "bucket")
    known = _cells(here.where("label = main").select("bucket", "node", "n", "label"), most_members, most_shingles).withColumn("asks", F.lit(False))
    asking = here.where("label <> main").select("bucket", "node", "n", "label")
    lone = here.where("label = main").groupBy("bucket").agg(F.count("*").alias("m")).where("m = 1").select("bucket")
    known = materialise(known.unionByName(here.where("label = main").join(lone, "bucket", "left_semi").select("bucket", "node", "n", "label", F.lit(1).cast("bigint").alias("cells"), F.lit(0).cast("bigint").alias("cell"), F.lit(False).alias("asks")), allowMissingColumns=True))
    m = asking.groupBy("bucket").agg(F.count("*").alias("m"), F.sum("n").alias("all_n"))
    blocks = F.least(F.col("m"), F.ceil(F.greatest(F.col("m") / most_members, F.col("all_n") / most_shingles)).cast("bigint"))
    asking = materialise(asking.join(checked(materialise(m.select("bucket", blocks.alias("blocks")))), "bucket").withColumn("block", F.pmod(F.xxhash64("node", "bucket"), F.col("blocks"))))
    of_known = checked(materialise(known.groupBy("bucket").agg(F.first("cells").alias("cells"))))
    of_asking = checked(materialise(asking.groupBy("bucket").agg(F.first("blocks").alias("blocks"))))
    #: Cells: a block of those that ask with a cell of the largest component, or with another block of those that ask.
    one = asking.join(of_known, "bucket").withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("cells") - 1)))
    one = one.select("bucket", (F.col("block") * F.col("cells") + F.col("other")).alias("cell"), "node", F.lit(True).alias("asks"), "label")
    two = known.drop("asks").join(of_asking, "bucket").withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    two = two.select("bucket", (F.col("block") * F.col("cells") + F.col("cell")).alias("cell"), "node", F.lit(False).alias("asks"), "label")
    pair = -1 - (F.least("block", "other") * F.col("blocks") + F.greatest("block", "other"))
    three = asking.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))).select("bucket", pair.alias("cell"), "node", F.lit(True).alias("asks"), "label")
    return linked(one.union(two).union(three).distinct(), rows)


def links(rows: DataFrame, nodes: DataFrame, most_members: int = CELL_MEMBERS, most_shingles: int = CELL_SHINGLES, list_members: int = LIST_MEMBERS) -> DataFrame | None:
    """Edges (a, b) that connect the nodes (row, n, first) as their links do; None where no shingle is shared."""

    def entries_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, at = unpacked(batch.column("first"))
            here = np.repeat(np.arange(batch.num_rows), np.diff(at))
            yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(batch.column("row").to_numpy()[here]), pa.array(batch.column("n").to_numpy()[here])], ["shingle", "node", "n"])

    every = nodes.select("row", "n", "first").mapInArrow(entries_of, "shingle bigint, node bigint, n bigint")
    shared = materialise(every.groupBy("shingle").agg(F.count("*").alias("m")).where("m > 1"))
    if small_enough(shared, NARROW_ROWS):
        entries = materialise(every.join(F.broadcast(shared), "shingle"))
    else:
        low = F.col("shingle").bitwiseAND(SHARED_BITS - 1).alias("low")
        entries = materialise(marked(every.select("*", low), shared.select(low), "low").drop("low").join(shared, "shingle"))
    if entries.isEmpty():
        return None
    near = _near(_sent(entries.where(F.col("m") <= list_members).withColumn("label", F.col("node"))))
    near = materialise(near.union(entries.where(F.col("m") > list_members).select("node")).distinct())
    entries = materialise(entries.join(checked(near, NARROW_ROWS), "node", "left_semi"))
    if entries.isEmpty():
        return None
    chosen = entries.groupBy("node", "n").agg(F.max(F.struct("m", "shingle")).alias("longest")).select(F.col("longest.shingle").alias("bucket"), "node", "n")
    cells = _cells(materialise(chosen), most_members, most_shingles)
    edges = linked(cells.select("bucket", "cell", "node", F.lit(True).alias("asks"), F.col("node").alias("label")), rows)
    left = _open_lists(_labelled(entries, edges))
    if left.isEmpty():
        return edges
    few = _compared(_candidates(_sent(left.where(F.col("m") <= list_members))), rows)
    edges = edges.union(few)
    long = left.where(F.col("m") > list_members)
    if not long.isEmpty():
        edges = materialise(edges)
        again = _open_lists(_labelled(long.drop("label", "main"), edges))
        if not again.isEmpty():
            edges = edges.union(_in_blocks(again, rows, most_members, most_shingles))
    return materialise(edges)


def joined(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **sizes) -> DataFrame:
    """One row per document: id, n_shingles, component_id (smallest id that links reach, its own included)."""
    spark = docs.sparkSession
    workers_see_package(spark)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    texts = docs.select(F.col(id_col).alias("id"), F.translate(F.coalesce(F.col(text_col), F.lit("")), letters, letters.lower()).alias("text"))
    sketch = spark.sparkContext.broadcast(counted(texts, counters_for(docs.count())))
    rows = materialise(sets(texts, sketch).withColumn("row", F.monotonically_increasing_id()))
    words = rows.where("n > 0")
    shapes = materialise(words.groupBy("shape").agg(F.min("row").alias("row"), F.min("id").alias("least")))
    nodes = marked(words.select("row", "n", "first"), shapes.select("row"))
    edges = links(words, nodes, **sizes)
    known = shapes
    if edges is not None and not edges.isEmpty():
        label = materialise(components(edges, "row", "label"))
        least = label.join(shapes.select("row", "least"), "row").groupBy("label").agg(F.min("least").alias("all_least"))
        known = shapes.join(checked(materialise(label.join(least, "label").select("row", "all_least"))), "row", "left").select("shape", F.coalesce("all_least", "least").alias("least"))
    out = words.select("id", "n", "shape").join(known.select("shape", "least"), "shape").select("id", "n", F.col("least").alias("component_id"))
    out = out.union(rows.where("n = 0").select("id", "n", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")
