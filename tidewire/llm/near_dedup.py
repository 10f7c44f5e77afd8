"""Near-duplicate detection by improved consistent weighted sampling over TF-IDF shingles.

Shingles are runs of five words (maximal runs of visible characters, lower case; a text of fewer words is one shingle).
A shingle weighs (1 + ln count) * idf; document frequencies of all rows are counted in a sketch of fixed size, and idf
falls from 1.25 for unique shingles to 1 for ubiquitous ones, so that a large group of copies cannot devalue what its
members share: any pair of plain similarity 0.834 or more passes 0.8 of the weighted one, and none under 0.762 does.

Texts of equal shingle counts are one node. ROWS * BANDS consistent weighted samples per node form BANDS bucket keys. A
bucket is dealt into cells of bounded size; in a cell, mates that agree in LEAST_AGREEING samples at least are looked at
in the first band that they share, and only their texts travel: a cell's texts meet in one task, which takes all of its
exact weighted Jaccard similarities at once and puts out a forest of links. Members of one bucket that lie in different
cells and in different classes then meet cell by cell, so every pair of bucket mates is settled. Classes are the
connected components; a class is named by its smallest id.

A pair of similarity 0.8 agrees in fewer than LEAST_AGREEING of 64 samples with probability 1e-6, and shares no bucket
with probability 0.0002; nothing else is lost.

Null texts are empty. Texts without words are classes of their own, as are rows with a null id (class null). Rows
repeated under one id are told apart by their text: each takes the class of its text. Ties (several texts of one
similarity, copies) need no order, as classes are components. Texts of any length are read whole. An empty table gives
an empty result, extra columns are ignored by classes() and kept by one_of_each(), whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm import buffers
from tidewire.operators.graph import connected_components
from tidewire.runtime import checked, materialise, workers_see_package

WORDS = 5
THRESHOLD = 0.8
ROWS, BANDS = 4, 16
#: Samples of ROWS * BANDS in which two mates agree at least to be compared.
LEAST_AGREEING = 36
#: Members and words of a cell at most (a longer text is a cell's only one, or one of two).
CELL_MEMBERS = 768
CELL_WORDS = 1_000_000
#: Counters of the document-frequency sketch (fixed size: 4 MB), and how much more a unique shingle weighs.
SKETCH = 1 << 20
SKETCH_CHUNK = 1 << 12
IDF_SPAN = 0.25
#: Bytes of text that are worked on at once: small enough for the arrays to stay in the processor's cache.
SLICE = 120_000
#: Cells of up to so many texts are compared by lists of pairs, larger ones by matrix products.
FEW = 24

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Powers, so that words that change places change the sum.
_PLACE = np.array([pow(buffers.BASE, k, 1 << 64) for k in range(1, 17)], np.uint64)
_HASH = np.uint64((1 << 48) - 1)


def shingles(data: np.ndarray, at: np.ndarray, width: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, 48-bit shingle hash, count), sorted, of up to 65,536 lower-case texts."""
    visible = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    starts = np.flatnonzero(visible & (edge[:-1] | ~np.concatenate([[False], visible[:-1]])))
    ends = np.flatnonzero(visible & (edge[1:] | ~np.concatenate([visible[1:], [False]]))) + 1
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    word = np.append(buffers.span_hash(buffers.prefix_hash(data), starts, ends), np.zeros(width, np.uint64))
    doc = np.searchsorted(at, starts, side="right") - 1
    first = np.searchsorted(doc, np.arange(len(at)))
    number = np.diff(first)
    length = number[doc]
    begins = np.flatnonzero((np.arange(len(doc)) + np.minimum(width, length)) <= first[doc + 1])
    short = length[begins] < width
    begins = begins[~short | (begins == first[doc[begins]])]
    value = word[begins] * _PLACE[0]
    short = np.flatnonzero(length[begins] < width)
    for k in range(1, width):
        further = word[begins + k]
        if len(short):
            further[short[begins[short] + k >= first[doc[begins[short]] + 1]]] = 0
        value += further * _PLACE[k]
    key = np.sort((buffers.mix64(value) & _HASH) | doc[begins].astype(np.uint64) << np.uint64(48))
    fresh = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return (key[fresh] >> np.uint64(48)).astype(np.int64), key[fresh] & _HASH, np.diff(np.append(fresh, len(key)))


def idf_table(frequency: np.ndarray, docs: int, span: float = IDF_SPAN) -> np.ndarray:
    """Weights by sketch slot: 1 + span for document frequency 1, falling by its logarithm to 1 for all documents."""
    noise = frequency.sum() / len(frequency)  # what a slot counts of other shingles
    df = np.clip(frequency - noise, 1, max(docs, 2))
    return (1 + span * (1 - np.log(df) / np.log(max(docs, 2)))).astype(np.float32)


def slot(value: np.ndarray) -> np.ndarray:
    return (value & np.uint64(SKETCH - 1)).astype(np.int64)


def weighted(value: np.ndarray, count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return (1 + np.log(count)) * idf[slot(value)]


def _gamma_quantiles(n: int) -> np.ndarray:
    x = np.linspace(0, 30, 1 << 20)
    return np.interp((np.arange(n) + 0.5) / n, 1 - (1 + x) * np.exp(-x), x)


_tables: dict[str, tuple] = {}


def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gamma(2, 1) quantiles by 12 random bits, their inverses, and the logarithms of such quantiles by 16 random bits."""
    if "own" not in _tables:
        q = _gamma_quantiles(1 << 12).astype(np.float32)
        _tables["own"] = q, 1 / q, np.log(_gamma_quantiles(1 << 16)).astype(np.float32)
    return _tables["own"]


def samples(owner: np.ndarray, value: np.ndarray, weight: np.ndarray, number: int) -> tuple[np.ndarray, np.ndarray]:
    """(documents, `number` consistent weighted samples of 16 bits for each): equal with the probability of the pair's weighted Jaccard similarity."""
    gamma, inverse, log_gamma = tables()
    at = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    n = len(value)
    log_weight = np.log(weight).astype(np.float32)
    place = np.arange(n, dtype=np.uint64)
    mixed = buffers.mix64(value + np.uint64(1))
    h, packed = np.empty(n, np.uint64), np.empty(n, np.uint64)
    step, shift, rank = np.empty(n, np.float32), np.empty(n, np.float32), np.empty(n, np.float32)
    out = np.empty((len(at), number), np.uint16)
    seeds = buffers.mix64(np.arange(1, 2 * number + 1, dtype=np.uint64)) | np.uint64(1)
    for k in range(number):
        np.multiply(mixed, seeds[2 * k], out=h)
        np.right_shift(h, np.uint64(32), out=packed)
        np.bitwise_xor(h, packed, out=h)
        np.multiply(h, seeds[2 * k + 1], out=h)
        quarters = h.view(np.uint16).reshape(-1, 4)
        a = (h >> np.uint64(52)).view(np.int64)
        np.multiply(quarters[:, 1], np.float32(1 / 65536), out=shift, casting="unsafe")
        np.take(inverse, a, out=step, mode="clip")
        np.multiply(step, log_weight, out=step)
        np.add(step, shift, out=step)
        np.floor(step, out=step)
        #: ln c - r (t - beta + 1), the logarithm of c / (y exp(r)).
        np.subtract(shift, step, out=shift)
        np.subtract(shift, np.float32(1), out=shift)
        np.take(gamma, a, out=rank, mode="clip")
        np.multiply(shift, rank, out=shift)
        np.take(log_gamma, quarters[:, 2].astype(np.intp), out=rank, mode="clip")
        np.add(rank, shift, out=rank)
        np.add(rank, np.float32(1024), out=rank)
        packed = rank.view(np.uint32).astype(np.uint64)
        np.left_shift(packed, np.uint64(32), out=packed)
        np.bitwise_or(packed, place, out=packed)
        won = (np.minimum.reduceat(packed, at) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        out[:, k] = buffers.mix64(h[won] + step[won].astype(np.int64).astype(np.uint64) * np.uint64(0xA24BAED4963EE407)) >> np.uint64(48)
    return owner[at], out


def similar(cell: np.ndarray, owner: np.ndarray, value: np.ndarray, count: np.ndarray, idf: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of texts of one cell (cell[i] is text i's; ascending) whose weighted Jaccard similarity reaches the threshold.

    The least of two weights (1 + ln count) * idf is a sum over the counts that both reach; so similarities are products
    of 0/1 columns. Columns that the same texts share are added up first.
    """
    n = len(cell)
    token = np.repeat(np.arange(len(value)), count)
    level = np.arange(len(token)) - np.repeat(np.cumsum(count) - count, count)
    who = owner[token]
    mass = idf[slot(value)].astype(float)[token] * np.where(level == 0, 1.0, np.log1p(1 / np.maximum(level, 1)))
    total = np.bincount(who, mass, n)
    column = buffers.mix64(value[token] + level.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    column = buffers.mix64(column + cell[who].astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
    order = np.argsort(column, kind="stable")
    column, who, mass = column[order], who[order], mass[order]
    begin = np.flatnonzero(np.append(True, column[1:] != column[:-1])) if n and len(column) else np.zeros(0, np.int64)
    length = np.diff(np.append(begin, len(column)))
    begin, length = begin[length > 1], length[length > 1]
    if not len(begin):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    marks = np.append(np.uint64(0), np.cumsum(buffers.mix64(np.arange(1, n + 1, dtype=np.uint64))[who]))
    _, lead, pattern = np.unique(marks[begin + length] - marks[begin], return_index=True, return_inverse=True)
    mass = np.bincount(pattern, mass[begin])
    begin, length = begin[lead], length[lead]
    size = np.bincount(cell, minlength=int(cell[-1]) + 1)
    few = size[cell[who[begin]]] <= FEW
    left, right, common = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    for gap in range(1, FEW):
        run = np.flatnonzero(few & (length > gap))
        if not len(run):
            break
        pairs = length[run] - gap
        which = np.repeat(run, pairs)
        at = begin[which] + np.arange(len(which)) - np.repeat(np.cumsum(pairs) - pairs, pairs)
        left.append(who[at])
        right.append(who[at + gap])
        common.append(mass[which])
    a, b, shared = (np.concatenate(x) for x in (left, right, common))
    key = a * n + b
    key, where = np.unique(key, return_inverse=True)
    shared = np.bincount(where, shared, len(key))
    a, b = key // n, key % n
    close = shared >= threshold * (total[a] + total[b] - shared)
    left, right = [a[close]], [b[close]]
    for c in np.unique(cell[who[begin[~few]]]):
        base = int(np.searchsorted(cell, c))
        members = int(size[c])
        rows = np.flatnonzero(~few & (cell[who[begin]] == c))
        product = np.zeros((members, members))
        for part in np.array_split(rows, -(-len(rows) // 1024)):
            x = np.zeros((len(part), members))
            inner = np.repeat(np.arange(len(part)), length[part])
            at = np.repeat(begin[part], length[part]) + np.arange(len(inner)) - np.repeat(np.cumsum(length[part]) - length[part], length[part])
            x[inner, who[at] - base] = 1
            product += (x * mass[part, None]).T @ x
        own = total[base : base + members]
        i, j = np.nonzero(product >= threshold * (own[:, None] + own[None] - product))
        left.append(i[i < j] + base)
        right.append(j[i < j] + base)
    return np.concatenate(left), np.concatenate(right)


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest one that the edges connect it with."""
    label = np.arange(n)
    while True:
        before = label.copy()
        np.minimum.at(label, a, label[b])
        np.minimum.at(label, b, label[a])
        label = label[label]
        if (label == before).all():
            return label


def similarities(a: pa.Array, b: pa.Array, idf: np.ndarray) -> np.ndarray:
    """Weighted Jaccard similarities of two columns of lower-case texts (0 where both have no words)."""
    n = len(a)
    sides = [shingles(*buffers.utf8(x)) for x in (a, b)]
    owner = np.concatenate([s[0] for s in sides])
    value = np.concatenate([s[1] for s in sides])
    weight = np.concatenate([weighted(s[1], s[2], idf) for s in sides])
    order = np.lexsort((value, owner))
    owner, value, weight = owner[order], value[order], weight[order]
    total = np.bincount(owner, weight, n)
    met = np.flatnonzero((owner[1:] == owner[:-1]) & (value[1:] == value[:-1]))
    common = np.bincount(owner[met], np.minimum(weight[met], weight[met + 1]), n)
    return common / np.maximum(total - common, 1e-12)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, h, text): lower-case texts, told apart by h where an id repeats."""
    rows = docs.select(F.col(id_col).alias("id"), F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("text"))
    return rows.select("id", F.xxhash64("text").alias("h"), "text")


def frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """The document-frequency sketch over all rows, and their number."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, docs = np.zeros(SKETCH, np.int64), 0
        for batch in batches:
            docs += batch.num_rows
            slots = [np.zeros(0, np.int64)] + [slot(shingles(*buffers.utf8(part.column("text")))[1]) for part in buffers.slices(batch, "text", SLICE)]
            sketch += np.bincount(np.concatenate(slots), minlength=SKETCH)
        kind = "<u2" if sketch.max() < 65536 else "<i8"
        parts = [sketch[k : k + SKETCH_CHUNK].astype(kind).tobytes() for k in range(0, SKETCH, SKETCH_CHUNK)]
        yield pa.RecordBatch.from_arrays([pa.array([*range(len(parts)), -1], pa.int64()), pa.array([*parts, np.array([docs], "<i8").tobytes()], pa.binary()), pa.array([kind] * len(parts) + ["<i8"])], ["chunk", "counts", "kind"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, counts, kind in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                sums[chunk] = sums.get(chunk, 0) + np.frombuffer(counts, kind).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["chunk", "counts"])

    parts = texts.select("text").mapInArrow(counted, "chunk bigint, counts binary, kind string").repartition("chunk").mapInArrow(summed, "chunk bigint, counts binary").collect()
    got = {r["chunk"]: np.frombuffer(r["counts"], np.int64) for r in parts}
    if not got:
        return np.zeros(SKETCH, np.int64), 0
    return np.concatenate([got[k] for k in range(SKETCH // SKETCH_CHUNK)]), int(got[-1][0])


def signatures(texts: DataFrame, idf) -> DataFrame:
    """Per row that has words: id, h, shape (16 bytes naming its shingle counts), words, sample (ROWS * BANDS samples of two bytes)."""
    key = texts.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = idf.value
        for batch in batches:
            for part in buffers.slices(batch, "text", SLICE):
                owner, value, count = shingles(*buffers.utf8(part.column("text")))
                if not len(owner):
                    continue
                docs, sample = samples(owner, value, weighted(value, count, table), ROWS * BANDS)
                at = np.searchsorted(owner, docs)
                shape = np.stack([np.add.reduceat(buffers.mix64(value + (count.astype(np.uint64) << np.uint64(48)) + np.uint64(s)), at) for s in (0xA5A5, 0x5A5A5A)], 1)
                who = pa.array(docs)
                yield pa.RecordBatch.from_arrays([part.column("id").take(who), part.column("h").take(who), _binary(shape), pa.array(np.add.reduceat(count, at)), _binary(sample)], ["id", "h", "shape", "words", "sample"])

    return texts.mapInArrow(run, f"id {key}, h bigint, shape binary, words bigint, sample binary")


def _binary(rows: np.ndarray) -> pa.Array:
    """A row of the matrix as the bytes of one value."""
    width = rows.shape[1] * rows.itemsize
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer((np.arange(len(rows) + 1) * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(rows))])


def bands(sample: Column) -> Column:
    """(band, bucket) of each band of a sample."""
    width = 2 * ROWS
    return F.array(*[F.struct(F.lit(b).alias("band"), F.xxhash64(F.lit(b), F.substring(sample, b * width + 1, width)).alias("bucket")) for b in range(BANDS)])


def _by_cell(batches: Iterator[pa.RecordBatch], most: int = 4096) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Table]]:
    """(begins, ends, rows) of whole cells, of rows sorted by bucket and cell: about `most` rows at once, or one larger cell."""
    held: list[pa.RecordBatch] = []
    count = 0

    def whole(last: bool):
        table = pa.Table.from_batches(held).combine_chunks()
        keys = np.stack([table.column(c).to_numpy().astype(np.int64) for c in ("bucket", "cell")], 1)
        begin = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(1)))
        upto = len(table) if last else int(begin[-1])
        begin = begin[begin < upto]
        return begin, np.append(begin[1:], upto)[: len(begin)], table, upto

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        if count >= most:
            begin, end, table, upto = whole(False)
            if upto:
                yield begin, end, table.slice(0, upto)
            held = table.slice(upto).to_batches()
            count = len(table) - upto
    if held:
        begin, end, table, upto = whole(True)
        if upto:
            yield begin, end, table.slice(0, upto)


def mates(members: DataFrame) -> DataFrame:
    """Of (bucket, cell, band, node, label, sample): bucket, cell, node of those that have a mate of another label to be compared in this cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for begin, end, table in _by_cell(batches):
            sample = np.frombuffer(b"".join(table.column("sample").to_pylist()), np.uint16).reshape(len(table), -1)
            joint = sample.view(np.uint64)  # a band's samples as one number
            label, band = table.column("label").to_numpy(), table.column("band").to_numpy()
            wanted = np.zeros(len(table), bool)
            two = begin[end - begin == 2]
            if len(two):
                #: No earlier band in common, and enough samples.
                later = np.arange(joint.shape[1])[None] >= band[two, None]
                good = ((joint[two] == joint[two + 1]) <= later).all(1) & ((sample[two] == sample[two + 1]).sum(1) >= LEAST_AGREEING) & (label[two] != label[two + 1])
                wanted[two[good]] = wanted[two[good] + 1] = True
            for a, b in zip(begin[end - begin > 2].tolist(), end[end - begin > 2].tolist(), strict=True):
                own = np.ascontiguousarray(sample[a:b].T)
                agreeing = np.zeros((b - a, b - a), np.uint8)
                for column in own:
                    agreeing += column[:, None] == column[None]
                open_pairs = (agreeing >= LEAST_AGREEING) & (label[a:b, None] != label[None, a:b])
                for k in range(int(band[a])):
                    open_pairs &= joint[a:b, k, None] != joint[None, a:b, k]
                wanted[a:b] = open_pairs.any(1)
            yield pa.RecordBatch.from_arrays([pa.array(table.column(c).to_numpy()[wanted]) for c in ("bucket", "cell", "node")], ["bucket", "cell", "node"])

    dealt = members.select("bucket", "cell", "band", "node", "label", "sample").repartition("bucket", "cell").sortWithinPartitions("bucket", "cell")
    return dealt.mapInArrow(run, "bucket bigint, cell bigint, node bigint")


def linked(open_members: DataFrame, nodes: DataFrame, texts: DataFrame, idf, threshold: float) -> DataFrame:
    """Edges (a, b) of a forest that connects the nodes of each cell of open_members (bucket, cell, node) as its similar pairs do."""
    keys = materialise(open_members.join(nodes.select("node", "id", "h"), "node"))
    wanted = checked(materialise(keys.select("id", "h").distinct()), 100_000)
    some = texts.join(wanted, ["id", "h"], "left_semi").dropDuplicates(["id", "h"])
    rows = keys.join(some, ["id", "h"]).select("bucket", "cell", "node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_of = idf.value
        for begin, end, table in _by_cell(batches, 512):
            node = table.column("node").to_numpy()
            cell = np.repeat(np.arange(len(begin)), end - begin)
            parts, done = [], 0
            for batch in table.to_batches():
                for part in buffers.slices(batch, "text", SLICE):
                    owner, value, count = shingles(*buffers.utf8(part.column("text")))
                    parts.append((owner + done, value, count))
                    done += part.num_rows
            owner, value, count = (np.concatenate(x) for x in zip(*parts, strict=True))
            label = forest(len(node), *similar(cell, owner, value, count, table_of, threshold))
            tied = np.flatnonzero(label != np.arange(len(node)))
            yield pa.RecordBatch.from_arrays([pa.array(node[label[tied]]), pa.array(node[tied])], ["a", "b"])

    met = rows.repartition("bucket", "cell").sortWithinPartitions("bucket", "cell")
    return materialise(met.mapInArrow(run, "a bigint, b bigint").distinct())


def links(nodes: DataFrame, texts: DataFrame, idf, threshold: float = THRESHOLD, most_members: int = CELL_MEMBERS, most_words: int = CELL_WORDS) -> DataFrame | None:
    """Edges (a, b) that connect the nodes (node, id, h, words, sample) joined by bucket mates of at least `threshold`; None without mates."""
    members = nodes.select("node", "words", F.explode(bands(F.col("sample"))).alias("b")).select("b.band", "b.bucket", "node", "words")
    cells = F.ceil(F.greatest(F.col("n") / most_members, F.col("all_words") / most_words)).cast("bigint")
    shared = members.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("words").alias("all_words")).where("n > 1")
    shared = materialise(shared.select("bucket", "n", F.least("n", cells).alias("cells")))
    found = materialise(members.join(checked(shared), "bucket").withColumn("salt", F.pmod(F.xxhash64("node", "bucket"), F.col("cells"))))
    if found.isEmpty():
        return None
    held = found.join(nodes.select("node", "sample"), "node")
    edges = linked(mates(held.withColumn("cell", F.col("salt")).withColumn("label", F.col("node"))), nodes, texts, idf, threshold)
    crowded = materialise(found.where("cells > 1"))
    if crowded.isEmpty():
        return edges
    return materialise(edges.union(_across(crowded, edges, nodes, texts, idf, threshold)))


def _across(crowded: DataFrame, edges: DataFrame, nodes: DataFrame, texts: DataFrame, idf, threshold: float) -> DataFrame:
    """Edges between mates of different cells of a bucket: those outside its largest class meet the bucket's other cells."""
    label = checked(materialise(components(edges, "node", "label")))
    named = materialise(crowded.join(label, "node", "left").withColumn("label", F.coalesce("label", "node")))
    sizes = named.groupBy("bucket", "label").count().groupBy("bucket").agg(F.max(F.struct("count", "label")).alias("most"))
    outside = named.join(checked(materialise(sizes.select("bucket", F.col("most.label").alias("main")))), "bucket").where("label <> main").drop("main")
    outside = materialise(outside)
    #: A pair of cells (s, t), s < t, is a cell of its own, numbered above the others.
    pair = F.least("salt", "other") * F.col("cells") + F.greatest("salt", "other") + F.col("cells")
    going = outside.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("cells") - 1))).where("other <> salt")
    visited = checked(materialise(outside.select("bucket", F.col("salt").alias("other")).distinct()))
    staying = named.join(visited, "bucket").where("other <> salt")
    columns = ["bucket", "band", "node", "label"]
    met = going.select(*columns, pair.alias("cell")).union(staying.select(*columns, pair.alias("cell"))).distinct()
    return linked(mates(met.join(nodes.select("node", "sample"), "node")), nodes, texts, idf, threshold)


def components(edges: DataFrame, node: str, label: str) -> DataFrame:
    """(node, label) of the nodes with edges."""
    return connected_components(edges.select(F.col("a").alias("id")).union(edges.select("b")), edges).select(F.col("id").alias(node), F.col("component").alias(label))


def labelled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, **cells) -> DataFrame:
    """Per row: id, h (hash of its text), class_id (smallest id of its class; its own id where there is none), lead (the class's least (id, h))."""
    spark = docs.sparkSession
    workers_see_package(spark)
    texts = _texts(docs, id_col, text_col)
    frequency, n = frequencies(texts)
    idf = spark.sparkContext.broadcast(idf_table(frequency, n))
    texts_known = texts.where("id IS NOT NULL")
    signed = materialise(signatures(texts_known, idf))
    #: Numbers of nodes are read from a written table, so they stay what they are.
    shapes = signed.groupBy("shape").agg(F.min(F.struct("id", "h", "words", "sample")).alias("lead"))
    nodes = materialise(shapes.select("shape", F.monotonically_increasing_id().alias("node"), "lead.*"))
    edges = links(nodes, texts_known, idf, threshold, **cells)
    known = nodes.select("shape", "node", F.struct("id", "h").alias("lead"))
    if edges is not None and not edges.isEmpty():
        label = materialise(components(edges, "node", "label"))
        leads = materialise(known.join(checked(label), "node").groupBy("label").agg(F.min("lead").alias("first")))
        joined = materialise(label.join(checked(leads), "label").select("node", "first"))
        known = known.join(checked(joined), "node", "left").select("shape", F.coalesce("first", "lead").alias("lead"))
    rows = signed.select("id", "h", "shape").join(known.select("shape", "lead"), "shape").select("id", "h", F.col("lead.id").alias("class_id"), (F.struct("id", "h") == F.col("lead")).alias("lead"))
    bare = texts.where(F.col("id").isNull() | ~F.col("text").rlike("[^\\x20\\x09-\\x0D]"))
    return rows.union(bare.select("id", "h", F.col("id").alias("class_id"), F.lit(True).alias("lead")))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, **cells) -> DataFrame:
    """Per row: id, class_id (smallest id of its near-duplicates; its own id where there is none)."""
    return labelled(docs, id_col, text_col, threshold, **cells).select(F.col("id").alias(id_col), "class_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class, that of the least (id, text hash), with docs' columns; rows without words or id all stay.

    Rows of one id and text are one document: one of them stays.
    """
    rows = materialise(labelled(docs, id_col, text_col))
    h = F.xxhash64(F.lower(F.coalesce(F.col(text_col), F.lit(""))))
    out = materialise(rows.where("NOT lead").select(F.col("id").alias("_dropped"), F.col("h").alias("_h")).distinct())
    left = docs.join(checked(out), (F.col(id_col) == F.col("_dropped")) & (h == F.col("_h")), "left_anti")
    again = materialise(rows.where("lead AND id IS NOT NULL").groupBy(F.col("id").alias("_again"), F.col("h").alias("_h")).count().where("count > 1").drop("count"))
    if again.isEmpty():
        return left
    this = (F.col(id_col) == F.col("_again")) & (h == F.col("_h"))
    key = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    repeated = left.join(checked(again), this, "left_semi").select(F.col(id_col).alias("id"), h.alias("h"), key).dropDuplicates(["id", "h"]).select("row.*")
    return left.join(checked(again), this, "left_anti").unionByName(repeated)
