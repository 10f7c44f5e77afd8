"""Removal of repeated 100-byte strings by maximal repeats of enhanced suffix arrays.

A byte goes if a WIDTH-byte string that covers it starts earlier too (in a smaller id, or earlier in its document). These
are the bytes of all but the first occurrence of the maximal repeats of WIDTH bytes or more.

Finding candidates. Every window of WIDTH bytes is owned by its minimiser, the GRAM-byte string of least hash in it
(leftmost of equals): equal windows have equal owners at equal places. The consecutive windows that one owner owns are a
block, named by the owner's hash (anchor) and the hash of the block's bytes. One pass over the texts makes the blocks; a
task keeps the first of its equal blocks and settles the others at once, the rest are dealt by anchor, and of blocks
equal in both hashes all but the first are repeats throughout. Where two different blocks share an anchor, repeats begin
or end; these can share a window only if they agree in the SIDE bytes before or behind the owner, which marks of 12 bits
tell: only for such blocks are bytes fetched.

Settling them. The blocks of an anchor become contexts; their suffixes that start a window are sorted, the common-prefix
array is scanned with a stack into its interval tree, and each interval of at least WIDTH bytes whose suffixes differ in
the byte before (or start a block) is a maximal repeat, put out as a group with all its occurrences. All but a group's
first occurrence are removed. The suffixes of an anchor with more than GROUP_CONTEXTS different blocks are not gathered:
they are dealt by their first WIDTH bytes (a hash), of whose occurrences all but the first go, which gives the same bytes.

Null texts are empty. Documents are taken in order of id, null last; rows repeated under one id are ordered by their text
digest, and equal ones are told apart. Texts of any length are read whole. An empty table gives an empty result; extra
columns are ignored, whatever their names. Hashes of blocks and windows have 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm import buffers
from tidewire.runtime import checked, materialise, workers_see_package

WIDTH = 100
GRAM = 24
#: A window reaches so many bytes beyond its owner on one side at least.
SIDE = (WIDTH - GRAM) // 2
#: Contexts of an anchor that are put into one suffix array at most; beyond that its windows are grouped by hash.
GROUP_CONTEXTS = 4_000
#: Bytes of text that are worked on at once: small enough for the arrays to stay in the processor's cache.
SLICE = 100_000
#: Bytes of text that are read in one piece at most.
LONG = 1 << 22
#: Blocks that a task holds before it settles the equal ones.
FLUSH = 400_000


def anchors(data: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """Blocks of the concatenated texts (under 16 MB): doc, first and last window start, anchor and block hashes, and marks of the owner with SIDE bytes on either side (0 where the block ends before)."""
    n = len(data)
    empty = {k: np.zeros(0, np.uint64 if k in ("anchor", "block") else np.int64) for k in ("doc", "first", "last", "anchor", "block", "left", "right")}
    if n < WIDTH:
        return empty
    prefix = buffers.prefix_hash(data)
    hashed = buffers.sliding_hash(prefix, GRAM)
    place = np.uint64((1 << 24) - 1)
    #: The least hash of each run of WIDTH - GRAM + 1 grams, the leftmost of equals: place in the low bits of the compared value.
    least = (hashed & ~place) | np.arange(len(hashed), dtype=np.uint64)
    have, wanted = 1, WIDTH - GRAM + 1
    while have < wanted:
        step = min(have, wanted - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    owner = (least & place).view(np.int64)
    inside = np.zeros(len(owner) + 1, np.int8)
    held = np.flatnonzero(np.diff(at) >= WIDTH)
    starts, stops = at[held], at[held + 1] - WIDTH + 1
    np.add.at(inside, starts, 1)
    np.add.at(inside, stops, -1)
    inside = np.cumsum(inside[:-1], dtype=np.int8).view(bool)
    fresh = np.empty(len(owner) + 1, bool)
    np.not_equal(owner[1:], owner[:-1], out=fresh[1:-1])
    fresh[0] = fresh[-1] = True
    fresh[starts] = True
    fresh[stops[stops < len(owner)]] = True
    change = np.flatnonzero(fresh[:-1] & inside)
    if not len(change):
        return empty
    ends = np.flatnonzero(fresh[1:] & inside)
    own = owner[change]
    content = buffers.span_hash(prefix, change, ends + WIDTH) ^ ((own - change).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    doc = np.searchsorted(at, change, side="right") - 1
    mark = lambda a, b, whole: np.where(whole, (buffers.span_hash(prefix, np.where(whole, a, 0), np.where(whole, b, 0)) % np.uint64(4095)).astype(np.int64) + 1, 0)
    left, right = mark(own - SIDE, own + GRAM, own - SIDE >= change), mark(own, own + GRAM + SIDE, own + GRAM + SIDE <= ends + WIDTH)
    return {"doc": doc, "first": change - at[doc], "last": ends - at[doc], "anchor": hashed[own], "block": content, "left": left, "right": right}


def long_anchors(data: np.ndarray, at: np.ndarray, most: int = LONG) -> dict[str, np.ndarray]:
    """anchors() of texts of any length: long ones in overlapping pieces, at whose seams a block is cut in two."""
    if len(data) <= most:
        return anchors(data, at)
    out = []
    for doc, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
        for start in range(a, max(b - WIDTH + 1, a + 1), most):
            piece = data[start : min(start + most + WIDTH - 1, b)]
            found = anchors(piece, np.array([0, len(piece)]))
            out.append(found | {"doc": found["doc"] + doc, "first": found["first"] + start - a, "last": found["last"] + start - a})
    return {k: np.concatenate([o[k] for o in out]) for k in out[0]}


def spans(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Union of [start, end) intervals, ascending."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(starts.tolist(), ends.tolist(), strict=True)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def maximal_repeats(contexts: list[bytes], windows: list[int], width: int = WIDTH) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """(length, occurrences as (context, start)) of the maximal repeats of at least `width` bytes.

    Only suffixes that start one of a context's first windows[i] windows take part; matches end with their contexts. A
    suffix at a context's start differs from every other in the byte before.
    """
    owner = np.repeat(np.arange(len(contexts)), windows)
    start = np.concatenate([np.arange(w) for w in windows]) if len(windows) else np.zeros(0, int)
    if not len(owner):
        return
    longest = max(len(c) for c in contexts)
    text = np.zeros((len(contexts), longest + width), np.uint8)
    for k, c in enumerate(contexts):
        text[k, : len(c)] = np.frombuffer(c, np.uint8)
    length = np.array([len(c) for c in contexts])[owner] - start
    #: Suffixes in order of their first `width` bytes; those alone in that are no repeats.
    view = np.lib.stride_tricks.sliding_window_view(text, width, axis=1)
    head = np.ascontiguousarray(view[owner, start]).view(f"V{width}").ravel()
    order = np.argsort(head, kind="stable")
    same = head[order][1:] == head[order][:-1]
    paired = np.append(same, False) | np.append(False, same)
    if not paired.any():
        return
    order = order[paired]
    group = np.cumsum(~np.append(False, same))[paired]
    ahead = np.where(start[order] > 0, text[owner[order], np.maximum(start[order] - 1, 0)].astype(int), -1 - owner[order])
    low, high = _runs(group)
    #: Where all suffixes follow one byte, those one byte to the left form the longer repeat.
    diverse = np.minimum.reduceat(ahead, low) != np.maximum.reduceat(ahead, low)
    for a, b in zip(low[diverse].tolist(), high[diverse].tolist(), strict=True):
        rows, before = order[a:b], ahead[a:b]
        tails = sorted(range(len(rows)), key=lambda j: contexts[owner[rows[j]]][start[rows[j]] :])
        rows, before = rows[tails], before[tails]
        suffix = [contexts[owner[r]][start[r] :] for r in rows]
        common = [_common(a, b) for a, b in zip(suffix, suffix[1:], strict=False)]
        yield from _intervals(rows, before, common, owner, start, width)


def _runs(group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cut = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    return cut, np.append(cut[1:], len(group))


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    x = np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)
    return int(x.argmax()) if x.any() else n


def _intervals(rows, before, common, owner, start, width) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """Scan of the common-prefix array: each interval of its tree, if its suffixes differ in the byte before."""
    stack: list[tuple[int, int]] = []
    for k in range(1, len(rows) + 1):
        now = common[k - 1] if k < len(rows) else -1
        left = k - 1
        while stack and stack[-1][0] > now:
            depth, left = stack.pop()
            if k - left > 1 and len(set(before[left:k].tolist())) > 1:
                yield depth, [(int(owner[r]), int(start[r])) for r in rows[left:k]]
        if now >= width and (not stack or stack[-1][0] < now):
            stack.append((now, left))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(uid, id, text) with uid a number in order of the rows; the id itself where ids are unique, whole and not null."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    if docs.schema[id_col].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint"):
        odd = docs.select(F.col(id_col).alias("id")).groupBy("id").agg(F.count("*").alias("n")).where("n > 1 OR id IS NULL")
        if odd.isEmpty():
            return rows.select(F.col("id").cast("bigint").alias("uid"), "id", "text")
    ordered = rows.orderBy(F.col("id").asc_nulls_last(), F.sha2("text", 256))
    return materialise(ordered.select(F.monotonically_increasing_id().alias("uid"), "id", "text"))


BLOCK_SCHEMA = "kind int, anchor bigint, block bigint, uid bigint, first int, last int"
_BLOCK = ("anchor", "block", "uid", "first", "last")
#: Blocks and runs on their way to their anchors: at holds the first window start, both marks, and in its low byte the
#: block's span (under WIDTH) or RUN, where block holds the run's last window start.
PACKED_SCHEMA = "anchor bigint, block bigint, uid bigint, at bigint"
RUN = 255
#: Blocks of one anchor that are held for the comparison of their marks at most; more are all looked at.
HELD = 100_000


def _packed(anchor, block, uid, first, last, marks) -> Iterator[pa.RecordBatch]:
    """marks None: runs."""
    if len(uid):
        at = first.astype(np.int64) << 32 | (RUN if marks is None else marks << 8 | (last - first))
        columns = [np.zeros(len(uid), np.int64) if anchor is None else anchor.view(np.int64), last.astype(np.int64) if block is None else block.view(np.int64), uid.astype(np.int64), at]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["anchor", "block", "uid", "at"])


def _unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, list[np.ndarray]]:
    """(whether a row is a run, anchor, block, uid, first, last and marks)."""
    anchor, block, uid, at = (batch.column(c).to_numpy() for c in range(4))
    run, first = (at & 255) == RUN, (at >> 32).astype(np.int32)
    return run, [anchor, block, uid, first, np.where(run, block, first + (at & 255)).astype(np.int32), at >> 8 & 0xFFFFFF]


def blocks(texts: DataFrame) -> DataFrame:
    """One pass over (uid, text), as packed rows: runs of window starts that stand earlier too, and blocks, the first of those equal that a task met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        waiting = 0
        for batch in batches:
            for part in buffers.slices(batch, "text", SLICE):
                data, at = buffers.utf8(part.column("text"))
                uid = part.column("uid").to_numpy()
                b = long_anchors(data, at)
                held.append((b["anchor"], b["block"], uid[b["doc"]], b["first"].astype(np.int32), b["last"].astype(np.int32), b["left"] << 12 | b["right"]))
                waiting += len(b["doc"])
            if waiting > FLUSH:
                yield from _settled(held)
                held, waiting = [], 0
        yield from _settled(held)

    return texts.mapInArrow(run, PACKED_SCHEMA)


def met(dealt: DataFrame) -> DataFrame:
    """Of blocks() sorted by anchor and block: the runs, blocks that have an equal one before as runs (0), first blocks that can share a window with another one of their anchor (1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None  # anchor and block of the row before
        rest = [np.zeros(0, np.int64)] * 6  # first blocks of that anchor
        crowded = None  # an anchor whose first blocks go out as they come
        for batch in batches:
            runs, table = _unpacked(batch)
            yield from _rows(0, *(t[runs] for t in table[:5]))
            table = [t[~runs] for t in table]
            if not len(table[0]):
                continue
            anchor, block = table[:2]
            again = np.append(False, (anchor[1:] == anchor[:-1]) & (block[1:] == block[:-1]))
            again[0] = before == (anchor[0], block[0])
            before = anchor[-1], block[-1]
            yield from _runs_out(*(t[again] for t in table[2:5]))
            lead = [np.append(r, t[~again]) for r, t in zip(rest, table, strict=True)]
            if crowded is not None:
                more = lead[0] == crowded
                yield from _rows(1, *(t[more] for t in lead[:5]))
                lead = [t[~more] for t in lead]
            last = lead[0] == anchor[-1]
            yield from _alike([t[~last] for t in lead])
            rest = [t[last] for t in lead]
            if len(rest[0]) > HELD:
                yield from _rows(1, *rest[:5])
                crowded, rest = anchor[-1], [t[:0] for t in rest]
        yield from _alike(rest)

    return dealt.mapInArrow(run, BLOCK_SCHEMA)


def _alike(lead: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Of the first blocks of whole anchors those that share a mark, left or right, with another one of their anchor: others share no window."""
    anchor, marks = lead[0], lead[5]
    wanted = np.zeros(len(anchor), bool)
    for mark in (marks >> 12, marks & 0xFFF):
        there = np.flatnonzero(mark > 0)
        if not len(there):
            continue
        key = buffers.mix64(anchor[there].view(np.uint64) + mark[there].astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        wanted[there[order[np.append(same, False) | np.append(False, same)]]] = True
    yield from _rows(1, *(t[wanted] for t in lead[:5]))


def removals(keyed: DataFrame) -> DataFrame:
    """(uid, first, last): runs of window starts that stand earlier too, of (uid, text)."""
    texts = keyed.select("uid", "text")
    found = blocks(texts).repartition(F.when(F.expr(f"at & 255 = {RUN}"), F.xxhash64("uid", "at")).otherwise(F.col("anchor")))
    second = materialise(met(found.sortWithinPartitions("anchor", "block", "uid", "at")))
    requests = second.where("kind = 1")
    wanted = requests.groupBy("uid").agg(F.collect_list(F.struct("anchor", "first", "last")).alias("asked"))
    fetched, _ = _meeting(texts, materialise(wanted))

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uid, text, asked in zip(batch.column("uid").to_pylist(), batch.column("text"), batch.column("asked"), strict=True):
                raw, asked = text.as_py().encode(), asked.values
                anchor, first, last = (asked.field(c) for c in ("anchor", "first", "last"))
                cut = [raw[a : b + WIDTH] for a, b in zip(first.to_pylist(), last.to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([anchor, pa.array(np.full(len(cut), uid)), first, last, pa.array(cut, pa.binary())], ["anchor", "uid", "first", "last", "bytes"])

    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_anchor, rows = None, []
        for batch in batches:
            found: list[tuple] = []
            for row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "uid", "first", "last", "bytes")), strict=True):
                if row[0] != open_anchor:
                    found += _group_removals(rows)
                    open_anchor, rows = row[0], []
                rows.append(row[1:])
            yield _removed(found)
        yield _removed(_group_removals(rows))

    def exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The windows of contexts."""
        for batch in batches:
            for anchor, uid, first, last, raw in zip(*(batch.column(c).to_pylist() for c in ("anchor", "uid", "first", "last", "bytes")), strict=True):
                hashed, at = buffers.sliding_hash(buffers.prefix_hash(np.frombuffer(raw, np.uint8)), WIDTH), np.arange(first, last + 1)
                yield from _rows(2, np.full(len(at), anchor), hashed, np.full(len(at), uid), at, at)

    asked = fetched.select("uid", "text", "asked").mapInArrow(contexts, "anchor bigint, uid bigint, first int, last int, bytes binary")
    whole = second.where("kind = 0").select("uid", "first", "last")
    crowded = materialise(requests.groupBy("anchor").count().where(F.col("count") > GROUP_CONTEXTS).select("anchor"))
    if not crowded.isEmpty():
        whole = whole.union(_later(materialise(asked.join(checked(crowded), "anchor", "left_semi").mapInArrow(exploded, BLOCK_SCHEMA))))
        asked = asked.join(checked(crowded), "anchor", "left_anti")
    ordered = asked.repartition("anchor").sortWithinPartitions("anchor", "uid", "first")
    return whole.union(ordered.mapInArrow(repeated, "uid bigint, first int, last int"))


def _later(windows: DataFrame) -> DataFrame:
    """Windows that stand earlier too, grouped by their hash."""
    earliest = windows.groupBy("anchor", "block").agg(F.min(F.struct("uid", "first")).alias("best"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = windows.join(checked(materialise(earliest)), ["anchor", "block"])
    return again.where((F.col("uid") != F.col("best.uid")) | (F.col("first") != F.col("best.first"))).select("uid", "first", F.col("first").alias("last"))


def _meeting(texts: DataFrame, lists: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(texts with their list, texts without one). Only texts that have a list are shuffled, where their ids can be broadcast."""
    ids = checked(lists.select("uid"), 200_000)
    return texts.join(ids, "uid", "left_semi").join(lists, "uid"), texts.join(ids, "uid", "left_anti")


def _joined_runs(uid: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of window starts, those that touch put together."""
    if not len(uid):
        return uid, first, last
    order = np.lexsort((first, uid))
    uid, first, last = uid[order], first[order], last[order]
    apart = np.flatnonzero(np.append(True, (uid[1:] != uid[:-1]) | (first[1:] > last[:-1] + 1)))
    return uid[apart], first[apart], np.maximum.reduceat(last, apart)


def _runs_out(uid: np.ndarray, first: np.ndarray, last: np.ndarray) -> Iterator[pa.RecordBatch]:
    uid, first, last = _joined_runs(uid, first, last)
    nothing = np.zeros(len(uid), np.int64)
    yield from _rows(0, nothing, nothing, uid, first, last)


def _rows(kind: int, anchor, block, uid, first, last) -> Iterator[pa.RecordBatch]:
    if len(anchor):
        columns = [np.full(len(anchor), kind, np.int32), np.asarray(anchor).view(np.int64), np.asarray(block).view(np.int64), np.asarray(uid).astype(np.int64), np.asarray(first).astype(np.int32), np.asarray(last).astype(np.int32)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["kind", *_BLOCK])


def _settled(held: list[tuple]) -> Iterator[pa.RecordBatch]:
    """First of the equal blocks of what a task has read: to be dealt; the others: settled. Packed rows."""
    if not held:
        return
    anchor, block, uid, first, last, marks = (np.concatenate(x) for x in zip(*held, strict=True))
    #: Blocks come in order of their documents, as a rule; the two hashes as one keep equal blocks together.
    if (uid[1:] < uid[:-1]).any():
        order = np.lexsort((first, uid))
        anchor, block, uid, first, last, marks = (x[order] for x in (anchor, block, uid, first, last, marks))
    order = np.argsort(block ^ (anchor << np.uint64(1)), kind="stable")
    a, b = anchor[order], block[order]
    repeat = np.zeros(len(order), bool)
    repeat[order[1:]] = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
    yield from _packed(None, None, *_joined_runs(uid[repeat], first[repeat], last[repeat]), None)
    yield from _packed(*(x[~repeat] for x in (anchor, block, uid, first, last, marks)))


def _group_removals(rows: list[tuple]) -> list[tuple[int, int, int]]:
    """(uid, first, last) of the later occurrences of the maximal repeats among the contexts of one anchor."""
    if len(rows) < 2:
        return []
    out = []
    for length, places in maximal_repeats([r[3] for r in rows], [r[2] - r[1] + 1 for r in rows]):
        at = sorted((rows[c][0], rows[c][1] + s, rows[c][2]) for c, s in places)
        out += [(uid, start, min(start + length - WIDTH, end)) for uid, start, end in at[1:]]
    return out


def _removed(found: list[tuple]) -> pa.RecordBatch:
    """The runs that touch, of all groups of a batch, put together."""
    runs = np.array(found, np.int64).reshape(-1, 3)
    uid, first, last = _joined_runs(runs[:, 0], runs[:, 1], runs[:, 2])
    return pa.RecordBatch.from_arrays([pa.array(uid, pa.int64()), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))], ["uid", "first", "last"])


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_bytes, removed (array of {first, end} byte spans), kept (the remaining bytes)."""
    workers_see_package(docs.sparkSession)
    keyed = _keyed(docs, id_col, text_col)
    key = keyed.schema["id"].dataType.simpleString()
    runs = removals(keyed)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("runs").to_pylist()
            got = [spans(np.array([r["first"] for r in x]), np.array([r["last"] + WIDTH for r in x])) for x in lists]
            yield pa.RecordBatch.from_arrays([batch.column("uid"), pa.array([[{"first": a, "end": b} for a, b in g] for g in got], pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())])))], ["uid", "removed"])

    per_doc = runs.groupBy("uid").agg(F.collect_list(F.struct("first", "last")).alias("runs")).mapInArrow(merged, "uid bigint, removed array<struct<first:int,end:int>>")
    per_doc = materialise(per_doc)
    touched, untouched = _meeting(keyed, per_doc)
    rows = touched.select("id", "text", "removed").unionByName(untouched.select("id", "text", F.lit(None).cast(per_doc.schema["removed"].dataType).alias("removed")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in buffers.slices(batch, "text"):
                sizes, kept = [], []
                for text, removed in zip(part.column("text").to_pylist(), part.column("removed").to_pylist(), strict=True):
                    raw = text.encode()
                    sizes.append(len(raw))
                    edges = [0, *[e for r in removed or () for e in (r["first"], r["end"])], len(raw)]
                    kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(sizes, pa.int64()), pa.array([r or [] for r in part.column("removed").to_pylist()], part.column("removed").type), pa.array(kept, pa.binary())], ["id", "n_bytes", "removed", "kept"])

    return rows.select("id", "text", "removed").mapInArrow(cut, f"id {key}, n_bytes bigint, removed array<struct<first:int,end:int>>, kept binary").withColumnRenamed("id", id_col)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """deduplicated() reduced to id, n_bytes, n_removed, n_spans, kept_sha256."""
    out = deduplicated(docs, id_col, text_col)
    return out.select(id_col, "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("removed").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))

