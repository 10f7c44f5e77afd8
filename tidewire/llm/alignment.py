"""Alignment of two tokenizers over the same text: groups of tokens between common ends, links of overlapping tokens.

Tokenizer A is a byte-level BPE in JSON form, B a piece model with byte fallback; A encodes a space and the text, B the text
(to which it adds the space itself). A whole Arrow slice is laid end to end, with the byte offsets of its documents; the
ends of all A tokens and of all B tokens are counted by place once. Places where both end cut the documents into groups.
Two tokens overlap exactly where some stretch between neighbouring ends (of either kind) lies in both, and each such pair
has one stretch; so links are the places where A or B ends, and the running numbers of ends name their tokens. What a
document has is a difference of prefix sums at its borders.

How many documents hold a pair of ids is counted over all documents: a task adds up what it reads before it sends it on,
and the ids of a pair are one integer. Each document's different pairs are written with their numbers (one pass of the
tokenizers), and looked up afterwards: the pairs held by the most documents, PAIRS_HELD at most, as a sorted array in each
worker, all others, which few documents hold, by a join.

Documents whose joined A or B bytes are not a space and their text (the piece model may change white space or full-width
forms), empty ones and null ones have no tokens: zeros and an empty string. Rows repeated under one id, or with a null id,
are documents of their own. Texts of any length are read whole; a slice is at least one text. An empty table gives an empty
result. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm import buffers
from tidewire.runtime import materialise, workers_see_package

#: Pairs that workers hold to look up, at most (12 bytes each, made once and broadcast).
PAIRS_HELD = 4_000_000
#: Different pairs of a task that are added up before they are sent on.
PAIRS_SUMMED = 2_000_000
#: Bits of a pair's integer that hold the B id.
B_BITS = 20
SLICE = 250_000

_loaded: dict[tuple[str, str], Pair] = {}


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: itself where it is printable, else one from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


class Pair:
    """Both tokenizers, the bytes of their ids, and the digits of each id behind each separator."""

    def __init__(self, a_path: str, b_path: str, pattern: str):
        import sentencepiece
        import tiktoken

        with open(a_path, encoding="utf8") as f:
            vocabulary = json.load(f)
        special = {t["content"] for t in vocabulary["added_tokens"]}
        letters = byte_letters()
        ranks = {bytes(letters[c] for c in token): i for token, i in vocabulary["model"]["vocab"].items() if token not in special}
        #: Ids must follow the order of merges: then the lowest rank is the first merge that applies.
        for rank, merge in enumerate(vocabulary["model"]["merges"], 256):
            if vocabulary["model"]["vocab"]["".join(merge.split(" ") if isinstance(merge, str) else merge)] != rank:
                raise ValueError("ids of the vocabulary don't follow its merges")
        self.coder = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=b_path)
        a_bytes = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            a_bytes[i] = token
        names = [self.pieces.id_to_piece(i) for i in range(self.pieces.get_piece_size())]
        b_bytes = [bytes([int(n[3:5], 16)]) if self.pieces.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]
        if len(b_bytes) > 1 << B_BITS:
            raise ValueError("too many pieces")
        self.bytes = pa.array(a_bytes, pa.large_binary()), pa.array(b_bytes, pa.large_binary())
        self.sizes = tuple(np.array([len(x) for x in t]) for t in (a_bytes, b_bytes))
        self.most = max(len(a_bytes), len(b_bytes))
        self.written = pa.array([f"{separator}{i}" for separator in ("", ",", "|", ";") for i in range(self.most)], pa.large_string())


def pair_of(a_path: str, b_path: str, pattern: str) -> Pair:
    if (a_path, b_path) not in _loaded:
        _loaded[a_path, b_path] = Pair(a_path, b_path, pattern)
    return _loaded[a_path, b_path]


def encoded(texts: list[str], pair: Pair) -> list[tuple[np.ndarray, np.ndarray]]:
    """(ids, tokens of each text) of both tokenizers."""
    sides = [pair.coder.encode_to_numpy(" " + t, disallowed_special=()) for t in texts], pair.pieces.encode(texts, num_threads=1)
    return [(np.concatenate([np.asarray(i, np.int64) for i in ids]), np.array([len(i) for i in ids], np.int64)) for ids in sides]


def _same_bytes(tokens: pa.Array, number: np.ndarray, size: np.ndarray, data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether each text's tokens, put together, are its bytes."""
    n = len(number)
    joined = np.frombuffer(tokens.buffers()[2], np.uint8)[: int(size.sum())] if len(tokens) and tokens.buffers()[2] is not None else np.zeros(0, np.uint8)
    if len(joined) == len(data) and (joined == data).all():
        ends = np.append(0, np.cumsum(size))[np.append(0, np.cumsum(number))]
        if (ends == at).all():
            return np.ones(n, bool)
    ends = np.append(0, np.cumsum(size))[np.append(0, np.cumsum(number))]
    return np.array([np.array_equal(joined[ends[i] : ends[i + 1]], data[at[i] : at[i + 1]]) for i in range(n)], bool)


def aligned(texts: list[str], pair: Pair) -> dict[str, object]:
    """Of each text: n_a, n_b, n_groups, n_links, groups (a large string array), pairs (each link's integer) and their borders."""
    n = len(texts)
    spaced = [(" " + t).encode() if t else b"" for t in texts]
    at = np.append(0, np.cumsum([len(s) for s in spaced]))
    data = np.frombuffer(b"".join(spaced), np.uint8)
    some = [i for i in range(n) if spaced[i]]
    sides, good = [], np.array([bool(s) for s in spaced])
    for (ids, number), table, width in zip(encoded([texts[i] for i in some], pair) if some else [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * 2, pair.bytes, pair.sizes, strict=True):
        count = np.zeros(n, np.int64)
        count[some] = number
        good &= _same_bytes(table.take(pa.array(ids)), count, width[ids], data, at)
        sides.append((ids, count))
    if not good.all():
        sides = [(ids[np.repeat(good, count)], np.where(good, count, 0)) for ids, count in sides]
        at = np.append(0, np.cumsum(np.where(good, np.diff(at), 0)))
    (a, n_a), (b, n_b) = sides
    ends = [np.cumsum(width[ids]) for (ids, _), width in zip(sides, pair.sizes, strict=True)]
    places = int(at[-1]) + 1
    marks_a, marks_b = (np.bincount(e, minlength=places) for e in ends)
    cut = np.flatnonzero(marks_a & marks_b)
    stretch = np.flatnonzero(marks_a | marks_b)
    #: The tokens of a stretch are those that end at its end or next after it.
    of_a, of_b = np.cumsum(marks_a)[stretch] - marks_a[stretch], np.cumsum(marks_b)[stretch] - marks_b[stretch]
    links = (a[of_a] << B_BITS) | b[of_b]
    n_groups, n_links = (np.diff(np.searchsorted(x, at, side="right")) for x in (cut, stretch))
    #: A token stands behind the tokens of earlier groups, B tokens also behind the A tokens of their own.
    group_a, group_b = np.searchsorted(cut, ends[0]), np.searchsorted(cut, ends[1])
    in_a, in_b = np.bincount(group_a, minlength=len(cut)), np.bincount(group_b, minlength=len(cut))
    upto_a, upto_b = np.cumsum(in_a), np.cumsum(in_b)
    place_a, place_b = np.arange(len(a)) + (upto_b - in_b)[group_a], np.arange(len(b)) + upto_a[group_b]
    code = np.empty(len(a) + len(b), np.int64)
    code[place_a], code[place_b] = a + pair.most, b + pair.most  # behind a comma
    first_a, first_b = place_a[upto_a - in_a], place_b[upto_b - in_b]
    code[first_b] += pair.most  # behind a bar
    code[first_a] += 2 * pair.most  # behind a semicolon
    per_text = np.append(0, np.cumsum(n_a + n_b))
    opening = per_text[:-1][np.diff(per_text) > 0]
    code[opening] -= 3 * pair.most
    return {"n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_links, "written": pair.written.take(pa.array(code)), "tokens": per_text, "links": links, "link_at": np.append(0, np.cumsum(n_links))}


def groups_of(found: dict[str, object]) -> list[bytes]:
    """The groups of each text as 'a1,a2|b1;a3|b2,b3'."""
    _, offsets, data = found["written"].buffers()
    offset = np.frombuffer(offsets, np.int64)[found["tokens"]] if len(found["written"]) else np.zeros(len(found["tokens"]), np.int64)
    return [bytes(data[x:y]) if y > x else b"" for x, y in zip(offset[:-1].tolist(), offset[1:].tolist(), strict=True)]


def different(links: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(different pairs of each text, ascending; how often it has them; borders) of links."""
    key = (np.repeat(np.arange(len(at) - 1), np.diff(at)) << 40) | links
    key.sort()
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return key[first] & (1 << 40) - 1, np.diff(np.append(first, len(key))), np.searchsorted(key[first] >> 40, np.arange(len(at)))


def _binaries(values: np.ndarray, at: np.ndarray) -> pa.Array:
    """values[at[i] : at[i + 1]] as bytes, for each i."""
    return pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer((at * values.itemsize).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def _numbers(column: pa.ChunkedArray | pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """(all numbers, borders of the rows) of a column that _binaries() made."""
    raw, at = buffers.utf8(column)
    return raw.view(kind), at // np.dtype(kind).itemsize


def alignments(docs: DataFrame, a_path: str, b_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """One row per document: id, n_a, n_b, n_groups, n_links, groups (or their sha256), pairs, times.

    pairs holds the document's different pairs (little-endian 64-bit, A id << B_BITS | B id, ascending), times how often
    each is linked (little-endian 32-bit).
    """
    workers_see_package(docs.sparkSession)
    key = docs.schema[id_col].dataType.simpleString()
    names = ["id", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pair_of(a_path, b_path, pattern)
        for batch in batches:
            for part in buffers.slices(batch, "text", SLICE):
                found = aligned(pc.fill_null(part.column("text"), "").to_pylist(), pair)
                groups = groups_of(found)
                if digest:
                    groups = [hashlib.sha256(g).hexdigest() if g else "" for g in groups]
                pairs, times, at = different(found["links"], found["link_at"])
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), *(pa.array(found[c]) for c in names[1:5]), pa.array(groups, pa.binary()).cast(pa.string()) if not digest else pa.array(groups), _binaries(pairs, at), _binaries(times.astype(np.uint32), at)], names
                )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {key}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, pairs binary, times binary")


def pair_counts(aligned_rows: DataFrame) -> DataFrame:
    """pair, n (documents that hold it linked), best (whether no pair of its A id has more)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sums, waiting, size = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

        def added() -> tuple[np.ndarray, np.ndarray]:
            every = np.concatenate([keys, *waiting])
            number = np.concatenate([sums, np.ones(len(every) - len(keys), np.int64)])
            order = np.argsort(every, kind="stable")
            every = every[order]
            first = np.flatnonzero(np.append(True, every[1:] != every[:-1])) if len(every) else np.zeros(0, np.int64)
            return every[first], np.add.reduceat(number[order], first) if len(first) else number

        for batch in batches:
            got = _numbers(batch.column("pairs"), "<i8")[0]
            waiting.append(got)
            size += len(got)
            if size > PAIRS_SUMMED:
                keys, sums = added()
                waiting, size = [], 0
                if len(keys) > PAIRS_SUMMED:
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(sums)], ["pair", "n"])
                    keys, sums = keys[:0], sums[:0]
        keys, sums = added()
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(sums)], ["pair", "n"])

    counts = materialise(aligned_rows.select("pairs").mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")))
    of_a = F.shiftright("pair", B_BITS)
    #: One row per id of A: no more than its vocabulary.
    highest = counts.groupBy(of_a.alias("a")).agg(F.max("n").alias("most"))
    return materialise(counts.join(F.broadcast(highest), of_a == F.col("a")).select("pair", "n", (F.col("n") == F.col("most")).alias("best")))


def _held(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Sorted pairs held by at least `least` documents with their n and best, and `least`: the least power of two that leaves at most `most` pairs."""
    sizes = sorted(map(tuple, counts.groupBy(F.floor(F.log2("n")).alias("bits")).count().collect()), reverse=True)
    least, number = 1, 0
    for bits, n in sizes:
        number += n
        if number > most:
            least = 2 ** (bits + 1)
            break

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([batch.column("pair").to_numpy(), batch.column("n").to_numpy() * 2 + batch.column("best").to_numpy(zero_copy_only=False)]).tobytes()], pa.binary())], ["own"])

    parts = [np.frombuffer(r["own"], "<i8").reshape(2, -1) for r in counts.where(F.col("n") >= least).mapInArrow(packed, "own binary").collect()]
    pair, n = np.concatenate(parts, 1) if parts else np.zeros((2, 0), np.int64)
    order = np.argsort(pair)
    return pair[order], n[order], least


def summed(aligned_rows: DataFrame, counts: DataFrame, most: int = PAIRS_HELD) -> DataFrame:
    """aligned_rows (with a column row that is unique) without pairs and times, but with n_best and count_sum."""
    pair, n, least = _held(counts, most)
    table = aligned_rows.sparkSession.sparkContext.broadcast((pair, n))
    rest = counts.where(F.col("n") < least)
    whole = rest.isEmpty()

    def looked_up(pairs: pa.Array, times: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        keys, numbers = table.value
        (own, at), often = _numbers(pairs, "<i8"), _numbers(times, "<u4")[0].astype(np.int64)
        place = np.minimum(np.searchsorted(keys, own), max(len(keys) - 1, 0))
        known = keys[place] == own if len(keys) else np.zeros(len(own), bool)
        return own, at, often, known, np.where(known, numbers[place] if len(keys) else 0, 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, at, often, _, got = looked_up(batch.column("pairs"), batch.column("times"))
            sums = [np.diff(np.append(0, np.cumsum(x))[at]) for x in (often * (got & 1), often * (got >> 1))]
            yield pa.RecordBatch.from_arrays([batch.column("row"), *(pa.array(x) for x in sums)], ["row", "n_best", "count_sum"])

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, at, often, known, _ = looked_up(batch.column("pairs"), batch.column("times"))
            row = np.repeat(batch.column("row").to_numpy(), np.diff(at))
            yield pa.RecordBatch.from_arrays([pa.array(x[~known]) for x in (row, own, often)], ["row", "pair", "often"])

    carried = [c for c in aligned_rows.columns if c not in ("pairs", "times")]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in aligned_rows.schema if f.name in carried)

    def run_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (sums,) = run([batch])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carried), sums.column("n_best"), sums.column("count_sum")], [*carried, "n_best", "count_sum"])

    known = aligned_rows.mapInArrow(run_whole, f"{fields}, n_best bigint, count_sum bigint")
    if whole:
        return known
    met = aligned_rows.select("row", "pairs", "times").mapInArrow(others, "row bigint, pair bigint, often bigint").join(rest, "pair")
    more = met.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("often")).otherwise(0)).alias("more_best"), F.sum(F.col("often") * F.col("n")).alias("more_sum"))
    added = [(F.col(x) + F.coalesce(F.col(y), F.lit(0))).alias(x) for x, y in (("n_best", "more_best"), ("count_sum", "more_sum"))]
    return known.join(more, "row", "left").select(*carried, *added)


def digests(docs: DataFrame, a_path: str, b_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", most: int = PAIRS_HELD) -> DataFrame:
    """Per document: id, n_a, n_b, n_groups, n_links, n_best (links whose pair no other of its A id surpasses), count_sum, groups_sha256."""
    rows = materialise(alignments(docs, a_path, b_path, pattern, id_col, text_col, digest=True).withColumn("row", F.monotonically_increasing_id()))
    out = summed(rows, pair_counts(rows), most)
    return out.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"))
