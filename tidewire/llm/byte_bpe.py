"""Byte-level BPE encoding by overlapping chunks, and decoding by concatenating raw bytes.

A text is cut into chunks that overlap by `overlap_chars` (one of up to `chunk_chars` code points is one chunk); each
chunk is pre-tokenised on its own, anywhere in the cluster, and only its boundaries inside the two overlaps are kept.
Where a chunk and its successor share a boundary that follows a visible character, both pre-tokenise alike from there on:
that is the stitch. Spans between stitches are encoded in parallel and their ids concatenated. A seam without a common
boundary is not cut, so its chunks are encoded together and the result never depends on chunking.

Texts of several chunks are encoded once each, whatever their number of copies. digests() hashes ids and decoded bytes
where they are made, so that no decoded text is held or moved: a span's tokens are decoded and hashed piece by piece.

Nulls count as empty texts (no ids, digest of nothing). Repeated rows each give a row, ties need no order, and an empty
table gives an empty result. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewire.llm import buffers
from tidewire.runtime import checked, materialise, workers_see_package

CHUNK_CHARS = 32_768
OVERLAP_CHARS = 1_024
#: Bytes of text whose ids a worker holds at once, and ids that it decodes at once.
SLICE = 250_000
DECODED = 65_536

_codecs: dict[tuple[str, str], tuple] = {}


def codec(path: str, pattern: str) -> tuple:
    """(tiktoken encoding, id -> bytes table, compiled pattern), built once per worker."""
    if (path, pattern) not in _codecs:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        table = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            table[rank] = token
        coder = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        _codecs[path, pattern] = coder, table, regex.compile(pattern)
    return _codecs[path, pattern]


def ids_of(text: str, coder) -> np.ndarray:
    return np.asarray(coder.encode_to_numpy(text, disallowed_special=()), dtype="<u4") if text else np.zeros(0, "<u4")


def bytes_of(ids: np.ndarray, table: list[bytes]) -> bytes:
    return b"".join([table[i] for i in ids.tolist()])


def cut(text: str, size: int, overlap: int) -> list[tuple[int, str]]:
    """(offset, chunk) with each chunk reaching `overlap` into the next."""
    return [(at, text[at : at + size + overlap]) for at in range(0, max(len(text), 1), size)]


def seam_boundaries(chunk: str, offset: int, size: int, overlap: int, pattern) -> tuple[list[int], list[int]]:
    """Absolute pre-token boundaries in the chunk's first and last overlap, where a visible character stands before.

    A boundary at the chunk's very end is left out: its token may go on in the next chunk.
    """
    head, tail = [], []
    for match in pattern.finditer(chunk):
        at = match.end()
        if at < len(chunk) and (at <= overlap or at > size) and not chunk[at - 1].isspace():
            if at <= overlap:
                head.append(offset + at)
            if at > size:
                tail.append(offset + at)
    return head, tail


def stitched(text: str, path: str, pattern: str, size: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> np.ndarray:
    """The chunked encoding of one text in one process; the distributed form takes the same steps."""
    coder, _, compiled = codec(path, pattern)
    chunks = cut(text, size, overlap)
    marks = [seam_boundaries(chunk, at, size, overlap, compiled) for at, chunk in chunks]
    cuts = [0]
    for before, after in zip(marks, marks[1:], strict=False):
        common = set(before[1]) & set(after[0])
        if common:
            cuts.append(min(common))
    return np.concatenate([ids_of(text[a:b], coder) for a, b in zip(cuts, [*cuts[1:], len(text)], strict=True)])


def _results(ids: list[np.ndarray], table: list[bytes], digest: bool) -> list[pa.Array]:
    """Columns of encoded texts: ids and decoded bytes, or the ids' number and both digests."""
    if not digest:
        return [pa.array([i.tobytes() for i in ids], pa.binary()), pa.array([bytes_of(i, table) for i in ids], pa.binary())]
    decoded = []
    for i in ids:
        own = hashlib.sha256()
        for at in range(0, len(i), DECODED):
            own.update(bytes_of(i[at : at + DECODED], table))
        decoded.append(own.hexdigest())
    return [pa.array([len(i) for i in ids], pa.int64()), pa.array([hashlib.sha256(i).hexdigest() for i in ids], pa.string()), pa.array(decoded, pa.string())]


def _encoded(docs: DataFrame, path: str, pattern: str, id_col: str, text_col: str, chunk_chars: int, overlap_chars: int, digest: bool) -> DataFrame:
    workers_see_package(docs.sparkSession)
    key = docs.schema[id_col].dataType.simpleString()
    fields = "n_tokens bigint, ids_sha256 string, decoded_sha256 string" if digest else "ids binary, decoded binary"
    names = [f.split()[0] for f in fields.split(", ")]
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    short = rows.where(F.length("text") <= chunk_chars)
    long = rows.where(F.length("text") > chunk_chars).withColumn("h", F.sha2("text", 256))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, table, _ = codec(path, pattern)
        for batch in batches:
            for part in buffers.slices(batch, "text", SLICE):
                ids = [ids_of(t.as_py(), coder) for t in part.column("text")]
                yield pa.RecordBatch.from_arrays([part.column("id"), *_results(ids, table, digest)], ["id", *names])

    def chunked(batches):
        for batch in batches:
            for h, text in zip(batch.column("h"), batch.column("text"), strict=True):
                got = cut(text.as_py(), chunk_chars, overlap_chars)
                yield pa.RecordBatch.from_arrays([pa.array([h.as_py()] * len(got)), pa.array(range(len(got)), pa.int64()), pa.array([a for a, _ in got], pa.int64()), pa.array([c for _, c in got])], ["h", "no", "offset", "chunk"])

    def marked(batches):
        _, _, compiled = codec(path, pattern)
        for batch in batches:
            for part in buffers.slices(batch, "chunk", SLICE):
                seams = [seam_boundaries(c, o, chunk_chars, overlap_chars, compiled) for o, c in zip(part.column("offset").to_pylist(), part.column("chunk").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("h", "no", "offset", "chunk")), pa.array([s[0] for s in seams], pa.list_(pa.int64())), pa.array([s[1] for s in seams], pa.list_(pa.int64()))], ["h", "no", "offset", "chunk", "head", "tail"])

    def spans_encoded(batches):
        coder, _, _ = codec(path, pattern)
        for batch in batches:
            for part in buffers.slices(batch, "piece", SLICE):
                yield pa.RecordBatch.from_arrays([part.column("h"), part.column("span"), pa.array([ids_of(t.as_py(), coder).tobytes() for t in part.column("piece")], pa.binary())], ["h", "span", "ids"])

    def joined(batches):
        _, table, _ = codec(path, pattern)
        for batch in batches:
            for h, spans in zip(batch.column("h"), batch.column("spans"), strict=True):
                ids = np.frombuffer(b"".join(s["ids"].as_py() for s in spans.values), "<u4")
                yield pa.RecordBatch.from_arrays([pa.array([h.as_py()]), *_results([ids], table, digest)], ["h", *names])

    texts = long.groupBy("h").agg(F.first("text").alias("text"))
    chunks = texts.mapInArrow(chunked, "h string, no bigint, offset bigint, chunk string").repartition("h", "no")
    seams = chunks.mapInArrow(marked, "h string, no bigint, offset bigint, chunk string, head array<bigint>, tail array<bigint>")
    in_text = Window.partitionBy("h").orderBy("no")
    stitch = seams.withColumn("start", F.array_min(F.array_intersect(F.lag("tail").over(in_text), "head")))
    stitch = stitch.withColumn("next", F.lead("start").over(in_text)).withColumn("last", F.lead("no").over(in_text).isNull())
    stitch = stitch.withColumn("span", F.count("start").over(in_text))
    begin = F.coalesce("start", "offset")
    end = F.when(F.col("last"), F.col("offset") + F.length("chunk")).otherwise(F.coalesce("next", F.col("offset") + chunk_chars))
    owned = stitch.withColumn("stop", end).withColumn("begin", begin).selectExpr("h", "span", "no", "substring(chunk, cast(begin - offset + 1 as int), cast(stop - begin as int)) AS piece")
    spans = owned.groupBy("h", "span").agg(F.sort_array(F.collect_list(F.struct("no", "piece"))).alias("parts")).select("h", "span", F.expr("array_join(transform(parts, p -> p.piece), '')").alias("piece"))
    encoded = spans.mapInArrow(spans_encoded, "h string, span bigint, ids binary").groupBy("h").agg(F.sort_array(F.collect_list(F.struct("span", "ids"))).alias("spans"))
    results = encoded.mapInArrow(joined, "h string, " + fields)
    if digest:
        results = checked(materialise(results), 200_000)
    whole_rows = short.mapInArrow(whole, f"id {key}, " + fields)
    return whole_rows.unionByName(long.select("id", "h").join(results, "h").select("id", *names)).withColumnRenamed("id", id_col)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> DataFrame:
    """One row per input row: id, ids (little-endian unsigned 32-bit binary), decoded (binary)."""
    return _encoded(docs, path, pattern, id_col, text_col, chunk_chars, overlap_chars, False)


def digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> DataFrame:
    """What encode() gives, as id, n_tokens, ids_sha256, decoded_sha256."""
    return _encoded(docs, path, pattern, id_col, text_col, chunk_chars, overlap_chars, True)
