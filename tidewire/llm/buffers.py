"""Vectorised access to Arrow string columns, for the operators that run in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Batches are worked on in slices of about so many bytes of text, whose arrays stay in the processor's cache; a longer
#: single text forms a slice of its own.
SLICE_BYTES = 150_000


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The concatenated UTF-8 bytes and the n+1 offsets of a string column; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(at) else np.zeros(0, np.uint8)
    return raw, at - at[0]


def slices(batch: pa.RecordBatch, column: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into pieces whose text column holds about `size` bytes."""
    n = batch.num_rows
    if not n:
        return
    _, at = utf8(batch.column(batch.schema.get_field_index(column)))
    start = 0
    while start < n:
        end = int(np.searchsorted(at, at[start] + size, side="right")) - 1
        end = min(n, max(end, start + 1))
        yield batch.slice(start, end - start)
        start = end


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers (multiply and shift rounds)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


#: Odd multiplier of the rolling polynomial, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def powers(n: int, base: int = BASE, name: str = "up") -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept and grown between calls."""
    have = _powers.get(name)
    if have is None or len(have) < n:
        out = np.empty(max(n, 1 << 16), np.uint64)
        out[0] = 1
        done = 1
        while done < len(out):
            step = min(done, len(out) - done)
            out[done : done + step] = out[:step] * np.uint64(pow(base, done, 1 << 64))
            done += step
        _powers[name] = have = out
    return have[:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """P with P[i] the polynomial of data[:i]; span_hash() turns differences into position-free hashes."""
    out = np.zeros(len(data) + 1, np.uint64)
    table = mix64(np.arange(1, 257, dtype=np.uint64))
    np.cumsum(table[data] * powers(len(data)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end] (equal spans hash alike wherever they stand); the length is mixed in."""
    down = powers(len(prefix), INVERSE, "down")
    return mix64((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def sliding_hash(prefix: np.ndarray, width: int) -> np.ndarray:
    """span_hash() of every span of `width` bytes."""
    n = len(prefix) - width
    out = prefix[width:] - prefix[:n]
    out *= powers(len(prefix), INVERSE, "down")[:n]
    out += np.uint64(width * 0xA24BAED4963EE407 & (1 << 64) - 1)
    return mix64(out)
