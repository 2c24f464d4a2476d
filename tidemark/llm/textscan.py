"""Vectorised scanning of text batches, shared by the operators of this subpackage.

A batch is one UTF-8 buffer with the byte offsets of its documents. Everything here works on whole
batches with numpy and Arrow; no loop runs per character or per word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from ..session import ship

#: Text bytes handled at once by one Python worker; a longer document is handled alone.
CHUNK_BYTES = 2 << 20
#: Rows in one Arrow batch between the JVM and Python.
ARROW_ROWS = 1024

_WS = np.zeros(256, bool)
_WS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
LOWER_BYTES = bytes(_LOWER)


def bounded_batches(spark) -> None:
    """Keeps the Arrow batches of this session small, so that long documents fit a worker's memory; workers get this package."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches into runs of rows whose texts hold at most ``limit`` bytes (or one row)."""
    for batch in batches:
        give_back()
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        total = np.cumsum(size)
        lo = 0
        while lo < batch.num_rows:
            base = total[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(total, base + limit, "right")))
            yield batch.slice(lo, hi - lo)
            lo = hi


def give_back() -> None:
    """Returns freed memory to the machine, as workers live on from stage to stage."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and each text's offsets; a null is an empty text."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n, at = len(column), column.offset
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, at * 8) if n else np.zeros(1, np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def lower(raw: np.ndarray) -> np.ndarray:
    """A-Z become a-z; every other byte stays."""
    return _LOWER[raw]


def words(raw: np.ndarray, offsets: np.ndarray, gap: np.ndarray = _WS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` (or between other bytes) and each document's range of words."""
    n = len(raw)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = ~gap[raw]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= cut[1:n] | ~inside[:-1]
    last[:-1] &= cut[1:n] | ~inside[1:]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def binary_array(raw: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Adjoining slices of a buffer as an Arrow array, without copying."""
    offsets = np.ascontiguousarray(offsets, np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(raw))])


def joined_words(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of a batch, one after another, each followed by one space; and their offsets."""
    size = ends - starts + 1
    at = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(size, out=at[1:])
    out = np.empty(at[-1], np.uint8)
    out[at[1:] - 1] = 32
    keep = np.ones(len(out), bool)
    keep[at[1:] - 1] = False
    mark = np.zeros(len(raw) + 1, np.int8)
    mark[starts] += 1
    mark[ends] -= 1
    out[keep] = raw[np.cumsum(mark[:-1], dtype=np.int8).astype(bool)]
    return out, at


def encode_words(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, gap: np.ndarray = _WS) -> tuple[np.ndarray, pa.Array]:
    """For each word the place of its text in an array of distinct words."""
    if not len(starts):
        return np.zeros(0, np.int64), pa.array([], pa.large_binary())
    size = ends - starts
    at = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(size, out=at[1:])
    kept = raw[~gap[raw]]
    code = binary_array(kept, at).dictionary_encode()
    return code.indices.to_numpy().astype(np.int64), code.dictionary


def hash_words(distinct: pa.Array, seed: int = 0) -> np.ndarray:
    """64-bit hashes of distinct words."""
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(x, seed) for x in distinct.to_pylist()), np.uint64, len(distinct))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads their bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(h: np.ndarray, k: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """A 64-bit hash for each run of ``k`` entries of ``h`` (a polynomial modulo 2**64)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    base |= 1
    power = np.full(len(h), base, np.uint64)
    power[0] = 1
    power = np.cumprod(power, dtype=np.uint64)
    inverse = np.full(n, pow(base, -1, 1 << 64), np.uint64)
    inverse[0] = 1
    inverse = np.cumprod(inverse, dtype=np.uint64)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * power, out=total[1:], dtype=np.uint64)
    return mix((total[k:] - total[:n]) * inverse)
