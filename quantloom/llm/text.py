"""Helpers shared by the operators of this subpackage: whole texts as byte arrays, words and hashes.

Python code here only sees one Arrow batch at a time inside a Spark task; Spark partitions, shuffles
and retries the work. A null text counts as the empty text everywhere.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard

from quantloom.durable import durable as reliable  # noqa: F401  for the operators
from quantloom.durable import released  # noqa: F401

#: Bytes up to which a span's hash is a polynomial.
LONG_SPAN = 64
#: Bytes of text handled at once inside a task; a longer document is a piece of its own.
CHUNK_BYTES = 2 << 20

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit values (splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


BYTE_CODES = mix(np.arange(1, 257, dtype=_U) * _U(_BASE))

#: Maps A-Z to a-z, byte by byte, and leaves all else alone.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Separator bytes of white-space words: the words are [^\x20\x09-\x0D]+.
SPACE_SEPARATORS = np.zeros(256, dtype=bool)
SPACE_SEPARATORS[[0x20, *range(0x09, 0x0E)]] = True

#: Separator bytes of letter-and-digit words: the words are [^\x00-\x2F\x3A-\x60\x7B-\x7F]+.
ALNUM_SEPARATORS = np.zeros(256, dtype=bool)
ALNUM_SEPARATORS[[*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True

_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the hash base and of its inverse, kept between calls."""
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, CHUNK_BYTES + 4096)
        for key, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, dtype=_U)
            steps[0] = 1
            _powers[key] = np.cumprod(steps)
    return _powers["up"][:n], _powers["down"][:n]


def prefix_hashes(buf: np.ndarray) -> np.ndarray:
    """S with S[e]-S[s] == base**s * hash(buf[s:e]) modulo 2**64."""
    up, _ = powers(len(buf))
    sums = np.zeros(len(buf) + 1, dtype=_U)
    np.cumsum(BYTE_CODES[buf] * up, out=sums[1:])
    return sums


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans, which are given in ascending order without overlap.

    Long spans have a cryptographic hash: modulo 2**64, a polynomial takes built strings of some hundred bytes for equal.
    """
    out = np.empty(len(starts), dtype=_U)
    at = 0
    while at < len(starts):
        base = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, base + CHUNK_BYTES, side="right")))
        sums = prefix_hashes(buf[base : ends[to - 1]])
        _, down = powers(int(ends[to - 1] - base) + 1)
        s, e = starts[at:to] - base, ends[at:to] - base
        out[at:to] = mix((sums[e] - sums[s]) * down[s])
        at = to
    for i in np.flatnonzero(np.asarray(ends) - np.asarray(starts) > LONG_SPAN):
        out[i] = int.from_bytes(hashlib.blake2b(buf[starts[i] : ends[i]].tobytes(), digest_size=8).digest())
    return out


def words(buf: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word starts and ends in buf, and for each document the number of words before it (and at last of all)."""
    inside = ~separators[buf]
    first, last = inside.copy(), inside.copy()
    if len(buf):
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        full = offsets[1:] > offsets[:-1]
        begin, end = offsets[:-1][full], offsets[1:][full] - 1
        first[begin], last[end] = inside[begin], inside[end]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def text_chunks(batch: pa.RecordBatch, column: str, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cuts a batch into runs of rows: (first row, end row, their bytes, offsets of their texts in these bytes)."""
    values = batch.column(batch.schema.get_field_index(column))
    if values.null_count:
        values = values.fill_null("")
    kind = np.int64 if pa.types.is_large_string(values.type) or pa.types.is_large_binary(values.type) else np.int32
    _, at, data = values.buffers()
    n = len(values)
    if not n:
        return
    offsets = np.frombuffer(at, dtype=kind)[values.offset : values.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, side="right")) - 1)
        end = min(end, n, row + 4096)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def windows_hash(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of width consecutive entries (len - width + 1 of them)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=_U)
    out = np.zeros(n, dtype=_U)
    for k in range(width):
        out = (out + hashes[k : k + n]) * _U(0xD6E8FEB86659FD93)
        out ^= out >> _U(32)
    return mix(out)


def as_long(x: np.ndarray) -> pa.Array:
    """Unsigned 64-bit values as Spark's signed long, bit by bit."""
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def binary_rows(data: bytes, offsets: np.ndarray) -> pa.Array:
    """A binary column whose row i is data[offsets[i]:offsets[i + 1]]."""
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(data)])


def pack_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose last column, a text, is compressed for a shuffle (null stays null)."""
    pack = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        texts = batch.column(batch.num_columns - 1).to_pylist()
        yield pa.record_batch([*batch.columns[:-1], pa.array([None if t is None else pack(t.encode()) for t in texts], pa.binary())], batch.schema.names)
