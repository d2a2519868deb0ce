"""Vectorised text kernels over the byte buffers of Arrow string columns.

A chunk of rows is one uint8 array with row offsets. Words, lines and their hashes are found for all rows of a
chunk with array operations; no Python object is made for a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Text bytes in a chunk; a longer single text is a chunk of its own.
CHUNK_BYTES = 1 << 20
#: The space bytes of the word pattern [^\x20\x09-\x0D]+.
SPACES = np.zeros(256, bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
WORD_BYTES = ~SPACES

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE_CODES = np.random.Generator(np.random.PCG64(20240601)).integers(1, 1 << 63, 256, dtype=U64) | U64(1)
_powers: dict[int, np.ndarray] = {}


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets (from 0) of a string array; nulls are empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    n = len(texts)
    if n == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    kind = np.int64 if wide else np.int32
    at = np.frombuffer(offsets, kind, n + 1, texts.offset * np.dtype(kind).itemsize).astype(np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def chunks(batch: pa.RecordBatch, name: str, most: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batch with at most `most` bytes in column `name` (a longer text stands alone), with bytes and offsets."""
    data, at = buffer_of(column(batch, name))
    start = 0
    while start < len(at) - 1:
        stop = max(start + 1, int(np.searchsorted(at, at[start] + most, "right")) - 1)
        yield batch.slice(start, stop - start), data[at[start] : at[stop]], at[start : stop + 1] - at[start]
        start = stop


def spans(flags: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True; a run ends where its row ends."""
    n = len(flags)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = flags[:-1]
    before[at[:-1][at[:-1] < n]] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = flags[1:]
    last = at[1:] - 1
    after[last[last >= 0]] = False
    return np.flatnonzero(flags & ~before), np.flatnonzero(flags & ~after) + 1


def rows_of(positions: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.searchsorted(at, positions, "right") - 1


def per_row(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of flags by row."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 1)
        have = np.full(size, base, U64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if size <= 8 * CHUNK_BYTES:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class SpanHashes:
    """64-bit hashes of byte spans: a polynomial over per-byte random codes, from one prefix sum."""

    def __init__(self, data: np.ndarray) -> None:
        n = len(data)
        self.prefix = np.zeros(n + 1, U64)
        np.cumsum(_BYTE_CODES[data] * _power(_BASE, n), out=self.prefix[1:])
        self.inverse = _power(_BASE_INVERSE, n + 1)

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        body = (self.prefix[ends] - self.prefix[starts]) * self.inverse[starts]
        return mix(body + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def window_hashes(hashes: np.ndarray, rows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """First words of the width-word windows that lie in one row, and the windows' hashes."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    out = np.zeros(n, U64)
    for k in range(width):
        out = out * U64(0x9E3779B97F4A7C15) + hashes[k : k + n]
    first = np.flatnonzero(rows[:n] == rows[width - 1 :])
    return first, mix(out[first])


def text_list(data: np.ndarray, at: np.ndarray) -> list[bytes]:
    whole, cuts = data.tobytes(), at.tolist()
    return [whole[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
