"""Vectorised helpers over the raw UTF-8 bytes of Arrow text columns."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text handled at once by the numpy helpers.
CHUNK_BYTES = 4 << 20

#: The separators of ``[^\\x20\\x09-\\x0D]+`` words.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32

#: Bytes of the longest string that is hashed by a rolling sum.
SHORT = 64
_KEY = b"cadence strings"
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_TABLE = np.random.default_rng(20240607).integers(0, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def binary_column(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text or binary column; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_binary())
    if col.null_count:
        col = col.fill_null(b"")
    _, offs, data = col.buffers()
    offsets = np.frombuffer(offs, np.int64, len(col) + 1, col.offset * 8) if len(col) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes (a longer text stands alone)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        for k, base in enumerate((_BASE, _INVERSE)):
            p = np.full(size, base, U64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers


def slice_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of ``data[s:e]`` for each pair, equal for equal strings
    wherever they lie: differences of a rolling sum, moved back to power 0, for
    short strings; a keyed digest for those of more than ``SHORT`` bytes, since
    sums modulo a power of two are alike for some pairs of long ones."""
    out = _short_hashes(data, starts, ends)
    long = np.flatnonzero(ends - starts > SHORT)
    if len(long):
        view = memoryview(np.ascontiguousarray(data))
        out[long] = np.frombuffer(b"".join([blake2b(view[s:e], digest_size=8, key=_KEY).digest()
                                            for s, e in zip(starts[long].tolist(), ends[long].tolist())]), "<u8")
    return out


def _short_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, down = _power_tables(len(data) + 1)
    sums = np.empty(len(data) + 1, U64)
    sums[0] = 0
    np.cumsum(_TABLE[data] * up[:len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64))


def window_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """Hashes of every ``data[i:i + width]`` (``len(data) - width + 1`` of them)."""
    n = len(data) - width + 1
    if n <= 0:
        return np.zeros(0, U64)
    up, down = _power_tables(len(data) + 1)
    sums = np.empty(len(data) + 1, U64)
    sums[0] = 0
    np.cumsum(_TABLE[data] * up[:len(data)], out=sums[1:])
    out = sums[width:] - sums[:n]
    out *= down[:n]
    return mix(out)


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): the words of each text; those of text ``i`` are
    ``first[i]:first[i + 1]``. ``offsets`` start at 0."""
    n = len(data)
    inside = ~SPACE[data]
    begin = np.zeros(n + 1, bool)
    begin[offsets] = True
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    starts = np.flatnonzero(inside & (~before | begin[:n]))
    ends = np.flatnonzero(inside & (~after | begin[1:n + 1])) + 1
    return starts, ends, np.searchsorted(starts, offsets)
