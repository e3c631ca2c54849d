"""Vectorised text primitives used inside Arrow tasks.

Texts arrive as Arrow string columns; everything below works on their raw
UTF-8 buffer with numpy, so a task never loops over words in Python.

Fingerprints are polynomial hashes modulo 2**64 over random 64-bit codes of the
symbols, finished with a bit mixer. Equal sequences always get equal
fingerprints; callers that need exactness combine two of them (128 bits) or
verify.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 - 2  # = 3 mod 8: odd, so it has an inverse modulo 2**64
_PIECE = 1 << 21                # bytes hashed at a time: bounds the 8-byte-per-byte temporaries

_rng = np.random.Generator(np.random.PCG64(20240229))
CODES = _rng.integers(1, 2**64 - 1, 256, dtype=U64) | U64(1)
CODES_LOWER = CODES.copy()
CODES_LOWER[65:91] = CODES[97:123]

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B**j and B**-j for j < n, grown on demand and kept per worker."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            row = np.full(size, base, U64)
            row[0] = 1
            _powers[k] = np.cumprod(row, dtype=U64)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Bit mixer (murmur finaliser) on a copy of ``x``."""
    x = x ^ (x >> U64(33))
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


def prefix(values: np.ndarray) -> np.ndarray:
    """Polynomial prefix sums of a uint64 sequence, one longer than it."""
    out = np.zeros(len(values) + 1, U64)
    np.cumsum(values * powers(len(values))[0], out=out[1:], dtype=U64)
    return out


def span_hash(pre: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Fingerprints of the slices [start, end) of the sequence under ``pre``."""
    inv = powers(len(pre))[1]
    return mix((pre[end] - pre[start]) * inv[start] + (end - start).astype(U64))


def window_hash(pre: np.ndarray, k: int) -> np.ndarray:
    """Fingerprints of all k-symbol windows."""
    n = len(pre) - k
    if n <= 0:
        return np.zeros(0, U64)
    return mix((pre[k:] - pre[:n]) * powers(n)[1] + U64(k))


def sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values, in log2(w) passes."""
    if len(h) < w:
        return h[:0]
    have, out = 1, h
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column; a null counts as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    if off is None or len(column) == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset: column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offsets.astype(np.int64), raw


def row_slices(offsets: np.ndarray, cap: int = 8 << 20) -> Iterator[tuple[int, int]]:
    """Runs of rows holding about ``cap`` bytes each (one row at least)."""
    r, n = 0, len(offsets) - 1
    while r < n:
        e = max(r + 1, int(np.searchsorted(offsets, offsets[r] + cap, "right")) - 1)
        yield r, min(e, n)
        r = min(e, n)


def word_bounds(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the rows under ``offsets``:
    (start, end) byte positions in ``data`` and a row pointer into them."""
    lo, hi = int(offsets[0]), int(offsets[-1])
    if hi <= lo:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~SEPARATOR[data[lo:hi]]
    edge = np.zeros(hi - lo + 1, bool)          # a row begins here: words do not run on
    edge[offsets - lo] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:-1]
    start = np.flatnonzero(first) + lo
    end = np.flatnonzero(last) + (lo + 1)
    return start, end, np.searchsorted(start, offsets)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, codes: np.ndarray = CODES) -> np.ndarray:
    """One fingerprint per word, hashing bounded pieces of the buffer."""
    out = np.empty(len(start), U64)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + _PIECE, "right")))
        base = int(start[i])
        pre = prefix(codes[data[base: int(end[j - 1])]])
        out[i:j] = span_hash(pre, start[i:j] - base, end[i:j] - base)
        i = j
    return out
