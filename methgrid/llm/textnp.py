"""Vectorised views of Arrow text columns: bytes, words and rolling hashes.

All functions work on one batch that is laid out as one byte array with
offsets, so no Python string is made per document or per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Odd, so that it has an inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
BYTE_CODE = np.random.default_rng(20240131).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: A second, independent pair for digests of 128 bits.
OTHER_BASE = 0xBF58476D1CE4E5B9
OTHER_CODE = np.random.default_rng(20240207).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)

_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; grown and kept per process."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        have = np.full(size, base, U64)
        have[0] = 1
        _POWERS[base] = have = np.cumprod(have, dtype=U64)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over 64 bits."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the offsets of its rows; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut to about ``size`` bytes of text; a longer document is a batch of its own."""
    for batch in batches:
        if not len(batch):
            continue
        _, offsets = flat(batch.column(text))
        at = 0
        while at < len(batch):
            to = int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1
            to = min(len(batch), max(to, at + 1))
            yield batch.slice(at, to - at)
            at = to


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` and, per document, the number of the first word (one more entry at the end)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    space = SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = edge[:n].copy()
    before[0] = True
    before[1:] |= space[:-1]
    after = edge[1:]
    after[-1] = True
    after[:-1] |= space[1:]
    solid = ~space
    starts = np.flatnonzero(solid & before)
    ends = np.flatnonzero(solid & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, code: np.ndarray = BYTE_CODE, base: int = BASE) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, equal for equal bytes anywhere."""
    n = len(data)
    sums = np.zeros(n + 1, U64)
    np.cumsum(code[data] * powers(base, n), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * powers(pow(base, -1, 1 << 64), n + 1)[starts] + (ends - starts).astype(U64))


def owners(first: np.ndarray) -> np.ndarray:
    """The document of each word, from the first words that words() gives."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))
