"""Vectorised byte, word and line helpers that run inside Arrow batches.

All of them work on the concatenated UTF-8 bytes of a slice of rows, so that a
slice costs a few numpy passes instead of a Python loop over words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Rows are cut into slices of about so many bytes, which bounds the temporaries.
SLICE_BYTES = 2 << 20

_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=U64) * U64(2) + U64(1)
_R = 0x9E3779B97F4A7C15 | 5
_R_INV = pow(_R, -1, 1 << 64)
_SHINGLE = _rng.integers(1, 1 << 63, 64, dtype=U64) * U64(2) + U64(1)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for later calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        out = np.full(size, base, U64)
        out[0] = 1
        _powers[base] = have = np.multiply.accumulate(out)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    h = h ^ (h >> U64(31))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(29))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(32))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, eight bytes at a time.

    Each chunk is finalised together with its place before chunks are added up, so that
    no pattern of letters cancels out, as it can in a polynomial modulo 2**64.
    """
    size = (end - start).astype(np.int64)
    count = (size + 7) >> 3
    ends = np.cumsum(count)
    owner = np.repeat(np.arange(len(size)), count)
    place = np.arange(len(owner)) - (ends - count)[owner]
    padded = np.concatenate([np.ascontiguousarray(data, np.uint8), np.zeros(8, np.uint8)])
    view = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    chunk = view[start[owner] + 8 * place]
    spare = np.maximum(8 * place + 8 - size[owner], 0).astype(U64) * U64(8)
    chunk = (chunk << spare) >> spare
    total = np.concatenate([np.zeros(1, U64), np.cumsum(mix(mix(chunk + U64(0x632BE59BD9B4E019)) + place.astype(U64) * U64(_R)), dtype=U64)])
    return mix(total[ends] - total[ends - count] + size.astype(U64) * U64(0xD6E8FEB86659FD93))


class SpanHash:
    """Hashes of byte spans of a slice; those of all spans of one length by a rolling polynomial, which only groups."""

    def __init__(self, data: np.ndarray):
        self.data = data

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return span_hashes(self.data, start, end)

    def grams(self, k: int) -> np.ndarray:
        """A hash of every span of ``k`` bytes, in one pass; unequal spans may share it, so compare what it brings together."""
        inverse, n = powers(_R_INV, len(self.data) + 1), len(self.data) + 1 - k
        sums = np.zeros(len(self.data) + 1, U64)
        np.cumsum(_BYTE[self.data] * powers(_R, len(self.data) + 1)[: len(self.data)], out=sums[1:])
        return mix((sums[k:] - sums[:n]) * inverse[:n] + U64(k * 0xD6E8FEB86659FD93 % (1 << 64)))


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of slices of about ``limit`` bytes; null counts as empty.

    A longer text is a slice of its own.
    """
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_binary())
    n = len(column)
    if n == 0:
        return
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of True that don't cross rows; first run of each row."""
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    tails = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    begin[heads] = inside[heads]
    end[tails] = inside[tails]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte spans of the words ``[^\\x20\\x09-\\x0D]+``; index of each row's first word."""
    return spans(~SPACE[data], offsets)


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte spans of the \\n-split lines (empty ones too); index of each row's first line."""
    breaks = np.flatnonzero(data == 10)
    row = np.searchsorted(offsets, breaks, side="right") - 1
    starts = np.concatenate([offsets[:-1], breaks + 1])
    order = np.lexsort((np.concatenate([np.zeros(len(offsets) - 1, np.int8), np.ones(len(breaks), np.int8)]), starts, np.concatenate([np.arange(len(offsets) - 1), row])))
    starts = starts[order]
    first = np.arange(len(offsets) - 1) + np.searchsorted(breaks, offsets[:-1])
    first = np.append(first, len(starts))
    ends = np.empty_like(starts)
    ends[:-1] = starts[1:] - 1
    ends[first[1:] - 1] = offsets[1:]
    return starts, ends, first


def row_of(first: np.ndarray) -> np.ndarray:
    """The row of each element, from the index of each row's first element."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def windows(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-element windows inside each row, and the index where each starts."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    out = hashes[:n] * _SHINGLE[0]
    for j in range(1, k):
        out = out + hashes[j : j + n] * _SHINGLE[j]
    keep = np.zeros(n, bool)
    counts = np.diff(first)
    full = counts >= k
    ok = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(ok, first[:-1][full], 1)
    np.add.at(ok, first[1:][full] - k + 1, -1)
    keep = np.cumsum(ok)[:n] > 0
    at = np.flatnonzero(keep)
    return mix(out[at]), at


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of the values of each row."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[first[1:]] - total[first[:-1]]
