"""Texts of an Arrow batch as one byte array: words, hashes and sliding minima in numpy.

All functions work on whole texts. ``data`` holds the UTF-8 bytes of the texts one after
another and ``offsets`` where each begins, so no Python object is made for a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at a time; only a longer single text goes beyond it.
CHUNK = 2 << 20

_BYTE = np.arange(256)
#: Words of letters, digits and everything beyond ASCII; ``LOWER`` folds A-Z only.
PLAIN = ((_BYTE >= 0x30) & (_BYTE <= 0x39)) | ((_BYTE >= 0x61) & (_BYTE <= 0x7A)) | (_BYTE >= 0x80)
LOWER = np.where((_BYTE >= 0x41) & (_BYTE <= 0x5A), _BYTE + 32, _BYTE).astype(np.uint8)
#: Words of everything but the six ASCII white-space characters.
SOLID = ~((_BYTE == 0x20) | ((_BYTE >= 0x09) & (_BYTE <= 0x0D)))

_BASE = 0x9E3779B97F4A7C15 | 1
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = x ^ (x >> _U(32))
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    x *= _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64) * _U(0xA24BAED4963EE407)) | _U(1)
_powers: list[np.ndarray] = []


def forget() -> None:
    """Let go of what is kept between calls."""
    _powers.clear()


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of each."""
    if not _powers or len(_powers[0]) < n:
        size = n + n // 8
        _powers[:] = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            column = np.full(size, base, dtype=np.uint64)
            column[0] = 1
            _powers.append(np.multiply.accumulate(column))
    return _powers[0][:n], _powers[1][:n]


class Rolling:
    """Hashes of any slices of a sequence of 64-bit codes."""

    def __init__(self, codes: np.ndarray):
        power, self.inverse = _power(len(codes) + 1)
        self.sums = np.zeros(len(codes) + 1, dtype=np.uint64)
        np.cumsum(codes * power[:-1], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        value = (self.sums[ends] - self.sums[starts]) * self.inverse[starts]
        return mix(value + (ends - starts).astype(np.uint64))

    def all(self, width: int) -> np.ndarray:
        """Hash of every slice of that width."""
        n = len(self.sums) - width
        if n <= 0:
            return np.zeros(0, dtype=np.uint64)
        return mix((self.sums[width:] - self.sums[:n]) * self.inverse[:n] + _U(width))


def layout(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type)
                                  or pa.types.is_large_binary(column.type) else "")
    large = column.type in (pa.large_string(), pa.large_binary())
    _, places, body = column.buffers()
    offsets = np.frombuffer(places, dtype=np.int64 if large else np.int32)[
        column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = (np.frombuffer(body, dtype=np.uint8)[offsets[0]:offsets[-1]]
            if body is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8))
    return data, offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts together stay within the limit, or are one text."""
    row, n = 0, len(offsets) - 1
    while row < n:
        stop = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        stop = min(n, max(stop, row + 1))
        yield row, stop
        row = stop


def chunks(column: pa.Array, limit: int = CHUNK):
    """(first row, rows, bytes, offsets) for each part of a column."""
    data, offsets = layout(column)
    for row, stop in slices(offsets, limit):
        part = offsets[row:stop + 1]
        yield row, stop - row, data[part[0]:part[-1]], part - part[0]


def words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray):
    """Starts and ends of the words, and the place of each text's first word."""
    inside = kind[data]
    before = np.zeros(len(data), dtype=bool)
    before[1:] = inside[:-1]
    first = offsets[:-1]
    first = first[first < len(data)]
    before[first] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(len(data), dtype=bool)
    after[:-1] = inside[1:]
    last = offsets[1:] - 1
    after[last[last >= 0]] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return Rolling(BYTE_CODE[data]).of(starts, ends)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every window of that width."""
    if len(values) < width:
        return values[:0]
    low, reach = values, 1
    while 2 * reach <= width:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    if reach < width:
        low = np.minimum(low[:len(low) - (width - reach)], low[width - reach:])
    return low


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All members of the integer ranges, one range after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    shift = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    return np.arange(total, dtype=np.int64) + shift


def covered(starts: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """Which of the places 0..size-1 lie in any of the spans."""
    step = np.zeros(size + 1, dtype=np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, ends, -1)
    return np.cumsum(step[:-1]) > 0
