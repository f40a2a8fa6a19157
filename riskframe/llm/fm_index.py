"""FM-index over integer sequences: suffix order, wavelet matrix, sampled positions.

A sequence holds symbols from 1 up; 0 ends a run, and no match reaches over it.
All searches are vectors over patterns or lanes.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64


def suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Positions ordered by their next ``depth`` symbols up to the run's end, then by place.

    Prefix doubling on packed symbols; it stops when all ranks differ or the depth or
    the longest run is reached. Equal runs of any length are ordered by place, which
    keeps the steps of an FM-index exact.
    """
    n = len(symbols)
    bits = max(1, int(symbols.max(initial=0)).bit_length())
    pack = max(1, min(62 // bits, 16))
    ends = np.flatnonzero(symbols == 0)
    place = np.arange(n)
    nearest = np.searchsorted(ends, place)
    left = np.append(ends, n)[nearest] - place  # symbols before the run's end
    padded = np.append(symbols, np.zeros(pack, symbols.dtype)).astype(np.uint64)
    key = np.zeros(n, dtype=np.uint64)
    for j in range(pack):
        key = (key << _U(bits)) | np.where(left > j, padded[j:j + n], _U(0))
    reach, longest = pack, min(depth, int(left.max(initial=0)))
    while True:
        order = np.argsort(key)
        ordered = key[order]
        fresh = np.ones(n, dtype=bool)
        fresh[1:] = ordered[1:] != ordered[:-1]
        ranks = np.empty(n, dtype=np.uint64)
        ranks[order] = np.cumsum(fresh).astype(np.uint64)
        if fresh.all() or reach >= longest:
            break
        ahead = np.zeros(n, dtype=np.uint64)
        ahead[:n - reach] = ranks[reach:]
        ahead[left <= reach] = 0
        key = (ranks << _U(32)) | ahead
        reach *= 2
    if not fresh.all():
        order = np.argsort((ranks << _U(32)) | place.astype(np.uint64))
    return order


class WaveletMatrix:
    """Rank of any symbol before any place, in bit-packed levels."""

    def __init__(self, values: np.ndarray, top: int):
        self.bits = max(1, int(top).bit_length())
        self.n = len(values)
        self.levels, self.counts, self.zeros = [], [], []
        current = values
        for level in range(self.bits - 1, -1, -1):
            bit = ((current >> level) & 1).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            words = np.zeros(self.n // 64 + 2, dtype=np.uint64)
            words.view(np.uint8)[:len(packed)] = packed
            counts = np.zeros(len(words), dtype=np.int64)
            np.cumsum(np.bitwise_count(words[:-1]), out=counts[1:])
            self.levels.append(words)
            self.counts.append(counts)
            self.zeros.append(int(self.n - bit.sum()))
            current = np.concatenate([current[~bit], current[bit]])
        self.start = self.walk(np.arange(top + 1), np.zeros(top + 1, dtype=np.int64))

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        mask = (_U(1) << (at & 63).astype(np.uint64)) - _U(1)
        return self.counts[level][word] + np.bitwise_count(self.levels[level][word] & mask)

    def walk(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level in range(self.bits):
            ones = self._ones(level, at)
            bit = (symbol >> (self.bits - 1 - level)) & 1
            at = np.where(bit == 1, self.zeros[level] + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.walk(symbol, at) - self.start[symbol]

    def access(self, at: np.ndarray) -> np.ndarray:
        symbol = np.zeros(len(at), dtype=np.int64)
        for level in range(self.bits):
            word, shift = at >> 6, (at & 63).astype(np.uint64)
            bit = ((self.levels[level][word] >> shift) & _U(1)).astype(np.int64)
            ones = self._ones(level, at)
            at = np.where(bit == 1, self.zeros[level] + ones, at - ones)
            symbol = (symbol << 1) | bit
        return symbol


class FMIndex:
    def __init__(self, symbols: np.ndarray, top: int, depth: int = 1 << 30,
                 sample: int | None = None):
        symbols = symbols.astype(np.int64)
        self.n, self.top = len(symbols), top
        order = suffix_order(symbols, depth)
        before = np.where(order == 0, 0, symbols[order - 1])
        self.tree = WaveletMatrix(before, top)
        self.first = np.zeros(top + 2, dtype=np.int64)
        np.cumsum(np.bincount(symbols, minlength=top + 1), out=self.first[1:])
        self.order = order if sample is None else None
        if sample is not None:
            run_start = np.append(True, symbols[:-1] == 0)
            kept = (order % sample == 0) | run_start[order]
            self.kept_at = np.append(0, np.cumsum(kept))
            self.kept_place = order[kept]
            self.is_kept = kept

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray):
        """Ranges of the patterns with a symbol put before them."""
        both = self.tree.rank(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        base = self.first[symbol]
        return base + both[:len(symbol)], base + both[len(symbol):]

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places of suffixes, stepping back to the next sampled one."""
        place = np.zeros(len(rows), dtype=np.int64)
        open_, at, steps = np.arange(len(rows)), rows.astype(np.int64), 0
        while len(open_):
            hit = self.is_kept[at]
            place[open_[hit]] = self.kept_place[self.kept_at[at[hit]]] + steps
            open_, at = open_[~hit], at[~hit]
            symbol = self.tree.access(at)
            at = self.first[symbol] + self.tree.rank(symbol, at)
            steps += 1
        return place
