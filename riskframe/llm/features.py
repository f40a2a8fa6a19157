"""Hashed word and character n-grams of whole texts, for linear models in numpy."""

from __future__ import annotations

import numpy as np

from riskframe.llm import text as T

_U = np.uint64


def grams(data: np.ndarray, offsets: np.ndarray, widths: tuple[int, ...], buckets: int, salt: int = 0):
    """(bucket, row) of every byte n-gram that stays within its text."""
    roll = T.Rolling(T.BYTE_CODE[data])
    for width in widths:
        counts = np.maximum(np.diff(offsets) - width + 1, 0)
        at = T.ranges(offsets[:-1], counts)
        code = roll.all(width)[at] if len(at) else np.zeros(0, np.uint64)
        yield (T.mix(code + _U(salt + width)) >> _U(20)).astype(np.int64) % buckets, counts


def word_grams(codes: np.ndarray, first: np.ndarray, widths: tuple[int, ...], buckets: int):
    roll = T.Rolling(codes)
    for width in widths:
        counts = np.maximum(np.diff(first) - width + 1, 0)
        at = T.ranges(first[:-1], counts)
        code = roll.all(width)[at] if len(at) else np.zeros(0, np.uint64)
        yield (T.mix(code + _U(97 * width)) >> _U(20)).astype(np.int64) % buckets, counts


def row_sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive stretches, along the first axis."""
    total = np.concatenate([np.zeros((1,) + values.shape[1:]), np.cumsum(values, axis=0, dtype=np.float64)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))
