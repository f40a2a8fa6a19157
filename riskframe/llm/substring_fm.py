"""Substring dedup of word windows with an FM-index for each shard.

Segments of the corpus (see ``segments``) are dealt out by content. Each shard builds a
compressed FM-index of its distinct segments, weighted by their copies, and streams them
over it: backward search through the wavelet matrix finds the longest repeated match at
each place, and intervals of ``WINDOW`` words or more are reported.

Defined results: a null, empty or short text keeps everything; windows of repeated rows count
as repeats of each other; a document's own repeats count; columns of other names are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from riskframe.llm import text as T
from riskframe.llm.fm_index import FMIndex
from riskframe.llm.segments import Scheme, covered_units, repeats, sha, with_removals

WINDOW = 35
SCHEME = Scheme(window=WINDOW, piece=6, by_word=True)
#: Words of the first, short search at a window; it rules out most places in a few steps.
PROBE = 8
#: Windows that one lane of the vectorised search looks at.
LANE = 256


def matching_windows(index: FMIndex, weight: np.ndarray, sequence: np.ndarray,
                     first: np.ndarray, windows: np.ndarray, window: int) -> np.ndarray:
    """Which places of the sequence start a window found twice or more.

    Each lane walks its windows from right to left. ``weight`` sums the copies of the
    suffixes in order. A match that fails at f with end e rules out all windows that hold
    f..e; a match beyond the window length marks every window inside it.
    """
    marked = np.zeros(len(sequence), dtype=bool)
    pieces = -(-windows // LANE)
    part = T.ranges(np.zeros(len(windows), np.int64), pieces)
    owner = np.repeat(np.arange(len(windows)), pieces)
    low_end = first[owner] + part * LANE
    at = first[owner] + np.minimum((part + 1) * LANE, windows[owner]) - 1
    end = at + PROBE - 1
    left = end + 1
    low, high = np.zeros(len(at), np.int64), np.full(len(at), index.n, np.int64)
    full = np.zeros(len(at), dtype=bool)
    while len(at):
        new_low, new_high = index.extend(sequence[left - 1], low, high)
        good = weight[new_high] - weight[new_low] >= 2
        fail = ~good
        fail_at = left - 1
        left = np.where(good, left - 1, left)
        low, high = np.where(good, new_low, low), np.where(good, new_high, high)
        inside = good & full & (left <= at)
        marked[left[inside]] = True
        finished = inside & (left == low_end)
        # a probe that reached its window: search the whole window
        whole = good & ~full & (left == at)
        # failures, by the kind of search and how far it came
        matched = fail & full & (left <= at)
        missed = fail & full & (left > at)
        probe = fail & ~full
        at = np.where(matched, fail_at, np.where(missed, at - 1, np.where(probe, end - window, at)))
        finished |= fail & (at < low_end)
        ahead = np.where(probe, at, np.maximum(fail_at, at)) + PROBE - 1
        end = np.where(whole, at + window - 1,
                       np.where(fail, np.minimum(ahead, at + window - 1), end))
        again = whole | fail
        left = np.where(again, end + 1, left)
        low, high = np.where(again, 0, low), np.where(again, index.n, high)
        full = np.where(again, whole, full)
        if finished.any():
            keep = ~finished
            low_end, at, end, left = low_end[keep], at[keep], end[keep], left[keep]
            low, high, full = low[keep], high[keep], full[keep]
    return marked


def index(data: np.ndarray, offsets: np.ndarray, copies: np.ndarray) -> list[np.ndarray]:
    """Per segment, which of its windows occur twice or more in the shard."""
    starts, ends, first = T.words(data, offsets, T.SOLID)
    values, symbol = np.unique(T.word_codes(data, starts, ends), return_inverse=True)
    sizes = np.diff(first)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    sequence = np.zeros(len(symbol) + len(sizes), dtype=np.int64)
    sequence[np.arange(len(symbol)) + owner] = symbol + 1
    begin = first[:-1] + np.arange(len(sizes))
    built = FMIndex(sequence, len(values), depth=LANE + 2 * WINDOW)
    share = np.zeros(len(sequence), dtype=np.int64)
    share[np.arange(len(symbol)) + owner] = copies[owner]
    weight = np.append(0, np.cumsum(share[built.order]))
    windows = np.maximum(sizes - WINDOW + 1, 0)
    marked = matching_windows(built, weight, sequence, begin, windows, WINDOW)
    return [marked[b:b + w] for b, w in zip(begin.tolist(), windows.tolist())]


DIGEST = "doc_id bigint, uid bigint, n_words bigint, whole_sha string"
REMOVED = "doc_id bigint, uid bigint, n_removed bigint, kept string, kept_sha string"


def _whole(batches):
    for batch in batches:
        for row, n, data, offsets in T.chunks(batch.column("text")):
            texts = [data[offsets[i]:offsets[i + 1]].tobytes().split() for i in range(n)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(row, n), batch.column("uid").slice(row, n),
                 pa.array([len(t) for t in texts], pa.int64()), pa.array([sha(b" ".join(t)) for t in texts])],
                ["doc_id", "uid", "n_words", "whole_sha"])


def _removed(batches):
    for batch in batches:
        gone, kept = [], []
        for body, spans in zip(batch.column("content"), batch.column("spans").to_pylist()):
            found = body.as_py().split()
            out = covered_units(spans, WINDOW, len(found))
            gone.append(int(out.sum()))
            kept.append(b" ".join([w for w, x in zip(found, out.tolist()) if not x]))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("uid"), pa.array(gone, pa.int64()),
             pa.array([k.decode() for k in kept], pa.string()), pa.array([sha(k) for k in kept])],
            ["doc_id", "uid", "n_removed", "kept", "kept_sha"])


def deduplicated(docs: DataFrame) -> DataFrame:
    """Per document: its words, how many go, its remaining words where any goes, their hash."""
    hits, bodies = repeats(docs, SCHEME, index)
    rows = with_removals(docs, hits, bodies, _whole, _removed, DIGEST, REMOVED)
    return rows.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("bigint").alias("n_removed"),
                       "kept", F.coalesce("kept_sha", "whole_sha").alias("kept_sha256"))


def op5(spark, sf_dir: str) -> DataFrame:
    return deduplicated(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept")


def reference(docs: list[tuple], window: int = WINDOW) -> list[tuple]:
    """The contract by brute force, for tests."""
    split = [(d, (t or "").encode().split()) for d, t in docs]
    seen = Counter(tuple(w[i:i + window]) for _, w in split for i in range(len(w) - window + 1))
    out = []
    for d, w in split:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i:i + window])] > 1:
                gone[i:i + window] = [True] * window
        out.append((d, len(w), sum(gone), sha(b" ".join(x for x, g in zip(w, gone) if not g))))
    return out
