"""Substring dedup of byte windows with blockwise suffix arrays.

Segments of the corpus (see ``segments``) are dealt out by content. In each shard the
suffixes that start a window are sorted one bucket at a time. Ties longer than the cover's
period are resolved by the ranks of sampled suffixes: for any two suffixes a shift below the
period takes both to samples, whose order is computed once. Segments are laid out so that equal
windows have equal residues and most ties need one shift only. Neighbours in the order that
share ``WINDOW`` bytes are repeats.

Defined results: a null or empty text has no bytes; short texts keep everything; repeated rows
repeat each other; windows count within a text too; columns of other names are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from riskframe.llm import text as T
from riskframe.llm.segments import Scheme, covered_units, repeats, sha, with_removals

WINDOW = 400
SCHEME = Scheme(window=WINDOW, piece=48, by_word=False)
#: Every difference modulo the period is a difference of two members of the cover.
PERIOD, COVER = 13, (0, 1, 3, 9)
#: Suffixes sorted at once.
BUCKET = 1 << 18

_U = np.uint64
_SHIFT = np.array([[next(d for d in range(PERIOD) if (a + d) % PERIOD in COVER and (b + d) % PERIOD in COVER)
                    for b in range(PERIOD)] for a in range(PERIOD)])


def prefixes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first 16 bytes of the suffixes as two ordered integers; zeros beyond the end."""
    padded = np.append(data, np.zeros(16, np.uint8))
    rows = np.lib.stride_tricks.sliding_window_view(padded, 16)[at]
    both = np.ascontiguousarray(rows).view(">u8").astype(np.uint64)
    return both[:, 0], both[:, 1]


def aligned(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The segments laid out anew, each with its least piece at a multiple of the period.

    Equal windows of two segments then start at places of the same residue, whose ties one
    look at the sampled ranks resolves. Returns the bytes and where each segment starts.
    """
    sizes = np.diff(offsets)
    piece = T.Rolling(T.BYTE_CODE[data]).all(SCHEME.piece)
    counts = np.maximum(sizes - SCHEME.piece + 1, 0)
    some = np.flatnonzero(counts)
    own = piece[T.ranges(offsets[:-1][some], counts[some])]
    head = np.cumsum(counts[some]) - counts[some]
    anchor = np.zeros(len(sizes), dtype=np.int64)
    if len(some):
        low = np.minimum.reduceat(own, head)
        hits = np.flatnonzero(own == np.repeat(low, counts[some]))
        anchor[some] = hits[np.searchsorted(hits, head)] - head
    room = sizes + PERIOD - 1
    slot = np.cumsum(room) - room
    start = slot + (-(slot + anchor)) % PERIOD
    out = np.zeros(int(room.sum()), dtype=np.uint8)
    out[T.ranges(start, sizes)] = data
    return out, start


def sample_ranks(data: np.ndarray, start: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Rank of every suffix whose place is in the cover, up to its segment's end; else 0."""
    n = len(data)
    place = np.flatnonzero(np.isin(np.arange(n) % PERIOD, COVER))
    of = np.searchsorted(start, place, side="right") - 1
    inside = (of >= 0) & (place < (start + sizes)[np.maximum(of, 0)])
    place, of = place[inside], of[inside]
    if not len(place):
        return np.zeros(n, dtype=np.uint64)
    stop = (start + sizes)[of]
    left = stop - place
    one, two = prefixes(data, place)
    # bytes beyond the segment do not count, nor those beyond one period
    size = np.minimum(left, PERIOD)
    keep_one = np.where(size >= 8, ~_U(0), ~(~_U(0) >> (8 * np.minimum(size, 7)).astype(np.uint64)))
    rest = np.maximum(size - 8, 0)
    keep_two = np.where(rest > 0, ~(~_U(0) >> (8 * rest).astype(np.uint64)), _U(0))
    one &= keep_one
    two = (two & keep_two) | size.astype(np.uint64)
    order = np.lexsort((two, one))
    x, y = one[order], two[order]
    slot = np.full(n + 1, len(place), dtype=np.int64)
    slot[place] = np.arange(len(place))
    rank = np.zeros(len(place) + 1, dtype=np.uint64)     # the last one stands for the end
    reach, deepest = PERIOD, int(left.max())

    def settle(who: np.ndarray, at: np.ndarray, fresh: np.ndarray) -> np.ndarray:
        """Rank groups by the place of their head; the places that are still tied."""
        head = np.flatnonzero(fresh)
        size = np.diff(np.append(head, len(at)))
        rank[who] = np.repeat(at[head] + 1, size).astype(np.uint64)
        return at[np.repeat(size > 1, size)]

    tied = settle(order, np.arange(len(order)), np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])))
    while len(tied) and reach < deepest:
        who = order[tied]
        ahead = np.where(left[who] > reach, slot[np.minimum(place[who] + reach, n)], len(place))
        key = (rank[who] << _U(32)) | rank[ahead]
        by = np.argsort(key)
        who, key = who[by], key[by]
        order[tied] = who
        tied = settle(who, tied, np.append(True, key[1:] != key[:-1]))
        reach *= 2
    if len(tied):                                        # alike to their ends: by place
        who = order[tied]
        who = who[np.argsort((rank[who] << _U(32)) | place[who].astype(np.uint64))]
        rank[who] = tied.astype(np.uint64) + _U(1)
    full = np.zeros(n, dtype=np.uint64)
    full[place] = rank[:-1]
    return full


def sort_bucket(data: np.ndarray, at: np.ndarray, one: np.ndarray, two: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Suffix places in order. Each starts a window, so 32 bytes can be read before the ranks."""
    order = np.lexsort((two, one))
    at, one, two = at[order], one[order], two[order]
    fresh = np.append(True, (one[1:] != one[:-1]) | (two[1:] != two[:-1]))
    size = np.diff(np.append(np.flatnonzero(fresh), len(at)))
    some = np.flatnonzero(np.repeat(size > 1, size))
    if not len(some):
        return at
    run = np.cumsum(fresh)[some]
    three, four = prefixes(data, at[some] + 16)
    by = np.lexsort((four, three, run))
    at[some] = at[some][by]
    run, three, four = run[by], three[by], four[by]
    fresh[some[1:]] = (run[1:] != run[:-1]) | (three[1:] != three[:-1]) | (four[1:] != four[:-1])
    group = np.cumsum(fresh) - 1
    head = np.flatnonzero(fresh)
    sizes = np.diff(np.append(head, len(at)))
    tied = np.flatnonzero(sizes[group] > 1)
    if not len(tied):
        return at
    place, base = at[tied], group[tied].astype(np.uint64) << _U(32)
    residue = place % PERIOD
    mixed = np.zeros(len(head), dtype=bool)
    mixed[group[tied][1:][(group[tied][1:] == group[tied][:-1]) & (residue[1:] != residue[:-1])]] = True
    alike = ~mixed[group[tied]]
    out = at.copy()
    key = base[alike] | rank[place[alike] + _SHIFT[residue[alike], residue[alike]]]
    out[tied[alike]] = place[alike][np.argsort(key)]
    tied, place, base, residue = tied[~alike], place[~alike], base[~alike], residue[~alike]
    if not len(tied):
        return out
    of = [np.flatnonzero(residue == r) for r in range(PERIOD)]
    below = np.zeros(len(tied), dtype=np.int64)  # members of the group that come before
    for a in range(PERIOD):
        for b in range(a, PERIOD):
            mine, other = of[a], of[b]
            if not len(mine) or not len(other):
                continue
            shift = _SHIFT[a, b]
            key = base[mine] | rank[place[mine] + shift]
            if a == b:
                by = np.argsort(key)
                where = np.arange(len(by)) - np.searchsorted(base[mine][by], base[mine][by])
                below[mine[by]] += where
                continue
            keys = base[other] | rank[place[other] + shift]
            key_sorted, keys_sorted = np.sort(key), np.sort(keys)
            below[mine] += np.searchsorted(keys_sorted, key) - np.searchsorted(keys_sorted, base[mine])
            below[other] += np.searchsorted(key_sorted, keys) - np.searchsorted(key_sorted, base[other])
    out[head[group[tied]] + below] = place
    return out


def index(data: np.ndarray, offsets: np.ndarray, copies: np.ndarray) -> list[np.ndarray]:
    """Per segment, which of its windows occur twice or more in the shard."""
    sizes = np.diff(offsets)
    windows = np.maximum(sizes - WINDOW + 1, 0)
    data, begin = aligned(data, offsets)
    rank = sample_ranks(data, begin, sizes)
    hashes = T.Rolling(T.BYTE_CODE[data]).all(WINDOW)
    starts = T.ranges(begin, windows)
    owner = np.repeat(np.arange(len(sizes)), windows)
    marked = np.zeros(len(data), dtype=bool)
    one, two = prefixes(data, starts)
    # buckets by the leading bytes, with bounds that never part equal ones
    cuts = np.sort(one[:: max(1, len(one) // 4096)])
    bounds = np.unique(cuts[:: max(1, len(cuts) * BUCKET // max(1, len(one)))])
    bucket = np.searchsorted(bounds, one, side="right")
    by_bucket = np.argsort(bucket, kind="stable")
    edges = np.append(0, np.cumsum(np.bincount(bucket)))
    rows = np.ndarray((max(0, len(data) - WINDOW + 1),), dtype=f"V{WINDOW}", buffer=data, strides=(1,))
    share = np.zeros(len(data), dtype=np.int64)
    share[starts] = copies[owner]
    for low, high in zip(edges[:-1].tolist(), edges[1:].tolist()):
        if low == high:
            continue
        mine = by_bucket[low:high]
        order = sort_bucket(data, starts[mine], one[mine], two[mine], rank)
        same = np.append(False, hashes[order[1:]] == hashes[order[:-1]])
        near = np.flatnonzero(same)
        for k in range(0, len(near), 8192):  # exact check of the shared bytes
            i = near[k:k + 8192]
            x = rows[order[i]].view(np.uint8).reshape(-1, WINDOW)
            y = rows[order[i - 1]].view(np.uint8).reshape(-1, WINDOW)
            same[i] = (x == y).all(axis=1)
        head = np.flatnonzero(~same)
        total = np.add.reduceat(share[order], head)
        marked[order] = np.repeat(total >= 2, np.diff(np.append(head, len(order))))
    return [marked[b:b + w] for b, w in zip(begin.tolist(), windows.tolist())]


DIGEST = "doc_id bigint, uid bigint, n_bytes bigint, whole_sha string"
REMOVED = "doc_id bigint, uid bigint, n_removed bigint, n_spans bigint, kept binary, kept_sha string"


def _whole(batches):
    for batch in batches:
        for row, n, data, offsets in T.chunks(batch.column("text")):
            hashes = [sha(data[offsets[i]:offsets[i + 1]].tobytes()) for i in range(n)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(row, n), batch.column("uid").slice(row, n),
                 pa.array(np.diff(offsets), pa.int64()), pa.array(hashes, pa.string())],
                ["doc_id", "uid", "n_bytes", "whole_sha"])


def _removed(batches):
    for batch in batches:
        gone, runs, kept = [], [], []
        for body, spans in zip(batch.column("content"), batch.column("spans").to_pylist()):
            found = np.frombuffer(body.as_py(), dtype=np.uint8)
            out = covered_units(spans, WINDOW, len(found))
            gone.append(int(out.sum()))
            runs.append(int((out & ~np.append(False, out[:-1])).sum()))
            kept.append(found[~out].tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("uid"), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()),
             pa.array(kept, pa.binary()), pa.array([sha(k) for k in kept])],
            ["doc_id", "uid", "n_removed", "n_spans", "kept", "kept_sha"])


def deduplicated(docs: DataFrame) -> DataFrame:
    """Per document: its bytes, how many go in how many runs, what is kept where any goes, its hash.

    A window may begin or end inside a character, so what is kept is binary.
    """
    hits, bodies = repeats(docs, SCHEME, index)
    rows = with_removals(docs, hits, bodies, _whole, _removed, DIGEST, REMOVED)
    zero = F.lit(0).cast("bigint")
    return rows.select("doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"),
                       F.coalesce("n_spans", zero).alias("n_spans"), "kept",
                       F.coalesce("kept_sha", "whole_sha").alias("kept_sha256"))


def op10(spark, sf_dir: str) -> DataFrame:
    return deduplicated(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept")


def reference(docs: list[tuple], window: int = WINDOW) -> list[tuple]:
    """The contract by brute force, for tests."""
    raw = [(d, (t or "").encode()) for d, t in docs]
    seen = Counter(hash(b[i:i + window]) for _, b in raw for i in range(len(b) - window + 1))
    out = []
    for d, b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - window + 1):
            if seen[hash(b[i:i + window])] > 1:
                gone[i:i + window] = b"\1" * window
        text = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, sha(text)))
    return out
