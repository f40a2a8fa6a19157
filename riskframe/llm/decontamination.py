"""Benchmark decontamination with an FM-index for each shard of training text.

A shard is a run of documents of one Arrow batch. Its words become symbols of the
benchmark's vocabulary, every other word ends a run, and runs too short for any window
hold no match and are left out. Benchmark windows are searched backwards through the
wavelet matrix, found rows are located by sampled suffix places, and the spans of a
document are merged. No document leaves its task, so there is no shuffle.

Defined results: a null or empty text has no words and is clean; benchmark rows with a null
text or without words hold no window; a null item_id marks words but is not named; repeated
rows count each for itself; columns other than those named are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from riskframe.llm import text as T
from riskframe.llm.fm_index import FMIndex
from riskframe.llm.stage import arrow, fresh, identified, staged

WINDOW = 10
#: Benchmark text sent to the executors at once; a larger benchmark takes more passes.
BLOCK_BYTES = 32 << 20
SHARD_BYTES = 8 << 20
SAMPLE = 16
_WORD = re.compile(rb"[a-z0-9\x80-\xff]+")
_FOLD = bytes(T.LOWER)

FOUND = ("doc_id bigint, uid bigint, n_words bigint, starts array<bigint>, ends array<bigint>, "
         "items array<string>")


@dataclass
class Phrases:
    """Windows of one benchmark block as vocabulary symbols."""

    codes: np.ndarray      # sorted word hashes
    names: list[bytes]     # the words, in that order; symbol = place + 1
    windows: np.ndarray    # (windows, width) symbols, 0 after the end of a short one
    sizes: np.ndarray
    items: list[list[str]]  # per window the items that hold it


def phrases(rows: list[tuple[str | None, bytes]], width: int) -> Phrases:
    owners: dict[tuple[bytes, ...], set[str]] = {}
    for item, body in rows:
        found = _WORD.findall(body.translate(_FOLD))
        for i in range(max(1, len(found) - width + 1) if found else 0):
            owners.setdefault(tuple(found[i:i + width]), set()).update([item] if item is not None else [])
    names = sorted({w for window in owners for w in window})
    data, offsets = T.layout(pa.array(names, pa.binary()))
    codes = T.word_codes(data, offsets[:-1], offsets[1:]) if names else np.zeros(0, np.uint64)
    order = np.argsort(codes)
    place = {names[j]: i + 1 for i, j in enumerate(order)}
    windows = np.zeros((len(owners), width), dtype=np.int64)
    for i, window in enumerate(owners):
        windows[i, :len(window)] = [place[w] for w in window]
    return Phrases(codes[order], [names[j] for j in order], windows,
                   np.array([len(w) for w in owners], dtype=np.int64),
                   [sorted(x) for x in owners.values()])


def search(index: FMIndex, windows: np.ndarray, sizes: np.ndarray):
    """(window, place) of every occurrence, by backward search."""
    low, high = np.zeros(len(windows), np.int64), np.full(len(windows), index.n, np.int64)
    for step in range(windows.shape[1]):
        live = np.flatnonzero((step < sizes) & (low < high))
        symbol = windows[live, sizes[live] - 1 - step]
        low[live], high[live] = index.extend(symbol, low[live], high[live])
    hits = np.flatnonzero((low < high) & (sizes > 0))
    counts = high[hits] - low[hits]
    rows = T.ranges(low[hits], counts)
    return np.repeat(hits, counts), index.locate(rows)


def shard_hits(data, offsets, known: Phrases):
    """Word places per document, and the located windows (document, first, end, window)."""
    data = T.LOWER[data]
    starts, ends, first = T.words(data, offsets, T.PLAIN)
    codes = T.word_codes(data, starts, ends)
    none = np.zeros(0, np.int64)
    if not len(codes) or not len(known.codes):
        return np.diff(first), none, none, none, none
    at = np.minimum(np.searchsorted(known.codes, codes), len(known.codes) - 1)
    symbol = np.where(known.codes[at] == codes, at + 1, 0)
    # runs of known words within one document
    fresh = np.zeros(len(symbol), dtype=bool)
    fresh[first[:-1][first[:-1] < len(symbol)]] = True
    inside = symbol > 0
    begin = np.flatnonzero(inside & (fresh | ~np.append(False, inside[:-1])))
    stop = np.flatnonzero(inside & np.append(fresh[1:] | ~inside[1:], True)) + 1
    long = stop - begin >= known.sizes.min(initial=1 << 30)
    begin, stop = begin[long], stop[long]
    if not len(begin):
        return np.diff(first), none, none, none, none
    lengths = stop - begin
    member = T.ranges(begin, lengths)
    slot = np.arange(len(member)) + np.repeat(np.arange(len(begin)), lengths)
    sequence = np.zeros(len(member) + len(begin), dtype=np.int64)
    origin = np.zeros(len(sequence), dtype=np.int64)
    sequence[slot], origin[slot] = symbol[member], member
    index = FMIndex(sequence, len(known.codes), sample=SAMPLE)
    window, place = search(index, known.windows, known.sizes)
    start = origin[place]
    size = known.sizes[window]
    # exact check: each word under a hit is the word itself, not one of equal hash
    span = np.unique(T.ranges(start, size))
    wrong = [w for w in span.tolist()
             if data[starts[w]:ends[w]].tobytes() != known.names[symbol[w] - 1]]
    if wrong:
        bad = np.zeros(len(symbol) + 1, dtype=np.int64)
        bad[np.array(wrong) + 1] = 1
        bad = np.cumsum(bad)
        keep = bad[start + size] == bad[start]
        window, start, size = window[keep], start[keep], size[keep]
    doc = np.searchsorted(first, start, side="right") - 1
    return np.diff(first), doc, start - first[doc], start - first[doc] + size, window


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[list[int], list[int]]:
    """Spans without overlap or touch, in order."""
    out: list[list[int]] = []
    for s, e in sorted(zip(starts.tolist(), ends.tolist())):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [x[0] for x in out], [x[1] for x in out]


def _finder(block, width: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = block.value
        for batch in batches:
            column = batch.column("text")
            for row, n, data, offsets in T.chunks(column, SHARD_BYTES):
                counts, doc, begin, stop, window = shard_hits(data, offsets, known)
                spans: list = [[[], []] for _ in range(n)]
                items: list = [[] for _ in range(n)]
                order = np.argsort(doc, kind="stable")
                cut = np.searchsorted(doc[order], np.arange(n + 1))
                for d in np.unique(doc).tolist():
                    mine = order[cut[d]:cut[d + 1]]
                    spans[d] = merged(begin[mine], stop[mine])
                    items[d] = sorted({x for w in set(window[mine].tolist()) for x in known.items[w]})
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(row, n), batch.column("uid").slice(row, n),
                     pa.array(counts, pa.int64()),
                     pa.array([s[0] for s in spans], pa.list_(pa.int64())),
                     pa.array([s[1] for s in spans], pa.list_(pa.int64())),
                     pa.array(items, pa.list_(pa.string()))],
                    ["doc_id", "uid", "n_words", "starts", "ends", "items"])
    return find


def blocks(benchmark: DataFrame, limit: int) -> Iterator[list]:
    """Benchmark rows in lists of bounded size, by a hash of the item."""
    bench = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").where("text IS NOT NULL")
    size = bench.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    parts = max(1, -(-size // limit))
    slot = F.pmod(F.xxhash64("item", "text"), F.lit(parts))
    for part in range(parts):
        yield [(r["item"], r["text"].encode()) for r in bench.where(slot == part).collect()]


def contaminated_spans(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW,
                       block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, uid, n_words, merged word spans, items found.

    The benchmark's size is measured first. One block is broadcast at a time; beyond
    ``block_bytes`` the documents are searched once per block and the spans merged.
    """
    spark = docs.sparkSession
    source = identified(docs)
    found = [arrow(source, _finder(spark.sparkContext.broadcast(phrases(rows, width)), width), FOUND)
             for rows in blocks(benchmark, block_bytes)]
    if len(found) == 1:
        return found[0]
    whole = staged(found[0], "spans")
    for part in found[1:]:
        hits = staged(part.where(F.size("items") + F.size("starts") > 0), "spans")
        hits = hits.dropDuplicates(["doc_id", "uid"])
        old, new = whole.alias("o"), hits.alias("n")
        joined = old.join(new, F.col("o.doc_id").eqNullSafe(F.col("n.doc_id"))
                          & (F.col("o.uid") == F.col("n.uid")), "left")
        both = [F.concat(F.col(f"o.{c}"), F.coalesce(F.col(f"n.{c}"), F.array().cast(t))).alias(c)
                for c, t in (("starts", "array<bigint>"), ("ends", "array<bigint>"),
                             ("items", "array<string>"))]
        whole = staged(arrow(joined.select("o.doc_id", "o.uid", "o.n_words", *both), _remerge, FOUND),
                       "spans")
    return whole


def _remerge(batches):
    for batch in batches:
        rows = batch.to_pylist()
        for r in rows:
            r["starts"], r["ends"] = merged(np.array(r["starts"]), np.array(r["ends"]))
            r["items"] = sorted(set(r["items"]))
        yield pa.RecordBatch.from_pylist(rows, schema=batch.schema)


def digest(spans: DataFrame) -> DataFrame:
    """Counts and the hash of the items of each document."""
    hit = F.aggregate(F.zip_with("starts", "ends", lambda s, e: e - s), F.lit(0).cast("bigint"),
                      lambda a, x: a + x)
    return spans.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Documents that hold no benchmark window, with the input's columns; no shuffle.

    A benchmark beyond one block takes one more pass over the kept rows for each block.
    """
    spark = docs.sparkSession
    for rows in blocks(benchmark, block_bytes):
        docs = arrow(docs, _cleaner(spark.sparkContext.broadcast(phrases(rows, width))), docs.schema)
    return docs


def _cleaner(block):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = block.value
        for batch in batches:
            hit = np.zeros(batch.num_rows, dtype=bool)
            for row, _, data, offsets in T.chunks(batch.column("text"), SHARD_BYTES):
                hit[row + np.unique(shard_hits(data, offsets, known)[1])] = True
            yield batch.filter(pa.array(~hit))
    return keep


def cut(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """All documents without the words of their merged spans and what stands between those."""
    doc, uid, mine, starts, ends = fresh(docs, "doc", "uid", "mine", "starts", "ends")
    spans = contaminated_spans(docs, benchmark)
    hits = (spans.where(F.size("starts") > 0).select(
        F.col("doc_id").alias(doc), F.col("uid").alias(uid), F.col("starts").alias(starts),
        F.col("ends").alias(ends)).dropDuplicates([doc, uid]))
    marked = docs.withColumn(mine, F.xxhash64("doc_id", "text"))
    joined = marked.join(hits, F.col("doc_id").eqNullSafe(F.col(doc)) & (F.col(mine) == F.col(uid)), "left")
    names = docs.columns

    def trim(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for i, (s, e) in enumerate(zip(batch.column(starts).to_pylist(), batch.column(ends).to_pylist())):
                if s:
                    texts[i] = cut_words(texts[i], s, e)
            columns = [pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(columns, names)

    return arrow(joined.select(*names, starts, ends), trim, docs.schema)


def cut_words(body: str, starts: list[int], ends: list[int]) -> str:
    """Text without the words of the spans, from a span's first byte to its last."""
    raw = body.encode()
    found = [m.span() for m in _WORD.finditer(raw.translate(_FOLD))]
    out, at = [], 0
    for s, e in zip(starts, ends):
        out.append(raw[at:found[s][0]])
        at = found[e - 1][1]
    return b"".join([*out, raw[at:]]).decode()


def op1(spark, sf_dir: str) -> DataFrame:
    return digest(contaminated_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"),
                                     spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def reference(docs: list[tuple], benchmark: list[tuple], width: int = WINDOW) -> list[tuple]:
    """The contract by brute force, for tests."""
    windows: dict[tuple, set] = {}
    for item, body in benchmark:
        w = _WORD.findall((body or "").encode().translate(_FOLD))
        for i in range(max(1, len(w) - width + 1) if w else 0):
            windows.setdefault(tuple(w[i:i + width]), set()).add(str(item))
    sizes = sorted({len(w) for w in windows})
    out = []
    for doc, body in docs:
        w = _WORD.findall((body or "").encode().translate(_FOLD))
        hit, items = [False] * len(w), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                if (found := windows.get(tuple(w[i:i + size]))) is not None:
                    hit[i:i + size] = [True] * size
                    items |= found
        out.append((doc, len(w), sum(hit), len(items),
                    hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), any(hit)))
    return out
