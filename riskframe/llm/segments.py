"""Cut a corpus into segments so that equal windows of any two texts meet in one shard.

A window's key is the least hash of the short pieces inside it, a function of its content
alone. Consecutive windows of one key form a segment. A key that stands at one place of
the corpus cannot hold a repeated window, so only segments of keys seen at two places or
more travel with their content; equal segments are merged before they are dealt out by key.
The per-shard index then decides which windows are repeated.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from riskframe.llm import text as T
from riskframe.llm.stage import arrow, identified, staged

#: Content bytes indexed at once, whole keys at a time.
INDEX_BYTES = 4 << 20
#: A key with more distinct content than this is dealt out window by window.
KEY_BYTES = 8 << 20
#: A longer text is cut in pieces of so many bytes that share a window less one unit.
PIECE_BYTES = T.CHUNK
#: Window hashes or window contents in a batch.
BATCH, BATCH_BYTES = 1 << 18, 16 << 20

Index = Callable[[np.ndarray, np.ndarray, np.ndarray], list[np.ndarray]]


@dataclass(frozen=True)
class Scheme:
    """Window length and piece length in units, and whether a unit is a word or a byte."""

    window: int
    piece: int
    by_word: bool

    @property
    def span(self) -> int:
        return self.window - self.piece + 1

    def units(self, data: np.ndarray, offsets: np.ndarray):
        """Codes of the units and the place of each text's first one."""
        if not self.by_word:
            return T.BYTE_CODE[data], offsets
        starts, ends, first = T.words(data, offsets, T.SOLID)
        return T.word_codes(data, starts, ends), first

    def pieces(self, data: np.ndarray, offsets: np.ndarray, limit: int):
        """(bytes, offsets, first unit): a chunk as it is, or overlapping pieces of one long text.

        Equal windows need not lie in equal segments, so a cut through a segment loses nothing.
        """
        if len(offsets) != 2 or len(data) <= limit:
            yield data, offsets, 0
            return
        if self.by_word:
            starts, ends, _ = T.words(data, offsets, T.SOLID)
        n = len(starts) if self.by_word else len(data)
        at = 0
        while at < n:
            if self.by_word:
                stop = int(np.searchsorted(ends, starts[at] + limit, side="right"))
            else:
                stop = at + limit
            stop = min(n, max(stop, at + 2 * self.window))
            body = data[starts[at]:ends[stop - 1]] if self.by_word else data[at:stop]
            yield body, np.array([0, len(body)]), at
            if stop == n:
                return
            at = stop - self.window + 1

    def hashes(self, content: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Two independent hashes of every window of one segment."""
        data = np.frombuffer(content, np.uint8)
        codes, _ = self.units(data, np.array([0, len(data)]))
        return T.Rolling(codes).all(self.window), T.Rolling(T.mix(codes)).all(self.window)

    def runs(self, data: np.ndarray, offsets: np.ndarray):
        """Segments: key, row, first window within the text, windows, and if its key recurs inside."""
        codes, first = self.units(data, offsets)
        pieces = T.Rolling(codes).all(self.piece)
        low = T.sliding_min(pieces, self.span)
        none = np.zeros(0, dtype=np.int64)
        if not len(low):
            return none.astype(np.uint64), none, none, none, none.astype(bool)
        counts = np.maximum(np.diff(first) - self.window + 1, 0)
        begin = first[:-1][counts > 0]
        fresh = np.append(True, low[1:] != low[:-1])
        fresh[begin] = True
        valid = T.covered(begin, begin + counts[counts > 0], len(low))
        start = np.flatnonzero(fresh & valid)
        row = np.searchsorted(first, start, side="right") - 1
        stop = np.minimum(np.append(start[1:], len(low)), first[row] + counts[row])
        # a window repeated inside its own segment has the key at two places of it
        enters = np.flatnonzero(pieces[:len(low)] == low)
        leaves = np.flatnonzero(pieces[self.span - 1:self.span - 1 + len(low)] == low)
        one = np.searchsorted(enters, start)
        two = np.searchsorted(leaves, stop) - 1
        far = np.iinfo(np.int64).max
        x = np.append(enters, far)[one]
        z = np.where(two >= 0, np.append(leaves, 0)[two] + self.span - 1, -1)
        inner = (x < stop) & (z >= start + self.span - 1) & (x < z)
        return low[start], row, start - first[row], stop - start, inner | (stop - start > self.span)


def _keys(scheme: Scheme, limit: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uid = batch.column("uid").to_numpy(zero_copy_only=False)
            for first, _, chunk, places in T.chunks(batch.column("text")):
                for data, offsets, _ in scheme.pieces(chunk, places, limit):
                    key, row, _, _, inner = scheme.runs(data, offsets)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key.view(np.int64)), pa.array(uid[first + row]),
                         pa.array(1 + inner.astype(np.int64))], ["key", "uid", "places"])
    return scan


CUT = ("key bigint, content binary, doc_id bigint, uid bigint, first bigint, windows bigint")


def _cut(scheme: Scheme, limit: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column("keys")
            lists = wanted.offsets.to_numpy()
            values = wanted.values.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for begin, n, chunk, places in T.chunks(batch.column("text")):
                place = lists[begin:begin + n + 1].astype(np.int64)
                owner = np.repeat(np.arange(n), np.diff(place)).astype(np.uint64)
                pairs = values[place[0]:place[-1]] ^ T.mix(owner + np.uint64(1))

                def rows(key, content, row, first, windows):
                    at = pa.array(begin + row)
                    return pa.RecordBatch.from_arrays(
                        [pa.array(key, pa.int64()), pa.array(content, pa.binary()), batch.column("doc_id").take(at),
                         batch.column("uid").take(at), pa.array(first, pa.int64()), pa.array(windows, pa.int64())],
                        ["key", "content", "doc_id", "uid", "first", "windows"])

                touched = np.zeros(n, dtype=bool)
                for data, offsets, shift in scheme.pieces(chunk, places, limit):
                    key, row, first, windows, _ = scheme.runs(data, offsets)
                    mine = np.flatnonzero(np.isin(key ^ T.mix(row.astype(np.uint64) + np.uint64(1)), pairs))
                    touched[row[mine]] = True
                    content, last, units = [], -1, []
                    for i in mine.tolist():
                        r = int(row[i])
                        if r != last:
                            body, last = data[offsets[r]:offsets[r + 1]].tobytes(), r
                            units = body.split() if scheme.by_word else body
                        piece = units[first[i]:first[i] + windows[i] + scheme.window - 1]
                        content.append(b" ".join(piece) if scheme.by_word else piece)
                    yield rows(key[mine].view(np.int64), content, row[mine], shift + first[mine], windows[mine])
                # the text itself follows once, with no key, for the removal at the end
                texts = np.flatnonzero(touched)
                nothing = [None] * len(texts)
                yield rows(nothing, [chunk[places[r]:places[r + 1]].tobytes() for r in texts.tolist()], texts, nothing, nothing)
    return cut


PLACES = "one bigint, two bigint, key bigint, chash bigint, at bigint, n bigint"


def _places(scheme: Scheme):
    """Each distinct window of a segment by its two hashes, its first place there and how often it occurs."""
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                one, two = scheme.hashes(batch.column("content")[r].as_py())
                _, at, n = np.unique(one ^ T.mix(two), return_index=True, return_counts=True)
                key, chash, occ = (batch.column(c)[r].as_py() for c in ("key", "chash", "occ"))
                for cut in range(0, len(at), BATCH):
                    some = at[cut:cut + BATCH]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(one[some].view(np.int64)), pa.array(two[some].view(np.int64)),
                         pa.array(np.full(len(some), key)), pa.array(np.full(len(some), chash)),
                         pa.array(some), pa.array(n[cut:cut + BATCH] * occ)], ["one", "two", "key", "chash", "at", "n"])
    return find


def _windows(scheme: Scheme):
    """The asked windows of a segment with their content, in batches of bounded size."""
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0

        def packed() -> pa.RecordBatch:
            key, chash, content, occ = zip(*rows)
            return pa.RecordBatch.from_arrays(
                [pa.array(key, pa.int64()), pa.array(chash, pa.int64()), pa.array(content, pa.binary()),
                 pa.array(occ, pa.int64())], ["key", "chash", "content", "occ"])

        for batch in batches:
            for r in range(batch.num_rows):
                body = batch.column("content")[r].as_py()
                units = body.split(b" ") if scheme.by_word else body
                for asked in batch.column("asked")[r]:
                    w = asked.as_py()
                    piece = units[w["at"]:w["at"] + scheme.window]
                    rows.append((w["one"], w["two"], b" ".join(piece) if scheme.by_word else piece, w["n"]))
                    size += len(rows[-1][2])
                    if size > BATCH_BYTES:
                        yield packed()
                        rows, size = [], 0
        if rows:
            yield packed()
    return find


def _flags(scheme: Scheme):
    """Flags of the windows of a segment whose hashes are among the repeated ones."""
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flags = []
            for r in range(batch.num_rows):
                one, _ = scheme.hashes(batch.column("content")[r].as_py())
                again = batch.column("again")[r].values.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                flags.append(np.packbits(np.isin(one, again), bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("chash"), pa.array(flags, pa.binary())],
                                             ["key", "chash", "flags"])
    return find


def _shard(index: Index):
    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by key; whole keys are gathered up to the bound and indexed."""
        held: list[pa.RecordBatch] = []
        size = 0

        def flush(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(rows).combine_chunks()
            data, offsets = T.layout(table["content"])
            found = index(data, offsets, table["occ"].to_numpy())
            some = [i for i, f in enumerate(found) if f.any()]
            flags = [np.packbits(found[i], bitorder="little").tobytes() for i in some]
            take = pa.array(some, pa.int64())
            return pa.RecordBatch.from_arrays(
                [pa.chunked_array(table[c].take(take).chunks, table[c].type).combine_chunks()
                 for c in ("key", "chash")] + [pa.array(flags, pa.binary())], ["key", "chash", "flags"])

        for batch in batches:
            key = batch.column("key").to_numpy()
            ends = np.append(np.flatnonzero(key[1:] != key[:-1]) + 1, len(key))
            lengths = np.cumsum(np.diff(T.layout(batch.column("content"))[1]))
            at = 0
            for end in ends.tolist():
                same = held and at == 0 and held[-1].column("key")[-1].as_py() == int(key[0])
                if size >= INDEX_BYTES and not same:
                    yield flush(held)
                    held, size = [], 0
                held.append(batch.slice(at, end - at))
                size += int(lengths[end - 1] - (lengths[at - 1] if at else 0))
                at = end
        if held:
            yield flush(held)
    return shard


def repeats(docs: DataFrame, scheme: Scheme, index: Index) -> tuple[DataFrame, DataFrame]:
    """(hits, bodies): flags of repeated windows per document, and the texts concerned.

    hits has doc_id, uid and spans, an array of (first window, flags); bodies has the bytes of
    every text that holds a segment of a recurring key.
    """
    source = identified(docs)
    rows = arrow(source, _keys(scheme, PIECE_BYTES), "key bigint, uid bigint, places bigint")
    recurring = rows.groupBy("key").agg(F.sum("places").alias("n")).where("n >= 2").select("key")
    wanted = (rows.select("key", "uid").join(recurring, "key")
              .groupBy(F.col("uid").alias("of")).agg(F.collect_set("key").alias("keys")))
    chosen = source.join(wanted, F.col("uid") == F.col("of")).drop("of")
    cut = staged(arrow(chosen, _cut(scheme, PIECE_BYTES), CUT), "segments")
    segments = cut.where("key IS NOT NULL").withColumn("chash", F.xxhash64("content"))
    distinct = staged(segments.groupBy("key", "chash", "content").agg(F.count("*").alias("occ")), "distinct")
    flags = "key bigint, chash bigint, flags binary"

    def indexed(rows: DataFrame) -> DataFrame:
        return arrow(rows.repartition(F.col("key")).sortWithinPartitions("key"), _shard(index), flags)

    heavy = (distinct.groupBy("key").agg(F.sum(F.octet_length("content")).alias("size"))
             .where(F.col("size") > KEY_BYTES).select("key"))
    found = indexed(distinct.join(heavy, "key", "left_anti"))
    if heavy.limit(1).count():
        found = found.unionByName(_heavy(distinct.join(heavy, "key", "left_semi"), scheme, indexed))
    # rows alike in doc_id and text share their segments: once is enough
    spots = segments.select("key", "chash", "doc_id", "uid", "first").distinct()
    hits = (spots.join(found, ["key", "chash"])
            .groupBy("doc_id", "uid").agg(F.collect_list(F.struct("first", "flags")).alias("spans")))
    return hits, cut.where("key IS NULL").select("doc_id", "uid", "content").dropDuplicates(["doc_id", "uid"])


def _heavy(rows: DataFrame, scheme: Scheme, indexed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The same answer for keys of unbounded content, whose windows are dealt out singly.

    Windows meet by two 64-bit hashes; only where two meet, one of them is sent with its content,
    to be indexed like any other segment.
    """
    segments = staged(rows.select("key", "chash", "content", "occ"), "heavy")
    places = staged(arrow(segments, _places(scheme), PLACES), "places")
    met = places.groupBy("one", "two").agg(F.sum("n").alias("n"), F.min(F.struct("key", "chash", "at")).alias("of")).where("n > 1")
    asked = met.groupBy("of.key", "of.chash").agg(F.collect_list(F.struct("of.at", "one", "two", "n")).alias("asked"))
    pieces = arrow(segments.join(asked, ["key", "chash"]).select("content", "asked"), _windows(scheme),
                   "key bigint, chash bigint, content binary, occ bigint")
    good = indexed(pieces).select(F.col("key").alias("one"), F.col("chash").alias("two"))
    again = places.join(good, ["one", "two"]).groupBy("key", "chash").agg(F.collect_list("one").alias("again"))
    return arrow(segments.join(again, ["key", "chash"]).select("key", "chash", "content", "again"), _flags(scheme),
                 "key bigint, chash bigint, flags binary")


def covered_units(spans: list[dict], window: int, size: int) -> np.ndarray:
    """Units under any flagged window."""
    starts, ends = [], []
    for s in spans:      # runs of flagged windows, so that a long repetitive text takes little memory
        flags = np.unpackbits(np.frombuffer(s["flags"], np.uint8), bitorder="little").view(np.int8)
        edges = np.flatnonzero(np.diff(flags, prepend=0, append=0))
        starts.append(s["first"] + edges[::2])
        ends.append(s["first"] + edges[1::2] - 1 + window)
    if not sum(map(len, starts)):
        return np.zeros(size, dtype=bool)
    starts, ends = np.concatenate(starts), np.concatenate(ends)
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    out = np.zeros(size, dtype=bool)
    first = np.flatnonzero(np.append(True, starts[1:] > ends[:-1]))
    for a, b in zip(starts[first].tolist(), ends[np.append(first[1:], len(ends)) - 1].tolist()):
        out[a:b] = True
    return out


def sha(parts: bytes) -> str:
    return hashlib.sha256(parts).hexdigest()


def with_removals(docs: DataFrame, hits: DataFrame, bodies: DataFrame, whole, removed,
                  schema: str, removed_schema: str) -> DataFrame:
    """Every document by ``whole``, those with hits by ``removed``, in one frame."""
    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["uid"] == b["uid"])
    touched = bodies.alias("b").join(hits.alias("h"), F.col("b.doc_id").eqNullSafe(F.col("h.doc_id"))
                                     & (F.col("b.uid") == F.col("h.uid")))
    changed = arrow(touched.select("b.doc_id", "b.uid", "content", "spans"), removed, removed_schema)
    changed = changed.withColumnsRenamed({"doc_id": "_doc", "uid": "_uid"})
    all_ = arrow(identified(docs), whole, schema)
    return all_.join(changed, all_["doc_id"].eqNullSafe(changed["_doc"]) & (all_["uid"] == changed["_uid"]), "left")
