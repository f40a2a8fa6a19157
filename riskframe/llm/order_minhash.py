"""Near-duplicate classes by Order MinHash and banded alignment.

A text is its lower-cased words. Each of ``SKETCHES`` hash functions takes the ``LEAST``
smallest occurrence-labelled five-word shingles and keeps them in text order; texts that
agree in one such sketch are candidates. A candidate pair is a link if the Jaccard
similarity of its shingle sets and its word edit similarity are both ``SIMILARITY`` or
more; the edit distance comes from an alignment in the band that this allows. Classes are
the components of the links.

Texts of equal words are one node before any comparison. Nodes of a bucket meet in blocks of
bounded size as narrow rows: class so far, size of the shingle set, and its parities (the number
of shingles in each of many hash classes, modulo 2). Parities that differ are a lower bound of
the symmetric difference of two sets, so most pairs below the threshold fall out without error
and without their texts. Of the pairs that are left between different classes, a block asks for
the alignment of a least spanning forest, closest pairs first. Rounds go on until no block has a
pair of different classes that is not aligned, so the classes are those of all candidate pairs,
while a group of copies costs about as many alignments as it has members.

Defined results: a null text is a class of its own; texts without words are one class if their
bytes are equal; texts under five words are linked only if equal; repeated rows share a class.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from riskframe.llm import text as T
from riskframe.llm.components import components
from riskframe.llm.stage import arrow, fresh, identified, staged

SHINGLE, SIMILARITY = 5, 0.8
SKETCHES, LEAST = 24, 5
#: Parity bits of a shingle set: the power of two at or above twice its size, within these bounds.
LEAST_BITS, MOST_BITS = 256, 8192
#: Members of a bucket in one block; of larger buckets, about the square root of this times their size.
BLOCK = 512
#: Rows gathered, pairs compared and pairs kept at a time, in whole blocks.
SLAB, PIECE, KEPT = 1 << 14, 1 << 19, 1 << 17

_U = np.uint64
_SEEDS = T.mix(np.arange(1, SKETCHES + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)) | _U(1)

LINKED = "a string, b string, linked boolean"
SKETCHED = "doc_id bigint, uid bigint, node string, bands array<bigint>, size int, parity binary"
ASKED = "bucket bigint, a string, b string"


def labelled(shingles: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes told apart by their occurrence within the document, and where each stands once."""
    mixed = shingles ^ T.mix(owner.astype(np.uint64) + _U(1))
    order = np.argsort(mixed)
    ordered = mixed[order]
    again = np.append(False, ordered[1:] == ordered[:-1])
    distinct = order[~again]
    if not again.any():
        return shingles, distinct
    run = np.cumsum(~again) - 1
    some = np.isin(run, run[again])          # only shingles that recur need an order by place
    place, run = order[some], run[some]
    by = np.lexsort((place, run))
    place, run = place[by], run[by]
    nth = np.arange(len(run)) - np.searchsorted(run, run)
    out = shingles.copy()
    out[place] = T.mix(shingles[place] + nth.astype(np.uint64) * _U(0xC2B2AE3D27D4EB4F))
    return out, distinct


def parities(shingles: np.ndarray, owner: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parity bytes of the rows' sets one after another, and where each row's begin."""
    bits = np.clip(1 << np.ceil(np.log2(2 * sizes)).astype(np.int64), LEAST_BITS, MOST_BITS)
    begin = np.append(0, np.cumsum(bits))
    place = begin[owner] + (T.mix(shingles * _U(0xBF58476D1CE4E5B9)) & (bits[owner] - 1).astype(np.uint64)).astype(np.int64)
    odd = np.bincount(place, minlength=begin[-1]) & 1
    return np.packbits(odd.astype(bool), bitorder="little"), begin // 8


def sketches(codes: np.ndarray, first: np.ndarray):
    """Rows with enough words, their sketch hashes (rows, SKETCHES), set sizes, parities and their places."""
    sizes = np.diff(first) - SHINGLE + 1
    rows = np.flatnonzero(sizes > 0)
    if not len(rows):
        return rows, np.zeros((0, SKETCHES), np.int64), sizes[rows], np.zeros(0, np.uint8), np.zeros(1, np.int64)
    sizes = sizes[rows]
    at = T.ranges(first[rows], sizes)
    owner = np.repeat(np.arange(len(rows)), sizes)
    shingles = T.Rolling(codes).all(SHINGLE)[at]
    label, distinct = labelled(shingles, owner)
    owners = owner[distinct]
    counts = np.bincount(owners, minlength=len(rows))
    parity = parities(shingles[distinct], owners, counts)
    head = np.cumsum(sizes) - sizes
    out = np.zeros((len(rows), SKETCHES), dtype=np.int64)
    top = ~_U(0)
    for i, seed in enumerate(_SEEDS):
        value = label * seed
        places = np.full((len(rows), LEAST), np.iinfo(np.int64).max)
        for k in range(LEAST):
            low = np.minimum.reduceat(value, head)
            hit = np.flatnonzero(value == np.repeat(low, sizes))
            who, once = np.unique(owner[hit], return_index=True)
            hit = hit[once]
            hit = hit[value[hit] != top]
            places[owner[hit], k] = hit
            value[hit] = top
        places.sort(axis=1)
        there = places < len(label)
        chosen = np.where(there, label[np.minimum(places, len(label) - 1)], _U(0))
        code = np.full(len(rows), i + 1, dtype=np.uint64)
        for k in range(LEAST):
            code = T.mix(code * _U(0xA24BAED4963EE407) + chosen[:, k])
        out[:, i] = code.view(np.int64)
    return rows, out, counts, *parity


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        absent = batch.column("text").is_null().to_numpy(zero_copy_only=False)
        for row, n, data, offsets in T.chunks(batch.column("text")):
            folded = T.LOWER[data]
            starts, ends, first = T.words(folded, offsets, T.PLAIN)
            codes = T.word_codes(folded, starts, ends)
            one = T.Rolling(codes).of(first[:-1], first[1:])
            two = T.Rolling(T.mix(codes)).of(first[:-1], first[1:])
            names = [f"{a:016x}{b:016x}" for a, b in zip(one.tolist(), two.tolist())]
            uid = batch.column("uid").slice(row, n)
            for i in np.flatnonzero((np.diff(first) == 0) | absent[row:row + n]).tolist():
                body = data[offsets[i]:offsets[i + 1]].tobytes()
                names[i] = (f"null-{uid[i].as_py()}" if absent[row + i]
                            else f"raw-{hashlib.sha256(body).hexdigest()}")
            some, found, sizes, parity, places = sketches(codes, first)
            bounds = np.zeros(n + 1, dtype=np.int32)
            bounds[some + 1] = SKETCHES
            bands = pa.ListArray.from_arrays(pa.array(np.cumsum(bounds, dtype=np.int32)), pa.array(found.ravel()))
            size, length = np.zeros(n, np.int32), np.zeros(n, np.int64)
            size[some], length[some] = sizes, np.diff(places)
            packed = pa.Array.from_buffers(pa.binary(), n, [
                None, pa.py_buffer(np.append(0, np.cumsum(length)).astype(np.int32)), pa.py_buffer(parity)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(row, n), uid, pa.array(names, pa.string()), bands, pa.array(size), packed],
                ["doc_id", "uid", "node", "bands", "size", "parity"])


def edit_distance(a: np.ndarray, b: np.ndarray, limit: int) -> int | None:
    """Word edit distance if it is at most limit, by furthest-reaching places in the band.

    Only diagonals within the limit are kept; equal stretches are found by halving on
    rolling hashes, for all diagonals of a step at once.
    """
    n, m = len(a), len(b)
    if abs(n - m) > limit:
        return None
    one, two = T.Rolling(a), T.Rolling(b)

    def slide(i: np.ndarray, k: np.ndarray) -> np.ndarray:
        j = i + k
        room = np.minimum(n - i, m - j)
        low, high = np.zeros(len(i), np.int64), np.maximum(room, 0)
        while (low < high).any():
            mid = (low + high + 1) // 2
            same = one.of(i, i + mid) == two.of(j, j + mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return i + low

    goal = m - n
    reach = slide(np.array([0]), np.array([0]))
    if goal == 0 and reach[0] == n:
        return 0
    for d in range(1, limit + 1):
        k = np.arange(-d, d + 1)
        gone = np.full(2, -2)
        wide = np.concatenate([gone, reach, gone])
        # from the diagonal itself (replace), the one above (drop a word of a), the one below (of b)
        step = np.maximum(np.maximum(wide[1:-1] + 1, wide[2:] + 1), wide[:-2])
        step = np.minimum(step, np.minimum(n, m - k))
        fine = (step >= 0) & (step + k >= 0)
        reach = np.where(fine, step, -2)
        reach[fine] = slide(step[fine], k[fine])
        if abs(goal) <= d and reach[goal + d] >= n:
            return d
    return None


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Both similarities at the threshold or more, for word codes of two texts."""
    if min(len(a), len(b)) < SHINGLE:
        return len(a) == len(b) and bool((a == b).all())
    x, y = np.unique(T.Rolling(a).all(SHINGLE)), np.unique(T.Rolling(b).all(SHINGLE))
    both = len(np.intersect1d(x, y, assume_unique=True))
    if both < SIMILARITY * (len(x) + len(y) - both) - 1e-9:
        return False
    limit = int((1 - SIMILARITY) * max(len(a), len(b)) + 1e-9)
    return edit_distance(a, b, limit) is not None


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def codes(column):
        for _, n, data, offsets in T.chunks(column):
            folded = T.LOWER[data]
            starts, ends, first = T.words(folded, offsets, T.PLAIN)
            found = T.word_codes(folded, starts, ends)
            for i in range(n):
                yield found[first[i]:first[i + 1]]

    for batch in batches:
        linked = [similar(a, b) for a, b in zip(codes(batch.column("text_a")), codes(batch.column("text_b")))]
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_())],
                                         ["a", "b", "linked"])


def checked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs with the alignment's decision; a member's texts join where the pair is."""
    one = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    two = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    return arrow(pairs.join(one, "a").join(two, "b"), _verify, LINKED)


def folded(data: np.ndarray, offsets: np.ndarray, words: int) -> np.ndarray:
    """Parities of rows that have at least so many 64-bit words, folded to that many (rows, words)."""
    out = np.zeros((len(offsets) - 1, words), dtype=np.uint64)
    lengths = np.diff(offsets) // (8 * words)
    for times in np.unique(lengths[lengths > 0]).tolist():
        rows = np.flatnonzero(lengths == times)
        at = T.ranges(offsets[rows] // 8, np.full(len(rows), times * words))
        parts = data.view(np.uint64)[at].reshape(len(rows), times, words)
        out[rows] = np.bitwise_xor.reduce(parts, axis=1)
    return out


class Forest:
    """Closest pairs between classes, block by block: what a least spanning forest needs, and if that is all.

    Pairs are offered in pieces; a forest of the whole lies within the forests of its pieces.
    """

    def __init__(self, root: np.ndarray, depth: int):
        self.root, self.depth = root, depth
        self.held: list[np.ndarray] = []
        self.size = 0
        self.more: set[int] = set()        # blocks with pairs that were left out

    def offer(self, block: np.ndarray, distance: np.ndarray, p: np.ndarray, q: np.ndarray) -> None:
        self.held.append(np.stack([block, distance, p, q]))
        self.size += len(p)
        if self.size > KEPT:
            self.reduce()

    def reduce(self) -> np.ndarray:
        rows = np.concatenate(self.held, axis=1) if self.held else np.zeros((4, 0), np.int64)
        rows = rows[:, np.lexsort((rows[3], rows[2], rows[1], rows[0]))]
        left = np.arange(rows.shape[1])
        keep = np.zeros(rows.shape[1], dtype=bool)
        for _ in range(self.depth):
            parent: dict[int, int] = {}
            last = -1
            for i, block, a, b in zip(left.tolist(), rows[0, left].tolist(), self.root[rows[2, left]].tolist(),
                                      self.root[rows[3, left]].tolist()):
                if block != last:
                    parent, last = {}, block
                while (up := parent.get(a, a)) != a:
                    parent[a] = a = parent.get(up, up)
                while (up := parent.get(b, b)) != b:
                    parent[b] = b = parent.get(up, up)
                if a != b:
                    parent[a] = b
                    keep[i] = True
            left = np.flatnonzero(~keep)
        self.more.update(np.unique(rows[0, ~keep]).tolist())
        self.held, self.size = [rows[:, keep]], int(keep.sum())
        return self.held[0]


def _asked(depth: int):
    """Pairs to align from rows in whole blocks, sorted by block; a bucket with more to come has a null pair."""
    def flush(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        bucket, i, j, side = (table[c].to_numpy() for c in ("bucket", "i", "j", "side"))
        new = np.append(True, (bucket[1:] != bucket[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]))
        block = np.cumsum(new) - 1
        names = pa.chunked_array([*table["node"].chunks, *table["other"].chunks]).combine_chunks().dictionary_encode()
        known, code = names.dictionary, names.indices.fill_null(-1).to_numpy()
        node, other = code[:len(bucket)].astype(np.int64), code[len(bucket):].astype(np.int64)
        # rows of pairs that were aligned before come first in their block
        gone = other >= 0
        done = np.minimum(node, other)[gone] * len(known) + np.maximum(node, other)[gone]
        mine = np.flatnonzero(~gone)
        block, side, node, cross = block[mine], side[mine], node[mine], (i != j)[mine]
        root = table["root"].take(pa.array(mine)).combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64)
        size = table["size"].to_numpy()[mine].astype(np.int64)
        data, offsets = T.layout(table["parity"].take(pa.array(mine)).combine_chunks())
        width = np.diff(offsets) // 8
        sheets: dict[int, np.ndarray] = {}
        place = np.arange(len(mine))
        end = np.searchsorted(block, block, side="right")
        second = np.searchsorted(2 * block + side, 2 * block + 1)
        start = np.where(cross, np.where(side == 0, second, end), place + 1)
        counts = end - start
        forest = Forest(root, depth)
        for a, b in T.slices(np.append(0, np.cumsum(counts)), PIECE):
            p = np.repeat(place[a:b], counts[a:b])
            q = T.ranges(start[a:b], counts[a:b])
            low, high = np.minimum(size[p], size[q]), np.maximum(size[p], size[q])
            fine = (root[p] != root[q]) & (node[p] != node[q]) & (low >= SIMILARITY * high - 1e-9)
            p, q = p[fine], q[fine]
            if len(done):
                seen = np.isin(np.minimum(node[p], node[q]) * len(known) + np.maximum(node[p], node[q]), done)
                p, q = p[~seen], q[~seen]
            most = (1 - SIMILARITY) / (1 + SIMILARITY) * (size[p] + size[q]) + 1e-6
            words = np.minimum(width[p], width[q])
            for w in np.unique(words).tolist():
                sheet = sheets[w] if w in sheets else sheets.setdefault(w, folded(data, offsets, w))
                some = np.flatnonzero(words == w)
                for cut in range(0, len(some), step := max(1, (1 << 22) // w)):
                    part = some[cut:cut + step]
                    apart = np.bitwise_count(sheet[p[part]] ^ sheet[q[part]]).sum(axis=1, dtype=np.int64)
                    near = apart <= most[part]
                    part = part[near]
                    forest.offer(block[p[part]], apart[near], p[part], q[part])
        _, _, p, q = forest.reduce()
        a, b = (known.take(pa.array(x)) for x in (node[p], node[q]))
        first = np.flatnonzero(new)
        open_ = np.unique(bucket[first[np.array(sorted(forest.more), dtype=np.int64)]])
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([bucket[mine][p], open_])), pa.concat_arrays([a, pa.nulls(len(open_), pa.string())]),
             pa.concat_arrays([b, pa.nulls(len(open_), pa.string())])], ["bucket", "a", "b"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows, last = 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("bucket", "i", "j")])
            begins = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist()]
            kept = 0                     # rows of this batch that were handed over before
            for at, end in zip(begins, [*begins[1:], batch.num_rows]):
                if (at or last != key[:, 0].tolist()) and rows + end - at > SLAB and rows:
                    held.append(batch.slice(kept, at - kept))
                    yield flush(pa.Table.from_batches(held))
                    held, rows, kept = [], 0, at
                rows += end - at
            held.append(batch.slice(kept))
            last = key[:, -1].tolist()
        if held:
            yield flush(pa.Table.from_batches(held))
    return find


def asked(members: DataFrame, nodes: DataFrame, aligned: DataFrame | None, depth: int) -> DataFrame:
    """(bucket, a, b): pairs to align next; a bucket that will ask again has one row without a pair.

    members: bucket, node, chunks, chunk; nodes: node, root, size, parity; aligned: a, b, pairs found
    to be no links.
    """
    spread = F.sequence(F.lit(0), F.col("chunks") - 1)
    rows = members.select("bucket", "node", "chunk", F.explode(spread).alias("with")).select(
        "bucket", "node", F.least("chunk", "with").cast("int").alias("i"), F.greatest("chunk", "with").cast("int").alias("j"),
        F.when(F.col("chunk") > F.col("with"), 1).otherwise(0).alias("side"))
    rows = rows.join(nodes, "node").select("bucket", "i", "j", "side", "node", F.lit(None).cast("string").alias("other"),
                                           "root", "size", "parity")
    if aligned is not None:
        one = members.select("bucket", F.col("node").alias("a"), F.col("chunk").alias("x"))
        two = members.select("bucket", F.col("node").alias("b"), F.col("chunk").alias("y"))
        rows = rows.unionByName(aligned.join(one, "a").join(two, ["bucket", "b"]).select(
            "bucket", F.least("x", "y").cast("int").alias("i"), F.greatest("x", "y").cast("int").alias("j"),
            F.lit(-1).alias("side"), F.col("a").alias("node"), F.col("b").alias("other"),
            F.lit(None).cast("string").alias("root"), F.lit(0).alias("size"), F.lit(None).cast("binary").alias("parity")))
    keys = ["bucket", "i", "j"]
    return arrow(rows.repartition(*keys).sortWithinPartitions(*keys, "side", "node"), _asked(depth), ASKED)


def linked_classes(members: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, root) of all linked nodes: components of every candidate pair that is a link.

    members: bucket, node, chunks, chunk. A round aligns one forest per block, the next ones more, so
    even blocks full of pairs just under the threshold take few rounds.
    """
    joined = aligned = None
    depth = 1
    while True:
        rooted = nodes.withColumn("root", F.col("node")) if joined is None else nodes.join(joined, "node", "left").withColumn(
            "root", F.coalesce("root", "node"))
        found = staged(asked(members, rooted, aligned, depth), "asked")
        pairs = found.where("a IS NOT NULL").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        now = staged(checked(pairs, texts), "aligned")
        links = now.where("linked").select("a", "b")
        if joined is not None:
            for end in ("a", "b"):
                links = links.join(joined.select(F.col("node").alias(end), F.col("root").alias("to")), end, "left").withColumn(
                    end, F.coalesce("to", end)).drop("to")
        new = staged(components(links), "joined")
        if joined is None:
            joined = new
        else:
            moved = joined.join(new.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left")
            joined = staged(moved.select("node", F.coalesce("to", "root").alias("root")).unionByName(
                new.join(joined, "node", "left_anti").select("node", "root")), "joined")
        # linked pairs are of one class from now on; only the others must not be asked for again
        apart = now.where("NOT linked").select("a", "b")
        aligned = apart if aligned is None else aligned.unionByName(apart)
        more = found.where("a IS NULL").select("bucket").distinct()
        members, depth = staged(members.join(more, "bucket", "left_semi"), "crowded"), depth * 4
        if not members.limit(1).count():
            return joined


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, uid, class_id, class_size, representative): class_id is the class's least doc_id.

    representative marks the rows of the class's least (doc_id, uid).
    """
    source = identified(docs)
    table = staged(arrow(source, _sketch, SKETCHED), "sketches")
    nodes = table.groupBy("node").agg(F.min(F.struct("doc_id", "uid")).alias("at"), F.first(
        F.struct("bands", "size", "parity")).alias("of")).select("node", "at", "of.*")
    rows = nodes.select("node", F.explode("bands").alias("bucket"))
    chunks = F.ceil(F.sqrt(F.col("n") / BLOCK)).cast("int")
    crowded = rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket", chunks.alias("chunks"))
    members = staged(rows.join(crowded, "bucket").withColumn(
        "chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")), "members")
    met = members.select("node").distinct()
    named = staged(nodes.join(met, "node", "left_semi").select(
        "node", "size", "parity", F.col("at.doc_id").alias("d"), F.col("at.uid").alias("u")), "nodes")
    texts = staged(source.join(named.select("node", "d", "u"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("uid") == F.col("u")))
                   .select("node", "text").dropDuplicates(["node"]), "texts")
    joined = linked_classes(members, named.select("node", "size", "parity"), texts)
    placed = table.select("doc_id", "uid", "node").join(joined, "node", "left").withColumn(
        "root", F.coalesce("root", "node"))
    heads = placed.groupBy("root").agg(F.min("doc_id").alias("class_id"),
                                       F.min(F.struct("doc_id", "uid")).alias("head"), F.count("*").alias("class_size"))
    return placed.join(heads, "root").select(
        "doc_id", "uid", "class_id", "class_size",
        F.struct("doc_id", "uid").eqNullSafe(F.col("head")).alias("representative"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """One document of each class, with the input's columns; rows alike in doc_id and text are one."""
    doc, uid, mine = fresh(docs, "doc", "uid", "mine")
    kept = (classes(docs).where("representative").select(F.col("doc_id").alias(doc), F.col("uid").alias(uid)).distinct())
    marked = docs.withColumn(mine, F.xxhash64("doc_id", "text"))
    same = F.col("doc_id").eqNullSafe(F.col(doc)) & (F.col(mine) == F.col(uid))
    out = marked.join(kept, same, "left_semi").withColumn(doc, F.coalesce(F.col("doc_id"), F.lit(0)))
    return out.dropDuplicates([doc, mine]).select(*docs.columns)


def op2(spark, sf_dir: str) -> DataFrame:
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "class_id", "class_size")


def reference(docs: list[tuple]) -> dict:
    """Classes by comparing all pairs, for tests: doc_id to class_id."""
    import re
    words = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
             for _, t in docs]
    grams = [{tuple(w[i:i + SHINGLE]) for i in range(len(w) - SHINGLE + 1)} or {tuple(w)} for w in words]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            last, row = row, [i + 1]
            for j, y in enumerate(b):
                row.append(min(last[j] + (x != y), last[j + 1] + 1, row[-1] + 1))
        return row[-1]

    for i in range(len(docs)):
        for j in range(i):
            if docs[i][1] is None or docs[j][1] is None:
                continue
            if not words[i] or not words[j]:
                linked = docs[i][1] == docs[j][1]
            elif words[i] == words[j]:
                linked = True
            else:
                both = len(grams[i] & grams[j])
                linked = (both >= SIMILARITY * (len(grams[i]) + len(grams[j]) - both) - 1e-9
                          and min(len(words[i]), len(words[j])) >= SHINGLE
                          and distance(words[i], words[j]) <= (1 - SIMILARITY) * max(len(words[i]), len(words[j])) + 1e-9)
            if linked:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least: dict = {}
    for i, (d, _) in enumerate(docs):
        least[find(i)] = min(d, least.get(find(i), d))
    return {d: least[find(i)] for i, (d, _) in enumerate(docs)}
