"""Ranked lexical search: a document FP-tree for each run of documents, branch and bound per item.

Documents are restricted to the terms of the stated items, once, with their counts: these narrow
vectors are written to the shared folder and give the corpus counts. Then each task builds trees:
the terms of a vector stand in order of document frequency, most frequent first, and vectors in
the order of their paths, so that documents share the nodes of common prefixes; a node with few
documents is a leaf. Every node knows the largest count of each term and the smallest length norm
below it. As a score grows with the count and falls with the norm, these bound all documents of a
node from above. For each item the tree is searched depth first, best bound first, and a node is
left out if its bound cannot reach the item's worst kept score; leaves are scored exactly. The
kept documents of an item go on from tree to tree within a task, and tasks meet in a ranking per
item, of which Spark keeps the first ``TOP`` before it shuffles.

Items are a stated query set: they come to the executors in blocks of up to ``TERMS`` distinct
terms and ``REPEATS`` terms in all, and documents are searched once per block. Only a single item
beyond that is a block of its own.

Defined results: a null or empty text has no terms; an item with no terms, or none that the
documents have, gets no row; every row of the benchmark is an item, also if its item_id is
repeated or null; rows of documents that are alike take a rank each; a null doc_id comes after
all others of its score; columns of other names are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from riskframe.llm import text as T
from riskframe.llm.stage import arrow, staged

TOP = 20
#: Distinct terms, and terms in all, of the items that are searched at once.
TERMS, REPEATS = 1 << 20, 1 << 22
#: Documents of a tree, entries of their vectors, and documents of a leaf.
TREE_DOCS, TREE_ENTRIES, LEAF = 1 << 14, 1 << 20, 32
#: Levels of path nodes; what lies deeper is divided into leaves at once.
DEPTH = 40

VECTORS = "doc_id bigint, n bigint, terms binary, counts binary"
FOUND = "query int, doc_id bigint, score bigint"
LAST = np.iinfo(np.int64).max        # stands for a null doc_id


def term_codes(data: np.ndarray, offsets: np.ndarray):
    """Codes of the terms of each text, and the place of each text's first one."""
    folded = T.LOWER[data]
    starts, ends, first = T.words(folded, offsets, T.PLAIN)
    return T.word_codes(folded, starts, ends), first


@dataclass
class Items:
    """One block of items: their sorted distinct term codes, and per item the terms' places."""

    keys: list              # item_id of each query
    codes: np.ndarray
    terms: list[np.ndarray]
    times: list[np.ndarray]  # how often the item repeats each of them


def item_blocks(benchmark: DataFrame, most_terms: int, most_repeats: int) -> Iterator[Items]:
    """Items in blocks of bounded size; rows come to the driver one partition at a time."""
    held: list[tuple] = []
    seen: set[int] = set()
    size = 0

    def block() -> Items:
        codes = np.unique(np.concatenate([c for _, c, _ in held]))
        return Items([k for k, _, _ in held], codes, [np.searchsorted(codes, c) for _, c, _ in held],
                     [t for _, _, t in held])

    for row in benchmark.select("item_id", "text").where("text IS NOT NULL").toLocalIterator():
        data = np.frombuffer(row["text"].encode(), np.uint8)
        all_codes, _ = term_codes(data, np.array([0, len(data)]))
        codes, times = np.unique(all_codes, return_counts=True)
        if not len(codes):
            continue
        if held and (size + int(times.sum()) > most_repeats or len(seen) + len(codes) > most_terms):
            yield block()
            held, seen, size = [], set(), 0
        held.append((row["item_id"], codes, times.astype(np.int64)))
        seen.update(codes.tolist())
        size += int(times.sum())
    if held:
        yield block()


def _restricted(block):
    """Length and vector of every document: term places (ascending) and counts as bytes."""
    def restrict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = block.value
        for batch in batches:
            for row, rows, data, offsets in T.chunks(batch.column("text")):
                found, first = term_codes(data, offsets)
                at = np.minimum(np.searchsorted(codes, found), len(codes) - 1)
                known = np.flatnonzero(codes[at] == found)
                owner = np.searchsorted(first, known, side="right") - 1
                entry, counts = np.unique(owner * len(codes) + at[known], return_counts=True)
                cut = np.searchsorted(entry, np.arange(rows + 1) * len(codes))
                terms = (entry % len(codes)).astype("<i4")
                counts = counts.astype("<i4")
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(row, rows), pa.array(np.diff(first), pa.int64()),
                     _packed(terms, cut), _packed(counts, cut)], ["doc_id", "n", "terms", "counts"])
    return restrict


def _packed(values: np.ndarray, cut: np.ndarray) -> pa.Array:
    """A binary value per row from the array that holds all rows' values."""
    return pa.Array.from_buffers(pa.large_binary(), len(cut) - 1, [
        None, pa.py_buffer((cut * 4).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def _document_counts(size: int):
    """(term, df) of a task's vectors."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size, dtype=np.int64)
        for batch in batches:
            data, _ = T.layout(batch.column("terms"))
            df += np.bincount(data.view("<i4"), minlength=size)
        there = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int64()), pa.array(df[there], pa.int64())], ["term", "df"])
    return count


@dataclass
class Corpus:
    """Counts over all documents for one block of items."""

    documents: int
    length: int
    df: np.ndarray
    weight: np.ndarray

    def norms(self, n: np.ndarray) -> np.ndarray:
        return 75 + (25 * n * self.documents) // self.length


def corpus_counts(vectors: DataFrame, size: int) -> Corpus:
    total = vectors.agg(F.count_if(F.col("n") > 0).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("length")).first()
    df = np.zeros(size, dtype=np.int64)
    for row in arrow(vectors.select("terms"), _document_counts(size), "term bigint, df bigint").groupBy("term").agg(
            F.sum("df").alias("df")).toLocalIterator():
        df[row["term"]] = row["df"]
    weight = np.array([math.floor(1000 * math.log((2 * total["documents"] + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    return Corpus(total["documents"], total["length"], df, weight)


def gain(counts: np.ndarray, norms: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * counts) // (1000 * counts + 12 * norms)


class Tree:
    """FP-tree of the documents of one run, with the bounds of every node.

    Nodes are numbered from the root; a node covers the documents low to high of the path order
    and its children are the nodes child to child_end. Vectors are kept in path order.
    """

    def __init__(self, doc: np.ndarray, n: np.ndarray, norms: np.ndarray, cut: np.ndarray, rank: np.ndarray,
                 counts: np.ndarray, terms: int):
        # terms of a document by rank, most frequent first; documents by their paths
        owner = np.repeat(np.arange(len(doc)), np.diff(cut))
        order = np.argsort(owner * terms + rank)
        rank, counts = rank[order], counts[order]
        paths = rank.astype(">u4").tobytes()
        keys = [paths[4 * a:4 * b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]
        by = sorted(range(len(doc)), key=keys.__getitem__)
        self.doc, self.norms = doc[by], norms[by]
        sizes = np.diff(cut)[by]
        member = T.ranges(cut[:-1][by], sizes)
        self.rank, self.counts, self.terms = rank[member], counts[member], terms
        self.cut = np.append(0, np.cumsum(sizes))
        self.owner = np.repeat(np.arange(len(doc)), sizes)
        self._grow(self._shared([keys[i] for i in by]))
        self._bounds()

    @staticmethod
    def _shared(keys: list[bytes]) -> np.ndarray:
        """Terms that each path shares with the one before; -1 for the first."""
        out = np.full(len(keys), -1, dtype=np.int64)
        for i in range(1, len(keys)):
            a, b = keys[i - 1], keys[i]
            size = min(len(a), len(b))
            if a[:size] == b[:size]:
                out[i] = size // 4
                continue
            low, high = 0, size // 4
            while low < high:               # first place where they differ, by halving
                middle = (low + high) // 2
                if a[:4 * middle + 4] == b[:4 * middle + 4]:
                    low = middle + 1
                else:
                    high = middle
            out[i] = low
        return out

    def _grow(self, shared: np.ndarray) -> None:
        low, high, first, last, level = [0], [len(self.doc)], [0], [0], [0]
        at = 0
        while at < len(low):
            a, b = low[at], high[at]
            if b - a > LEAF:
                inner = shared[a + 1:b]
                branch = np.flatnonzero(inner == inner.min()) + a + 1 if level[at] < DEPTH else []
                cuts = self._grouped([a, *np.asarray(branch).tolist(), b])
                if len(cuts) == 2:           # one path, or too deep a one
                    cuts = [*range(a, b, LEAF), b]
                first[at], last[at] = len(low), len(low) + len(cuts) - 1
                low += cuts[:-1]
                high += cuts[1:]
                first += [0] * (len(cuts) - 1)
                last += [0] * (len(cuts) - 1)
                level += [level[at] + 1] * (len(cuts) - 1)
            at += 1
        self.low, self.high, self.child, self.child_end = map(np.array, (low, high, first, last))

    @staticmethod
    def _grouped(cuts: list[int]) -> list[int]:
        """Small neighbours among the children are one node, up to a leaf's size."""
        out = [cuts[0]]
        for i in range(1, len(cuts)):
            if i + 1 < len(cuts) and cuts[i + 1] - out[-1] <= LEAF:
                continue
            out.append(cuts[i])
        return out if len(out) > 1 else [cuts[0], cuts[-1]]

    def _bounds(self) -> None:
        """Largest counts by (term, node) and smallest norm and doc_id by node."""
        nodes = len(self.low)
        self.least_norm = np.full(nodes, LAST, dtype=np.int64)
        self.least_doc = np.full(nodes, LAST, dtype=np.int64)
        leaves = np.flatnonzero(self.child == self.child_end)
        leaves = leaves[np.argsort(self.low[leaves])]
        self.least_norm[leaves] = np.minimum.reduceat(self.norms, self.low[leaves])
        self.least_doc[leaves] = np.minimum.reduceat(self.doc, self.low[leaves])
        leaf = leaves[np.searchsorted(self.low[leaves], self.owner, side="right") - 1]
        key, most = self._most(leaf * self.terms + self.rank, self.counts)
        parent = np.full(nodes, -1, dtype=np.int64)
        depth = np.zeros(nodes, dtype=np.int64)
        for at in np.flatnonzero(self.child < self.child_end).tolist():
            parent[self.child[at]:self.child_end[at]] = at
            depth[self.child[at]:self.child_end[at]] = depth[at] + 1
        keys, values = [key], [most]
        held = {d: [] for d in range(int(depth.max()) + 1)}
        of = depth[key // self.terms]
        for d in np.unique(of).tolist():
            held[d].append((key[of == d], most[of == d]))
        for d in range(int(depth.max()), 0, -1):     # from the deepest level up
            mine = np.flatnonzero(depth == d)
            np.minimum.at(self.least_norm, parent[mine], self.least_norm[mine])
            np.minimum.at(self.least_doc, parent[mine], self.least_doc[mine])
            if not held[d]:
                continue
            key, most = (np.concatenate(x) for x in zip(*held[d]))
            key, most = self._most(parent[key // self.terms] * self.terms + key % self.terms, most)
            held[d - 1].append((key, most))
            keys.append(key)
            values.append(most)
        key, most = self._most(np.concatenate(keys), np.concatenate(values))
        node, term = key // self.terms, key % self.terms
        order = np.argsort(term, kind="stable")
        self.node, self.most = node[order], most[order]
        self.term_cut = np.searchsorted(term[order], np.arange(self.terms + 1))

    @staticmethod
    def _most(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(key):
            return key, value
        order = np.argsort(key, kind="stable")
        key, value = key[order], value[order]
        head = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        return key[head], np.maximum.reduceat(value, head)

    def search(self, ranks: np.ndarray, weights: np.ndarray, best: "Best", scale: np.ndarray) -> int:
        """Offer the documents that may be among the best; returns the leaves that were scored."""
        sizes = self.term_cut[ranks + 1] - self.term_cut[ranks]
        entry = T.ranges(self.term_cut[ranks], sizes)
        node = self.node[entry]
        bound = np.zeros(len(self.low), dtype=np.int64)
        np.add.at(bound, node, np.repeat(weights, sizes) * gain(self.most[entry], self.least_norm[node]))
        scale[ranks] = weights
        stack, scored = [0], 0
        while stack:
            at = stack.pop()
            if not best.open(int(bound[at]), int(self.least_doc[at])):
                continue
            a, b = int(self.child[at]), int(self.child_end[at])
            if a < b:
                stack += (a + np.argsort(bound[a:b], kind="stable")).tolist()     # best last, so taken first
                continue
            scored += 1
            low, high = int(self.low[at]), int(self.high[at])
            span = slice(int(self.cut[low]), int(self.cut[high]))
            factor = scale[self.rank[span]]
            hit = np.flatnonzero(factor)
            owner = self.owner[span][hit]
            score = np.zeros(high - low, dtype=np.int64)
            np.add.at(score, owner - low, factor[hit] * gain(self.counts[span][hit], self.norms[owner]))
            best.offer(score, self.doc[low:high])
        scale[ranks] = 0
        return scored


class Best:
    """The best documents of one item so far: highest score, then least doc_id."""

    def __init__(self, top: int):
        self.top = top
        self.score = np.zeros(0, np.int64)
        self.doc = np.zeros(0, np.int64)
        self.worst = (0, -1)

    def open(self, bound: int, doc: int) -> bool:
        """Whether a document with at most that score and at least that doc_id may get in."""
        score, last = self.worst
        return bound > score or (bound == score and score > 0 and doc < last)

    def offer(self, score: np.ndarray, doc: np.ndarray) -> None:
        good = score >= max(self.worst[0], 1)
        if not good.any():
            return
        score, doc = np.concatenate([self.score, score[good]]), np.concatenate([self.doc, doc[good]])
        order = np.lexsort((doc, -score))[:self.top]
        self.score, self.doc = score[order], doc[order]
        if len(order) == self.top:
            self.worst = (int(self.score[-1]), int(self.doc[-1]))


def _searcher(block, top: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, corpus = block.value
        place = np.empty(len(corpus.df), dtype=np.int64)      # rank of a term: most frequent first
        place[np.argsort(-corpus.df, kind="stable")] = np.arange(len(corpus.df))
        best = [Best(top) for _ in items.terms]
        scale = np.zeros(len(corpus.df), dtype=np.int64)
        queries = []
        for term, times in zip(items.terms, items.times):
            weight = corpus.weight[term] * times
            some = (weight > 0) & (corpus.df[term] > 0)
            queries.append((place[term[some]], weight[some]))

        def run(held: list[pa.RecordBatch]) -> None:
            table = pa.Table.from_batches(held).combine_chunks()
            data, offsets = T.layout(table["terms"])
            counts = T.layout(table["counts"])[0].view("<i4").astype(np.int64)
            doc = table["doc_id"].fill_null(LAST).to_numpy()
            n = table["n"].to_numpy()
            tree = Tree(doc, n, corpus.norms(n), offsets // 4, place[data.view("<i4")], counts, len(place))
            for (ranks, weights), mine in zip(queries, best):
                if len(ranks):
                    tree.search(ranks, weights, mine, scale)

        held, docs, entries = [], 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, TREE_DOCS // 8):
                part = batch.slice(at, TREE_DOCS // 8)
                held.append(part)
                docs += part.num_rows
                entries += int(T.layout(part.column("terms"))[1][-1]) // 4
                if docs >= TREE_DOCS or entries >= TREE_ENTRIES:
                    run(held)
                    held, docs, entries = [], 0, 0
        if docs:
            run(held)
        query = np.repeat(np.arange(len(best)), [len(b.doc) for b in best])
        doc = np.concatenate([b.doc for b in best])
        yield pa.RecordBatch.from_arrays(
            [pa.array(query, pa.int32()), pa.array(doc, pa.int64(), mask=doc == LAST),
             pa.array(np.concatenate([b.score for b in best]), pa.int64())], ["query", "doc_id", "score"])
    return find


def ranked(docs: DataFrame, benchmark: DataFrame, top: int = TOP, most_terms: int = TERMS,
           most_repeats: int = REPEATS) -> DataFrame:
    """(item_id, rank, doc_id, score): the best documents of each item, best first."""
    spark = docs.sparkSession
    kind = dict(benchmark.dtypes)["item_id"]
    out = None
    for items in item_blocks(benchmark, most_terms, most_repeats):
        codes = spark.sparkContext.broadcast(items.codes)
        vectors = staged(arrow(docs.select("doc_id", "text"), _restricted(codes), VECTORS), "vectors")
        corpus = corpus_counts(vectors, len(items.codes))
        if not corpus.length:
            continue
        block = spark.sparkContext.broadcast((items, corpus))
        found = arrow(vectors, _searcher(block, top), FOUND)
        order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        names = spark.createDataFrame(list(enumerate(items.keys)), f"query int, item_id {kind}")
        part = best.join(names, "query").select("item_id", "rank", "doc_id", "score")
        out = part if out is None else staged(out, "ranked").unionByName(staged(part, "ranked"))
    if out is None:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id bigint, score bigint")
    return out


def op12(spark, sf_dir: str) -> DataFrame:
    return ranked(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


SQL = r"""
WITH f AS (
  SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
q AS (
  SELECT item_id, row_number() OVER () AS item, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
z AS (SELECT item_id, item, term, count(*) AS times FROM q GROUP BY ALL),
s AS (SELECT count(*)::BIGINT AS n_docs, sum(len(words))::BIGINT AS l FROM f WHERE len(words) > 0),
v AS (
  SELECT doc_id, row, any_value(len(words)) AS n, term, count(*) AS tf
  FROM (SELECT doc_id, row, words, unnest(words) AS term FROM f) GROUP BY doc_id, row, term),
r AS (SELECT * FROM v WHERE term IN (SELECT term FROM z)),
w AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM r, s GROUP BY term, n_docs),
x AS (
  SELECT item_id, item, doc_id, row,
         sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // l))))::BIGINT AS score
  FROM z JOIN r USING (term) JOIN w USING (term), s GROUP BY ALL),
k AS (
  SELECT item_id, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS rank, doc_id, score
  FROM x WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM k WHERE rank <= 20
"""
