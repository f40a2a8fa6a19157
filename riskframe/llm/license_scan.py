"""License scans: an exact set-similarity join of text blocks with license templates.

Blocks are lines, longer lines in pieces of ``BLOCK`` words with half overlap. A template is
contained in a block if the block holds at least ``CONTAINED`` of its distinct words. Template
words are ordered by their frequency in all documents, rarest first; a block can only reach the
threshold if it holds one of a template's first words (prefix filter), has words enough (length
filter) and enough of both are still to come behind the first common one (positional filter).
What passes is counted exactly. Base phrases are found beside it as consecutive words.

Defined results: a null or empty text has no words, no labels (empty strings) and score 0; repeated
rows get equal results; columns of other names are ignored. The score is the largest containment
found, and 1 with a base phrase.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from riskframe.llm import text as T
from riskframe.llm.stage import arrow

# Phrases and their labels.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"),
           ("mit license", "mit"))
# The labels that the method adds, each with a wording commonly used for it.
TEMPLATES = (
    ("gpl-3", "licensed under the GNU General Public License version 3"),
    ("gpl-2", "licensed under the GNU General Public License version 2"),
    ("lgpl", "licensed under the GNU Lesser General Public License"),
    ("agpl", "licensed under the GNU Affero General Public License"),
    ("apache-2", "licensed under the Apache License Version 2.0"),
    ("mit", "released under the MIT License"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("mpl-2", "subject to the terms of the Mozilla Public License v. 2.0"),
    ("cc-by-nc", "licensed under CC BY NC 4.0"),
    ("cc-by-sa", "licensed under CC BY SA 4.0"),
    ("cc-by-4", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("all-rights-reserved", "all rights reserved"),
)
CONTAINED = 0.8
BLOCK, STRIDE = 64, 32

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def fold(body: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), body)


def split(body: str) -> list[str]:
    return _WORD.findall(fold(body))


def need(size: int) -> int:
    return math.ceil(CONTAINED * size - 1e-9)


class Lexicon:
    """Words of templates and phrases with their hashes; symbols from 1 up."""

    def __init__(self, templates=TEMPLATES, phrases=PHRASES):
        self.templates = [(label, sorted(set(split(t)))) for label, t in templates]
        self.phrases = [(split(p), label) for p, label in phrases]
        names = sorted({w for _, ws in self.templates for w in ws} | {w for ws, _ in self.phrases for w in ws})
        data, offsets = T.layout(pa.array([n.encode() for n in names], pa.binary()))
        code = T.word_codes(data, offsets[:-1], offsets[1:])
        order = np.argsort(code)
        self.codes, self.names = code[order], [names[i] for i in order]
        self.symbol = {n: i + 1 for i, n in enumerate(self.names)}

    def symbols(self, data, starts, ends) -> np.ndarray:
        """Symbol of each word, 0 for a word of none; equal hashes are compared by bytes."""
        code = T.word_codes(data, starts, ends)
        if not len(code):
            return np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        found = np.where(self.codes[at] == code, at + 1, 0)
        sizes = np.array([len(n.encode()) for n in self.names])
        found[(found > 0) & (sizes[at] != ends - starts)] = 0
        return found


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = Lexicon()
    for batch in batches:
        total = np.zeros(len(known.names) + 1, dtype=np.int64)
        for _, _, data, offsets in T.chunks(batch.column("text")):
            data = T.LOWER[data]
            starts, ends, _ = T.words(data, offsets, T.PLAIN)
            total += np.bincount(known.symbols(data, starts, ends), minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array(known.names), pa.array(total[1:])], ["word", "n"])


def frequencies(docs: DataFrame) -> dict[str, int]:
    """How often each template word stands in all documents; one row per template word."""
    counts = arrow(docs.select("text"), _count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return {r["word"]: r["n"] for r in counts.collect()}


class Join:
    """Templates in global order with an index of their prefixes."""

    def __init__(self, known: Lexicon, counts: dict[str, int]):
        order = sorted(known.names, key=lambda w: (counts.get(w, 0), w))
        self.place = np.zeros(len(order) + 1, dtype=np.int64)      # symbol to place in the order
        for i, w in enumerate(order):
            self.place[known.symbol[w]] = i
        self.templates = [(label, sorted(self.place[known.symbol[w]] for w in ws)) for label, ws in known.templates]
        self.prefix: dict[int, list[tuple[int, int]]] = {}
        for t, (_, tokens) in enumerate(self.templates):
            for i, token in enumerate(tokens[:len(tokens) - need(len(tokens)) + 1]):
                self.prefix.setdefault(int(token), []).append((t, i))
        self.heads = np.array(sorted(self.prefix), dtype=np.int64)

    def match(self, tokens: list[int]) -> dict[int, float]:
        """Containment of every template that the block, given in order, reaches."""
        found: dict[int, float] = {}
        seen: set[int] = set()
        whole = set(tokens)
        for j, token in enumerate(tokens):
            for t, i in self.prefix.get(token, ()):
                if t in seen:
                    continue
                seen.add(t)          # the first common word decides the positional bound
                own = self.templates[t][1]
                least = need(len(own))
                if len(tokens) < least or min(len(own) - i, len(tokens) - j) < least:
                    continue
                common = sum(x in whole for x in own)
                if common >= least:
                    found[t] = common / len(own)
        return found


SCANNED = ("doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, "
           "labels string, score double, blocks array<struct<label:string,line:bigint,first_word:bigint,contained:double>>")


def _scan(counts: dict[str, int]):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Lexicon()
        join = Join(known, counts)
        for batch in batches:
            for row, n, data, offsets in T.chunks(batch.column("text")):
                lower = T.LOWER[data]
                starts, ends, first = T.words(lower, offsets, T.PLAIN)
                symbol = known.symbols(lower, starts, ends)
                doc = np.searchsorted(first, np.arange(len(starts)), side="right") - 1
                base: list[list] = [[] for _ in range(n)]
                for phrase, label in known.phrases:
                    hit = np.ones(max(0, len(symbol) - len(phrase) + 1), dtype=bool)
                    for j, w in enumerate(phrase):
                        hit &= symbol[j:j + len(hit)] == known.symbol[w]
                    at = np.flatnonzero(hit)
                    at = at[doc[at] == doc[at + len(phrase) - 1]]
                    for p, d in zip(at.tolist(), doc[at].tolist()):
                        base[d].append((p - int(first[d]), label))
                blocks = _blocks(data, offsets, starts, first, symbol, doc, join)
                rows = []
                for i in range(n):
                    places = [p for p, _ in base[i]]
                    own = sorted({x for _, x in base[i]})
                    more = sorted({*own, *(b["label"] for b in blocks.get(i, []))})
                    rows.append((int(first[i + 1] - first[i]), len(places), min(places, default=None),
                                 max(places, default=None), ",".join(own), ",".join(more),
                                 1.0 if places else max([b["contained"] for b in blocks.get(i, [])], default=0.0),
                                 blocks.get(i, [])))
                columns = list(zip(*rows))
                kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.float64(), pa.list_(pa.struct(
                    [("label", pa.string()), ("line", pa.int64()), ("first_word", pa.int64()), ("contained", pa.float64())]))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(row, n)] + [pa.array(c, k) for c, k in zip(columns, kinds)],
                    ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "blocks"])
    return scan


def _blocks(data, offsets, starts, first, symbol, doc, join: Join) -> dict[int, list[dict]]:
    """Matching blocks by document."""
    if not len(starts):
        return {}
    newline = np.append(0, np.cumsum(data == 0x0A))
    line = newline[starts] + doc            # lines of different documents differ
    fresh = np.append(True, line[1:] != line[:-1])
    begin = np.flatnonzero(fresh)
    of = np.cumsum(fresh) - 1
    at = np.arange(len(starts)) - begin[of]
    length = np.diff(np.append(begin, len(starts)))[of]
    some = np.flatnonzero(symbol > 0)
    piece = at[some] // STRIDE
    key, token = [], []
    for back in (0, 1):
        b = piece - back
        good = (b >= 0) & ((b == 0) | (b * STRIDE < length[some] - (BLOCK - STRIDE)))
        key.append(begin[of[some[good]]] + b[good] * STRIDE)   # the block's first word
        token.append(join.place[symbol[some[good]]])
    pair = np.unique(np.concatenate(key) * (len(join.place) + 1) + np.concatenate(token))
    key, token = pair // (len(join.place) + 1), pair % (len(join.place) + 1)
    hopeful = np.unique(key[np.isin(token, join.heads)])
    low, high = np.searchsorted(key, hopeful), np.searchsorted(key, hopeful, side="right")
    out: dict[int, list[dict]] = {}
    for k, a, b in zip(hopeful.tolist(), low.tolist(), high.tolist()):
        for t, contained in join.match(token[a:b].tolist()).items():
            d = int(doc[k])
            out.setdefault(d, []).append({"label": join.templates[t][0], "contained": contained,
                                          "line": int(newline[starts[k]] - newline[offsets[d]]), "first_word": k - int(first[d])})
    return out


def scan(docs: DataFrame) -> DataFrame:
    """Counts, labels and the matching blocks of every document; two passes, no shuffle of texts."""
    return arrow(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), _scan(frequencies(docs)), SCANNED)


def op3(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("blocks")


def _sql() -> str:
    template = [(i, label, w, need(len(ws)), len(ws)) for i, (label, ws) in enumerate(Lexicon().templates) for w in ws]
    values = ", ".join(f"({i}, '{label}', '{w}', {k}, {n})" for i, label, w, k, n in template)
    size = max(len(split(p)) for p, _ in PHRASES)
    phrases = ", ".join("(" + ", ".join([f"'{label}'", str(len(split(p)))] + [f"'{w}'" for w in split(p)]
                                         + ["''"] * (size - len(split(p)))) + ")" for p, label in PHRASES)
    same = " AND ".join(f"(p.n < {j + 1} OR p.w{j} = n.w{j})" for j in range(size))
    ahead = ", ".join(f"lead(w, {j}, '') OVER o AS w{j}" for j in range(size))
    return rf"""
WITH template(t, label, w, least, size) AS (VALUES {values}),
phrase(label, n, {', '.join(f'w{j}' for j in range(size))}) AS (VALUES {phrases}),
folded AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents),
line AS (
  SELECT doc_id, unnest(string_split(body, chr(10))) AS body, generate_subscripts(string_split(body, chr(10)), 1) AS line FROM folded),
listed AS (
  SELECT doc_id, line, regexp_extract_all(body, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM line),
word AS (
  SELECT doc_id, line, len(ws) AS length, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS pos FROM listed),
numbered AS (
  SELECT doc_id, row_number() OVER o - 1 AS place, {ahead} FROM word WINDOW o AS (PARTITION BY doc_id ORDER BY line, pos)),
base AS (SELECT n.doc_id, n.place, p.label FROM numbered n JOIN phrase p ON {same}),
base_doc AS (
  SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word,
         array_to_string(list_sort(list_distinct(list(label))), ',') AS base_labels FROM base GROUP BY doc_id),
piece AS (
  SELECT doc_id, line, length, w, pos // {STRIDE} AS b FROM word
  UNION ALL SELECT doc_id, line, length, w, pos // {STRIDE} - 1 FROM word),
block AS (
  SELECT DISTINCT doc_id, line, b, w FROM piece WHERE b >= 0 AND (b = 0 OR b * {STRIDE} < length - {BLOCK - STRIDE})),
hit AS (
  SELECT doc_id, label, count(*) / size::DOUBLE AS contained FROM block JOIN template USING (w)
  GROUP BY doc_id, line, b, t, label, least, size HAVING count(*) >= least),
label AS (SELECT doc_id, label FROM base UNION SELECT doc_id, label FROM hit),
labels AS (SELECT doc_id, array_to_string(list_sort(list(label)), ',') AS labels FROM label GROUP BY doc_id),
best AS (SELECT doc_id, max(contained) AS contained FROM hit GROUP BY doc_id),
total AS (SELECT doc_id, sum(len(ws))::BIGINT AS n_words FROM listed GROUP BY doc_id)
SELECT doc_id, n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
       coalesce(labels, '') AS labels,
       CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(contained, 0.0)::DOUBLE END AS score
FROM total LEFT JOIN base_doc USING (doc_id) LEFT JOIN labels USING (doc_id) LEFT JOIN best USING (doc_id)
"""


SQL = _sql()
