"""Quality rules: counts of a text, and a hashed n-gram logistic regression beside them.

The model learns on labelled quality rows: hashed words, word pairs and character n-grams,
each kind averaged over the text, L2-regularised logistic regression by gradient steps in
numpy, and Platt calibration on rows held out of the fit. Scoring runs over Arrow batches;
a document is kept if no base rule fails and its calibrated probability of good quality is
``KEEP`` or more.

Training uses at most about ``ROWS`` labelled rows of each class, by a hash of the doc_id; texts
are whole, and everything else covers all documents.

Defined results: a null or empty text has no words and fails the base rules; without labelled rows
of both classes the model abstains and base rules alone decide; repeated rows get equal results.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from riskframe.llm import text as T
from riskframe.llm.features import grams, row_sums, sigmoid, word_grams
from riskframe.llm.stage import arrow

ROWS = 600
KEEP = 0.3
BUCKETS = 1 << 16
WORDS, CHARS = (1, 2), (4,)
KINDS = len(WORDS) + len(CHARS)
STEPS, RATE, DECAY = 100, 0.5, 1e-6
MIN_WORDS, MAX_REPEAT = 10, 20
SYMBOLS = b"#*$%&|<>"
#: Bytes of text that a worker counts and scores at a time; it holds about 120 bytes for each.
PART = 1 << 19

_SYMBOL = np.isin(np.arange(256), np.frombuffer(SYMBOLS, np.uint8))
_LEAD = (np.arange(256) & 0xC0) != 0x80     # every byte that begins a code point
_PER_WORD = 5


@dataclass
class Model:
    weights: np.ndarray      # (KINDS, BUCKETS)
    bias: float
    slope: float
    shift: float

    def probability(self, margins: np.ndarray) -> np.ndarray:
        return sigmoid(self.slope * margins + self.shift)


def _parts(data, offsets, starts, ends, first, buckets: int):
    codes = T.word_codes(data, starts, ends)
    yield from word_grams(codes, first, WORDS, buckets)
    yield from grams(data, offsets, CHARS, buckets)


def margins(model: Model, parts) -> np.ndarray:
    total = model.bias
    for weight, (bucket, counts) in zip(model.weights, parts):
        total = total + row_sums(weight[bucket], counts) / np.maximum(counts, 1)
    return total


def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Labelled texts as hashed counts: what the driver gets of a training row."""
    for batch in batches:
        for row, n, data, offsets in T.chunks(batch.column("text"), PART):
            starts, ends, first = T.words(data, offsets, T.SOLID)
            keys: list = [[] for _ in range(n)]
            values: list = [[] for _ in range(n)]
            for kind, (bucket, counts) in enumerate(_parts(data, offsets, starts, ends, first, BUCKETS)):
                stops = np.cumsum(counts)
                for i in range(n):
                    own, times = np.unique(bucket[stops[i] - counts[i]:stops[i]], return_counts=True)
                    keys[i].append((own + kind * BUCKETS).astype(np.int32))
                    values[i].append(times / max(1, counts[i]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("good").slice(row, n),
                 pa.array([np.concatenate(k) for k in keys], pa.list_(pa.int32())),
                 pa.array([np.concatenate(v).astype(np.float32) for v in values], pa.list_(pa.float32())),
                 batch.column("fold").slice(row, n)], ["good", "keys", "shares", "fold"])


def train(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> Model | None:
    """Fit on a bounded, hashed sample of labelled rows."""
    lab = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", F.col("quality").alias("good"))
    counts = {r["good"]: r["count"] for r in lab.groupBy("good").count().collect()}
    if not counts.get(0) or not counts.get(1):
        return None
    # a row is in the sample by its hash alone: as many rows as the bound in expectation
    unit = F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(1 << 30)) / float(1 << 30)
    share = F.when(F.col("good") == 0, rows / counts[0]).otherwise(rows / counts[1])
    chosen = F.broadcast(lab.where(unit < share))    # about 2 * rows narrow rows
    fold = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(5)).cast("int").alias("fold")
    sample = docs.select("doc_id", "text").join(chosen, "doc_id").select("text", "good", fold)
    got = arrow(sample, vectors, "good int, keys array<int>, shares array<float>, fold int").toArrow()
    if got.num_rows == 0:
        return None
    y = got["good"].to_numpy().astype(np.float64)
    keys = got["keys"].combine_chunks()
    shares = got["shares"].combine_chunks()
    sizes = np.diff(keys.offsets.to_numpy()).astype(np.int64)
    owner = np.repeat(np.arange(len(y)), sizes)
    return fit(keys.flatten().to_numpy(), shares.flatten().to_numpy().astype(np.float64), owner, y,
               got["fold"].to_numpy() == 0)


def fit(keys, shares, owner, y, held) -> Model | None:
    """Logistic regression by Adam steps on all rows; Platt scaling on the held rows."""
    n = len(y)
    if len(set(y[~held].tolist())) < 2:
        return None
    used, slot = np.unique(keys, return_inverse=True)
    scale = 1.0 / np.sqrt(np.maximum(np.bincount(slot, shares ** 2), 1e-12) / n + 1e-8)
    value = shares * scale[slot] / np.sqrt(len(used))
    weight, bias = np.zeros(len(used)), 0.0
    first, second = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    good = (~held) * np.where(y == 1, 0.5 / max(1, y[~held].sum()), 0.5 / max(1, (1 - y[~held]).sum()))
    for t in range(1, STEPS + 1):
        margin = bias + np.bincount(owner, value * weight[slot], minlength=n)
        error = (sigmoid(margin) - y) * good
        slope = np.append(np.bincount(slot, value * error[owner], minlength=len(used)) + DECAY * weight, error.sum())
        first = 0.9 * first + 0.1 * slope
        second = 0.99 * second + 0.01 * slope ** 2
        step = RATE * (first / (1 - 0.9 ** t)) / (np.sqrt(second / (1 - 0.99 ** t)) + 1e-9)
        weight, bias = weight - step[:-1], bias - step[-1]
    table = np.zeros(KINDS * BUCKETS)
    table[used] = weight * scale / np.sqrt(len(used))
    margin = bias + np.bincount(owner, value * weight[slot], minlength=n)
    fit_on = held if len(set(y[held].tolist())) == 2 else np.ones(n, bool)
    a, b = platt(margin[fit_on], y[fit_on])
    return Model(table.reshape(KINDS, BUCKETS).astype(np.float32), float(bias), a, b)


def platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the calibrated log-odds, by Newton steps on smoothed targets."""
    pos, neg = y.sum(), (1 - y).sum()
    goal = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    weight = np.where(y == 1, 0.5 / pos, 0.5 / neg)      # classes count alike
    x = np.stack([margin, np.ones(len(margin))], axis=1)
    theta = np.array([1.0, 0.0])
    for _ in range(50):
        p = sigmoid(x @ theta)
        slope = x.T @ (weight * (p - goal)) + 1e-4 * (theta - [1.0, 0.0])
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(2)
        theta = theta - np.linalg.solve(curve, slope)
    return float(max(theta[0], 0.0)), float(theta[1])


def repeated_words(codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Words in five-word windows that their text holds twice or more."""
    counts = np.maximum(np.diff(first) - _PER_WORD + 1, 0)
    at = T.ranges(first[:-1], counts)
    out = np.zeros(len(first) - 1, dtype=np.int64)
    if not len(at):
        return out
    owner = np.repeat(np.arange(len(counts)), counts)
    window = T.Rolling(codes).all(_PER_WORD)[at] ^ T.mix(owner.astype(np.uint64) + np.uint64(1))
    order = np.argsort(window)
    same = window[order][1:] == window[order][:-1]
    often = np.zeros(len(at), dtype=bool)
    often[order[1:][same]] = True
    often[order[:-1][same]] = True
    begin = at[often]
    under = T.covered(begin, begin + _PER_WORD, len(codes))
    total = np.append(0, np.cumsum(under))
    return total[first[1:]] - total[first[:-1]]


def repeated_lines(data: np.ndarray, offsets: np.ndarray, words_before: np.ndarray) -> np.ndarray:
    """Lines with a word that equal an earlier line of their text."""
    out = np.zeros(len(offsets) - 1, dtype=np.int64)
    if not len(data):
        return out
    breaks = np.flatnonzero(data == 0x0A)
    starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]))
    row = np.searchsorted(offsets, starts, side="right") - 1
    ends = np.append(starts[1:], len(data))
    inner = np.append(np.isin(starts[1:] - 1, breaks) , False)
    ends = ends - inner
    good = (starts < len(data)) & (ends > starts)
    starts, ends, row = starts[good], ends[good], np.minimum(row[good], len(out) - 1)
    solid = words_before[ends] > words_before[starts]
    starts, ends, row = starts[solid], ends[solid], row[solid]
    line = T.Rolling(T.BYTE_CODE[data]).of(starts, ends) ^ T.mix(row.astype(np.uint64) + np.uint64(1))
    order = np.argsort(line)
    again = order[1:][line[order][1:] == line[order][:-1]]   # all but one of each set of equal lines
    return np.bincount(row[again], minlength=len(out)).astype(np.int64)


SCORED = ("doc_id bigint, uid bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
          "n_repeat_words bigint, base_failed boolean, quality double, kept boolean")


def _scorer(shared, keep: float):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model | None = shared.value
        for batch in batches:
            for row, n, data, offsets in T.chunks(batch.column("text"), PART):
                starts, ends, first = T.words(data, offsets, T.SOLID)
                codes = T.word_codes(data, starts, ends)
                n_words = np.diff(first)
                solid = T.SOLID[data]
                lead = np.append(0, np.cumsum(solid & _LEAD[data]))
                solid = np.append(0, np.cumsum(solid))
                symbols = np.append(0, np.cumsum(_SYMBOL[data]))
                repeat = repeated_words(codes, first)
                failed = (n_words < MIN_WORDS) | (100 * repeat > MAX_REPEAT * n_words)
                if model is None:
                    p = np.ones(n)
                else:
                    p = model.probability(margins(model, _parts(data, offsets, starts, ends, first, BUCKETS)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(row, n), batch.column("uid").slice(row, n),
                     pa.array(n_words, pa.int64()), pa.array(lead[offsets[1:]] - lead[offsets[:-1]], pa.int64()),
                     pa.array(symbols[offsets[1:]] - symbols[offsets[:-1]], pa.int64()),
                     pa.array(repeated_lines(data, offsets, solid), pa.int64()), pa.array(repeat, pa.int64()),
                     pa.array(failed), pa.array(p, pa.float64()), pa.array(~failed & (p >= keep))],
                    ["doc_id", "uid", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                     "base_failed", "quality", "kept"])
    return score


def scored(docs: DataFrame, labels: DataFrame, keep: float = KEEP) -> DataFrame:
    """Counts, calibrated probability and verdict of every document."""
    from riskframe.llm.stage import identified
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    return arrow(identified(docs), _scorer(model, keep), SCORED)


def accepted(docs: DataFrame, labels: DataFrame, keep: float = KEEP) -> DataFrame:
    """The documents that are kept, with the input's columns; one pass, no shuffle."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    score = _scorer(model, keep)

    def keep_rows(batches):
        for batch in batches:
            # the scorer wants an identity; rows of a batch stay in order, so the mask is enough
            plain = pa.RecordBatch.from_arrays(
                [pa.nulls(batch.num_rows, pa.int64()), pa.nulls(batch.num_rows, pa.int64()), batch.column("text")],
                ["doc_id", "uid", "text"])
            mask = np.concatenate([np.zeros(0, bool)] + [b.column("kept").to_numpy(zero_copy_only=False)
                                                         for b in score(iter([plain]))])
            yield batch.filter(pa.array(mask))

    return arrow(docs, keep_rows, docs.schema)


def op4(spark, sf_dir: str) -> DataFrame:
    return scored(spark.read.parquet(f"{sf_dir}/documents.parquet"),
                  spark.read.parquet(f"{sf_dir}/labels.parquet")).drop("uid")


def reference(docs: list[tuple]) -> list[tuple]:
    """The base counts by brute force, for tests."""
    out = []
    for doc, body in docs:
        body = body or ""
        for c in "\t\n\v\f\r":
            flat = body.replace(c, " ") if c == "\t" else flat.replace(c, " ")
        w = [x for x in flat.split(" ") if x]
        seen, dup = set(), 0
        for line in body.split("\n"):
            if line.strip(" \t\n\v\f\r"):
                dup += line in seen
                seen.add(line)
        windows = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
        often, hit = Counter(windows), [False] * len(w)
        for i, x in enumerate(windows):
            if often[x] > 1:
                hit[i:i + 5] = [True] * 5
        out.append((doc, len(w), sum(map(len, w)), sum(body.count(chr(c)) for c in SYMBOLS), dup, sum(hit),
                    len(w) < MIN_WORDS or 100 * sum(hit) > MAX_REPEAT * len(w)))
    return out
