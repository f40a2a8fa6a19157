"""Language identification by averaged hashed subword embeddings and a linear softmax.

A text is the mean of the embeddings of its lower-cased byte n-grams; a linear layer and a
softmax follow. Both tables are learned together by stochastic gradient descent in numpy.
A temperature fitted on rows held out of the descent calibrates the scores, and the lowest score
that keeps the wanted precision there marks predictions to be rejected.

Learning uses rows with a language whose crc32(doc_id) mod 5 is not 0, about ``PER_LANGUAGE`` of
each by a hash; their texts are whole. Scoring sums one table of bucket logits over the n-grams.

Defined results: null texts and texts without a letter are ``und`` with score 0; without any row
to learn from every text is ``und``; a null doc_id is neither held out nor learned from.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from riskframe.llm import text as T
from riskframe.llm.features import grams
from riskframe.llm.stage import arrow

FOLDS = 5
PER_LANGUAGE = 250
BUCKETS, WIDTH = 1 << 15, 16
GRAMS = (2, 4)
EPOCHS, RATE = 6, 0.5
PRECISION = 0.99
UNKNOWN = "und"


@dataclass
class Model:
    languages: list[str]
    logits: np.ndarray       # (BUCKETS, languages): embedding times softmax weights
    bias: np.ndarray
    temperature: float
    least: float             # scores below are rejected

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        rows = len(offsets) - 1
        total, count = np.zeros((rows, len(self.languages))), np.zeros(rows)
        for bucket, counts in grams(data, offsets, GRAMS, BUCKETS):
            ends = np.cumsum(counts)
            for c in range(len(self.languages)):
                sums = np.append(0.0, np.cumsum(self.logits[:, c][bucket], dtype=np.float64))
                total[:, c] += sums[ends] - sums[ends - counts]
            count += counts
        return softmax((total / np.maximum(count, 1)[:, None] + self.bias) / self.temperature)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, n, data, offsets in T.chunks(batch.column("text"), 1 << 20):
            found = list(grams(T.LOWER[data], offsets, GRAMS, BUCKETS))
            keys, shares = [], []
            for i in range(n):
                own = np.concatenate([b[(e := int(c[:i + 1].sum())) - c[i]:e] for b, c in found])
                key, times = np.unique(own, return_counts=True)
                keys.append(key.astype(np.int32))
                shares.append((times / max(1, len(own))).astype(np.float32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("lang").slice(row, n), pa.array(keys, pa.list_(pa.int32())),
                 pa.array(shares, pa.list_(pa.float32())), batch.column("h").slice(row, n)],
                ["lang", "keys", "shares", "h"])


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0, F.lit(False))


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model | None:
    usable = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~held_out())
    counts = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}   # one row per language
    if not counts:
        return None
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, per_language / n)])
    h = F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1 << 30))
    sample = usable.where(h / float(1 << 30) < share[F.col("lang")]).select("text", "lang", h.alias("h"))
    got = arrow(sample, vectors, "lang string, keys array<int>, shares array<float>, h bigint").toArrow()
    got = got.sort_by("h")      # the order of descent is the same in every run
    keys, shares = got["keys"].combine_chunks(), got["shares"].combine_chunks()
    cut = np.cumsum(keys.value_lengths().to_numpy())[:-1]
    return fit(got["lang"].to_pylist(), np.split(keys.flatten().to_numpy(), cut), np.split(shares.flatten().to_numpy(), cut))


def fit(langs: list[str], keys: list[np.ndarray], shares: list[np.ndarray]) -> Model | None:
    if not langs:
        return None
    names = sorted(set(langs))
    y = np.array([names.index(x) for x in langs])
    rng = np.random.default_rng(7)
    table = rng.normal(0, 0.1, (BUCKETS, WIDTH))
    weight, bias = np.zeros((WIDTH, len(names))), np.zeros(len(names))
    weight[:] = rng.normal(0, 0.1, weight.shape)
    fit_on = [i for i in range(len(y)) if i % 5 or len(y) < 20]
    held = [i for i in range(len(y)) if i % 5 == 0] if len(y) >= 20 else fit_on
    share = len(y) / (len(names) * np.bincount(y, minlength=len(names)))
    total = EPOCHS * len(fit_on)
    done = 0
    for _ in range(EPOCHS):
        for i in rng.permutation(fit_on):
            rate = RATE * (1 - done / total)
            done += 1
            if not len(keys[i]):
                continue
            mean = shares[i] @ table[keys[i]]
            error = softmax(mean @ weight + bias)
            error[y[i]] -= 1
            error *= rate * min(share[y[i]], 5.0)
            back = weight @ error
            weight -= np.outer(mean, error)
            bias -= 0.1 * error
            # a bucket's step follows its share of the text, scaled to the number of buckets
            table[keys[i]] -= np.outer(np.minimum(shares[i] * len(keys[i]), 4.0), back)
    logits = table @ weight
    raw = np.array([shares[i] @ logits[keys[i]] + bias if len(keys[i]) else bias for i in held])
    goal = y[held]
    # smoothed targets keep the scores of a faultless hold-out below 1
    soft = np.full(raw.shape, 1.0 / (len(goal) + 2) / len(names))
    soft[np.arange(len(goal)), goal] += 1 - soft.sum(axis=1)
    best = min(np.geomspace(0.05, 50, 80), key=lambda t: -(soft * np.log(softmax(raw / t) + 1e-300)).sum())
    p = softmax(raw / best)
    top, right = p.max(axis=1), p.argmax(axis=1) == goal
    order = np.argsort(-top)
    precise = np.cumsum(right[order]) / np.arange(1, len(order) + 1)
    good = np.flatnonzero(precise >= PRECISION)
    least = float(top[order][good[-1]]) if len(good) else 1.0
    return Model(names, np.ascontiguousarray(logits.astype(np.float32)), bias, float(best), min(least, 0.5 + 0.5 / len(names)))


def has_letter(body: bytes) -> bool:
    return any(c.isalpha() for c in body.decode())


_LETTER = np.zeros(256, dtype=bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True
PREDICTED = "doc_id bigint, held_out boolean, lang_pred string, score double, rejected boolean"


def _predict(shared):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model | None = shared.value
        for batch in batches:
            for row, n, data, offsets in T.chunks(batch.column("text")):
                letters = np.append(0, np.cumsum(_LETTER[data]))
                any_letter = letters[offsets[1:]] > letters[offsets[:-1]]
                for i in np.flatnonzero(~any_letter & (np.diff(offsets) > 0)).tolist():
                    any_letter[i] = has_letter(data[offsets[i]:offsets[i + 1]].tobytes())
                if model is None:
                    any_letter[:] = False
                p = model.scores(T.LOWER[data], offsets) if model is not None else np.zeros((n, 1))
                best, top = p.argmax(axis=1), np.where(any_letter, p.max(axis=1), 0.0)
                names = [model.languages[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), any_letter.tolist())]
                rejected = ~any_letter | (top < (model.least if model is not None else 1.0))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(row, n), batch.column("held_out").slice(row, n),
                     pa.array(names, pa.string()), pa.array(top, pa.float64()), pa.array(rejected)],
                    ["doc_id", "held_out", "lang_pred", "score", "rejected"])
    return predict


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """Language, calibrated score and whether to reject it, from the text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return arrow(docs.select("doc_id", held_out().alias("held_out"), "text"), _predict(shared), PREDICTED)


def op7(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, train(docs))


def is_held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % FOLDS == 0
