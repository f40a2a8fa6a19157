"""Audit of filters that overlap: who removes what, in every order, and who deserves the credit.

Each document gets one bit per filter that it fails. Documents are counted per part and bit
pattern, at most 32 patterns a part, and from there on only those counts are used. A coalition
of filters removes the documents that fail any of its members: that is the removal game. Its
Hart-Mas-Colell potential is computed recursively over the 32 coalitions,

    P(S) = (v(S) + sum of P(S without i) over i in S) / |S|,   P(none) = 0,

and a filter's Shapley value is P(all) - P(all without it). Differences of coalitions give what
each step of each order removes. The potential is kept in whole 1/120, so all of it is exact.

Defined results: a null text is an empty one; a null part is the empty string; a null doc_id is
neither smaller nor larger than another, so its text is never a copy, and it has no label; rows
alike are documents of their own, and as none has a smaller doc_id, none is a copy of the other;
a doc_id is good (toxic) if any row of labels says so; empty documents give no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from riskframe.llm.stage import arrow, staged

FILTERS = "ABCDE"
COALITIONS = 1 << len(FILTERS)
ORDERS = factorial(len(FILTERS))
WHITE = r"[\x20\x09-\x0D]+"

LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 50, 65, 5
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SYMBOLS = r"[#$%&*|]"

REPORT = ("part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, "
          "unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint")


def failures(text: Column) -> Column:
    """Bits of the filters A to D that look at one text alone."""
    words = F.array_remove(F.split(text, WHITE), "")
    n = F.size(words)
    capitals = F.length(text) - F.length(F.translate(text, CAPITALS, ""))
    fails = (n < LEAST_WORDS, 100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT * n,
             100 * capitals > MOST_CAPITALS * F.length(text), text.rlike(SYMBOLS))
    bits = F.lit(0)
    for i, failed in enumerate(fails):
        bits = bits + F.when(failed, 1 << i).otherwise(0)
    return bits


def patterns(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, pattern, n, good, toxic): documents by the bits of the filters they fail.

    The text itself never leaves its task: a narrow row with its hash is written once. A copy is
    found by the least doc_id of each hash, which partial aggregates give for a text of any number
    of copies; the join back is by doc_id, so a popular text is no hot key.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = staged(docs.select(
        "doc_id", F.coalesce(F.col("source"), F.lit("")).alias("part"), failures(text).alias("pattern"),
        F.unhex(F.sha2(text, 256)).alias("hash")), "failures")
    known, nameless = rows.where("doc_id IS NOT NULL"), rows.where("doc_id IS NULL")
    key = ["part", "pattern", "good", "toxic"]
    marks = labels.where("doc_id IS NOT NULL AND (quality = 1 OR toxic = 1)").groupBy(F.col("doc_id").alias("of")).agg(
        F.coalesce(F.max((F.col("quality") == 1).cast("int")), F.lit(0)).alias("good"),
        F.coalesce(F.max((F.col("toxic") == 1).cast("int")), F.lit(0)).alias("toxic"))
    first = known.groupBy("hash").agg(F.min("doc_id").alias("doc_id")).select(
        "doc_id", "hash", F.lit(0).alias("again"))
    counted = known.groupBy("doc_id", "hash", "part", "pattern").agg(F.count("*").alias("n"))
    marked = (counted.join(first, ["doc_id", "hash"], "left")
              .join(marks, F.col("doc_id") == F.col("of"), "left")
              .select("part", (F.col("pattern") + F.coalesce("again", F.lit(1)) * 16).alias("pattern"),
                      F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"), "n"))
    rest = nameless.groupBy("part", "pattern").agg(F.count("*").alias("n")).select(
        "part", "pattern", F.lit(0).alias("good"), F.lit(0).alias("toxic"), "n")
    return marked.select(*key, "n").unionByName(rest).groupBy("part", "pattern").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"),
        F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def removal_game(counts: np.ndarray) -> np.ndarray:
    """Documents that each coalition removes, from the counts of each pattern (last axis)."""
    coalition = np.arange(COALITIONS)
    meets = (coalition[:, None] & coalition[None, :]) != 0
    return counts @ meets.T.astype(np.int64)


def potential(game: np.ndarray) -> np.ndarray:
    """Hart-Mas-Colell potential of every coalition, in whole 1/120."""
    out = np.zeros_like(game)
    for coalition in range(1, COALITIONS):       # a coalition's subsets all have smaller numbers
        members = [i for i in range(len(FILTERS)) if coalition >> i & 1]
        before = sum(out[..., coalition ^ (1 << i)] for i in members)
        out[..., coalition] = (ORDERS * game[..., coalition] + before) // len(members)
    return out


def shapley(game: np.ndarray) -> np.ndarray:
    """Removals of each filter summed over all orders (last axis: filters)."""
    p = potential(game)
    every = COALITIONS - 1
    return np.stack([p[..., every] - p[..., every ^ (1 << i)] for i in range(len(FILTERS))], axis=-1)


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All orders and steps of a few parts at a time, from their arrays of 32 counts."""
    orders = list(permutations(range(len(FILTERS))))
    names = ["".join(FILTERS[i] for i in o) for o in orders]
    one = np.array(orders)                                            # (120, 5) filter of each step
    before = np.cumsum(1 << one, axis=1) - (1 << one)                 # coalition that came earlier
    after = before | (1 << one)
    for batch in batches:
        for row in range(batch.num_rows):
            part = batch.slice(row, 1)
            count, good, toxic = (np.array(part.column(c)[0].as_py(), dtype=np.int64) for c in ("n", "good", "toxic"))
            games = [removal_game(x) for x in (count, good, toxic)]
            removed, good_lost, toxic_lost = (g[after] - g[before] for g in games)
            fails = games[0][1 << one]
            columns = [count.sum() - games[0][after], removed, fails - removed, count[1 << one],
                       good_lost, toxic_lost, shapley(games[0])[one]]
            size = one.size
            yield pa.RecordBatch.from_arrays(
                [pa.array([part.column("part")[0].as_py()] * size, pa.string()),
                 pa.array(np.repeat(names, one.shape[1]).tolist(), pa.string()),
                 pa.array(np.tile(np.arange(1, one.shape[1] + 1), len(orders)), pa.int32()),
                 *[pa.array(c.ravel(), pa.int64()) for c in columns]],
                [c.split()[0] for c in REPORT.split(", ")])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step; see the columns in ``REPORT``."""
    table = patterns(docs, labels)
    slots = F.sequence(F.lit(0), F.lit(COALITIONS - 1))

    def array(name: str) -> Column:
        entries = F.map_from_entries(F.collect_list(F.struct("pattern", name)))    # 32 at most
        return F.transform(slots, lambda i: F.coalesce(F.try_element_at(entries, i), F.lit(0).cast("bigint"))).alias(name)

    return arrow(table.groupBy("part").agg(array("n"), array("good"), array("toxic")), _report, REPORT)


def op11(spark, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS body,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
l AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part,
         [len(words) < 50, 100 * len(list_distinct(words)) < 65 * len(words),
          100 * len(regexp_extract_all(body, '[A-Z]')) > 5 * length(body), regexp_matches(body, '[#$%&*|]'),
          coalesce(t.doc_id > min(t.doc_id) OVER (PARTITION BY body), false)] AS fails,
         coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
  FROM t LEFT JOIN l ON t.doc_id = l.doc_id),
c AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic
  FROM f GROUP BY part, fails),
x AS (SELECT unnest([1, 2, 3, 4, 5]) AS i),
o AS (
  SELECT [a.i, b.i, c.i, d.i, e.i] AS places
  FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (
  SELECT array_to_string(list_transform(places, lambda p: substr('ABCDE', p, 1)), '') AS filter_order,
         i AS step, places[i] AS own, places[1:i - 1] AS earlier
  FROM o, x),
r AS (
  SELECT part, filter_order, step, own,
         sum(n) FILTER (WHERE NOT fails[own] AND len(list_filter(earlier, lambda p: fails[p])) = 0)::BIGINT AS kept,
         sum(n) FILTER (WHERE fails[own] AND len(list_filter(earlier, lambda p: fails[p])) = 0)::BIGINT AS removed,
         sum(n) FILTER (WHERE fails[own] AND len(list_filter(earlier, lambda p: fails[p])) > 0)::BIGINT AS redundant,
         sum(n) FILTER (WHERE fails[own] AND len(list_filter(fails, lambda y: y)) = 1)::BIGINT AS unique_fails,
         sum(good) FILTER (WHERE fails[own] AND len(list_filter(earlier, lambda p: fails[p])) = 0)::BIGINT AS good_lost,
         sum(toxic) FILTER (WHERE fails[own] AND len(list_filter(earlier, lambda p: fails[p])) = 0)::BIGINT AS toxic_lost
  FROM c, s GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, coalesce(kept, 0) AS kept, coalesce(removed, 0) AS removed,
       coalesce(redundant, 0) AS redundant, coalesce(unique_fails, 0) AS unique_fails,
       coalesce(good_lost, 0) AS good_lost, coalesce(toxic_lost, 0) AS toxic_lost,
       (sum(coalesce(removed, 0)) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM r
"""
