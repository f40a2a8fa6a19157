"""Mixing sources to target weights by systematic sampling.

Each source gets a target of words. A document's expected copies are its source's target over
the source's size; their prefix sums within the source, plus one offset per source, decide:
a document is taken once for each integer that its step crosses. Documents stand in order of
size classes, so that the words taken come near the target, and of a hash within a class.

The place of a document in its source is counted in two levels: cells of (source, size class,
hash slice) are counted with partial aggregates, and places are numbered inside a cell, so no
source is ever ordered in one task.

Defined results: a null or empty text has size 0 and takes no words; a source without words
has target 0; a null source is a source of its own and comes last; repeated rows each count;
columns of other names are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from riskframe.llm.stage import fresh, staged

WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2
WORD = r"[^\x20\x09-\x0D]+"


def hashed_unit(text: Column) -> Column:
    """A number from 0 to 1, the same in every run."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, uid, size, order columns) of every document, written once."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint")
    rows = docs.select("doc_id", "source", F.xxhash64("doc_id", "text").alias("uid"), size.alias("size"))
    bits = F.length(F.bin("size"))
    return staged(rows.select("*", bits.alias("bits"),
                              F.expr("shiftright(size, greatest(length(bin(size)) - 5, 0))").alias("top"),
                              F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("h")), "sizes")


def targets(rows: DataFrame, share: float = SHARE, most: int = MOST, weights: tuple = WEIGHTS) -> DataFrame:
    """(source, source_size, target): one row per source, by repeated resharing in closed form.

    Sources are taken in order of cap over weight; each is capped if its weighted share of
    what is left exceeds its cap. The windows hold one row per source.
    """
    every = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(w) for w in weights])
    table = (rows.groupBy("source").agg(F.sum("size").alias("source_size"))
             .withColumn("i", F.row_number().over(every))
             .withColumn("w", F.element_at(cycle, ((F.col("i") - 1) % len(weights) + 1).cast("int")).cast("double"))
             .withColumn("cap", F.col("source_size") * most))
    ratio = Window.orderBy(F.col("cap") / F.col("w"), "i")
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).partitionBy()
    before = F.coalesce(F.sum("cap").over(ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("w").over(ratio.rowsBetween(0, Window.unboundedFollowing))
    level = (share * F.sum("source_size").over(whole) - before) / rest
    table = table.withColumn("level", level).withColumn("capped", F.col("cap") <= F.col("w") * F.col("level"))
    open_level = F.max(F.when(~F.col("capped"), F.col("level"))).over(whole)
    return table.select("source", "source_size", F.when(F.col("capped"), F.col("cap").cast("double"))
                        .otherwise(F.col("w") * open_level).alias("target"))


def copies(rows: DataFrame, goal: DataFrame) -> DataFrame:
    """Documents with source_size, target and the copies that the mix takes."""
    slice_ = F.substring("h", 1, 2)
    cell = ["source", "bits", "top", "slice"]
    rows = rows.withColumn("slice", slice_)
    counts = rows.groupBy(*cell).agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("source").orderBy("bits", "top", "slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*cell, F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy(*cell).orderBy("h", "size", "uid")
    placed = rows.withColumn("nth", F.row_number().over(inside)).alias("r")
    same = F.col("r.source").eqNullSafe(F.col("o.source"))
    for c in cell[1:]:
        same = same & (F.col(f"r.{c}") == F.col(f"o.{c}"))
    joined = placed.join(offsets.alias("o"), same).select("r.*", "ahead").alias("d").join(
        goal.alias("g"), F.col("d.source").eqNullSafe(F.col("g.source")))
    place = (F.col("ahead") + F.col("nth")).cast("double")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    shift = hashed_unit(F.concat(F.coalesce(F.col("d.source"), F.lit("")), F.lit("#offset")))
    return joined.select("d.doc_id", "d.uid", "d.source", "size", "source_size", "target",
                         (F.floor(place * rate + shift) - F.floor((place - 1) * rate + shift)).cast("int").alias("copies"))


def mixed(docs: DataFrame, share: float = SHARE) -> DataFrame:
    """The mix itself: every taken document once per copy, with the input's columns."""
    rows = sized(docs)
    doc, uid, mine, times, alike, nth = fresh(docs, "doc", "uid", "mine", "times", "alike", "nth")
    taken = staged(copies(rows, targets(rows, share)).groupBy(F.col("doc_id").alias(doc), F.col("uid").alias(uid))
                   .agg(F.sum("copies").cast("int").alias(times), F.count("*").alias(alike))
                   .where(F.col(times) > 0), "copies")
    marked = docs.withColumn(mine, F.xxhash64("doc_id", "text"))
    once = marked.join(taken, F.col("doc_id").eqNullSafe(F.col(doc)) & (F.col(mine) == F.col(uid)))
    if taken.where(F.col(alike) > 1).limit(1).count():    # rows alike in doc_id and text share their copies
        several = once.where(F.col(alike) > 1).withColumn(doc, F.coalesce(F.col("doc_id"), F.lit(0))).dropDuplicates([doc, mine])
        once = once.where(F.col(alike) == 1).unionByName(several)
    return once.withColumn(nth, F.explode(F.sequence(F.lit(1), times))).select(*docs.columns)


def op6(spark, sf_dir: str) -> DataFrame:
    rows = sized(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return copies(rows, targets(rows)).select("doc_id", "size", "source_size", "target",
                                              (F.col("copies") * F.col("size")).alias("taken"))


SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         row_number() OVER (ORDER BY source NULLS LAST) AS i FROM d GROUP BY source),
w AS (
  SELECT *, [3, 1, 2][(i - 1) % 3 + 1]::DOUBLE AS w, 2 * source_size AS cap FROM s),
l AS (
  SELECT *, (1.5::DOUBLE * (SELECT sum(source_size) FROM s)
             - coalesce(sum(cap) OVER (ORDER BY cap / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY cap / w, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM w),
t AS (
  SELECT source, source_size,
         CASE WHEN cap <= w * lv THEN cap::DOUBLE
              ELSE w * (SELECT max(lv) FROM l WHERE NOT cap <= w * lv) END AS target FROM l),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         row_number() OVER (PARTITION BY d.source ORDER BY length(bin(size)), size >> greatest(length(bin(size)) - 5, 0), h, size)::DOUBLE AS k,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS r,
         ('0x' || substr(md5(coalesce(d.source, '') || '#offset'), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (floor(k * r + u) - floor((k - 1) * r + u))::BIGINT * size AS taken FROM p
"""
