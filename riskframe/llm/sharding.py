"""Shards that each hold the whole mixture, by proportional stratified interleaving.

The rows of every source are shuffled by a seeded hash and ranked; a row's fractional rank is
(rank - 1 + u) / rows of the source, with one u in [0, 1) per source, so that small sources do
not all meet at one place. Any range of fractional ranks has each source in proportion, to within
one row; the rows sorted by them are cut into shards of equal row count. The law is ``rows``:
counts of shards differ by one at most.

Neither a source nor the table is ever ordered in one task. Ranks are counted in two levels:
cells of (source, range of the shuffle hash), then places inside a cell; the fractional ranks
likewise in ranges of their own. The number of cells follows the row count, so that a cell holds
about ``CELL`` rows at any size. Only built-in functions are used.

Defined results: a null text has no bytes (size 8) and the checksum of nothing, 0; a null source
is a source of its own; a null doc_id takes part like any other; rows alike in doc_id, text and
source lie in different slots, and which of them lies where makes no difference to these columns;
an empty table gives an empty one; columns of other names are carried along by ``interleaved``.
"""

from __future__ import annotations

from math import log2

from pyspark.sql import Column, DataFrame, Window, functions as F

from riskframe.llm.stage import fresh, staged

SHARDS, SEED = 24, 17
OVERHEAD = 8                 # bytes of a row besides its text
CELL, LEAST_BITS, MOST_BITS = 100_000, 10, 40
HASH_BITS = 60               # 15 hexadecimal digits


def shuffled(value: Column, seed: int) -> Column:
    """A whole number of 60 bits, the same in every engine that has MD5."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), value)), 1, 15), 16, 10).cast("bigint")


def bits(rows: int) -> int:
    """Bits of the hash that name a cell, so that even the rows of one source alone fill about CELL each."""
    return min(MOST_BITS, max(LEAST_BITS, round(log2(max(1, rows / CELL)))))


def interleaved(rows: DataFrame, shards: int = SHARDS, seed: int = SEED, source: str = "source",
                key: tuple[str, ...] = ("doc_id", "text")) -> DataFrame:
    """The rows with shard (0 to shards - 1) and slot (0 to the shard's rows - 1).

    ``key`` names the columns whose values decide the shuffle; pass narrow rows where the text
    itself need not travel. A column named shard or slot in the input is replaced.
    """
    rows = rows.select(*[c for c in rows.columns if c.lower() not in ("shard", "slot")])
    names = rows.columns
    h, who, cell, nth, n, ahead, part, frac, unit, place = fresh(
        rows, "h", "who", "cell", "nth", "n", "ahead", "part", "frac", "unit", "place")
    value = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("-")) for k in key])
    name = F.coalesce(F.concat(F.lit("+"), F.col(source).cast("string")), F.lit("-"))      # null is no string
    marked = staged(rows.select(*names, shuffled(value, seed).alias(h), name.alias(who)), "shuffled")
    total = marked.count()
    width = bits(total)
    marked = marked.withColumn(cell, F.shiftright(h, HASH_BITS - width))
    counts = _prefix(marked.groupBy(who, cell).agg(F.count("*").alias(n)), [who], cell, n, ahead, width)
    counts = counts.drop(n).join(marked.groupBy(who).agg(F.count("*").alias(n)), who)
    inside = Window.partitionBy(who, cell).orderBy(h, *key)
    ranked = marked.withColumn(nth, F.row_number().over(inside)).join(counts, [who, cell])
    ranked = ranked.withColumn(unit, shuffled(F.col(who), seed + 1).cast("double") / F.lit(float(1 << HASH_BITS)))
    rank = (F.col(ahead) + F.col(nth) - 1).cast("double") + F.col(unit)
    ranked = ranked.withColumn(frac, rank / F.col(n).cast("double"))
    ranked = staged(ranked.select(*names, who, unit, frac, F.floor(F.col(frac) * F.lit(float(1 << width))).alias(part)), "ranked")
    starts = _prefix(ranked.groupBy(part).agg(F.count("*").alias(n)), [], part, n, ahead, width)
    order = Window.partitionBy(part).orderBy(frac, unit, who)
    placed = ranked.withColumn(nth, F.row_number().over(order)).join(starts, part).select(
        *names, (F.col(ahead) + F.col(nth) - 1).alias(place))
    placed = placed.withColumn("shard", F.expr(f"cast((`{place}` * {shards}L) div {max(total, 1)}L as int)"))
    first = F.expr(f"(shard * {total}L + {shards - 1}L) div {shards}L")
    return placed.select(*names, "shard", (F.col(place) - first).alias("slot"))


def _prefix(counts: DataFrame, by: list[str], cell: str, n: str, ahead: str, width: int) -> DataFrame:
    """Adds the rows in earlier cells, in two levels: 2 ** (width / 2) rows are ordered at a time."""
    group, before = fresh(counts, "group", "before")
    counts = counts.withColumn(group, F.shiftright(cell, width // 2))
    earlier = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    sums = counts.groupBy(*by, group).agg(F.sum(n).alias(before))
    sums = sums.withColumn(before, F.coalesce(F.sum(before).over(earlier(*by).orderBy(group)), F.lit(0)))
    inner = F.coalesce(F.sum(n).over(earlier(*by, group).orderBy(cell)), F.lit(0))
    return counts.withColumn(ahead, inner).join(sums, [*by, group]).select(
        *by, cell, n, (F.col(ahead) + F.col(before)).alias(ahead))


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, text_crc32): what a shard has to know of a row, without its text."""
    return docs.select(
        "doc_id", "source", (F.coalesce(F.octet_length("text"), F.lit(0)) + OVERHEAD).cast("bigint").alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("bigint").alias("text_crc32"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED) -> None:
    """All columns as Parquet folders shard=0, 1, ..., the rows of each file in slot order."""
    placed = interleaved(docs, shards, seed)
    placed.repartition("shard", F.floor(F.col("slot") / CELL)).sortWithinPartitions("shard", "slot").write.option(
        "compression", "zstd").partitionBy("shard").parquet(path)


def op13(spark, sf_dir: str) -> DataFrame:
    rows = sized(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return interleaved(rows, key=("doc_id", "size", "text_crc32")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


#: The checksum is computed by its definition, four bits at a time, since the other engine has none.
SQL = r"""
WITH c AS (
  SELECT list_transform(range(16), lambda i: list_reduce([i::UBIGINT, 0, 0, 0, 0],
    lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END)) AS tab),
b AS (
  SELECT doc_id, source, regexp_extract_all(
    regexp_replace(hex(encode(coalesce(text, ''))), '(.)(.)', '\2\1', 'g'), '.') AS digits FROM documents),
d AS (
  SELECT doc_id, coalesce('+' || source, '-') AS who, (len(digits) // 2 + 8)::BIGINT AS size,
         xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(digits, lambda p: ('0x' || p)::UBIGINT)),
             lambda x, p: xor(x >> 4, tab[((xor(x, p) & 15) + 1)::BIGINT])), 4294967295::UBIGINT)::BIGINT AS text_crc32
  FROM b, c),
h AS (
  SELECT *, ('0x' || substr(md5('17|' || coalesce(doc_id::VARCHAR, '-') || '|' || size || '|' || text_crc32), 1, 15))::BIGINT AS h,
         ('0x' || substr(md5('18|' || who), 1, 15))::BIGINT::DOUBLE / 1152921504606846976::DOUBLE AS u FROM d),
f AS (
  SELECT *, ((row_number() OVER (PARTITION BY who ORDER BY h, doc_id NULLS FIRST, size, text_crc32) - 1)::DOUBLE + u)
            / (count(*) OVER (PARTITION BY who))::DOUBLE AS frac FROM h),
p AS (
  SELECT *, row_number() OVER (ORDER BY frac, u, who) - 1 AS place, count(*) OVER () AS n FROM f)
SELECT doc_id, size, text_crc32, 'rows' AS law, (place * 24 // n)::INTEGER AS shard,
       (place - ((place * 24 // n) * n + 23) // 24)::BIGINT AS slot, NULL::INTEGER AS grown_shard FROM p
"""
