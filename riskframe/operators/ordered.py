"""Global order statistics without gathering the rows in one task."""

from __future__ import annotations

from math import log2

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from riskframe.session import cut_lineage


def running_totals(groups: DataFrame, value: str, *, measures: list[str],
                   bucket: Column, by: list[str] | None = None,
                   descending: bool = False) -> DataFrame:
    """Adds ``cum_<m>``, each measure's sum up to and including the value, and ``all_<m>``.

    ``groups`` holds one row per (by, value). ``bucket`` is monotone in the value;
    totals run inside each bucket in parallel, and only the bucket totals, one row
    per bucket, are ordered in one place.
    """
    by = by or []
    rows = groups.withColumn("_bucket", bucket)
    order = F.col(value).desc() if descending else F.col(value).asc()
    order_bucket = F.col("_bucket").desc() if descending else F.col("_bucket").asc()

    inside = (W.partitionBy(*by, "_bucket").orderBy(order)
              .rowsBetween(W.unboundedPreceding, W.currentRow))
    before = (W.partitionBy(*by).orderBy(order_bucket)
              .rowsBetween(W.unboundedPreceding, -1))
    everything = W.partitionBy(*by)
    totals = rows.groupBy(*by, "_bucket").agg(*[F.sum(m).alias(f"_t_{m}") for m in measures])
    offsets = totals.select(*by, "_bucket", *[
        F.coalesce(F.sum(f"_t_{m}").over(before), F.lit(0)).alias(f"_o_{m}") for m in measures],
        *[F.sum(f"_t_{m}").over(everything).alias(f"all_{m}") for m in measures])
    return (
        rows.withColumns({f"_c_{m}": F.sum(m).over(inside) for m in measures})
        .join(offsets, [*by, "_bucket"])
        .withColumns({f"cum_{m}": F.col(f"_c_{m}") + F.col(f"_o_{m}") for m in measures})
        .drop("_bucket", *[f"_c_{m}" for m in measures], *[f"_o_{m}" for m in measures]))


def global_row_number(df: DataFrame, order: list[str], partitions: int | None = None,
                      name: str = "row_number") -> DataFrame:
    """Numbers all rows from 1 in the given total order.

    Rows are range-partitioned on the whole order key, so a value shared by many
    rows is split between partitions as long as the key ends in something unique.
    The partition of each row is fixed by a checkpoint before the partition sizes
    (one row per partition) are added up.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    placed = cut_lineage(df.repartitionByRange(n, *order)
                         .withColumn("_part", F.spark_partition_id()))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    ahead = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(ahead), F.lit(0))
                           .alias("_offset"))
    local = F.row_number().over(W.partitionBy("_part").orderBy(*order))
    return (placed.withColumn(name, local)
            .join(F.broadcast(offsets), "_part")
            .withColumn(name, F.col(name) + F.col("_offset"))
            .drop("_part", "_offset"))


#: Rows that are ranked together, about, when rows are dealt by a hash of their key.
CELL_ROWS = 100_000


def hashed_rank(df: DataFrame, by: str, key: str, name: str = "rank") -> DataFrame:
    """Rank from 0 of every row within its ``by`` value, in the order of a hash of its key.

    Rows are counted per class and range of the hash, so a rank is the count of the ranges
    before plus a place inside the row's own range: no class is ordered in one task, and only
    the counts, one row per range, are added up. The hash is MD5, which other engines have too.
    Rows of equal class and key get ranks in no particular order; a null class is one class.
    """
    h, cell, n, ahead, place = (f"_{x}_{name}" for x in ("h", "cell", "n", "ahead", "place"))
    digits = F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit(""))), 1, 15)
    bits = min(40, max(6, round(log2(max(1, df.count() / CELL_ROWS)))))
    rows = df.withColumn(h, F.conv(digits, 16, 10).cast("bigint")).withColumn(cell, F.shiftright(h, 60 - bits))
    offsets = rows.groupBy(F.col(by).alias("_by"), F.col(cell).alias("_cell")).agg(F.count(F.lit(1)).alias(n))
    before = W.partitionBy("_by").orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)
    offsets = offsets.select("_by", "_cell", F.coalesce(F.sum(n).over(before), F.lit(0)).alias(ahead))
    inside = W.partitionBy(by, cell).orderBy(h, key)
    placed = rows.withColumn(place, F.row_number().over(inside) - 1)
    return (placed.join(offsets, F.col(by).eqNullSafe(F.col("_by")) & (F.col(cell) == F.col("_cell")))
            .withColumn(name, F.col(ahead) + F.col(place)).select(*df.columns, name))


def column_quantiles(rows: DataFrame, columns: list[str], probabilities: list[float],
                     accuracy: int = 10_000) -> DataFrame:
    """Exact linear-interpolated quantiles of many columns: (variable, probability, quantile).

    A mergeable sketch of each column gives splitters on both sides of the wanted place, by
    count and not by value, so an outlier or a dominant value moves nothing. Rows below the
    lower splitter are only counted; the values between the two, at most about
    ``4 / accuracy`` of the rows, are counted by value and ordered. Columns whose splitters
    missed the place are asked again with wider ones. Nulls are left out; a column without
    values gives no row. ``rows`` is read once per round: pass a stored table.
    """
    spark, parts, left, slack = rows.sparkSession, [], list(columns), 2.0 / accuracy
    while left:
        edges = [(max(0.0, p - slack), min(1.0, p + slack)) for p in probabilities]
        places = F.array(*[F.lit(x) for pair in edges for x in pair])
        found = rows.agg(*[F.percentile_approx(c, places, accuracy).alias(f"q{i}") for i, c in enumerate(left)],
                         *[F.count(c).alias(f"n{i}") for i, c in enumerate(left)]).first()
        totals = {c: found[f"n{i}"] for i, c in enumerate(left)}
        entries = []
        for i, c in enumerate(left):
            if not totals[c]:
                continue
            for j, p in enumerate(probabilities):
                low, high = (None if e in (0.0, 1.0) else v for e, v in zip(edges[j], found[f"q{i}"][2 * j:2 * j + 2]))
                value = F.col(c).cast("double")
                keep = value.isNotNull() & (F.lit(True) if high is None else value <= high)
                shown = value if low is None else F.when(value >= low, value)      # null stands for all below
                entries.append(F.when(keep, F.struct(
                    F.lit(c).alias("variable"), F.lit(float(p)).alias("probability"), F.lit(totals[c]).cast("bigint").alias("total"),
                    shown.alias("value"))))
        if not entries:
            break
        long = rows.select(F.explode(F.array_compact(F.array(*entries))).alias("e")).select("e.*")
        counts = long.groupBy("variable", "probability", "total", "value").agg(F.count(F.lit(1)).alias("n"))
        upto = (W.partitionBy("variable", "probability").orderBy(F.col("value").asc_nulls_first())
                .rowsBetween(W.unboundedPreceding, W.currentRow))
        position = F.col("probability") * (F.col("total") - 1)
        at = counts.withColumn("last", F.sum("n").over(upto)).withColumn("first", F.col("last") - F.col("n") + 1)
        picked = (at.where("value IS NOT NULL").withColumns({
            "low": F.when((F.floor(position) + 1).between(F.col("first"), F.col("last")), F.col("value")),
            "high": F.when((F.ceil(position) + 1).between(F.col("first"), F.col("last")), F.col("value")),
            "weight": position - F.floor(position)})
            .groupBy("variable", "probability").agg(F.max("low").alias("low"), F.max("high").alias("high"), F.max("weight").alias("weight"))
            .where("low IS NOT NULL AND high IS NOT NULL")
            .select("variable", "probability", (F.col("low") + (F.col("high") - F.col("low")) * F.col("weight")).alias("quantile")))
        got = picked.collect()                    # one row per column and probability
        done = {c for c in left if sum(r.variable == c for r in got) == len(probabilities)}
        parts += [tuple(r) for r in got if r.variable in done]
        left = [c for c in left if totals[c] and c not in done]
        slack *= 8
    return spark.createDataFrame(parts, "variable string, probability double, quantile double")


def exact_quantiles(long: DataFrame, probabilities: list[float], *, group: str = "variable",
                    value: str = "value", buckets: int = 1000,
                    counted: bool = False) -> DataFrame:
    """Linear-interpolated quantiles per group: (group, probability, quantile).

    Equal values are counted first; running counts then locate the two order
    statistics around each probability. No group's values meet in one task except
    as bucket totals. With ``counted`` the rows already carry their count ``n``.
    """
    present = long.where(F.col(value).isNotNull())
    counts = present.groupBy(group, value).agg(
        (F.sum("n") if counted else F.count(F.lit(1))).alias("n"))
    span = counts.groupBy(group).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"),
                                     F.sum("n").alias("_total"))
    width = F.when(F.col("_hi") > F.col("_lo"), F.col("_hi") - F.col("_lo")).otherwise(1.0)
    # One row per group: the groups are the columns of a table.
    spread = counts.join(F.broadcast(span), group)
    running = running_totals(
        spread, value, measures=["n"], by=[group],
        bucket=F.floor((F.col(value) - F.col("_lo")) / width * F.lit(float(buckets))))
    wanted = F.array(*[F.lit(float(p)) for p in probabilities])
    at = running.withColumn("probability", F.explode(wanted))
    position = F.col("probability") * (F.col("_total") - 1)
    low, high = F.floor(position) + 1, F.ceil(position) + 1
    first, last = F.col("cum_n") - F.col("n") + 1, F.col("cum_n")
    return (
        at.withColumns({
            "_low": F.when(low.between(first, last), F.col(value)),
            "_high": F.when(high.between(first, last), F.col(value)),
            "_weight": position - F.floor(position)})
        .where("_low IS NOT NULL OR _high IS NOT NULL")
        .groupBy(group, "probability")
        .agg(F.max("_low").alias("_low"), F.max("_high").alias("_high"),
             F.max("_weight").alias("_weight"))
        .select(group, "probability",
                (F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("_weight"))
                .alias("quantile")))


def most_frequent(long: DataFrame, *, group: str = "variable",
                  value: str = "value") -> DataFrame:
    """Most frequent value per group, the smallest on ties."""
    counts = (long.where(F.col(value).isNotNull()).groupBy(group, value)
              .agg(F.count(F.lit(1)).alias("n")))
    best = counts.groupBy(group).agg(F.max("n").alias("n"))
    return (counts.join(F.broadcast(best), [group, "n"])
            .groupBy(group).agg(F.min(value).alias("level")))
