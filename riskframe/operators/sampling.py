"""Stratified curation of files for prose writers, batching and random picks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from riskframe.functions.numeric import draw

# ---- fixed values -----------------------------------------------------------------
# Declared precedence: a file belongs to the first stratum that takes it.
STRATA: dict[str, str] = {
    "declined": "decision_result = 'declined'",
    "approved": "decision_result = 'approved'",
    "conditional": "decision_result = 'approved_with_conditions'",
    "deferred": "decision_result = 'deferred'",
    "override": "reasons LIKE '%OVERRIDE%'",
    "ficp": "ficp_flagged = 1",
    "precarious_contract": "contract_stability = 'precarious'",
    "above_hcsf_approved": "above_hcsf_threshold = 1 AND decision_result LIKE 'approved%'",
    "observed_default": "default_flag = 1",
    "consolidation": "loan_type = 'DEBT_CONSOLIDATION'",
}
BATCHES, PER_BATCH, SHUFFLE_SEED = 8, 25, 4242
# -----------------------------------------------------------------------------------

_SALTS = 64


def quota_for(batches: int, per_batch: int) -> int:
    return max(4, batches * per_batch // len(STRATA))


def stratum_counts(rows: DataFrame) -> DataFrame:
    """Files per stratum; one file may count in several."""
    names = F.array_compact(F.array(*[F.when(F.expr(p), n) for n, p in STRATA.items()]))
    return (rows.select(F.explode(names).alias("stratum")).groupBy("stratum")
            .agg(F.count(F.lit(1)).alias("applications")))


def _candidates(rows: DataFrame, cap: int) -> DataFrame:
    """The first ``cap`` files of every stratum in key order, as one row per file.

    A stratum may hold most of the rows, so it is first thinned inside random
    slices: the first ``cap`` of the whole are among the first ``cap`` of each
    slice. At most slices x cap rows per stratum reach the second ranking.
    """
    indices = F.array_compact(F.array(*[
        F.when(F.expr(p), i) for i, p in enumerate(STRATA.values())]))
    long = rows.select("application_id", F.explode(indices).alias("stratum")).withColumn(
        "_slice", F.pmod(F.xxhash64("application_id"), F.lit(_SALTS)))
    for keys in (["stratum", "_slice"], ["stratum"]):
        rank = F.row_number().over(W.partitionBy(*keys).orderBy("application_id"))
        long = long.withColumn("_rank", rank).where(F.col("_rank") <= cap).drop("_rank")
    return long.groupBy("application_id").agg(*[
        F.coalesce(F.max(F.when(F.col("stratum") == i, 1)), F.lit(0)).alias(f"in_{i}")
        for i in range(len(STRATA))])


def stratified_sample(rows: DataFrame, batches: int = BATCHES,
                      per_batch: int = PER_BATCH) -> DataFrame:
    """(application_id, stratum): up to a quota per stratum, no file twice.

    Candidates number at most 3 x quota per stratum, a size set by the caller, so
    ranking them in one place is bounded whatever the size of the dataset.
    """
    quota = quota_for(batches, per_batch)
    picked = _candidates(rows, quota * 3).withColumn("taken", F.lit(-1))
    upto = (W.orderBy("application_id")
            .rowsBetween(W.unboundedPreceding, W.currentRow))
    for i in range(len(STRATA)):
        free = F.when((F.col("taken") < 0) & (F.col(f"in_{i}") == 1), 1).otherwise(0)
        picked = picked.withColumn("_free", free)
        taken = (F.col("_free") == 1) & (F.sum("_free").over(upto) <= quota)
        picked = picked.withColumn("taken", F.when(taken, i).otherwise(F.col("taken")))
    names = F.array(*[F.lit(n) for n in STRATA])
    return picked.where("taken >= 0").select(
        "application_id", F.element_at(names, F.col("taken") + 1).alias("stratum"))


def batched(sample: DataFrame, per_batch: int = PER_BATCH, seed: int = SHUFFLE_SEED,
            batches: int | None = BATCHES) -> DataFrame:
    """Shuffles a bounded sample by a keyed draw and numbers its batches from 1.

    Without a number of batches every row of the sample is given out.
    """
    order = W.orderBy(draw(F.col("application_id"), seed), "application_id")
    position = F.row_number().over(order) - 1
    numbered = sample.withColumn("batch", (F.floor(position / per_batch) + 1).cast("int"))
    return numbered if batches is None else numbered.where(F.col("batch") <= batches)


def random_pick(rows: DataFrame, n: int, seed: int = 0,
                key: str = "application_reference") -> DataFrame:
    """Reproducible random rows: a distributed top-n over a seeded hash."""
    return rows.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def first_rows(rows: DataFrame, n: int, key: str = "application_id") -> DataFrame:
    return rows.orderBy(key).limit(n)
