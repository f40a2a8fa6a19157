"""Group bias, whole-population target and reject-inference rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from riskframe.functions import credit
from riskframe.functions.numeric import round_to, scaled
from riskframe.operators import ordered

# ---- fixed values ---------------------------------------------------------------
NUMERIC_PROTECTED = ["age"]
CATEGORICAL_PROTECTED = ["sex", "nationality_zone", "marital_status"]
MINIMUM_GROUP = 30
# ---------------------------------------------------------------------------------


def approved() -> Column:
    return F.col("decision_result").isin(*credit.APPROVALS)


def population(rows: DataFrame) -> DataFrame:
    """Adds approved and target: observed outcome if approved, counterfactual if not."""
    return (rows.withColumn("approved", F.coalesce(approved(), F.lit(False)).cast("int"))
            .withColumn("target", F.when(F.col("approved") == 1, F.col("default_flag"))
                        .otherwise(F.col("counterfactual_default_flag")))
            .where(F.col("target").isNotNull()))


def population_rates(rows: DataFrame) -> DataFrame:
    """Files and default rate per split and approval."""
    return population(rows).groupBy("split", "approved").agg(
        F.count(F.lit(1)).alias("n"),
        round_to(F.sum("target") / F.count(F.lit(1)), 4).alias("default_rate"))


def fuzzy_rows(rows: DataFrame) -> DataFrame:
    """Augmented training rows with label and weight.

    Approved files keep their outcome; every other file appears as a default with
    weight pd and as a good payer with the remaining weight. Both copies come out
    of one pass over the rows.
    """
    share = F.col("pd")
    kept = F.array(F.struct(F.col("target").cast("int").alias("label"),
                            F.lit(1.0).alias("weight")))
    doubled = F.array(F.struct(F.lit(1).alias("label"), share.alias("weight")),
                      F.struct(F.lit(0).alias("label"), (1 - share).alias("weight")))
    copies = F.explode(F.when(F.col("approved") == 1, kept).otherwise(doubled))
    return rows.withColumn("_copy", copies).select("*", "_copy.label", "_copy.weight") \
        .drop("_copy")


def _by_value(rows: DataFrame) -> DataFrame:
    """One row per attribute value: count, PD sum in millionths, defaults."""
    def entry(name: str, text: Column, number: Column) -> Column:
        return F.struct(F.lit(name).alias("attribute"), text.alias("text"),
                        number.cast("double").alias("number"))

    nothing = F.lit(None)
    entries = F.array(
        *[entry(c, nothing.cast("string"), F.col(c)) for c in NUMERIC_PROTECTED],
        *[entry(c, F.col(c), nothing) for c in CATEGORICAL_PROTECTED])
    return (
        rows.select(F.explode(entries).alias("e"), scaled(F.col("pd"), 6).alias("micro"), "y")
        .groupBy("e.attribute", "e.text", "e.number")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("micro").alias("micro"),
             F.sum(F.col("y").cast("bigint")).alias("y")))


def bias_audit(rows: DataFrame) -> DataFrame:
    """Mean score and observed rate per protected group of at least 30 files.

    Numeric attributes are cut at their quartiles (duplicate edges dropped); rows
    are reduced to one line per attribute value before anything else.
    """
    values = _by_value(rows)
    numeric = values.where("number IS NOT NULL")
    edges = (
        ordered.exact_quantiles(
            numeric.select(F.col("attribute").alias("variable"),
                           F.col("number").alias("value"), "n"),
            [0.0, 0.25, 0.5, 0.75, 1.0], counted=True)
        .groupBy(F.col("variable").alias("attribute"))
        .agg(F.sort_array(F.collect_set("quantile")).alias("edges")))
    cut = numeric.join(F.broadcast(edges), "attribute")
    place = F.greatest(F.lit(1), F.size(F.expr("filter(edges, e -> e < number)")))
    low, high = F.element_at("edges", place), F.element_at("edges", place + 1)
    shown_low = round_to(F.when(place == 1, low - 0.001).otherwise(low), 3)
    label = F.concat(F.lit("("), shown_low.cast("string"), F.lit(", "),
                     round_to(high, 3).cast("string"), F.lit("]"))
    grouped = cut.withColumn("group", label).select("attribute", "group", "n", "micro", "y")
    plain = values.where("text IS NOT NULL").select(
        "attribute", F.col("text").alias("group"), "n", "micro", "y")
    sums = grouped.unionByName(plain).groupBy("attribute", "group").agg(
        F.sum("n").alias("n"), F.sum("micro").alias("micro"), F.sum("y").alias("y"))
    return sums.where(F.col("n") >= MINIMUM_GROUP).select(
        "attribute", "group", "n",
        round_to(F.col("micro") / F.lit(1e6) / F.col("n"), 3).alias("mean_score"),
        round_to(F.col("y") / F.col("n"), 3).alias("observed"))
