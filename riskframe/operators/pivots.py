"""Per-application rollups of the line tables.

Each is one partial aggregation followed by one exchange of at most one row per
application and input partition, whatever the number of lines an application has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from riskframe.functions.numeric import exact_sum
from riskframe.sources.tables import Tables, keyed_join

INCOME_FAMILIES = ["salary", "bonus", "benefits", "pension", "rental", "other"]
EXPENSE_FAMILIES = ["rent", "alimony", "tax", "other"]


def _sum_where(condition: Column, value: str = "monthly_amount") -> Column:
    return exact_sum(F.when(condition, F.col(value)).otherwise(F.lit(0.0)), 4)


def _count_where(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def income_pivot(t: Tables) -> DataFrame:
    family = t["income_type"].select(F.col("code").alias("income_type_code"), "family")
    return (
        t["income"].join(F.broadcast(family), "income_type_code")
        .groupBy("application_id")
        .agg(*[_sum_where(F.col("family") == f).alias(f"income_{f}") for f in INCOME_FAMILIES],
             _sum_where(F.col("role") == "co_borrower").alias("income_co_borrower"),
             _count_where(F.col("documented") == 0).alias("undocumented_income_lines")))


def expense_pivot(t: Tables) -> DataFrame:
    family = t["expense_type"].select(F.col("code").alias("expense_type_code"), "family")
    return (
        t["expense"].where("counted_in_dti = 1")
        .join(F.broadcast(family), "expense_type_code")
        .groupBy("application_id")
        .agg(*[_sum_where(F.col("family") == f).alias(f"expense_{f}")
               for f in EXPENSE_FAMILIES]))


def loan_rollup(t: Tables) -> DataFrame:
    return t["existing_loan"].groupBy("application_id").agg(
        F.count(F.lit(1)).alias("existing_loans"),
        exact_sum(F.col("monthly_payment"), 4).alias("existing_loan_payments"),
        exact_sum(F.col("outstanding_balance"), 4).alias("outstanding_balance_total"),
        _count_where(F.col("loan_kind") == "revolving").alias("revolving_loans"),
        _count_where(F.col("repaid_by_this_loan") == 1).alias("loans_refinanced"),
        F.sum("incidents_12m").alias("loan_incidents_12m"),
        F.max("remaining_months").alias("longest_remaining_months"))


def reason_rollup(t: Tables) -> DataFrame:
    """Codes joined by ``|`` in code order, with polarity counts.

    The code list of one application is a set drawn from 32 codes, so collecting
    it is bounded; ``collect_set`` also merges before the exchange.
    """
    polarity = t["reason"].select(F.col("code").alias("reason_code"), "polarity")
    return (
        t["decision_reason"].join(F.broadcast(polarity), "reason_code")
        .groupBy("application_id")
        .agg(F.array_join(F.sort_array(F.collect_set("reason_code")), "|").alias("reasons"),
             _count_where(F.col("polarity") == "adverse").alias("adverse_reasons"),
             _count_where(F.col("polarity") == "favourable").alias("favourable_reasons")))


def explode_reasons(df: DataFrame, key: str = "application_id",
                    codes: str = "reason_codes") -> DataFrame:
    """One row per distinct (application, reason code), first occurrence kept."""
    return df.select(key, F.explode(F.array_distinct(codes)).alias("reason_code"))


def consolidation_loans(t: Tables) -> DataFrame:
    """Loans with the refinancing flag a consolidation implies.

    On a debt consolidation every loan but a mortgage is repaid by the operation;
    elsewhere the stored flag stands.
    """
    product = t["application"].select(F.col("id").alias("application_id"), "loan_type_code")
    repaid = F.when((F.col("loan_type_code") == "DEBT_CONSOLIDATION")
                    & (F.col("loan_kind") != "mortgage"), 1).otherwise(
                        F.col("repaid_by_this_loan"))
    return (keyed_join(t["existing_loan"], product)
            .withColumn("repaid_by_this_loan", repaid))
