"""Affordability indicators from line tables and from nested documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from riskframe.functions import credit
from riskframe.functions.numeric import exact_sum, scaled
from riskframe.sources.tables import Tables, keyed_join

INDICATORS = [
    "gross_income", "weighted_income", "variable_income_share", "counted_expenses",
    "existing_payments", "retained_payments", "dti_before_pct", "dti_after_pct",
    "above_hcsf_threshold", "consumption_units", "residual_income", "residual_income_per_cu",
    "payment_shock", "savings_months_of_expenses", "formula_version",
]

# ---- fixed values -------------------------------------------------------------
NOT_ASSESSABLE = "weighted income is zero: the application cannot be assessed"
# -------------------------------------------------------------------------------


def _income_totals(t: Tables) -> DataFrame:
    amount = F.col("monthly_amount")
    return t["income"].groupBy("application_id").agg(
        exact_sum(amount).alias("gross"),
        exact_sum(amount * F.col("weighting")).alias("weighted"),
        exact_sum(F.when(F.col("variability") == "variable", amount).otherwise(F.lit(0.0)))
        .alias("variable"))


def _expense_totals(t: Tables) -> DataFrame:
    return (t["expense"].where("counted_in_dti = 1").groupBy("application_id")
            .agg(exact_sum(F.col("monthly_amount")).alias("counted")))


def _loan_totals(t: Tables) -> DataFrame:
    payment = F.col("monthly_payment")
    return t["existing_loan"].groupBy("application_id").agg(
        exact_sum(payment).alias("existing"),
        exact_sum(F.when(F.col("repaid_by_this_loan") == 1, payment).otherwise(F.lit(0.0)))
        .alias("refinanced"))


def _finish(df: DataFrame, *carry: str) -> DataFrame:
    """Apply the one formula to columns named after its arguments."""
    totals = {name: F.coalesce(F.col(name), F.lit(0.0))
              for name in ("gross", "weighted", "variable", "counted", "existing", "refinanced")}
    measured = credit.indicator_columns(
        **totals, payment=F.col("payment"), units=F.col("units"), liquid=F.col("liquid"))
    error = (F.when(totals["weighted"] <= 0, NOT_ASSESSABLE)
             .when(F.col("units").isNull(), "household missing")
             .when(F.col("liquid").isNull(), "account behaviour missing"))
    return df.select(*carry, *[c.alias(n) for n, c in measured.items()],
                     error.alias("indicator_error"))


def from_lines(t: Tables) -> DataFrame:
    """One row per application with 15 indicators and ``indicator_error``."""
    application = t["application"].select(
        F.col("id").alias("application_id"), F.col("monthly_payment").alias("payment"))
    units = t["household"].select("application_id", credit.consumption_units(
        F.col("household_size"), F.col("dependent_children"), F.col("children_under_14"))
        .alias("units"))
    liquid = t["account_behaviour"].select("application_id",
                                           F.col("liquid_savings").alias("liquid"))
    joined = application
    for block in (units, liquid, _income_totals(t), _expense_totals(t), _loan_totals(t)):
        joined = keyed_join(joined, block, how="left")
    return _finish(joined, "application_id")


def assessable(indicators: DataFrame) -> DataFrame:
    """Rows fit for the stored table: those without an error."""
    return indicators.where("indicator_error IS NULL").drop("indicator_error")


def _array_sum(array: str, value, keep=None) -> Column:
    """Exact sum over a document array, in the same fixed-point units as the lines."""
    def add(total: Column, item: Column) -> Column:
        amount = value(item)
        if keep is not None:
            amount = F.when(keep(item), amount).otherwise(F.lit(0.0))
        return total + scaled(amount, 4)

    items = F.coalesce(F.col(array), F.array())
    return F.aggregate(items, F.lit(0).cast("bigint"), add) / F.lit(10000.0)


def document_totals(documents: DataFrame) -> DataFrame:
    """Per-document sums, held as columns so later expressions stay small."""
    return documents.select(
        "*",
        _array_sum("incomes", lambda i: i["monthly_amount"]).alias("gross"),
        _array_sum("incomes", lambda i: i["monthly_amount"] * i["weighting"]).alias("weighted"),
        _array_sum("incomes", lambda i: i["monthly_amount"],
                   lambda i: i["variability"] == "variable").alias("variable"),
        _array_sum("expenses", lambda e: e["monthly_amount"],
                   lambda e: e["counted_in_dti"]).alias("counted"),
        _array_sum("existing_loans", lambda x: x["monthly_payment"]).alias("existing"),
        _array_sum("existing_loans", lambda x: x["monthly_payment"],
                   lambda x: x["repaid_by_this_loan"]).alias("refinanced"),
        credit.consumption_units(
            F.col("household.household_size"), F.col("household.dependent_children"),
            F.col("household.children_under_14")).alias("units"),
        F.col("behaviour.liquid_savings").alias("liquid"),
        credit.total_payment(
            credit.level_payment(F.col("operation.requested_amount"),
                                 F.col("operation.nominal_rate"),
                                 F.col("operation.term_months")),
            F.col("operation.monthly_insurance_cost")).alias("payment"))


TOTALS = ["gross", "weighted", "variable", "counted", "existing", "refinanced", "units",
          "liquid", "payment"]


def from_documents(documents: DataFrame, keep_totals: bool = False) -> DataFrame:
    """Indicators of nested documents: no shuffle, everything happens in the row.

    ``keep_totals`` leaves the sums on the rows for later trial amounts.
    """
    carry = documents.columns + (TOTALS if keep_totals else [])
    return _finish(document_totals(documents), *carry,
                   F.col("payment").alias("monthly_payment"))
