"""The analytical row: one per application, 104 columns, assembled from blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from riskframe.functions import credit
from riskframe.functions.numeric import round_to
from riskframe.operators import pivots
from riskframe.sources import refdata
from riskframe.sources.tables import Tables, keyed_join

# ---- fixed values: column order of the analytical row -------------------------
COLUMNS = [
    "application_id", "application_reference", "customer_reference", "application_date",
    "split", "source", "age", "sex", "nationality_zone", "marital_status", "channel",
    "loan_type", "requested_amount", "term_months", "nominal_rate", "apr",
    "payment_excl_insurance", "insurance_taken", "monthly_insurance_cost", "monthly_payment",
    "down_payment", "down_payment_ratio", "has_co_borrower", "household_size",
    "dependent_children", "housing_status", "months_at_address", "department", "area_type",
    "occupation", "contract_type", "contract_stability", "months_in_job",
    "in_probation_period", "industry", "employer_type", "co_borrower_contract",
    "co_borrower_months_in_job", "relationship_months", "income_salary", "income_bonus",
    "income_benefits", "income_pension", "income_rental", "income_other",
    "income_co_borrower", "undocumented_income_lines", "gross_income", "weighted_income",
    "variable_income_share", "expense_rent", "expense_alimony", "expense_tax",
    "expense_other", "counted_expenses", "existing_loans", "existing_loan_payments",
    "outstanding_balance_total", "revolving_loans", "loans_refinanced", "loan_incidents_12m",
    "longest_remaining_months", "retained_payments", "average_balance",
    "days_overdrawn_12m", "rejected_debits_12m", "overdraft_fees_12m", "overdraft_limit",
    "max_overdraft_used", "liquid_savings", "total_savings", "products_held",
    "salary_domiciled", "ficp_flagged", "fcc_flagged", "loans_repaid_clean",
    "dti_before_pct", "dti_after_pct", "above_hcsf_threshold", "consumption_units",
    "residual_income", "residual_income_per_cu", "payment_shock",
    "savings_months_of_expenses", "formula_version", "decision_result", "risk_score",
    "risk_grade", "approved_amount", "approved_term_months", "conditions", "rationale",
    "reasons", "adverse_reasons", "favourable_reasons", "outcome_status",
    "outcome_missed_payments", "outcome_sent_to_collections", "outcome_balance_at_default",
    "default_flag", "counterfactual_default_flag", "decided_by", "decision_date",
    "observation_months",
]
# -------------------------------------------------------------------------------

_INDICATOR_COLUMNS = [
    "gross_income", "weighted_income", "variable_income_share", "counted_expenses",
    "retained_payments", "dti_before_pct", "dti_after_pct", "above_hcsf_threshold",
    "consumption_units", "residual_income", "residual_income_per_cu", "payment_shock",
    "savings_months_of_expenses", "formula_version",
]


def _zero_filled(df: DataFrame, *names: str) -> DataFrame:
    """Absent child rows count as zero."""
    return df.withColumns({n: F.coalesce(F.col(n), F.lit(0).cast(df.schema[n].dataType))
                           for n in names})


def _application_block(t: Tables) -> DataFrame:
    return t["application"].select(
        F.col("id").alias("application_id"), F.col("reference").alias("application_reference"),
        "application_date", "split", "source", "channel",
        F.col("loan_type_code").alias("loan_type"), "requested_amount", "term_months",
        "nominal_rate", "apr", "usury_rate_cap", "payment_excl_insurance",
        "insurance_taken", "monthly_insurance_cost", "monthly_payment", "down_payment",
        credit.down_payment_ratio(F.col("down_payment"), F.col("requested_amount"))
        .alias("down_payment_ratio"),
        F.col("co_borrower_id").isNotNull().cast("int").alias("has_co_borrower"))


def _customer_block(t: Tables) -> DataFrame:
    """Customer attributes per application, joined on narrow rows.

    Only the two keys and the date travel to the customer; the wide row never
    shuffles by customer. A customer with very many applications makes a skewed
    join partition, which adaptive execution splits: the result is exchanged again
    by application, so nothing downstream relies on the customer partitioning.
    """
    keys = t["application"].select(F.col("id").alias("application_id"), "customer_id",
                                   "application_date")
    customer = t["customer"].select(
        F.col("id").alias("customer_id"), F.col("reference").alias("customer_reference"),
        "birth_date", "sex", "nationality_zone", "relationship_start_date")
    on = F.col("application_date")
    return keyed_join(keys, customer, "customer_id").select(
        "application_id", "customer_reference",
        credit.age_years(on, F.col("birth_date")).alias("age"), "sex", "nationality_zone",
        credit.relationship_months(on, F.col("relationship_start_date"))
        .alias("relationship_months"),
        F.floor(F.datediff(on, F.col("relationship_start_date")) / F.lit(30)).cast("int")
        .alias("rule_relationship_months"))


def _household_block(t: Tables) -> DataFrame:
    return t["household"].select(
        "application_id", "marital_status", "household_size", "dependent_children",
        "children_under_14", F.col("housing_status_code").alias("housing_status"), "months_at_address",
        "department", "area_type")


def _primary_block(t: Tables) -> DataFrame:
    tiers = t["employment_contract"].select(
        F.col("code").alias("contract_type"), F.col("stability").alias("contract_stability"))
    return (
        t["employment"].where("role = 'primary'")
        .select("application_id", F.col("occupation_code").alias("occupation"),
                F.col("contract_code").alias("contract_type"), "months_in_job",
                "in_probation_period", "industry", "employer_type")
        .join(F.broadcast(tiers), "contract_type"))


def _co_borrower_block(t: Tables) -> DataFrame:
    return t["employment"].where("role = 'co_borrower'").select(
        "application_id", F.col("contract_code").alias("co_borrower_contract"),
        F.col("months_in_job").alias("co_borrower_months_in_job"))


def _decision_block(t: Tables) -> DataFrame:
    return t["decision"].select(
        "application_id", F.col("result").alias("decision_result"), "risk_score",
        "risk_grade", "approved_amount", "approved_term_months", "conditions", "rationale",
        "decided_by", "decision_date")


def _outcome_block(t: Tables) -> DataFrame:
    return t["outcome"].select(
        "application_id", F.col("status").alias("outcome_status"),
        F.col("missed_payments").alias("outcome_missed_payments"),
        F.col("sent_to_collections").alias("outcome_sent_to_collections"),
        F.col("balance_at_default").alias("outcome_balance_at_default"), "observation_months")


def _counterfactual_block(t: Tables) -> DataFrame:
    return t["counterfactual_outcome"].select(
        "application_id", F.col("status").alias("counterfactual_status"))


def situation(t: Tables) -> DataFrame:
    """The row before any decision: mandatory blocks, rollups, no targets.

    Mandatory blocks are inner joins, so an application missing one of them drops
    out; children are rolled up before they are joined, so nothing fans out.
    """
    row = _application_block(t)
    for block in (_household_block(t), _primary_block(t),
                  t["account_behaviour"],
                  t["indicators"].select("application_id", *_INDICATOR_COLUMNS)):
        row = keyed_join(row, block)
    row = keyed_join(row, _co_borrower_block(t), how="left")
    income, expense, loans = pivots.income_pivot(t), pivots.expense_pivot(t), pivots.loan_rollup(t)
    for rollup in (income, expense, loans):
        row = keyed_join(row, rollup, how="left")
    row = keyed_join(row, _customer_block(t))
    filled = [c for r in (income, expense, loans) for c in r.columns if c != "application_id"]
    return _zero_filled(row, *filled)


def document_base(t: Tables) -> DataFrame:
    """Per-application attributes a nested document is built from, without lines."""
    row = _application_block(t)
    for block in (_household_block(t), _primary_block(t), t["account_behaviour"],
                  _customer_block(t)):
        row = keyed_join(row, block)
    return row


def dataset(t: Tables) -> DataFrame:
    """The full analytical row."""
    row = situation(t)
    for block in (_decision_block(t), _outcome_block(t), _counterfactual_block(t),
                  pivots.reason_rollup(t)):
        row = keyed_join(row, block, how="left")
    row = _zero_filled(row, "adverse_reasons", "favourable_reasons")
    row = row.withColumns({
        "default_flag": credit.default_label(F.col("outcome_status")),
        "counterfactual_default_flag": credit.default_label(F.col("counterfactual_status"))})
    return row.select(*COLUMNS)


def class_balance(rows: DataFrame) -> DataFrame:
    """Decision and default counts per split."""
    def decided(result: str):
        return F.count(F.when(F.col("decision_result") == result, 1))

    return rows.groupBy("split").agg(
        F.count(F.lit(1)).alias("applications"),
        decided("approved").alias("approved"),
        decided("approved_with_conditions").alias("approved_with_conditions"),
        decided("declined").alias("declined"),
        F.count(F.when(F.col("default_flag") == 1, 1)).alias("defaults"),
        round_to(F.sum(F.rint(F.col("dti_after_pct") * 100.0).cast("bigint"))
                 / F.lit(100.0) / F.count("dti_after_pct"), 2).alias("mean_dti_after"),
        F.count(F.when(F.col("above_hcsf_threshold") == 1, 1)).alias("above_hcsf"))


def by_split(rows: DataFrame, split: str) -> DataFrame:
    return rows.where(F.col("split") == split)


def labelled(rows: DataFrame, target: str = "default_flag") -> DataFrame:
    """Rows whose target was observed; unknown targets are never filled."""
    return rows.where(F.col(target).isNotNull())


def decided_as(rows: DataFrame, *results: str) -> DataFrame:
    return rows.where(F.col("decision_result").isin(*results))


def role_census(spark) -> DataFrame:
    return (refdata.variable_dictionary(spark).groupBy("role")
            .agg(F.count(F.lit(1)).alias("columns")))


def lookup(rows: DataFrame, references: DataFrame) -> DataFrame:
    """Rows of the listed references (a one-column DataFrame)."""
    wanted = references.select("application_reference").distinct()
    return keyed_join(rows, wanted, "application_reference", "left_semi")
