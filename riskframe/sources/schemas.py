"""Declared schema of every table, and the rules its rows must satisfy.

The rules are data: one list per table drives the violation reports, so that a
table is read once however many rules it has.
"""

from __future__ import annotations

TABLES: dict[str, str] = {
    "customer": (
        "id BIGINT, reference STRING, birth_date DATE, sex STRING, nationality_zone STRING, "
        "relationship_start_date DATE"),
    "application": (
        "id BIGINT, reference STRING, customer_id BIGINT, co_borrower_id BIGINT, "
        "application_date DATE, channel STRING, loan_type_code STRING, purpose STRING, "
        "requested_amount DOUBLE, term_months INT, nominal_rate DOUBLE, apr DOUBLE, "
        "usury_rate_cap DOUBLE, payment_excl_insurance DOUBLE, insurance_taken INT, "
        "monthly_insurance_cost DOUBLE, monthly_payment DOUBLE, down_payment DOUBLE, "
        "split STRING, source STRING"),
    "household": (
        "application_id BIGINT, marital_status STRING, household_size INT, "
        "dependent_children INT, children_under_14 INT, housing_status_code STRING, "
        "months_at_address INT, department STRING, area_type STRING"),
    "employment": (
        "application_id BIGINT, role STRING, occupation_code STRING, contract_code STRING, "
        "months_in_job INT, in_probation_period INT, industry STRING, employer_type STRING"),
    "income": (
        "application_id BIGINT, role STRING, income_type_code STRING, monthly_amount DOUBLE, "
        "variability STRING, weighting DOUBLE, documented INT"),
    "expense": (
        "application_id BIGINT, expense_type_code STRING, monthly_amount DOUBLE, "
        "counted_in_dti INT"),
    "existing_loan": (
        "application_id BIGINT, loan_kind STRING, lender STRING, outstanding_balance DOUBLE, "
        "monthly_payment DOUBLE, remaining_months INT, repaid_by_this_loan INT, "
        "incidents_12m INT"),
    "account_behaviour": (
        "application_id BIGINT, average_balance DOUBLE, days_overdrawn_12m INT, "
        "rejected_debits_12m INT, overdraft_fees_12m INT, overdraft_limit DOUBLE, "
        "max_overdraft_used DOUBLE, liquid_savings DOUBLE, total_savings DOUBLE, "
        "products_held INT, salary_domiciled INT, ficp_flagged INT, fcc_flagged INT, "
        "loans_repaid_clean INT"),
    "indicators": (
        "application_id BIGINT, gross_income DOUBLE, weighted_income DOUBLE, "
        "variable_income_share DOUBLE, counted_expenses DOUBLE, existing_payments DOUBLE, "
        "retained_payments DOUBLE, dti_before_pct DOUBLE, dti_after_pct DOUBLE, "
        "above_hcsf_threshold INT, consumption_units DOUBLE, residual_income DOUBLE, "
        "residual_income_per_cu DOUBLE, payment_shock DOUBLE, "
        "savings_months_of_expenses DOUBLE, formula_version STRING"),
    "decision": (
        "application_id BIGINT, result STRING, approved_amount DOUBLE, "
        "approved_term_months INT, risk_score INT, risk_grade STRING, conditions STRING, "
        "rationale STRING, decided_by STRING, decision_date DATE"),
    "decision_reason": "application_id BIGINT, reason_code STRING",
    "outcome": (
        "application_id BIGINT, status STRING, observation_months INT, payments_made INT, "
        "missed_payments INT, first_missed_payment_date DATE, balance_at_default DOUBLE, "
        "sent_to_collections INT, closed_date DATE"),
    "counterfactual_outcome": (
        "application_id BIGINT, status STRING, observation_months INT, missed_payments INT"),
}

# Tables with at most one or two rows per application: their rows spread evenly
# over buckets of application_id. Line tables are left out on purpose, since one
# application may own a large share of the lines.
BUCKET_KEY = {
    "application": "id",
    "household": "application_id",
    "employment": "application_id",
    "account_behaviour": "application_id",
    "indicators": "application_id",
    "decision": "application_id",
    "outcome": "application_id",
    "counterfactual_outcome": "application_id",
}

# Key shown in a violation report.
ROW_KEY = {name: ("id" if name in ("customer", "application") else "application_id")
           for name in TABLES}

NULLABLE = {
    "application": {"co_borrower_id", "purpose"},
    "employment": {"industry", "employer_type"},
    "decision": {"approved_amount", "approved_term_months", "conditions"},
    "outcome": {"first_missed_payment_date", "balance_at_default", "closed_date"},
}


def column_names(table: str) -> list[str]:
    return [part.split()[0] for part in TABLES[table].split(", ")]


def required_columns(table: str) -> list[str]:
    free = NULLABLE.get(table, set())
    return [c for c in column_names(table) if c not in free]


def _one_of(column: str, *values: str) -> tuple[str, str]:
    listed = ", ".join(f"'{v}'" for v in values)
    return f"{column} in list", f"{column} IN ({listed})"


def _between(column: str, low: float, high: float) -> tuple[str, str]:
    return f"{column} between {low} and {high}", f"{column} BETWEEN {low} AND {high}"


def _at_least(column: str, low: float) -> tuple[str, str]:
    return f"{column} >= {low}", f"{column} >= {low}"


def _above(column: str, low: float) -> tuple[str, str]:
    return f"{column} > {low}", f"{column} > {low}"


def _bit(column: str) -> tuple[str, str]:
    return f"{column} is 0 or 1", f"{column} IN (0, 1)"


_STATUSES = ("ongoing", "repaid_clean", "minor_incidents", "default", "early_repayment")

# ---- fixed values: allowed domains (rule name, predicate a row must meet) -----
DOMAIN_RULES: dict[str, list[tuple[str, str]]] = {
    "customer": [_one_of("sex", "M", "F", "NR"),
                 _one_of("nationality_zone", "FR", "EU", "NON_EU")],
    "application": [
        _one_of("channel", "branch", "online", "broker", "point_of_sale"),
        _above("requested_amount", 0), _between("term_months", 1, 120),
        _at_least("nominal_rate", 0), _at_least("apr", 0), _above("usury_rate_cap", 0),
        _above("payment_excl_insurance", 0), _bit("insurance_taken"),
        _at_least("monthly_insurance_cost", 0), _above("monthly_payment", 0),
        _at_least("down_payment", 0), _one_of("split", "train", "val", "test"),
        _one_of("source", "manual", "generated")],
    "household": [
        _one_of("marital_status", "single", "married", "civil_union", "cohabiting",
                "divorced", "widowed"),
        _between("household_size", 1, 15), _at_least("dependent_children", 0),
        _at_least("children_under_14", 0), _at_least("months_at_address", 0),
        _one_of("area_type", "urban", "suburban", "rural")],
    "employment": [
        _one_of("role", "primary", "co_borrower"), _at_least("months_in_job", 0),
        _bit("in_probation_period"),
        _one_of("employer_type", "private", "public", "self_employed")],
    "income": [
        _one_of("role", "primary", "co_borrower", "household"), _above("monthly_amount", 0),
        _one_of("variability", "fixed", "variable"), _between("weighting", 0, 1),
        _bit("documented")],
    "expense": [_above("monthly_amount", 0), _bit("counted_in_dti")],
    "existing_loan": [
        _one_of("loan_kind", "mortgage", "amortising_consumer", "revolving", "lease",
                "overdraft"),
        _one_of("lender", "internal", "external"), _at_least("outstanding_balance", 0),
        _at_least("monthly_payment", 0), _at_least("remaining_months", 0),
        _bit("repaid_by_this_loan"), _at_least("incidents_12m", 0)],
    "account_behaviour": [
        _between("days_overdrawn_12m", 0, 366), _at_least("rejected_debits_12m", 0),
        _at_least("overdraft_fees_12m", 0), _at_least("overdraft_limit", 0),
        _at_least("max_overdraft_used", 0), _at_least("liquid_savings", 0),
        _at_least("total_savings", 0), _at_least("products_held", 0),
        _bit("salary_domiciled"), _bit("ficp_flagged"), _bit("fcc_flagged"),
        _at_least("loans_repaid_clean", 0)],
    "indicators": [
        _at_least("gross_income", 0), _at_least("weighted_income", 0),
        _between("variable_income_share", 0, 1), _at_least("counted_expenses", 0),
        _at_least("existing_payments", 0), _at_least("retained_payments", 0),
        _between("dti_before_pct", 0, 200), _between("dti_after_pct", 0, 200),
        _bit("above_hcsf_threshold"), _at_least("consumption_units", 1),
        _at_least("savings_months_of_expenses", 0)],
    "decision": [
        _one_of("result", "approved", "approved_with_conditions", "declined", "deferred"),
        _above("approved_amount", 0), _above("approved_term_months", 0),
        _between("risk_score", 0, 100), _one_of("risk_grade", "A", "B", "C", "D", "E"),
        _one_of("decided_by", "human", "rule_engine", "llm")],
    "outcome": [
        _one_of("status", *_STATUSES), _at_least("observation_months", 0),
        _at_least("payments_made", 0), _at_least("missed_payments", 0),
        _at_least("balance_at_default", 0), _bit("sent_to_collections")],
    "counterfactual_outcome": [
        _one_of("status", *_STATUSES), _at_least("observation_months", 0),
        _at_least("missed_payments", 0)],
}

CROSS_COLUMN_RULES: dict[str, list[tuple[str, str]]] = {
    "application": [
        ("co-borrower differs from customer",
         "co_borrower_id IS NULL OR co_borrower_id <> customer_id"),
        ("apr within usury cap", "apr <= usury_rate_cap"),
        ("insurance cost only if taken", "insurance_taken = 1 OR monthly_insurance_cost = 0")],
    "household": [
        ("children under 14 within children", "children_under_14 <= dependent_children"),
        ("at least one adult", "dependent_children < household_size")],
    "account_behaviour": [("liquid within total savings", "liquid_savings <= total_savings")],
    "indicators": [
        ("retained within existing payments", "retained_payments <= existing_payments"),
        ("weighted within gross income", "weighted_income <= gross_income")],
}

DECISION_RULES = [
    ("amount present iff approved",
     "(result IN ('approved', 'approved_with_conditions')) = (approved_amount IS NOT NULL)"),
    ("term present iff approved",
     "(result IN ('approved', 'approved_with_conditions')) = (approved_term_months IS NOT NULL)"),
    ("conditions text on a conditional approval",
     "result <> 'approved_with_conditions' OR "
     "(conditions IS NOT NULL AND length(trim(conditions)) > 0)"),
]

OUTCOME_RULES = [
    ("missed payments are dated", "missed_payments = 0 OR first_missed_payment_date IS NOT NULL"),
    ("default carries a balance", "status <> 'default' OR balance_at_default IS NOT NULL"),
    ("clean repayment missed nothing", "status <> 'repaid_clean' OR missed_payments = 0"),
]

# (table, columns) that must be unique
UNIQUE_KEYS = [
    ("customer", ["id"]), ("customer", ["reference"]),
    ("application", ["id"]), ("application", ["reference"]),
    ("household", ["application_id"]), ("employment", ["application_id", "role"]),
    ("account_behaviour", ["application_id"]), ("indicators", ["application_id"]),
    ("decision", ["application_id"]), ("decision_reason", ["application_id", "reason_code"]),
    ("outcome", ["application_id"]), ("counterfactual_outcome", ["application_id"]),
]

# (child, column, parent, parent column)
FOREIGN_KEYS = [
    ("application", "customer_id", "customer", "id"),
    ("application", "co_borrower_id", "customer", "id"),
    ("application", "loan_type_code", "loan_type", "code"),
    ("household", "application_id", "application", "id"),
    ("household", "housing_status_code", "housing_status", "code"),
    ("employment", "application_id", "application", "id"),
    ("employment", "occupation_code", "occupation", "code"),
    ("employment", "contract_code", "employment_contract", "code"),
    ("income", "application_id", "application", "id"),
    ("income", "income_type_code", "income_type", "code"),
    ("expense", "application_id", "application", "id"),
    ("expense", "expense_type_code", "expense_type", "code"),
    ("existing_loan", "application_id", "application", "id"),
    ("account_behaviour", "application_id", "application", "id"),
    ("indicators", "application_id", "application", "id"),
    ("decision", "application_id", "application", "id"),
    ("decision_reason", "application_id", "application", "id"),
    ("decision_reason", "reason_code", "reason", "code"),
    ("outcome", "application_id", "decision", "application_id"),
    ("counterfactual_outcome", "application_id", "application", "id"),
]
# ---- end of fixed values ------------------------------------------------------
