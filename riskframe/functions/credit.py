"""Scalar credit formulas as Column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, functions as F

from riskframe.functions.numeric import round_to
from riskframe.sources import refdata

# ---- fixed values -----------------------------------------------------------
DTI_CAP_PCT = 35.0
FORMULA_VERSION = "v1"
INSURANCE_FACTOR = 0.00035
OBSERVATION_MONTHS = 18
HORIZON_CAP_MONTHS = 48
APPROVALS = ("approved", "approved_with_conditions")
# -----------------------------------------------------------------------------


def literal_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(pairs.items())])


def lookup(pairs: dict[str, str], key: Column) -> Column:
    return F.try_element_at(literal_map(pairs), key)


def age_years(on: Column, birth: Column) -> Column:
    return (F.datediff(on, birth) / F.lit(365.25)).cast("int")


def relationship_months(on: Column, start: Column) -> Column:
    return (F.datediff(on, start) / F.lit(30.4375)).cast("int")


def down_payment_ratio(down: Column, amount: Column) -> Column:
    return F.when(down > 0, down / amount).otherwise(F.lit(0.0))


def flag(condition: Column) -> Column:
    """SQL truth as 1, false or unknown as 0."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def default_label(status: Column) -> Column:
    """1 default, 0 performed, NULL when unobserved or still running."""
    return (F.when(status == "default", 1)
            .when(status.isNull() | (status == "ongoing"), F.lit(None).cast("int"))
            .otherwise(0))


def level_payment_error(principal: Column, term: Column) -> Column:
    return (F.when(term <= 0, "term_months must be strictly positive")
            .when(principal <= 0, "principal must be strictly positive"))


def level_payment(principal: Column, annual_rate_pct: Column, term: Column) -> Column:
    """Instalment of an amortising loan; NULL where the inputs are invalid."""
    r = annual_rate_pct / F.lit(100.0) / F.lit(12.0)
    growth = F.lit(1.0) - F.pow(F.lit(1.0) + r, -term)
    valid = (term > 0) & (principal > 0)
    return (F.when(valid & (r == 0), round_to(principal / term, 2))
            .when(valid, round_to(principal * r / growth, 2)))


def affordable_principal(income: Column, effort: Column, annual_rate_pct: Column,
                         term: Column, lowest: Column, highest: Column) -> Column:
    """Principal whose instalment takes the given share of income, within product bounds."""
    r = annual_rate_pct / F.lit(100.0) / F.lit(12.0)
    growth = F.lit(1.0) - F.pow(F.lit(1.0) + r, -term)
    raw = F.when(r == 0, income * effort * term).otherwise(income * effort * growth / r)
    return round_to(F.least(highest, F.greatest(lowest, raw)), 2)


def insurance_cost(amount: Column, taken: Column) -> Column:
    return F.when(taken == 1, round_to(amount * F.lit(INSURANCE_FACTOR), 2)).otherwise(F.lit(0.0))


def total_payment(instalment: Column, insurance: Column) -> Column:
    return round_to(instalment + insurance, 2)


def usury_cap(amount: Column) -> Column:
    return F.when(amount < 3000, 21.0).when(amount < 6000, 9.5).otherwise(8.2)


def consumption_units(size: Column, children: Column, under_14: Column) -> Column:
    adults = size - children
    older = children - under_14
    return round_to(F.lit(1.0) + F.lit(0.5) * (adults - 1) + F.lit(0.5) * older
                    + F.lit(0.3) * under_14, 2)


def grade_from_score(score: Column) -> Column:
    return (F.when(score >= 82, "A").when(score >= 68, "B").when(score >= 52, "C")
            .when(score >= 38, "D").otherwise("E"))


def grade_from_pd(pd: Column) -> Column:
    return (F.when(pd < 0.02, "A").when(pd < 0.05, "B").when(pd < 0.10, "C")
            .when(pd < 0.20, "D").otherwise("E"))


def stability_of(contract: Column) -> Column:
    """Stability tier, from the one contract table."""
    return lookup({code: tier for code, _, tier in refdata.EMPLOYMENT_CONTRACTS}, contract)


def contract_wording(contract: Column) -> Column:
    return F.coalesce(lookup(refdata.CONTRACT_FR, contract), contract)


def split_of(key: Column) -> Column:
    """Stored 70/15/15 partition; a function of the key alone, so never redrawn."""
    slot = F.pmod(key.cast("bigint") * F.lit(7919), F.lit(100))
    return F.when(slot < 70, "train").when(slot < 85, "val").otherwise("test")


def business_reference(prefix: str, number: Column, year: Column | None = None) -> Column:
    """PREFIX-[YYYY-]NNNNNN; wider numbers keep all their digits."""
    digits = number.cast("string")
    padded = F.lpad(digits, F.greatest(F.length(digits), F.lit(6)), F.lit("0"))
    parts = [F.lit(prefix)] + ([] if year is None else [year.cast("string")]) + [padded]
    return F.concat_ws("-", *parts)


def indicator_columns(*, gross: Column, weighted: Column, variable: Column, counted: Column,
                      existing: Column, refinanced: Column, payment: Column,
                      units: Column, liquid: Column) -> dict[str, Column]:
    """The affordability indicators, defined once for lines and for documents.

    Every ratio is NULL when weighted income is not positive: such a file cannot
    be assessed and is reported through ``indicator_error``.
    """
    usable = weighted > 0
    retained = existing - refinanced
    after = counted + retained + payment
    dti_after = (retained + payment + counted) / weighted * F.lit(100.0)
    residual = weighted - counted - retained - payment

    def when_usable(value: Column) -> Column:
        return F.when(usable, value)

    return {
        "gross_income": round_to(gross, 2),
        "weighted_income": round_to(weighted, 2),
        "variable_income_share": F.when(gross != 0, round_to(variable / gross, 4))
        .otherwise(F.lit(0.0)),
        "counted_expenses": round_to(counted, 2),
        "existing_payments": round_to(existing, 2),
        "retained_payments": round_to(retained, 2),
        "dti_before_pct": when_usable(
            round_to((existing + counted) / weighted * F.lit(100.0), 2)),
        "dti_after_pct": when_usable(round_to(dti_after, 2)),
        "above_hcsf_threshold": when_usable((dti_after > DTI_CAP_PCT).cast("int")),
        "consumption_units": units,
        "residual_income": when_usable(round_to(residual, 2)),
        "residual_income_per_cu": when_usable(round_to(residual / units, 2)),
        "payment_shock": when_usable(round_to(payment - refinanced, 2)),
        "savings_months_of_expenses": when_usable(
            F.when(after > 0, round_to(liquid / after, 2)).otherwise(F.lit(0.0))),
        "formula_version": F.lit(FORMULA_VERSION),
    }


def expert_points(c=F.col) -> list[tuple[str, Column]]:
    """Additive terms of the expert scorecard (logit points), after the intercept.

    ``c`` maps a variable name to a Column, so that the same card serves stored
    rows, documents and trial amounts.
    """
    def hit(condition: Column) -> Column:
        return flag(condition)

    return [
        ("dti_after_pct", F.lit(0.055) * F.greatest(F.lit(0.0), c("dti_after_pct") - 30)),
        ("residual_income_per_cu", F.lit(1.30) * hit(c("residual_income_per_cu") < 650)),
        ("contract_precarious", F.lit(0.95) * hit(c("contract_stability") == "precarious")),
        ("contract_intermediate", F.lit(0.40) * hit(c("contract_stability") == "intermediate")),
        ("ficp_flagged", F.lit(1.55) * c("ficp_flagged")),
        ("rejected_debits_12m", F.lit(0.24) * F.least(F.lit(6), c("rejected_debits_12m"))),
        ("days_overdrawn_12m", F.lit(0.011) * c("days_overdrawn_12m")),
        ("revolving_loans", F.lit(0.34) * c("revolving_loans")),
        ("savings_months_of_expenses",
         F.lit(-0.55) * hit(c("savings_months_of_expenses") >= 3)),
        ("loans_repaid_clean", F.lit(-0.22) * F.least(F.lit(4), c("loans_repaid_clean"))),
        ("has_co_borrower", F.lit(-0.30) * c("has_co_borrower")),
        ("months_in_job",
         F.lit(-0.018) * F.least(F.lit(60.0), c("months_in_job") / F.lit(2.0))),
    ]


EXPERT_INTERCEPT = -3.05
EXPERT_INPUTS = ["dti_after_pct", "residual_income_per_cu", "contract_stability", "ficp_flagged", "rejected_debits_12m",
                 "days_overdrawn_12m", "revolving_loans", "savings_months_of_expenses", "loans_repaid_clean",
                 "has_co_borrower", "months_in_job"]


def logistic(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def expert_logit(c=F.col, skip: set[str] = frozenset()) -> Column:
    """Intercept plus the terms of the expert card, but for the skipped ones."""
    z = F.lit(EXPERT_INTERCEPT)
    for name, points in expert_points(c):
        if name not in skip:
            z = z + points
    return z


def expert_pd(c=F.col) -> Column:
    """Probability of default from the expert card, to six digits."""
    return round_to(logistic(expert_logit(c)), 6)
