"""Scalar formulas and indicators on hand-made rows."""

import math

import pytest
from pyspark.sql import functions as F

from riskframe.functions import credit
from riskframe.functions.numeric import draw, exact_sum, round_to
from riskframe.operators import dataset, indicators, pivots, rules
from riskframe.sources import adapter, documents, refdata, schemas
from riskframe.sources.tables import Tables


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_dictionary_matches_columns():
    assert sorted(dataset.COLUMNS) == sorted(refdata.ROLE)
    assert [len(refdata.columns_with_role(r)) for r in ("meta", "protected", "feature", "target")
            ] == [10, 4, 74, 16]


def test_level_payment(spark):
    row = one(spark,
              usual=credit.level_payment(F.lit(10000.0), F.lit(6.0), F.lit(48)),
              zero=credit.level_payment(F.lit(1200.0), F.lit(0.0), F.lit(12)),
              bad_term=credit.level_payment(F.lit(1200.0), F.lit(5.0), F.lit(0)),
              bad_amount=credit.level_payment(F.lit(0.0), F.lit(5.0), F.lit(12)),
              term_error=credit.level_payment_error(F.lit(0.0), F.lit(0)),
              amount_error=credit.level_payment_error(F.lit(-1.0), F.lit(3)))
    r = 0.06 / 12
    assert row.usual == round(10000 * r / (1 - (1 + r) ** -48), 2)
    assert row.zero == 100.0 and row.bad_term is None and row.bad_amount is None
    assert row.term_error.startswith("term_months") and row.amount_error.startswith("principal")


def test_annuity_round_trip(spark):
    """The principal affordable from an income share pays that share back."""
    df = spark.range(500).select(
        (F.lit(1500.0) + F.col("id") * 13).alias("income"), (F.col("id") % 120 + 6).alias("term"),
        (F.lit(0.5) + (F.col("id") % 80) / 10.0).alias("rate"))
    principal = credit.affordable_principal(F.col("income"), F.lit(0.1), F.col("rate"),
                                            F.col("term"), F.lit(0.0), F.lit(1e9))
    paid = credit.level_payment(principal, F.col("rate"), F.col("term"))
    assert df.where(F.abs(paid - F.col("income") * 0.1) > 0.011).count() == 0


def test_grades_and_bounds(spark):
    df = spark.createDataFrame([(p,) for p in (0.0199, 0.02, 0.05, 0.10, 0.20)], "p DOUBLE")
    assert [r[0] for r in df.select(credit.grade_from_pd(F.col("p"))).collect()] == list("ABCDE")
    df = spark.createDataFrame([(s,) for s in (82, 81, 67, 51, 37)], "s INT")
    assert [r[0] for r in df.select(credit.grade_from_score(F.col("s"))).collect()] == list("ABCDE")
    df = spark.createDataFrame([(a,) for a in (2999.0, 3000.0, 6000.0)], "a DOUBLE")
    assert [r[0] for r in df.select(credit.usury_cap(F.col("a"))).collect()] == [21.0, 9.5, 8.2]


def test_labels_keep_the_unknown(spark):
    df = spark.createDataFrame([("default",), ("ongoing",), (None,), ("repaid_clean",)], "s STRING")
    assert [r[0] for r in df.select(credit.default_label(F.col("s"))).collect()] == [
        1, None, None, 0]


def test_rounding_and_sums(spark):
    row = one(spark, tie=round_to(F.lit(0.125), 2), up=round_to(F.lit(2.675), 2))
    assert (row.tie, row.up) == (0.12, 2.68)
    df = spark.range(1000).select((F.col("id") / 10.0).alias("x"))
    assert df.agg(exact_sum(F.col("x"))).first()[0] == 49950.0


def test_draw_is_defined_for_huge_keys(spark):
    keys = [3, 149_999, 2 ** 45 + 7]
    df = spark.createDataFrame([(k,) for k in keys], "k BIGINT")
    got = [r[0] for r in df.select(draw(F.col("k"), 53)).collect()]
    assert got == [((k * k * 53 + k * 7919 + 53) % 100003) % 1000 / 1000.0 for k in keys]


def test_references_keep_long_numbers(spark):
    row = one(spark, short=credit.business_reference("APP", F.lit(12), F.lit(2024)),
              long=credit.business_reference("CUS", F.lit(12345678)))
    assert (row.short, row.long) == ("APP-2024-000012", "CUS-12345678")


@pytest.fixture(scope="module")
def hand_made(spark):
    """Five applications: usual, no income, zero weight, no expense or loan, refinancing."""
    def frame(table, *rows):
        names = schemas.column_names(table)
        fields = [tuple(row.get(n) for n in names) for row in rows]
        return spark.createDataFrame(fields, schemas.TABLES[table])

    ids = range(1, 6)
    return Tables(spark, {
        "application": frame("application", *[
            {"id": i, "reference": f"R{i}", "monthly_payment": 300.0,
             "requested_amount": 10000.0, "loan_type_code":
             "DEBT_CONSOLIDATION" if i == 5 else "AUTO"} for i in ids]),
        "household": frame("household", *[
            {"application_id": i, "household_size": 4, "dependent_children": 2,
             "children_under_14": 1} for i in ids]),
        "account_behaviour": frame("account_behaviour", *[
            {"application_id": i, "liquid_savings": 900.0} for i in ids]),
        "income": frame("income", *[
            {"application_id": a, "monthly_amount": m, "weighting": w, "variability": v,
             "income_type_code": t, "role": "primary", "documented": d}
            for a, m, w, v, t, d in (
                (1, 2000.0, 1.0, "fixed", "SALARY", 1), (1, 500.0, 0.7, "variable",
                                                         "VARIABLE_BONUS", 0),
                (3, 800.0, 0.0, "fixed", "UNEMPLOYMENT_BENEFIT", 1),
                (4, 1500.0, 1.0, "fixed", "SALARY", 1), (5, 2000.0, 1.0, "fixed", "SALARY", 1))]),
        "expense": frame("expense", *[
            {"application_id": a, "expense_type_code": t, "monthly_amount": m,
             "counted_in_dti": n}
            for a, t, m, n in ((1, "RENT", 600.0, 1), (1, "OTHER_EXPENSE", 50.0, 0),
                               (5, "RENT", 400.0, 1))]),
        "existing_loan": frame("existing_loan", *[
            {"application_id": a, "loan_kind": k, "monthly_payment": p,
             "outstanding_balance": p * 10, "remaining_months": 10, "repaid_by_this_loan": r,
             "incidents_12m": 0}
            for a, k, p, r in ((1, "revolving", 100.0, 0), (5, "revolving", 450.0, 1),
                               (5, "mortgage", 200.0, 0))]),
    })


def test_indicators_by_hand(hand_made):
    got = {r.application_id: r for r in indicators.from_lines(hand_made).collect()}
    usual = got[1]
    assert usual.gross_income == 2500.0 and usual.weighted_income == 2350.0
    assert usual.counted_expenses == 600.0          # the uncounted line stays out
    assert usual.dti_after_pct == round((100 + 300 + 600) / 2350 * 100, 2)
    assert usual.above_hcsf_threshold == 1
    assert usual.consumption_units == round(1 + 0.5 + 0.5 + 0.3, 2)
    assert usual.variable_income_share == 0.2
    for broken in (2, 3):
        assert got[broken].indicator_error == indicators.NOT_ASSESSABLE
        assert got[broken].dti_after_pct is None
    assert got[4].counted_expenses == 0.0 and got[4].savings_months_of_expenses == 3.0
    assert got[5].payment_shock == -150.0           # relief from the refinanced loan
    assert got[5].retained_payments == 200.0


def test_rollups_by_hand(hand_made):
    income = {r.application_id: r for r in pivots.income_pivot(hand_made).collect()}
    assert (income[1].income_salary, income[1].income_bonus) == (2000.0, 500.0)
    assert income[1].undocumented_income_lines == 1 and 2 not in income
    expense = {r.application_id: r for r in pivots.expense_pivot(hand_made).collect()}
    assert expense[1].expense_other == 0.0
    loans = {r.loan_kind: r.repaid_by_this_loan for r in pivots.consolidation_loans(hand_made)
             .where("application_id = 5").collect()}
    assert loans == {"revolving": 1, "mortgage": 0}


def test_documents_agree_with_lines(spark, tiny):
    docs = documents.assemble(tiny)
    lines = indicators.from_lines(tiny).drop("application_id")
    application = tiny["application"].select(F.col("id").alias("application_id"), "reference")
    by_line = indicators.from_lines(tiny).join(application, "application_id").select(
        "reference", *indicators.INDICATORS)
    by_document = indicators.from_documents(docs).select("reference", *indicators.INDICATORS)
    assert lines.columns[-1] == "indicator_error"
    kept = by_line.join(by_document.select("reference"), "reference", "left_semi")
    assert by_document.exceptAll(kept).count() == 0 and kept.exceptAll(by_document).count() == 0


def test_effective_risk_and_maturity(spark):
    censored, horizon = rules.maturity(F.lit(10), F.lit(12))
    done, _ = rules.maturity(F.lit(12), F.lit(12))
    row = one(spark, censored=censored, horizon=horizon, done=done,
              risk=rules.effective_risk(F.lit(0.2), F.lit(70.0), F.lit(100.0)))
    assert row.censored and row.horizon == 10 and not row.done
    assert math.isclose(row.risk, 0.2 * (0.55 + 0.45 * 0.7))


def test_declines_always_carry_an_adverse_reason(spark):
    rows = spark.createDataFrame(
        [("declined", ["SOLID_SAVINGS"], None), ("declined", ["FICP_FLAG"], None),
         ("approved", [], "OVERRIDE_WEALTH")],
        "decision_result STRING, reason_codes ARRAY<STRING>, override STRING")
    got = [r.reason_codes for r in rules.with_final_reasons(rows).collect()]
    assert got == [["SOLID_SAVINGS", "INSUFFICIENT_INCOME"], ["FICP_FLAG"], ["OVERRIDE_WEALTH"]]


def test_conditions_text(spark):
    def text(**kw):
        values = dict(amount=F.lit(7000.5), reduced=F.lit(False), term=F.lit(36),
                      shortened=F.lit(False), insurance_required=F.lit(False)) | kw
        return rules.conditions_text(**values)

    row = one(spark, none=text(), both=text(reduced=F.lit(True), shortened=F.lit(True)))
    assert row.none.startswith("justificatifs")
    assert row.both == "montant ramené à 7000 EUR ; durée ramenée à 36 mois"


def test_adapter_lines_are_not_collected(spark):
    """Line tables stay one row per source line, however many an order has."""
    plan = adapter.income(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "collect_list" not in plan
