"""Nested documents: defaults, contract, scoring inputs, sizing."""

import copy
import json

import pytest
from pyspark.sql import functions as F

from riskframe.functions import credit
from riskframe.operators import indicators, scoring
from riskframe.sources import documents


def document(reference="D", **changes):
    body = {
        "reference": reference,
        "operation": {"loan_type": "AUTO", "requested_amount": 15000.0, "term_months": 60,
                      "nominal_rate": 5.0, "apr": 5.6, "usury_rate_cap": 8.2,
                      "insurance_taken": True, "monthly_insurance_cost": 5.25},
        "borrower": {"occupation": "CLERICAL", "contract_type": "PERMANENT",
                     "months_in_job": 48},
        "household": {"household_size": 2, "housing_status": "TENANT", "months_at_address": 24},
        "behaviour": {"relationship_months": 60, "liquid_savings": 2500.0,
                      "salary_domiciled": True},
        "incomes": [{"type": "SALARY", "monthly_amount": 2200.0}],
        "expenses": [{"type": "RENT", "monthly_amount": 650.0},
                     {"type": "OTHER_EXPENSE", "monthly_amount": 90.0, "counted_in_dti": False}],
        "existing_loans": [{"loan_kind": "revolving", "monthly_payment": 60.0,
                            "outstanding_balance": 900.0, "remaining_months": 15,
                            "repaid_by_this_loan": True}],
    }
    for path, value in changes.items():
        at = body
        *parents, last = path.split("__")
        for p in parents:
            at = at[p]
        if value is ...:
            at.pop(last)
        else:
            at[last] = copy.deepcopy(value)
    return body


def frame(spark, *bodies):
    texts = spark.createDataFrame([(json.dumps(b),) for b in bodies], "value STRING")
    return documents.with_defaults(documents.parse(texts))


BAD = {
    "usury": ({"operation__apr": 9.0}, "APR 9.0 above the usury ceiling 8.2"),
    "product": ({"operation__loan_type": "BOAT"}, "operation.loan_type"),
    "term": ({"operation__term_months": 121}, "operation.term_months"),
    "amount": ({"operation__requested_amount": 0}, "operation.requested_amount"),
    "channel": ({"operation__channel": "fax"}, "operation.channel"),
    "contract": ({"borrower__contract_type": "GIG"}, "borrower.contract_type"),
    "missing": ({"borrower__months_in_job": ...}, "borrower.months_in_job"),
    "adults": ({"household__dependent_children": 2}, "at least one adult"),
    "children": ({"household__children_under_14": 1}, "children_under_14 >"),
    "housing": ({"household__housing_status": "CAVE"}, "household.housing_status"),
    "no income": ({"incomes": []}, "incomes must not be empty"),
    "weight": ({"incomes": [{"type": "SALARY", "monthly_amount": 10, "weighting": 1.5}]},
               "incomes item"),
    "expense": ({"expenses": [{"type": "RENT", "monthly_amount": 0}]}, "expenses item"),
    "loan": ({"existing_loans": [{"loan_kind": "iou", "monthly_payment": 1,
                                  "outstanding_balance": 1, "remaining_months": 1}]},
             "existing_loans item"),
    "days": ({"behaviour__days_overdrawn_12m": 400}, "behaviour.days_overdrawn_12m"),
}


def test_contract(spark):
    bodies = [document("good")] + [document(name, **change) for name, (change, _) in BAD.items()]
    got = {r.reference: r.errors for r in documents.validate(frame(spark, *bodies)).collect()}
    assert got.pop("good") == []
    for name, errors in got.items():
        assert len(errors) == 1 and BAD[name][1] in errors[0], (name, errors)


def test_broken_json_is_invalid(spark):
    texts = spark.createDataFrame([("{not json",)], "value STRING")
    checked = documents.validate(documents.with_defaults(documents.parse(texts)))
    assert documents.valid(checked).count() == 0 and documents.invalid(checked).count() == 1


def test_defaults_and_indicators(spark):
    docs = frame(spark, document(), document("bare", expenses=..., existing_loans=...))
    rows = {r.reference: r for r in scoring.document_features(docs).collect()}
    row = rows["D"]
    payment = round(15000 * (0.05 / 12) / (1 - (1 + 0.05 / 12) ** -60), 2)
    assert row.monthly_payment == round(payment + 5.25, 2)
    assert row.counted_expenses == 650.0 and row.retained_payments == 0.0
    assert row.payment_shock == round(row.monthly_payment - 60, 2)
    assert row.dti_after_pct == round((row.monthly_payment + 650) / 2200 * 100, 2)
    assert (row.existing_loans, row.revolving_loans, row.undocumented_income_lines) == (1, 1, 0)
    assert row.channel == "branch" and row.area_type == "urban"
    assert rows["bare"].existing_loans == 0 and rows["bare"].counted_expenses == 0.0


def test_zero_income_is_an_error(spark):
    body = document(incomes=[{"type": "SALARY", "monthly_amount": 10, "weighting": 0.0}])
    assert indicators.from_documents(frame(spark, body)).first().indicator_error \
        == indicators.NOT_ASSESSABLE


def test_sizing(spark):
    risky = {"behaviour__rejected_debits_12m": 3, "behaviour__days_overdrawn_12m": 40,
             "operation__requested_amount": 45000.0}
    docs = frame(spark, document("fine"), document("cut", **risky),
                 document("hopeless", behaviour__ficp_flagged=True,
                          behaviour__days_overdrawn_12m=200),
                 document("small", operation__requested_amount=400.0,
                          behaviour__ficp_flagged=True))
    inputs = scoring.sizing_frame(documents.valid(documents.validate(docs))).withColumn(
        "initial_pd", credit.expert_pd())
    got = {r.reference: r for r in scoring.max_amount(inputs, scoring.expert_pd_at, 0.10).collect()}
    assert got["fine"].maximum_amount == 15000.0 and got["fine"].comment == scoring.MET
    cut = got["cut"]
    assert cut.pd_at_maximum <= 0.10 < cut.initial_pd
    assert 500 <= cut.maximum_amount < 45000
    assert cut.reduction_required == pytest.approx(45000 - cut.maximum_amount, abs=0.011)
    for name in ("hopeless", "small"):
        assert got[name].maximum_amount is None and got[name].pd_at_maximum is None
        assert got[name].comment == scoring.UNREACHABLE


def test_pretty_labels(spark):
    df = spark.createDataFrame(
        [("requested_amount", 12345.5), ("loan_type_AUTO", None), ("term_months", 48.0),
         ("mystery", None)], "variable STRING, value DOUBLE")
    got = [r[0] for r in df.select(scoring.pretty_label(F.col("variable"), F.col("value"))
                                   ).collect()]
    assert got == ["Requested amount (12 345.5)", "Loan product = AUTO", "Requested term (48)",
                   "mystery"]


def test_top_factors(spark):
    factors = scoring.factor_array([(n, F.lit(v)) for n, v in (
        ("a", 0.5), ("b", 0.005), ("c", -0.3), ("d", 0.7), ("e", 0.1), ("f", 0.2), ("g", 0.3),
        ("h", 0.05))])
    row = spark.range(1).select(scoring.top_factors(factors, True).alias("up"),
                                scoring.top_factors(factors, False).alias("down")).first()
    assert [f.variable for f in row.up] == ["d", "a", "g", "f", "e"]
    assert [(f.variable, f.contribution) for f in row.down] == [("c", -0.3)]


def test_rejects_come_from_one_pass(spark):
    """Broken and unmeasurable documents, with reasons, and one parse of the texts."""
    texts = [document("good"), document("no pay", incomes=[{"type": "SALARY", "monthly_amount": 10.0, "weighting": 0.0}]),
             document("broken", incomes=[]), document("huge", expenses=[{"type": "RENT", "monthly_amount": -1e300}])]
    rows = spark.createDataFrame([(t if isinstance(t, str) else json.dumps(t),) for t in texts] + [("no json",)], "value string")
    found = scoring.rejected_documents(documents.parse(rows))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1
    got = {r.reference: r.errors for r in found.collect()}
    assert set(got) == {"no pay", "broken", "huge", None}
    assert got["no pay"] == [indicators.NOT_ASSESSABLE] and got["broken"] == ["incomes must not be empty"]
    assert got["huge"] == ["expenses item not allowed"] and len(got[None]) > 10
