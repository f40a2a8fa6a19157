"""Every rule catches a row that breaks it, and nothing else."""

import pytest
from pyspark.sql import functions as F

from riskframe.operators import dataset, quality
from riskframe.sources import refdata, schemas


def wrong_value(predicate: str, column: str, kind: str):
    """A value of the column that breaks a domain rule."""
    if kind == "STRING":
        return F.lit("bogus")
    if "BETWEEN" in predicate:
        return F.lit(10 ** 6).cast(kind)
    return F.lit(-5).cast(kind)


@pytest.mark.parametrize("table", sorted(schemas.DOMAIN_RULES))
def test_domain_rules_catch_a_broken_row(tiny, table):
    kinds = dict(part.split() for part in schemas.TABLES[table].split(", "))
    base = tiny[table].limit(1)
    broken, expected = None, []
    for name, predicate in schemas.DOMAIN_RULES[table]:
        column = predicate.split()[0]
        row = base.withColumns({column: wrong_value(predicate, column, kinds[column]),
                                schemas.ROW_KEY[table]: F.lit(len(expected))})
        broken = row if broken is None else broken.unionByName(row)
        expected.append((name, str(len(expected))))
    got = {(r.rule, r.key) for r in quality.row_violations(
        broken, table, schemas.DOMAIN_RULES[table]).collect()}
    assert set(expected) <= got


def test_cross_column_rules(tiny):
    a = tiny["application"].where("apr <= usury_rate_cap").limit(1)
    bad = a.withColumns({"apr": F.lit(99.0), "co_borrower_id": F.col("customer_id"),
                         "insurance_taken": F.lit(0), "monthly_insurance_cost": F.lit(3.0)})
    rules = schemas.CROSS_COLUMN_RULES["application"]
    assert {r.rule for r in quality.row_violations(bad, "application", rules).collect()} == {
        name for name, _ in rules}
    h = tiny["household"].limit(1).withColumns({
        "dependent_children": F.lit(9), "household_size": F.lit(3), "children_under_14": F.lit(10)})
    rules = schemas.CROSS_COLUMN_RULES["household"]
    assert quality.row_violations(h, "household", rules).count() == 2


def test_unknown_is_no_violation(tiny):
    row = tiny["decision"].limit(1).withColumn("risk_score", F.lit(None).cast("int"))
    found = quality.row_violations(row, "decision", schemas.DOMAIN_RULES["decision"])
    assert found.where("rule LIKE 'risk_score%'").count() == 0
    missing = quality.row_violations(row, "decision", quality.table_rules("decision"))
    assert [r.rule for r in missing.collect()] == ["risk_score is present"]


def test_decision_and_outcome_summaries(tiny):
    d = tiny["decision"].where("result = 'declined'").limit(1).withColumn(
        "approved_amount", F.lit(1.0))
    d = d.unionByName(tiny["decision"].where("result = 'approved_with_conditions'").limit(1)
                      .withColumn("conditions", F.lit("  ")))
    got = {r.rule: r.violations for r in quality.decision_summary(
        tiny.replace(decision=d)).collect()}
    assert got["amount present iff approved"] == 1
    assert got["conditions text on a conditional approval"] == 1

    declined = tiny["decision"].where("result = 'declined'").select("application_id").limit(1)
    o = tiny["outcome"].limit(1).drop("application_id").crossJoin(declined).withColumns({
        "status": F.lit("default"), "balance_at_default": F.lit(None).cast("double"),
        "missed_payments": F.lit(2), "first_missed_payment_date": F.lit(None).cast("date")})
    got = {r.rule: r.violations for r in quality.outcome_summary(tiny.replace(outcome=o)).collect()}
    assert got["outcome on an approved application"] == 1
    assert got["missed payments are dated"] == 1 and got["default carries a balance"] == 1
    # Without a decision row the result is unknown: left to the reference check.
    orphan = o.withColumn("application_id", F.lit(10 ** 9))
    t = tiny.replace(outcome=orphan)
    assert {r.rule: r.violations for r in quality.outcome_summary(t).collect()}[
        "outcome on an approved application"] == 0
    assert quality.reference_violations(t).where(
        "rule = 'outcome.application_id -> decision'").count() == 1


def test_keys_and_references(tiny):
    twice = tiny["household"].unionByName(tiny["household"].limit(1))
    got = {r.rule: r.repeated_keys for r in quality.uniqueness_summary(
        tiny.replace(household=twice)).collect()}
    assert got["household(application_id)"] == 1
    stray = tiny["income"].limit(3).withColumn("income_type_code", F.lit("LOTTERY"))
    got = {r.rule: r for r in quality.reference_violations(
        tiny.replace(income=stray)).collect()}
    assert got["income.income_type_code -> income_type"].n == 3


def test_dictionary_gate(spark, tiny):
    rows = dataset.dataset(tiny)
    dictionary = refdata.variable_dictionary(spark)
    assert quality.dictionary_orphans(rows, dictionary).count() == 0
    assert quality.dictionary_stale(rows, dictionary).count() == 0
    extra = rows.withColumn("surprise", F.lit(1)).drop("apr")
    assert quality.dictionary_orphans(extra, dictionary).first()[0] == "surprise"
    assert quality.dictionary_stale(extra, dictionary).first()[0] == "apr"
    with pytest.raises(quality.InconsistentExport):
        quality.require_consistent(extra.columns, refdata.ROLE)
    with pytest.raises(quality.InconsistentExport):
        quality.require_consistent([c for c in rows.columns if c != "apr"], refdata.ROLE)
    census = {r.role: r.columns for r in dataset.role_census(spark).collect()}
    assert census == {"meta": 10, "protected": 4, "feature": 74, "target": 16}


def test_decline_without_reason(tiny):
    none = tiny["decision_reason"].where("false")
    declined = tiny["decision"].where("result = 'declined'").count()
    # the load leaves out the reasons of every 211th application
    expected = tiny["decision"].where("result = 'declined' AND application_id % 211 = 0").join(
        tiny["application"].select(F.col("id").alias("application_id"), "reference"), "application_id")
    found = [r.reference for r in quality.declines_without_reason(tiny).collect()]
    assert found and sorted(found) == sorted(r.reference for r in expected.collect())
    assert quality.declines_without_reason(tiny.replace(decision_reason=none)).count() == declined


def test_rationale_routes(spark, tiny):
    d = {r.result: r.reference for r in tiny["decision"].join(
        tiny["application"].select(F.col("id").alias("application_id"), "reference"),
        "application_id").groupBy("result").agg(F.min("reference").alias("reference")).collect()}
    long = " et la suite du texte" * 6
    rows = [("APP-NOPE", "x" * 200, 1, 0), (d["declined"], "  court  ", 1, 1),
            (d["declined"], "Position FAVORABLE." + long, 1, 2),
            (d["approved"], "Avis Défavorable" + long, 1, 3),
            (d["declined"], " " * 50 + "Demande rejetée." + long, 1, 4),
            (d["declined"], "Demande rejetée au second tour." + long, 2, 0),
            (d["approved"], "x" * 165 + "demande rejetée", 2, 1), (None, None, 2, 2)]
    batches = spark.createDataFrame(
        rows, "reference STRING, rationale STRING, file_number INT, position BIGINT")
    routed = quality.route_rationales(batches, tiny)
    got = {(r.file_number, r.position): r.route for r in routed.collect()}
    assert [got[k] for k in ((1, 0), (1, 1), (1, 2), (1, 3), (1, 4), (2, 0), (2, 1), (2, 2))] == [
        "unknown", "short", "contradictory", "contradictory", "loaded", "loaded", "loaded",
        "unknown"]
    merged = quality.merge_rationales(tiny["decision"], routed)
    texts = [r.rationale for r in merged.where("decided_by = 'llm'").collect()]
    assert len(texts) == 2 and any(t.startswith("Demande rejetée au second") for t in texts)
    assert merged.count() == tiny["decision"].count()
