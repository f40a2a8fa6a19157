"""Plans and results under skew: what must hold when tables are large and uneven."""

import re

import pytest
from pyspark.sql import functions as F

from paths import TINY
from riskframe.operators import dataset, indicators, pivots, quality
from riskframe.plans import oracle_tables, warehouse
from riskframe.plans.catalog import QUERIES
from riskframe.sources import documents


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, before)


def test_dataset_shuffles_only_rollups_and_customer_keys(tiny, no_broadcast):
    """Four rollups, two sides of the narrow customer join and its result: seven exchanges."""
    plan = plan_of(dataset.dataset(tiny))
    assert len(re.findall(r" Exchange hashpartitioning", plan)) == 7
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_unused_rollups_and_columns_are_pruned(tiny, no_broadcast):
    rows = dataset.dataset(tiny).where("split = 'test'").select("application_id", "dti_after_pct")
    plan = plan_of(rows)
    assert "monthly_amount" not in plan and "reason_code" not in plan
    assert "EqualTo(split,test)" in plan
    assert "weighted_income" not in plan


def test_documents_are_scored_in_the_row(spark, tiny):
    texts = documents.to_text(documents.assemble(tiny)).persist()
    parsed = documents.with_defaults(documents.parse(texts))
    scored = indicators.from_documents(documents.valid(documents.validate(parsed)))
    plan = plan_of(scored)
    assert " Exchange" not in plan.split("InMemoryRelation")[0]
    assert plan.split("InMemoryRelation")[0].count("from_json") == 1


def test_no_python_workers_in_registered_queries(spark, tiny):
    for name in ("v_dataset", "indicators_from_documents", "max_amount", "stratified_sample",
                 "rationale_merge", "cutoffs", "bias_audit"):
        plan = plan_of(QUERIES[name](spark, "/root/testdata/sf0.001"))
        assert not re.search(r"EvalPython|MapInPandas|FlatMapGroups|CartesianProduct", plan), name


def test_one_application_with_most_lines(tiny):
    """A file with a third of all lines: same sums, short documents."""
    many = 4000
    hot = tiny["income"].where("income_type_code = 'FAMILY_BENEFITS'").orderBy(
        "application_id").first()
    copies = tiny["income"].sparkSession.range(many).select(*[
        F.lit(hot[c]).cast(t).alias(c) for c, t in tiny["income"].dtypes])
    t = tiny.replace(income=tiny["income"].unionByName(copies))
    key = F.col("application_id") == hot.application_id
    before = pivots.income_pivot(tiny).where(key).first()
    after = pivots.income_pivot(t).where(key).first()
    assert after.income_benefits == before.income_benefits + many * hot.monthly_amount
    gross = indicators.from_lines(t).where(key).first().gross_income
    assert gross == indicators.from_lines(tiny).where(key).first().gross_income \
        + many * hot.monthly_amount
    reference = tiny["application"].where(F.col("id") == hot.application_id).first().reference
    doc = documents.assemble(t).where(F.col("reference") == reference).first()
    assert doc is None or len(doc.incomes) <= 6


def test_one_customer_with_most_applications(tiny):
    """Every application moved to one customer still finds its attributes."""
    owner = tiny["customer"].orderBy("id").first()
    moved = tiny["application"].withColumn("customer_id", F.lit(owner.id))
    rows = dataset.dataset(tiny.replace(application=moved))
    assert rows.count() == dataset.dataset(tiny).count()
    assert [r[0] for r in rows.select("customer_reference").distinct().collect()] == [
        owner.reference]
    checked = {r.rule: r for r in quality.reference_summary(
        tiny.replace(application=moved)).collect()}
    assert checked["application.customer_id -> customer"].violations == 0


def test_tables_are_loaded_once_per_session(spark):
    first = warehouse.tables(spark, "/root/testdata/sf0.001")
    assert warehouse.tables(spark, "/root/testdata/sf0.001") is first


def test_oracle_tables_are_independent_of_spark():
    assert all(isinstance(sql, str) for _, sql in oracle_tables.CTES.values())


@pytest.mark.parametrize("name", ["class_balance", "expert_pd", "lookup", "training_matrix", "check_incomplete"])
def test_tables_that_grow_are_never_broadcast(spark, tiny, name):
    """Pruned to a few narrow columns they look small, and fill the driver when there are many rows."""
    plan = plan_of(QUERIES[name](spark, TINY))
    keys = re.findall(r"BroadcastHashJoin \[(\w+)#", plan)
    assert not {"application_id", "customer_id", "application_reference", "id", "c"} & set(keys)
    assert "SortMergeJoin" in plan


def test_documents_need_no_decisions(spark, monkeypatch):
    """Indicators, decisions and outcomes are built when a query first asks for them, once."""
    built = []
    decide = warehouse.decided_rows
    monkeypatch.setattr(warehouse, "decided_rows", lambda t: built.append(1) or decide(t))
    t = warehouse.load(spark, TINY)
    assert documents.assemble(t).count() > 1000 and not built
    assert t["outcome"].count() > 0 and t["decision"].count() > 1000
    assert t.replace(income=t["income"])["decision_reason"].count() > 0 and len(built) == 1
    assert {"application", "indicators", "decision", "counterfactual_outcome"} <= set(t)


def test_buckets_grow_with_the_applications(spark, monkeypatch):
    """A task merges a bounded number of applications, however many there are."""
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    monkeypatch.setattr(warehouse, "TASK_APPLICATIONS", 100)
    try:
        t = warehouse.load(spark, TINY)
        n = int(spark.conf.get(key))
        assert n == -(-1500 // 100) and f"out of {n}" in plan_of(dataset.dataset(t))
        assert len(re.findall(r" Exchange hashpartitioning", plan_of(dataset.situation(t)))) == 6
    finally:
        spark.conf.set(key, before)
