"""Fitted cards on the small tables: structure, explanation, calibration, stream parity."""

import math

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from paths import SMALL
from riskframe.operators import dataset, metrics, modelling, scoring
from riskframe.plans import warehouse
from riskframe.sources import documents
from riskframe.streaming import score_stream as streams


@pytest.fixture(scope="module")
def rows(spark):
    return dataset.dataset(warehouse.tables(spark, SMALL)).persist()


@pytest.fixture(scope="module")
def train(rows):
    return modelling.default_rows(rows, "train", modelling.SCORECARD_VARIABLES)


@pytest.fixture(scope="module")
def test_frame(rows):
    return modelling.default_rows(rows, "test", modelling.SCORECARD_VARIABLES).persist()


@pytest.fixture(scope="module")
def card(train):
    fitted = modelling.logistic(train, modelling.SCORECARD_VARIABLES, 0.1)
    scored = fitted.transform(train).select("pd", F.col("label").alias("y"))
    fitted.domain = metrics.domain_bounds(scored).first().asDict()
    return fitted


def test_card_ranks(card, test_frame):
    assert modelling.validation_auc(card, test_frame) > 0.6
    assert len(card.columns) == 35 and len(card.names) == len(card.coefficients())


def test_contributions_add_up_to_the_logit(card, test_frame):
    scored = card.transform(test_frame)
    parts = F.aggregate(scoring.card_factors(card), F.lit(0.0), lambda t, f: t + f["contribution"])
    by_variable = F.aggregate(modelling.variable_contributions(card), F.lit(0.0),
                              lambda t, x: t + x)
    intercept = float(card.model.stages[-1].intercept)
    worst = scored.select(
        F.max(F.abs(parts + intercept - vector_to_array("rawPrediction")[1])).alias("a"),
        F.max(F.abs(parts - by_variable)).alias("b")).first()
    assert worst.a < 1e-9 and worst.b < 1e-9


def test_levels_rare_unseen_and_missing(card, train, test_frame):
    """A rare level shares a bucket, a missing one takes the mode, an unseen one is zeros."""
    counts = {None: 5, "A": 100, "B": 30, "C": 3, "D": 2}
    case = modelling._level_case("x", counts)
    df = train.sparkSession.createDataFrame([(v,) for v in ("A", "C", None, "Z")], "x STRING")
    assert [r[0] for r in df.selectExpr(case).collect()] == ["A", "infrequent", "A", None]
    one = test_frame.limit(1).withColumn("occupation", F.lit("ASTRONAUT"))
    names = [n for n in card.names if n.startswith("occupation_")]
    values = card.transform(one).select(vector_to_array("features").alias("v")).first().v
    assert names and all(values[card.names.index(n)] == 0.0 for n in names)


def test_sign_audit_and_choice(spark):
    coefs = spark.createDataFrame([("months_in_job", 0.2), ("payment_shock", -0.04),
                                   ("ficp_flagged", -0.3), ("apr", 9.0)],
                                  "variable STRING, coefficient DOUBLE")
    assert {r.variable for r in modelling.sign_audit(coefs).collect()} == {
        "months_in_job", "ficp_flagged"}
    auc = {"logistic_a": 0.70, "logistic_b": 0.74, "gb_3": 0.715, "gb_6": 0.71}
    assert modelling.choose(auc, {"logistic_a": 0, "logistic_b": 2}) == ("logistic_a", "gb_3")
    assert modelling.choose({**auc, "gb_3": 0.73}, {"logistic_a": 0, "logistic_b": 2}) == (
        "gb_3", "logistic_a")
    assert modelling.choose(auc, {"logistic_a": 1, "logistic_b": 2}) == ("gb_3", None)


def test_folds_are_balanced(spark, train):
    placed = modelling.with_folds(train)
    assert placed.columns == [*train.columns, "fold"] and placed.count() == train.count()
    sizes = placed.groupBy("label", "fold").count().collect()
    for label in (0.0, 1.0):
        per_fold = [r["count"] for r in sizes if r.label == label]
        assert len(per_fold) == 5 and max(per_fold) - min(per_fold) <= 1
    few = spark.createDataFrame([(i, float(i % 50 == 0)) for i in range(103)], "application_id long, label double")
    sizes = modelling.with_folds(few).groupBy("label", "fold").count().collect()
    assert sorted(r["count"] for r in sizes if r.label == 1.0) == [1, 1, 1]


def test_calibrators(spark):
    """Isotonic is monotone and Platt improves on scores that are far too low."""
    oof = spark.range(4000).select(
        F.col("id").alias("application_id"), ((F.col("id") % 100) / 400.0).alias("raw_pd"),
        ((F.col("id") * 37 % 100) < (F.col("id") % 100)).cast("double").alias("label"))
    fitted = modelling.fit_calibrators(oof)
    raw = metrics.metrics(oof.select(F.col("raw_pd").alias("pd"), F.col("label").alias("y")))
    for kind in ("isotonic", "platt"):
        scored = modelling.apply_calibration(oof, kind, fitted[kind])
        points = [r.pd for r in scored.select("raw_pd", "pd").distinct().orderBy("raw_pd").collect()]
        assert points == sorted(points)
        better = metrics.metrics(scored.select("pd", F.col("label").alias("y"))).first().brier
        assert better < raw.first().brier
        limit = scoring.raw_target(modelling.Card("x", [], None, kind, fitted[kind]), 0.3)
        inside = scored.where(F.col("raw_pd") <= limit).agg(F.max("pd")).first()[0]
        outside = scored.where(F.col("raw_pd") > limit).agg(F.min("pd")).first()[0]
        assert inside <= 0.3 + 1e-6 and outside > 0.3 - 1e-6


def test_importance_ways_agree(card, test_frame):
    """The shortcut for linear cards gives what re-scoring every variant gives."""
    few = test_frame.limit(150).persist()
    shortcut = {r.variable: r for r in metrics.metrics(
        modelling._swapped_linear(card, few, 1), ["variable"]).collect()}
    scored = modelling.swapped_inputs(few, card.columns, lambda long: card.transform(long).withColumn(
        "pd", F.col("raw_pd")), 1)
    full = {r.variable: r for r in metrics.metrics(scored, ["variable"]).collect()}
    assert shortcut.keys() == full.keys() == set(card.columns)
    for name, row in full.items():
        assert row.auc == pytest.approx(shortcut[name].auc, abs=2e-4)


def test_save_and_load(spark, card, test_frame, tmp_path):
    modelling.save_card(card, str(tmp_path))
    back = modelling.load_card(spark, str(tmp_path))
    assert back.fingerprint() == card.fingerprint() and back.domain == card.domain
    ours = card.transform(test_frame).select("application_id", "pd")
    theirs = back.transform(test_frame).select("application_id", "pd")
    assert ours.exceptAll(theirs).count() == 0


def test_stream_equals_batch(spark, card, tiny, tmp_path):
    documents.assemble(tiny).repartition(6).write.json(str(tmp_path / "in"))
    args = (spark, str(tmp_path / "in"), card, str(tmp_path / "out"), str(tmp_path / "state"))
    streams.score_stream(*args, files_per_trigger=2).awaitTermination()
    # the last micro-batch was killed between its writes and its commit: it runs again
    commits = sorted((tmp_path / "state" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    assert len(commits) > 1
    commits[-1].unlink()
    (commits[-1].parent / f".{commits[-1].name}.crc").unlink(missing_ok=True)
    streams.score_stream(*args, files_per_trigger=2).awaitTermination()
    streams.score_stream(*args).awaitTermination()      # nothing new: nothing twice
    streamed = spark.read.parquet(str(tmp_path / "out" / "scores"))
    arrived = documents.read(spark, str(tmp_path / "in"))
    batch = scoring.score_documents(arrived, card)
    assert streamed.count() == batch.count() > 1000
    flat = ["evaluation_id", "reference", "probability_of_default", "risk_grade", "out_of_domain"]
    assert batch.select(*flat).exceptAll(streamed.select(*flat)).count() == 0
    rejects = spark.read.parquet(str(tmp_path / "out" / "rejects"))
    assert rejects.count() == scoring.rejected_documents(arrived).count() > 0
    assert rejects.count() + streamed.count() == arrived.count()
    assert rejects.where("size(errors) = 0 OR errors[0] IS NULL").count() == 0
    row = batch.first()
    assert row.model.fingerprint == card.fingerprint() and len(row.adverse_factors) <= 5


def test_sizing_with_the_fitted_card(spark, card, tiny):
    docs = documents.valid(documents.validate(documents.with_defaults(
        documents.assemble(tiny)))).limit(40)
    docs = docs.persist()
    inputs, pd_at = scoring.with_linear_sizing(scoring.sizing_frame(docs), card)
    check = inputs.select(F.max(F.abs(pd_at(F.col("requested_amount")) - F.col("raw_pd")))).first()
    assert check[0] <= 2e-6          # the split logit is the card's own logit
    fast = {r.reference: r for r in scoring.max_amount(inputs, pd_at, 0.10, card).collect()}
    for r in fast.values():
        if r.reduction_required is not None:
            assert r.pd_at_maximum <= 0.10 and r.maximum_amount < r.requested_amount
    assert any(r.reduction_required is not None for r in fast.values())


def test_score_dataset(spark, card, rows):
    model, scores = modelling.train_decision(rows, ["dti_after_pct", "ficp_flagged",
                                                    "residual_income_per_cu", "loan_type"],
                                             trees=5, with_boosting=False)
    assert set(scores) == {"logistic", "forest"}
    wanted = rows.where("split = 'test'").select("application_reference").limit(20)
    got = scoring.score_dataset(rows, card, model, wanted.persist()).collect()
    assert len(got) == 20
    assert all(r.predicted_decision in model.labels and len(r.rationale_excerpt) <= 400
               for r in got)


def test_selection_bias_report(rows):
    report, cards = modelling.selection_bias(rows)
    got = {r.model: r for r in report.collect()}
    assert set(got) == {modelling.REAL, modelling.INFERRED, modelling.ORACLE}
    assert math.isclose(got[modelling.REAL].actual_rate, got[modelling.ORACLE].actual_rate)
    assert got[modelling.ORACLE].auc >= got[modelling.REAL].auc - 0.02


def test_sizing_ways_agree(spark, rows, tiny):
    """Scoring every halving gives what the in-row search gives."""
    columns = ["dti_after_pct", "residual_income_per_cu", "requested_amount", "ficp_flagged"]
    small = modelling.logistic(modelling.default_rows(rows, "train", columns), columns, 0.1)
    docs = documents.valid(documents.validate(documents.with_defaults(
        documents.assemble(tiny)))).limit(25).persist()
    frame = scoring.sizing_frame(docs).persist()
    inputs, pd_at = scoring.with_linear_sizing(frame, small)
    names = ["reference", "initial_pd", "maximum_amount", "comment"]
    fast = scoring.max_amount(inputs, pd_at, 0.08, small).select(*names).collect()
    slow = scoring.max_amount_any(frame, small, 0.08).select(*names).collect()
    assert sorted(map(str, fast)) == sorted(map(str, slow))
    assert any(r.maximum_amount is not None and r.comment.startswith("cutting") for r in fast)


def test_a_fit_leaves_the_rows_kept_that_its_caller_keeps(rows):
    columns = ["dti_after_pct", "ficp_flagged"]
    train = modelling.default_rows(rows, "train", columns).persist()
    modelling.logistic(train, columns, 0.1)
    assert train.storageLevel.useDisk
    train.unpersist()
    modelling.logistic(train, columns, 0.1)
    assert not train.storageLevel.useDisk


def test_a_fit_runs_in_few_tasks(spark):
    many = spark.range(1000).repartition(200)
    assert modelling.gathered(many, 1000).rdd.getNumPartitions() == modelling.FIT_TASKS
    assert modelling.gathered(many, 10**8).rdd.getNumPartitions() == 200


def test_candidates_are_fitted_side_by_side(spark, monkeypatch):
    """Each fit waits for the others to have begun; one after another would never get there."""
    from threading import Barrier
    from types import SimpleNamespace
    together = Barrier(3, timeout=30)

    def fit(name, rows):
        together.wait()
        return SimpleNamespace(name=name, linear=False, rows=rows.count())

    own = spark.range(20).select("id", (F.col("id") % 2).cast("double").alias("label"))
    names = ["logistic_a", "logistic_b", "logistic_c"]
    monkeypatch.setattr(modelling, "default_rows", lambda *_: own)
    monkeypatch.setattr(modelling, "candidates", lambda *_: {n: (lambda rows, n=n: fit(n, rows)) for n in names})
    monkeypatch.setattr(modelling, "validation_auc", lambda card, _: 0.5 + names.index(card.name) / 10)
    found = modelling.select_card(own)
    assert [found.cards[n].name for n in names] == list(found.cards) == names
    assert {c.rows for c in found.cards.values()} == {20}
    assert found.production == "logistic_c" and found.challenger is None


def test_model_selection_compares_the_boosted_candidates(monkeypatch):
    from riskframe.plans import catalog

    def select(rows, *, rounds=modelling.BOOSTING_ROUNDS, with_boosting=True):
        raise InterruptedError(sorted(modelling.candidates(rounds, with_boosting)), rounds)

    monkeypatch.setattr(catalog, "model_rows", lambda *_: None)
    monkeypatch.setattr(modelling, "select_card", select)
    with pytest.raises(InterruptedError) as asked:
        catalog.model_selection(None, "")
    assert asked.value.args == (["gb_depth3", "gb_depth6", "logistic_C0.1", "logistic_C0.5", "logistic_full"], 400)


def test_decision_model_has_the_boosted_candidates(rows, monkeypatch):
    """Both boosted candidates and the logistic one, of all classes; the query asks for all features and rounds."""
    asked = []
    fit = modelling.boosting.fit
    monkeypatch.setattr(modelling.boosting, "fit", lambda vectors, classes, rounds, step, max_depth: asked.append(
        (classes, rounds, step, max_depth)) or fit(vectors, classes, 2, step, max_depth))
    model, scores = modelling.train_decision(rows, ["dti_after_pct", "ficp_flagged", "loan_type"])
    assert set(scores) == {"gb_depth6", "gb_default", "logistic"} and min(scores.values()) > 0.3
    k = len(model.labels)
    assert k == 4 and sorted(asked, key=str) == [(k, 300, 0.1, None), (k, 400, 0.06, 6)]
    assert {r.predicted for r in model.predict(rows.limit(300)).select("predicted").collect()} <= set(model.labels)

    from riskframe.plans import catalog

    def train(rows, columns=None, *, trees=100, rounds=None, with_boosting=True):
        raise LookupError(columns, rounds, with_boosting)

    monkeypatch.setattr(catalog, "model_rows", lambda *_: None)
    monkeypatch.setattr(modelling, "train_decision", train)
    spark = rows.sparkSession
    with pytest.raises(LookupError) as query:
        catalog.default_decision(spark, "nowhere")
    assert query.value.args == (None, None, True)
