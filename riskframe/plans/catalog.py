"""The registered queries: each reads the source tables of a folder, whole."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from riskframe.functions import credit
from riskframe.functions.numeric import round_to
from riskframe.operators import (bias, dataset, indicators, metrics, modelling, ordered,
                                 pivots, quality, rules, sampling, scoring)
from riskframe.plans import warehouse
from riskframe.plans.warehouse import tables
from riskframe.session import dropping_shuffles
from riskframe.sources import adapter, documents, exports, refdata
from riskframe.streaming import score_stream as streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__.removesuffix("_from_lines")] = fn
    return fn


def iso_dates(df: DataFrame) -> DataFrame:
    """Dates as ISO text, the form the published tables use."""
    return df.select(*[F.col(f.name).cast("string").alias(f.name)
                       if f.dataType.typeName() == "date" else F.col(f.name)
                       for f in df.schema.fields])


def rows_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.dataset(tables(spark, sf_dir))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dataset rows with the expert PD."""
    return rows_of(spark, sf_dir).withColumn("pd", credit.expert_pd())


def labelled_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (scored(spark, sf_dir).where("default_flag IS NOT NULL")
            .withColumn("y", F.col("default_flag")))


def decided_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decided rows when every draw takes its most likely branch."""
    rows = rules.with_expert_risk(rules.with_reasons(
        dataset.situation(tables(spark, sf_dir))))
    return rules.with_final_reasons(rules.with_policy(rows))


def parsed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents assembled from the tables, sent through JSON text and read back."""
    texts = documents.to_text(documents.assemble(tables(spark, sf_dir)))
    return documents.with_defaults(documents.parse(texts))


# ---- tables and rollups -------------------------------------------------------------
@query
def indicators_from_lines(spark, sf_dir):
    return indicators.from_lines(tables(spark, sf_dir))


@query
def income_pivot(spark, sf_dir):
    return pivots.income_pivot(tables(spark, sf_dir))


@query
def expense_pivot(spark, sf_dir):
    return pivots.expense_pivot(tables(spark, sf_dir))


@query
def loan_rollup(spark, sf_dir):
    return pivots.loan_rollup(tables(spark, sf_dir))


@query
def reason_rollup(spark, sf_dir):
    return pivots.reason_rollup(tables(spark, sf_dir))


@query
def consolidation(spark, sf_dir):
    loans = pivots.consolidation_loans(tables(spark, sf_dir))
    return loans.groupBy("application_id").agg(
        F.count(F.lit(1)).alias("loans"), F.sum("repaid_by_this_loan").alias("repaid"))


@query
def v_dataset(spark, sf_dir):
    return iso_dates(rows_of(spark, sf_dir))


@query
def class_balance(spark, sf_dir):
    return dataset.class_balance(rows_of(spark, sf_dir))


@query
def authorship_stats(spark, sf_dir):
    t = tables(spark, sf_dir)
    routed = quality.route_rationales(adapter.rationale_batches(spark, sf_dir), t)
    return quality.authorship(quality.merge_rationales(t["decision"], routed))


# ---- export -------------------------------------------------------------------------
@query
def export_features(spark, sf_dir):
    return exports.role_matrix(rows_of(spark, sf_dir), "feature")


@query
def export_targets(spark, sf_dir):
    return exports.role_matrix(rows_of(spark, sf_dir), "target")


@query
def export_protected(spark, sf_dir):
    return exports.role_matrix(rows_of(spark, sf_dir), "protected")


@query
def export_summary(spark, sf_dir):
    return exports.export_summary(rows_of(spark, sf_dir))


@query
def training_matrix(spark, sf_dir):
    """Export to CSV, read back with declared types, join X and y, drop unlabelled rows."""
    folder = warehouse.scratch(spark, "export")
    exports.export(rows_of(spark, sf_dir), folder)
    rows = exports.training_rows(spark, folder, "train", "default_flag")
    return rows.select(exports.KEY, "department", "requested_amount", "dti_after_pct",
                       "co_borrower_contract", "months_in_job", "default_flag")


@query
def provenance(spark, sf_dir):
    return exports.provenance(tables(spark, sf_dir), seed=0, intensity=0.0,
                              reference_date=warehouse.REFERENCE_DATE)


@query
def lookup(spark, sf_dir):
    """Rows of the references named in the rationale batches."""
    wanted = (adapter.rationale_batches(spark, sf_dir)
              .select(F.col("reference").alias("application_reference")))
    rows = rows_of(spark, sf_dir).select("application_reference", "loan_type",
                                         "requested_amount", "decision_result")
    return dataset.lookup(rows, wanted)


@query
def ordered_limit(spark, sf_dir):
    """The first thousand files in application order."""
    rows = rows_of(spark, sf_dir).select("application_id", "split", "decision_result")
    return sampling.first_rows(rows, 1000)


# ---- scalar formulas ----------------------------------------------------------------
@query
def instalment(spark, sf_dir):
    a = tables(spark, sf_dir)["application"]
    excl = credit.level_payment(F.col("requested_amount"), F.col("nominal_rate"),
                                F.col("term_months"))
    zero = credit.level_payment(F.col("requested_amount"), F.lit(0.0), F.col("term_months"))
    bad = F.col("term_months") - 60
    cover = credit.insurance_cost(F.col("requested_amount"), F.col("insurance_taken"))
    return a.select("reference", excl.alias("payment"), zero.alias("zero_rate_payment"),
                    credit.total_payment(excl, cover).alias("total_payment"),
                    credit.level_payment(F.col("requested_amount"), F.col("nominal_rate"), bad)
                    .alias("shifted_payment"),
                    credit.level_payment_error(F.col("requested_amount"), bad).alias("error"))


@query
def affordable_principal(spark, sf_dir):
    rows = rows_of(spark, sf_dir)
    amount = credit.affordable_principal(
        F.col("weighted_income"), F.lit(0.105), F.col("nominal_rate"), F.col("term_months"),
        *(F.try_element_at(F.create_map(*[F.lit(x) for code, both in refdata.AMOUNT_BOUNDS.items()
                                         for x in (code, float(both[i]))]), F.col("loan_type")) for i in (0, 1)))
    return rows.select("application_reference", amount.alias("principal"),
                       credit.usury_cap(amount).alias("usury_cap"))


@query
def grades(spark, sf_dir):
    return scored(spark, sf_dir).select(
        "application_reference", "pd", credit.grade_from_pd(F.col("pd")).alias("pd_grade"),
        credit.grade_from_score(F.col("risk_score")).alias("score_grade"))


@query
def split_assignment(spark, sf_dir):
    orders = adapter.source(spark, sf_dir, "orders")
    return (orders.groupBy(credit.split_of(F.col("o_orderkey")).alias("split"))
            .agg(F.count(F.lit(1)).alias("applications")))


@query
def contract_wording(spark, sf_dir):
    e = tables(spark, sf_dir)["employment"]
    return e.groupBy(credit.contract_wording(F.col("contract_code")).alias("contract_fr"),
                     credit.stability_of(F.col("contract_code")).alias("stability")).agg(
        F.count(F.lit(1)).alias("n"))


# ---- rules --------------------------------------------------------------------------
@query
def coded_reasons(spark, sf_dir):
    rows = rules.with_reasons(dataset.situation(tables(spark, sf_dir)))
    return rows.select("application_reference",
                       F.array_join("reason_codes", "|").alias("reason_codes"))


@query
def expert_pd(spark, sf_dir):
    return scored(spark, sf_dir).select("application_reference", "pd")


@query
def policy_route(spark, sf_dir):
    return decided_majority(spark, sf_dir).select(
        "application_reference", "risk_score", F.col("hard_decline").cast("int"),
        F.col("grey_zone").cast("int"), "decision_result",
        F.col("deferral_candidate").cast("int"), rules.override_class().alias("override_class"),
        F.array_join("reason_codes", "|").alias("final_reasons"))


@query
def decisions(spark, sf_dir):
    return iso_dates(tables(spark, sf_dir)["decision"])


@query
def rationale_template(spark, sf_dir):
    d = tables(spark, sf_dir)["decision"]
    return d.select("application_id", "conditions", "rationale")


@query
def outcome_maturity(spark, sf_dir):
    """Observed and counterfactual outcomes in one list."""
    t = tables(spark, sf_dir)
    real = t["outcome"].withColumn("kind", F.lit("observed"))
    other = t["counterfactual_outcome"].select(
        "application_id", "status", "observation_months", "missed_payments",
        F.lit("counterfactual").alias("kind"))
    return iso_dates(real.unionByName(other, allowMissingColumns=True))


@query
def admission(spark, sf_dir):
    t = tables(spark, sf_dir)
    measured = indicators.from_lines(t).select(
        "application_id", "weighted_income", "dti_before_pct", "dti_after_pct")
    rows = t["application"].select(F.col("id").alias("application_id"), "reference", "apr",
                                   "requested_amount").join(measured, "application_id")
    return rules.admission(rows).select("reference", "reject_reason")


@query
def scoring_warnings(spark, sf_dir):
    rows = scored(spark, sf_dir)
    return rows.select("application_reference",
                       F.array_join(rules.scoring_warnings(), " / ").alias("warnings"))


# ---- checks -------------------------------------------------------------------------
@query
def check_incomplete(spark, sf_dir):
    return quality.incomplete_applications(tables(spark, sf_dir))


@query
def check_co_borrower(spark, sf_dir):
    return quality.co_borrower_mismatch(tables(spark, sf_dir))


@query
def check_decline_reason(spark, sf_dir):
    return quality.declines_without_reason(tables(spark, sf_dir))


@query
def check_warnings(spark, sf_dir):
    t = tables(spark, sf_dir)
    return quality.business_warnings(dataset.dataset(t), t)


@query
def check_outcomes(spark, sf_dir):
    return quality.outcome_summary(tables(spark, sf_dir))


@query
def check_decisions(spark, sf_dir):
    return quality.decision_summary(tables(spark, sf_dir))


@query
def check_domains(spark, sf_dir):
    return quality.domain_violations(tables(spark, sf_dir))


@query
def check_unique(spark, sf_dir):
    return quality.uniqueness_summary(tables(spark, sf_dir))


@query
def check_references(spark, sf_dir):
    return quality.reference_summary(tables(spark, sf_dir))


@query
def role_census(spark, sf_dir):
    """Columns per role, with the filled cells each role has in the dataset."""
    rows = rows_of(spark, sf_dir)
    filled = rows.agg(*[F.count(c).alias(c) for c in rows.columns])
    cells = filled.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).alias("filled"))
        for c in rows.columns])).alias("c")).select("c.*")
    # 104 dictionary rows.
    dictionary = F.broadcast(refdata.variable_dictionary(spark).select("column_name", "role"))
    return cells.join(dictionary, "column_name").groupBy("role").agg(
        F.count(F.lit(1)).alias("columns"), F.sum("filled").alias("filled_cells"))


# ---- documents ----------------------------------------------------------------------
@query
def document_validation(spark, sf_dir):
    return documents.validate(parsed_documents(spark, sf_dir)).select(
        "reference", F.array_join("errors", " / ").alias("errors"))


@query
def indicators_from_documents(spark, sf_dir):
    docs = documents.valid(documents.validate(parsed_documents(spark, sf_dir)))
    return indicators.from_documents(docs).select(
        "reference", *indicators.INDICATORS, "indicator_error")


# ---- measures on the expert card ----------------------------------------------------
@query
def scorecard_metrics(spark, sf_dir):
    return metrics.metrics(labelled_scores(spark, sf_dir), ["split"])


@query
def score_bands(spark, sf_dir):
    return metrics.score_bands(labelled_scores(spark, sf_dir), "application_id")


@query
def cutoffs(spark, sf_dir):
    return metrics.cutoffs(labelled_scores(spark, sf_dir))


@query
def domain_bounds(spark, sf_dir):
    return metrics.domain_bounds(labelled_scores(spark, sf_dir))


@query
def out_of_domain(spark, sf_dir):
    """Files whose PD exceeds the 99.9 % quantile of the labelled training files."""
    train = labelled_scores(spark, sf_dir).where("split = 'train'")
    limit = F.broadcast(metrics.domain_bounds(train).withColumn("_one", F.lit(1)))
    return (scored(spark, sf_dir).withColumn("_one", F.lit(1)).join(limit, "_one")
            .select("application_reference", "pd",
                    (F.col("pd") > F.col("pd_q999")).cast("int").alias("out_of_domain")))


@query
def bias_audit(spark, sf_dir):
    return bias.bias_audit(labelled_scores(spark, sf_dir))


@query
def imputation_values(spark, sf_dir):
    """Median of every numeric feature and most frequent level of the others, on train."""
    train = rows_of(spark, sf_dir).where("split = 'train'")
    return imputation(train)


def imputation(train: DataFrame) -> DataFrame:
    """The dataset is planned once: its training features are stored, and read by each round."""
    features = refdata.columns_with_role("feature")
    numeric = [c for c in features if refdata.DATA_TYPE[c] in ("numeric", "integer", "boolean")]
    other = [c for c in features if c not in numeric]
    spark = train.sparkSession
    folder = warehouse.scratch(spark, "imputation")
    train.select(*[F.col(c).cast("double").alias(c) for c in numeric],
                 *[F.col(c).cast("string").alias(c) for c in other]).write.parquet(folder)
    stored = spark.read.parquet(folder)
    medians = ordered.column_quantiles(stored.select(*numeric), numeric, [0.5]).select(
        "variable", F.col("quantile").alias("median"), F.lit(None).cast("string").alias("level"))
    long = stored.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("variable"), F.col(c).alias("value")) for c in other])).alias("e")).select("e.*")
    levels = ordered.most_frequent(long).select("variable", F.lit(None).cast("double").alias("median"), "level")
    return medians.unionByName(levels)


@query
def population_target(spark, sf_dir):
    return bias.population_rates(rows_of(spark, sf_dir))


@query
def fuzzy_rows(spark, sf_dir):
    train = bias.population(scored(spark, sf_dir)).where("split = 'train'")
    return bias.fuzzy_rows(train).select("application_reference", "label", "weight")


# ---- curation -----------------------------------------------------------------------
@query
def stratum_counts(spark, sf_dir):
    return sampling.stratum_counts(rows_of(spark, sf_dir))


@query
def stratified_sample(spark, sf_dir):
    return sampling.stratified_sample(rows_of(spark, sf_dir))


@query
def rationale_batches(spark, sf_dir):
    """Nested summaries of the stratified sample, shuffled into batches."""
    t = tables(spark, sf_dir)
    rows = dataset.dataset(t)
    nested = sampling.batched(exports.summaries(rows, t, sampling.stratified_sample(rows)))
    return nested.select(
        "batch", "reference", F.col("borrower.contract_fr").alias("contract_fr"),
        F.col("operation.requested_amount_eur").alias("requested_amount_eur"),
        F.col("decision.result").alias("result"),
        F.array_join("reasons.code", "|").alias("reasons"), "_stratum")


@query
def rationale_load(spark, sf_dir):
    t = tables(spark, sf_dir)
    routed = quality.route_rationales(adapter.rationale_batches(spark, sf_dir), t)
    return quality.route_summary(routed)


@query
def rationale_routes(spark, sf_dir):
    t = tables(spark, sf_dir)
    routed = quality.route_rationales(adapter.rationale_batches(spark, sf_dir), t)
    return routed.select("reference", "file_number", "position", "route",
                         F.length("rationale").alias("characters"))


@query
def rationale_merge(spark, sf_dir):
    t = tables(spark, sf_dir)
    routed = quality.route_rationales(adapter.rationale_batches(spark, sf_dir), t)
    return quality.merge_rationales(t["decision"], routed).select(
        "application_id", "decided_by", "rationale")


# ---- explanation and sizing on the expert card ----------------------------------------
@query
def contributions_expert(spark, sf_dir):
    """Material factors per file, five in each direction, numbered by strength."""
    factors = scoring.expert_factors()
    rows = rows_of(spark, sf_dir).select("application_reference", factors.alias("f"))
    sides = F.array(*[
        F.struct(F.lit(name).alias("direction"),
                 scoring.top_factors(F.col("f"), adverse).alias("factors"))
        for name, adverse in (("adverse", True), ("favourable", False))])
    long = rows.select("application_reference", F.explode(sides).alias("s"))
    return long.select("application_reference", "s.direction",
                       F.posexplode("s.factors").alias("place", "factor")).select(
        "application_reference", "direction", (F.col("place") + 1).alias("place"),
        F.col("factor.variable").alias("variable"),
        F.col("factor.contribution").alias("contribution"))


@query
def document_features(spark, sf_dir):
    """Line counts that assessable documents carry, which must be those of the line tables."""
    features = scoring.document_features(
        documents.valid(documents.validate(parsed_documents(spark, sf_dir)))).where("indicator_error IS NULL")
    return features.select("reference", *[F.col(c).cast("bigint").alias(c) for c in (
        "existing_loans", "revolving_loans", "loan_incidents_12m", "undocumented_income_lines")])


@query
def max_amount(spark, sf_dir):
    docs = documents.valid(documents.validate(parsed_documents(spark, sf_dir)))
    inputs = scoring.sizing_frame(docs).withColumn("initial_pd", credit.expert_pd())
    return scoring.max_amount(inputs, scoring.expert_pd_at)


# ---- models -----------------------------------------------------------------------------
_CARDS: dict[tuple[str, str], modelling.Card] = {}


_ROWS: dict[tuple[str, str], DataFrame] = {}
#: What models read of an analytical row besides their inputs.
MODEL_KEYS = ["application_id", modelling.KEY, "split", "decision_result", "default_flag", "counterfactual_default_flag"]


def _stored(rows: DataFrame, purpose: str) -> DataFrame:
    """Rows written to the shared folder and read from there."""
    spark = rows.sparkSession
    folder = warehouse.scratch(spark, purpose)
    with dropping_shuffles(spark):
        rows.write.parquet(folder)
    return spark.read.schema(rows.schema).parquet(folder)


def model_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys, targets and features of all analytical rows, worked out and stored once per session.

    A model reads them several times, for each split and candidate; without the store each time
    joins all tables again.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _ROWS:
        _ROWS[key] = _stored(rows_of(spark, sf_dir).select(
            *dict.fromkeys([*MODEL_KEYS, *refdata.columns_with_role("feature")])), "model-rows")
    return _ROWS[key]


def card_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for the scorecard: labelled rows of all splits with its 35 variables.

    They are kept on disk in the tasks and the order that they come in, since the last bits of a
    fit, and with them the fingerprint of the card, depend on that order.
    """
    own = (spark.sparkContext.applicationId, f"{sf_dir} card")
    if own not in _ROWS:
        _ROWS[own] = rows_of(spark, sf_dir).where("default_flag IS NOT NULL").select(
            *dict.fromkeys([*MODEL_KEYS, *modelling.SCORECARD_VARIABLES])).persist(StorageLevel.DISK_ONLY)
    return _ROWS[own]


def default_card(spark: SparkSession, sf_dir: str) -> modelling.Card:
    """The 35-variable logistic card of a folder, fitted once per session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _CARDS:
        columns = modelling.SCORECARD_VARIABLES
        rows = card_rows(spark, sf_dir)
        train = modelling.default_rows(rows, "train", columns)
        with modelling.held(train):
            card = modelling.logistic(train, columns, 0.1)
            scores = card.transform(train).select("pd", F.col("label").alias("y"))
            card.domain = metrics.domain_bounds(scores).first().asDict()
        on_test = card.transform(modelling.default_rows(rows, "test", columns)).select("pd", F.col("label").alias("y"))
        card.measures = metrics.metrics(on_test).first().asDict()
        _CARDS[key] = card
    return _CARDS[key]


def production_card(spark: SparkSession, sf_dir: str) -> modelling.Card:
    """The logistic card of a folder, calibrated, bounded and measured once per session.

    Documents carry its 35 variables, not all that the widest candidate of the selection wants.
    """
    key = (spark.sparkContext.applicationId, f"{sf_dir} production")
    if key not in _CARDS:
        _CARDS[key] = modelling.finished(default_card(spark, sf_dir), card_rows(spark, sf_dir),
                                           modelling.candidates()["logistic_C0.1"])
    return _CARDS[key]


def test_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modelling.default_rows(card_rows(spark, sf_dir), "test",
                                  modelling.SCORECARD_VARIABLES)


@query
def logistic_fit(spark, sf_dir):
    """Test predictions of the logistic card."""
    return default_card(spark, sf_dir).transform(test_rows(spark, sf_dir)).select(
        modelling.KEY, "pd", F.col("label").alias("observed_default"))


@query
def boosted_fit(spark, sf_dir):
    """Test measures of a boosted card of depth 3."""
    everything = refdata.columns_with_role("feature")
    rows = model_rows(spark, sf_dir)
    card = modelling.boosted(modelling.default_rows(rows, "train", everything), everything, 3)
    scores = card.transform(modelling.default_rows(rows, "test", everything))
    return metrics.metrics(scores.select("pd", F.col("label").alias("y")))


@query
def sign_audit(spark, sf_dir):
    """Every audited coefficient with its expected side and whether it is an anomaly."""
    card = default_card(spark, sf_dir)
    coefficients = modelling.coefficient_table(spark, card)
    odd = modelling.sign_audit(coefficients).select("variable", F.lit(1).alias("_odd"))
    expected = F.broadcast(modelling.expectations(spark))
    return (coefficients.join(expected, "variable").join(odd, "variable", "left")
            .select("variable", round_to(F.col("coefficient"), 4).alias("coefficient"),
                    "expected", F.coalesce("_odd", F.lit(0)).alias("anomaly")))


@query
def model_selection(spark, sf_dir):
    """Validation AUC and sign anomalies of all candidates, with the choice made."""
    chosen = modelling.select_card(model_rows(spark, sf_dir))
    return spark.createDataFrame(
        [(n, chosen.auc[n], chosen.anomalies[n], int(n == chosen.production))
         for n in chosen.cards], "candidate STRING, validation_auc DOUBLE, "
        "sign_anomalies INT, production INT")


@query
def oof_calibration(spark, sf_dir):
    """Out-of-fold scores of the training files and the calibrated value of each."""
    columns = modelling.SCORECARD_VARIABLES
    rows = card_rows(spark, sf_dir)
    train = modelling.default_rows(rows, "train", columns)
    oof = modelling.out_of_fold(train, modelling.candidates()["logistic_C0.1"]).persist()
    card, _ = modelling.calibrate(default_card(spark, sf_dir), oof,
                                  modelling.default_rows(rows, "val", columns))
    return modelling.apply_calibration(oof, card.calibration, card.calibrator).select(
        "application_id", "raw_pd", "pd", F.lit(card.calibration).alias("calibration"))


@query
def stratified_folds(spark, sf_dir):
    """The fold of every labelled training file: equal shares of both classes in each."""
    train = modelling.default_rows(rows_of(spark, sf_dir), "train", []).select("application_id", "label").persist()
    return modelling.with_folds(train).select("application_id", F.col("label").cast("int").alias("label"), "fold")


@query
def permutation_importance(spark, sf_dir):
    return modelling.permutation_importance(default_card(spark, sf_dir),
                                            test_rows(spark, sf_dir))


@query
def importance_expert(spark, sf_dir):
    """Mean loss of AUC of the expert card on test when one of its inputs is shuffled."""
    rows = labelled_scores(spark, sf_dir).where("split = 'test'")
    base = metrics.metrics(rows).first()["auc"]
    return modelling.mean_loss(base, modelling.swapped_inputs(
        rows, credit.EXPERT_INPUTS, lambda long: long.withColumn("pd", credit.expert_pd()),
        modelling.IMPORTANCE_REPEATS, "y"))


@query
def top_drivers_expert(spark, sf_dir):
    """The inputs of the expert card that matter most on test."""
    return modelling.top_drivers(importance_expert(spark, sf_dir))


@query
def isotonic_expert(spark, sf_dir):
    """Expert scores of the labelled training files, calibrated isotonically on themselves."""
    rows = labelled_scores(spark, sf_dir).where("split = 'train'").select(
        "application_id", F.col("pd").alias("raw_pd"), F.col("y").alias("label"))
    fitted = modelling.fit_isotonic(rows)
    return modelling.apply_calibration(rows, "isotonic", fitted).select("application_id", "raw_pd", "pd")


def expert_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(actual, predicted): the stored decision against the one that the expert PD alone would give."""
    return scored(spark, sf_dir).where("decision_result IS NOT NULL").select(
        F.col("decision_result").alias("actual"),
        F.when(F.col("pd") <= 0.05, "approved").when(F.col("pd") <= 0.12, "approved_with_conditions")
        .otherwise("declined").alias("predicted"))


@query
def confusion_expert(spark, sf_dir):
    """Stored decisions (rows) against those of the expert PD (columns)."""
    return metrics.confusion(expert_decisions(spark, sf_dir), ["approved", "approved_with_conditions", "declined"])


@query
def class_report_expert(spark, sf_dir):
    """Precision, recall, F1 and support of the decisions of the expert PD."""
    return metrics.class_report(expert_decisions(spark, sf_dir))


@query
def factor_labels_expert(spark, sf_dir):
    """Every term of the expert card with its business label and the file's own value."""
    rows = rows_of(spark, sf_dir)
    factors = scoring.contributions(rows, scoring.expert_factors(), "application_reference")
    return scoring.factor_labels(factors, rows, "application_reference", refdata.columns_with_role("feature")).select(
        "application_reference", "variable", "label")


@query
def batches_written(spark, sf_dir):
    """Nested summaries written as one JSON folder per batch and read back."""
    t = tables(spark, sf_dir)
    rows = dataset.dataset(t)
    folder = warehouse.scratch(spark, "batches")
    nested = exports.summaries(rows, t, sampling.stratified_sample(rows))
    exports.write_batches(nested, folder)
    back = spark.read.schema(nested.drop("application_id").schema.add("batch", T.IntegerType())).json(folder)
    return back.select(
        "batch", "reference", F.col("borrower.contract_fr").alias("contract_fr"),
        F.col("operation.requested_amount_eur").alias("requested_amount_eur"),
        F.col("financials.dti_after_pct").alias("dti_after_pct"), F.col("decision.result").alias("result"),
        F.array_join("reasons.code", "|").alias("reasons"), "_stratum")


_DECISIONS: dict[tuple[str, str], modelling.DecisionModel] = {}


def default_decision(spark: SparkSession, sf_dir: str) -> modelling.DecisionModel:
    """The decision model of a folder on all features, fitted once per session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _DECISIONS:
        _DECISIONS[key] = modelling.train_decision(model_rows(spark, sf_dir))[0]
    return _DECISIONS[key]


@query
def decision_model(spark, sf_dir):
    """Per-class report of the decision model on test."""
    model = default_decision(spark, sf_dir)
    test = modelling.decision_rows(model_rows(spark, sf_dir), "test", model.columns)
    return metrics.class_report(model.predict(test).select("actual", "predicted"))


@query
def dataset_scores(spark, sf_dir):
    """Every stored file scored: PD, grade, predicted and actual decision, text excerpt, factors."""
    found = scoring.score_dataset(rows_of(spark, sf_dir), production_card(spark, sf_dir), default_decision(spark, sf_dir))
    return found.withColumns({c: F.array_join(f"{c}.variable", "|") for c in ("adverse_factors", "favourable_factors")})


@query
def selection_bias(spark, sf_dir):
    return modelling.selection_bias(model_rows(spark, sf_dir))[0]


@query
def batch_score(spark, sf_dir):
    """Every document scored with the logistic card."""
    texts = documents.to_text(documents.assemble(tables(spark, sf_dir)))
    scored = scoring.score_documents(documents.parse(texts), default_card(spark, sf_dir))
    return flat_scores(scored)


@query
def production_scores(spark, sf_dir):
    """Every document scored with the calibrated card."""
    texts = documents.to_text(documents.assemble(tables(spark, sf_dir)))
    return flat_scores(scoring.score_documents(documents.parse(texts), production_card(spark, sf_dir)))


def flat_scores(scored: DataFrame) -> DataFrame:
    return scored.select(
        "evaluation_id", "reference", "probability_of_default", "risk_grade", "out_of_domain",
        F.col("indicators.dti_after_pct").alias("dti_after_pct"),
        F.array_join("adverse_factors.variable", "|").alias("adverse_factors"),
        F.array_join("favourable_factors.variable", "|").alias("favourable_factors"),
        F.col("model.fingerprint").alias("fingerprint"), F.col("model.calibration").alias("calibration"),
        F.col("model.test_auc").alias("test_auc"), F.col("model.test_gini").alias("test_gini"),
        F.array_join("warnings", " / ").alias("warnings"))


@query
def max_amount_fitted(spark, sf_dir):
    """Sizing with the fitted logistic card."""
    docs = documents.valid(documents.validate(parsed_documents(spark, sf_dir)))
    card = default_card(spark, sf_dir)
    inputs, pd_at = scoring.with_linear_sizing(scoring.sizing_frame(docs), card)
    return scoring.max_amount(inputs, pd_at, card=card)


@query
def stream_score(spark, sf_dir):
    """Documents written as files, scored by the stream, read back."""
    return flat_scores(spark.read.parquet(f"{_streamed(spark, sf_dir)}/out/scores"))


@query
def stream_rejects(spark, sf_dir):
    """Documents that the stream turned away, each with its errors."""
    rejects = spark.read.schema("reference string, errors array<string>, batch bigint").parquet(
        f"{_streamed(spark, sf_dir)}/out/rejects")
    return rejects.select("reference", F.array_join("errors", " / ").alias("errors"))


@query
def batch_rejects(spark, sf_dir):
    """Documents that the batch score turns away, each with its errors."""
    texts = documents.to_text(documents.assemble(tables(spark, sf_dir)))
    return scoring.rejected_documents(documents.parse(texts)).select(
        "reference", F.array_join("errors", " / ").alias("errors"))


def _streamed(spark: SparkSession, sf_dir: str) -> str:
    folder = warehouse.scratch(spark, "stream")
    with dropping_shuffles(spark):
        documents.assemble(tables(spark, sf_dir)).write.option("compression", "gzip").json(f"{folder}/in")
    streams.score_stream(spark, f"{folder}/in", default_card(spark, sf_dir),
                         f"{folder}/out", f"{folder}/state").awaitTermination()
    return folder
