"""Batch scoring, explanation, provenance and sizing of applications."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from riskframe.functions import credit
from riskframe.functions.numeric import round_to
from riskframe.operators import dataset, indicators, rules
from riskframe.operators.modelling import (Card, DecisionModel, apply_calibration,
                                           numeric_of)
from riskframe.session import cut_lineage
from riskframe.sources import documents as docs
from riskframe.sources import refdata
from riskframe.sources.tables import keyed_join

# ---- fixed values -----------------------------------------------------------------------
TOP_FACTORS, MATERIAL = 5, 0.01
EXCERPT = 400
TARGET_PD, LOWEST_AMOUNT, BISECTIONS = 0.05, 500.0, 40
CAVEAT = ("The model only ever learnt from approved applications. It understates the "
          "risk of profiles that are usually declined: usable for ranking, needs "
          "recalibration before pricing.")
MET = "the target is already met at the requested amount"
UNREACHABLE = ("no amount brings the PD under target: the risk lies in the profile, not in "
               "the sizing of the operation")
# -----------------------------------------------------------------------------------------


# ---- factors ------------------------------------------------------------------------------
def signed(value: Column) -> Column:
    return F.concat(F.when(value >= 0, "+").otherwise("-"),
                    F.call_function("format_number", F.abs(value), F.lit("0.000")))


def factor_array(parts: list[tuple[str, Column]]) -> Column:
    return F.array(*[F.struct(F.lit(n).alias("variable"), c.alias("contribution"))
                     for n, c in parts])


def top_factors(factors: Column, adverse: bool) -> Column:
    """The largest material contributions in one direction, strongest first.

    Sorting happens inside the row: an application has one entry per variable, so
    nothing is shuffled.
    """
    kept = F.filter(factors, lambda f: (f["contribution"] > MATERIAL) if adverse
                    else (f["contribution"] < -MATERIAL))
    weight = -1.0 if adverse else 1.0
    keyed = F.transform(kept, lambda f: F.struct(
        (f["contribution"] * F.lit(weight)).alias("rank"), f["variable"].alias("variable"),
        f["contribution"].alias("contribution")))
    return F.transform(F.slice(F.array_sort(keyed), 1, TOP_FACTORS), lambda f: F.struct(
        f["variable"].alias("variable"), round_to(f["contribution"], 4).alias("contribution")))


def card_factors(card: Card) -> Column:
    """Exact logit contributions of a linear card: coefficient times encoded value."""
    names, values = zip(*card.coefficients())
    pairs = F.arrays_zip(F.array(*[F.lit(n) for n in names]).alias("variable"),
                         F.array(*[F.lit(v) for v in values]).alias("coefficient"),
                         vector_to_array("features").alias("value"))
    return F.transform(pairs, lambda p: F.struct(
        p["variable"].alias("variable"), (p["coefficient"] * p["value"]).alias("contribution")))


def expert_factors(c=F.col) -> Column:
    return factor_array([(n, p.cast("double")) for n, p in credit.expert_points(c)])


def contributions(scored: DataFrame, factors: Column, key: str) -> DataFrame:
    """Long form: (key, variable, contribution)."""
    return (scored.select(key, F.explode(factors).alias("f"))
            .select(key, "f.variable", "f.contribution"))


def pretty_label(variable: Column, value: Column) -> Column:
    """Business label with the file's own value; ``label = level`` for a category.

    A one-hot name is its column name, an underscore and the level; the dictionary
    is matched on that prefix.
    """
    labels = credit.literal_map(refdata.LABEL)
    known = F.try_element_at(labels, variable)
    number = F.replace(F.call_function("format_number", value, F.lit("#,##0.##")),
                       F.lit(","), F.lit(" "))
    shown = F.concat(known, F.lit(" ("), F.coalesce(number, F.lit("None")), F.lit(")"))
    level = None
    for column in refdata.LABEL:
        if refdata.DATA_TYPE[column] != "categorical":
            continue
        text = F.concat(F.lit(refdata.LABEL[column] + " = "),
                        F.substr(variable, F.lit(len(column) + 2)))
        hit = F.startswith(variable, F.lit(column + "_"))
        level = F.when(hit, text) if level is None else level.when(hit, text)
    return F.when(known.isNotNull(), shown).otherwise(F.coalesce(level, variable))


def factor_labels(factors: DataFrame, rows: DataFrame, key: str,
                  columns: list[str]) -> DataFrame:
    """Adds ``label`` to long factors, with each file's value of the variable."""
    values = F.create_map(*[x for c in numeric_of(columns)
                            for x in (F.lit(c), F.col(c).cast("double"))])
    held = rows.select(key, values.alias("_values"))
    joined = keyed_join(factors, held, key)
    value = F.try_element_at("_values", F.col("variable"))
    return joined.withColumn("label", pretty_label(F.col("variable"), value)).drop("_values")


# ---- documents ------------------------------------------------------------------------------
def document_features(documents: DataFrame, keep_totals: bool = False) -> DataFrame:
    """Valid documents to indicators plus the 35 card inputs, row by row."""
    measured = indicators.from_documents(documents, keep_totals)
    op, who, home, bank = (F.col(c) for c in ("operation", "borrower", "household", "behaviour"))

    def count_where(array: str, test: Callable[[Column], Column]) -> Column:
        """Lines, not entries: an entry may stand for several lines."""
        return F.aggregate(F.filter(array, test), F.lit(0), lambda n, x: n + x["lines"])

    derived = {
        "down_payment_ratio": credit.down_payment_ratio(op["down_payment"],
                                                        op["requested_amount"]),
        "existing_loans_n": count_where("existing_loans", lambda x: F.lit(True)),
        "revolving_loans": count_where("existing_loans", lambda x: x["loan_kind"] == "revolving"),
        "loan_incidents_12m": F.aggregate("existing_loans", F.lit(0),
                                          lambda n, x: n + x["incidents_12m"]),
        "undocumented_income_lines": count_where("incomes", lambda i: ~i["documented"]),
        "contract_stability": credit.stability_of(who["contract_type"]),
    }
    plain = {**{c: op[c] for c in ("requested_amount", "term_months", "apr", "loan_type",
                                   "channel")},
             **{c: who[c] for c in ("months_in_job", "contract_type", "occupation")},
             **{c: home[c] for c in ("months_at_address", "housing_status", "area_type")},
             **{c: bank[c] for c in ("loans_repaid_clean", "days_overdrawn_12m",
                                     "rejected_debits_12m", "max_overdraft_used",
                                     "products_held", "relationship_months")}}
    bits = {"has_co_borrower": who, "in_probation_period": who, "insurance_taken": op,
            "ficp_flagged": bank, "fcc_flagged": bank, "salary_domiciled": bank}
    flags = {c: holder[c].cast("int") for c, holder in bits.items()}
    wide = measured.withColumns({**derived, **plain, **flags})
    return wide.drop("existing_loans").withColumnRenamed("existing_loans_n", "existing_loans")


def model_card(card: Card, metrics_row: dict | None = None) -> Column:
    """Provenance carried by every result."""
    measures = metrics_row or card.measures
    return F.struct(
        F.lit(card.name).alias("name"), F.lit(card.fingerprint()).alias("fingerprint"),
        F.lit(len(card.columns)).alias("n_variables"), F.lit(card.calibration).alias("calibration"),
        F.lit(measures.get("auc")).cast("double").alias("test_auc"),
        F.lit(measures.get("gini")).cast("double").alias("test_gini"),
        F.lit(CAVEAT).alias("caveat"))


def domain_warning(pd: Column, limit: float) -> Column:
    percent = F.concat(rules.one_decimal(pd * 100), F.lit("%"))
    return F.when(pd > limit, F.concat(
        F.lit("probability of "), percent,
        F.lit(f" beyond the 99.9th percentile of the training distribution ({limit * 100:.1f}%):"
              " the model is extrapolating, this value must not be used for pricing."
              " Manual review required.")))


def rejected_documents(documents: DataFrame) -> DataFrame:
    """(reference, errors): the documents that ``score_documents`` leaves out, and why.

    Every document is either scored or rejected: errors are the broken clauses of the contract,
    or the reason why its indicators cannot be computed. Both come from one pass over the
    documents; what a broken one holds is not measured.
    """
    checked = docs.validate(docs.with_defaults(documents))
    whole = F.size("errors") == 0
    measured = document_features(checked.withColumns({
        c: F.when(whole, F.col(c)) for c in checked.columns if c not in ("reference", "errors")}))
    return measured.where((F.size("errors") > 0) | F.col("indicator_error").isNotNull()).select(
        "reference", F.when(F.size("errors") > 0, F.col("errors"))
        .otherwise(F.array("indicator_error")).alias("errors"))


def score_documents(documents: DataFrame, card: Card,
                    metrics_row: dict | None = None) -> DataFrame:
    """Documents to score rows; documents that break the contract are left out.

    The evaluation id is a hash of the reference and the model, so re-scoring the
    same file with the same model gives the same id. No step needs an exchange.
    """
    valid = docs.valid(docs.validate(docs.with_defaults(documents)))
    inputs = document_features(valid).where("indicator_error IS NULL")
    scored = card.transform(inputs)
    pd, limit = F.col("pd"), float(card.domain.get("pd_q999", 1.0))
    factors = card_factors(card) if card.linear else F.array().cast(
        "array<struct<variable:string,contribution:double>>")
    described = scored.withColumn("_factors", factors)
    warnings = F.concat(rules.scoring_warnings(),
                        F.array_compact(F.array(domain_warning(pd, limit))))
    return described.select(
        F.sha2(F.concat_ws("|", F.coalesce("reference", F.lit("")),
                           F.lit(card.fingerprint())), 256).alias("evaluation_id"),
        "reference", round_to(pd, 4).alias("probability_of_default"),
        credit.grade_from_pd(pd).alias("risk_grade"), (pd > limit).alias("out_of_domain"),
        F.struct(*indicators.INDICATORS, "monthly_payment").alias("indicators"),
        top_factors(F.col("_factors"), True).alias("adverse_factors"),
        top_factors(F.col("_factors"), False).alias("favourable_factors"),
        model_card(card, metrics_row).alias("model"), warnings.alias("warnings"))


def score_dataset(rows: DataFrame, card: Card, decision: DecisionModel,
                  references: DataFrame | None = None) -> DataFrame:
    """Stored files, optionally by reference list: PD, grade, decisions, text excerpt."""
    picked = rows if references is None else dataset.lookup(rows, references)
    kept = ["application_reference", "decision_result", "outcome_status", "rationale",
            "decided_by"]
    inputs = list(dict.fromkeys(card.columns + decision.columns))
    scored = card.transform(picked.select(*kept, *inputs))
    scored = scored.select(*kept, *decision.columns, "pd", (
        card_factors(card) if card.linear else F.array().cast(
            "array<struct<variable:string,contribution:double>>")).alias("_factors"))
    both = decision.predict(scored)
    return both.select(
        "application_reference", round_to(F.col("pd"), 4).alias("probability_of_default"),
        credit.grade_from_pd(F.col("pd")).alias("risk_grade"),
        F.col("predicted").alias("predicted_decision"),
        F.col("decision_result").alias("actual_decision"),
        F.coalesce("outcome_status", F.lit("not approved")).alias("observed_outcome"),
        "decided_by", F.substring("rationale", 1, EXCERPT).alias("rationale_excerpt"),
        top_factors(F.col("_factors"), True).alias("adverse_factors"),
        top_factors(F.col("_factors"), False).alias("favourable_factors"))


# ---- sizing -----------------------------------------------------------------------------------
def sizing_frame(documents: DataFrame) -> DataFrame:
    """Valid, assessable documents as card inputs plus what a trial amount needs.

    Everything that does not move with the amount is worked out once per row here.
    """
    rate = F.col("operation.nominal_rate") / F.lit(100.0) / F.lit(12.0)
    rows = document_features(documents, keep_totals=True).where("indicator_error IS NULL")
    return rows.withColumns({
        "_rate": rate, "_growth": F.lit(1.0) - F.pow(F.lit(1.0) + rate, -F.col("term_months")),
        "_still": credit.expert_logit(F.col, skip=set(_EXPERT_MOVING))})


_EXPERT_MOVING = ("dti_after_pct", "residual_income_per_cu", "savings_months_of_expenses")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def payment_at(amount: Column) -> Column:
    """Total payment of a trial amount, insurance recomputed."""
    instalment = (F.when(F.col("_rate") == 0, round_to(amount / F.col("term_months"), 2))
                  .otherwise(round_to(amount * F.col("_rate") / F.col("_growth"), 2)))
    return credit.total_payment(
        instalment, credit.insurance_cost(amount, F.col("insurance_taken")))


def amount_indicators(amount: Column, payment: Column) -> dict[str, Column]:
    """The card inputs that depend on the amount, at unchanged term."""
    measured = credit.indicator_columns(
        gross=F.col("gross"), weighted=F.col("weighted"), variable=F.col("variable"),
        counted=F.col("counted"), existing=F.col("existing"), refinanced=F.col("refinanced"),
        payment=payment, units=F.col("units"), liquid=F.col("liquid"))
    return {**measured, "requested_amount": amount,
            "down_payment_ratio": credit.down_payment_ratio(
                F.col("operation.down_payment"), amount)}


def expert_pd_at(amount: Column) -> Column:
    """Expert PD of a trial amount; NULL for no amount."""
    def from_payment(payment: Column) -> Column:
        trial = amount_indicators(amount, payment)
        z = F.col("_still")
        for name, points in credit.expert_points(lambda n: trial.get(n, F.col(n))):
            if name in _EXPERT_MOVING:
                z = z + points
        return round_to(credit.logistic(z), 6)

    return F.when(amount.isNotNull(), let(payment_at(amount), from_payment))


def linear_pd_at(card: Card, scaler_mean: list[float], scaler_std: list[float]
                 ) -> tuple[Column, Callable[[Column], Column]]:
    """(fixed part of the logit, PD of a trial amount) for a linear card.

    Only the inputs that move with the amount are recomputed; everything else is one
    number per row, taken from the encoded vector.
    """
    numeric = numeric_of(card.columns)
    moving = [n for n in numeric if n in {
        "dti_after_pct", "above_hcsf_threshold", "residual_income_per_cu",
        "savings_months_of_expenses", "down_payment_ratio", "payment_shock",
        "requested_amount"}]
    coefficients = [v for _, v in card.coefficients()]
    still = [0.0 if i < len(numeric) and numeric[i] in moving else v
             for i, v in enumerate(coefficients)]
    fixed = F.aggregate(
        F.zip_with(vector_to_array("features"), F.array(*[F.lit(v) for v in still]),
                   lambda x, b: x * b),
        F.lit(float(card.model.stages[-1].intercept)), lambda total, x: total + x)

    def pd_at(amount: Column) -> Column:
        def from_payment(payment: Column) -> Column:
            trial = amount_indicators(amount, payment)
            z = F.col("_fixed")
            for name in moving:
                i = numeric.index(name)
                if scaler_std[i] > 0:
                    z = z + (trial[name].cast("double") - F.lit(scaler_mean[i])) * F.lit(
                        coefficients[i] / scaler_std[i])
            return round_to(credit.logistic(z), 6)

        return F.when(amount.isNotNull(), let(payment_at(amount), from_payment))

    return fixed, pd_at


def with_linear_sizing(inputs: DataFrame, card: Card) -> tuple[DataFrame, Callable]:
    """Inputs with ``_fixed``, ``raw_pd`` and ``initial_pd``, and the raw PD of an amount."""
    scaler = next(s for s in card.model.stages if hasattr(s, "mean"))
    fixed, pd_at = linear_pd_at(card, [float(v) for v in scaler.mean],
                                [float(v) for v in scaler.std])
    scored = card.transform(inputs)
    return scored.withColumn("_fixed", fixed).withColumn("initial_pd", F.col("pd")), pd_at


def raw_target(card: Card, target: float) -> float:
    """Largest raw PD whose calibrated value stays within the target.

    Calibrators are monotone, so the search can run on raw PDs.
    """
    if card.calibration == "platt":
        slope, shift = float(card.calibrator.coefficients[0]), float(card.calibrator.intercept)
        return (math.log(target / (1 - target)) - shift) / slope
    if card.calibration == "isotonic":
        edges = [float(v) for v in card.calibrator.boundaries]
        values = [float(v) for v in card.calibrator.predictions]
        if values[-1] <= target:
            return 1.0
        if values[0] > target:
            return -1.0
        i = max(k for k, v in enumerate(values) if v <= target)
        rise = values[i + 1] - values[i]
        return edges[i] + (edges[i + 1] - edges[i]) * (target - values[i]) / rise
    return target


def _sized(found: DataFrame, target: float) -> DataFrame:
    """Result columns from initial_pd, requested_amount, _low and pd_at_maximum."""
    met, low, requested = F.col("initial_pd") <= target, F.col("_low"), F.col("requested_amount")
    grouped = F.replace(F.format_number(low, 0), F.lit(","), F.lit(" "))
    return found.select(
        "reference", round_to(F.col("initial_pd"), 4).alias("initial_pd"),
        F.lit(target).alias("target_pd"), "requested_amount",
        F.when(met, requested).otherwise(round_to(low, 2)).alias("maximum_amount"),
        round_to(F.col("pd_at_maximum"), 4).alias("pd_at_maximum"),
        round_to(requested - low, 2).alias("reduction_required"),
        F.when(met, MET).when(low.isNull(), UNREACHABLE).otherwise(F.concat(
            F.lit("cutting the amount to "), grouped,
            F.lit(f" EUR keeps the PD under {target:.0%}"))).alias("comment"))


def max_amount(inputs: DataFrame, pd_at: Callable[[Column], Column], target: float = TARGET_PD,
               card: Card | None = None) -> DataFrame:
    """Largest amount that keeps the PD under target, at unchanged term.

    The 40 halvings are a fold inside the row, so the search is a projection: no
    exchange and no driver loop. ``initial_pd`` must be on the rows.
    """
    limit = raw_target(card, target) if card else target
    requested, floor = F.col("requested_amount"), F.lit(LOWEST_AMOUNT)

    def halve(span: Column, _: Column) -> Column:
        return let((span["low"] + span["high"]) / F.lit(2.0), lambda middle: F.when(
            pd_at(middle) <= limit,
            F.struct(middle.alias("low"), span["high"].alias("high"))).otherwise(
            F.struct(span["low"].alias("low"), middle.alias("high"))))

    reachable = (requested > floor) & (pd_at(floor) <= limit)
    search = F.aggregate(F.sequence(F.lit(1), F.lit(BISECTIONS)),
                         F.struct(floor.alias("low"), requested.alias("high")), halve)
    found = inputs.withColumn("_low", F.when((F.col("initial_pd") > target) & reachable,
                                             search["low"]))
    found = found.withColumn("pd_at_maximum", pd_at(F.col("_low")))
    if card and card.calibration != "none":
        shown = found.drop("raw_pd", "pd").withColumn("raw_pd", F.col("pd_at_maximum"))
        found = apply_calibration(shown, card.calibration, card.calibrator).withColumn(
            "pd_at_maximum", F.when(F.col("_low").isNotNull(), F.col("pd")))
    return _sized(found, target)


def max_amount_any(inputs: DataFrame, card: Card, target: float = TARGET_PD) -> DataFrame:
    """The same search for a card whose PD is no single expression.

    Every halving scores the whole table once; the lineage is cut every ten steps.
    """
    kept = inputs.columns

    def pd_of(rows: DataFrame, amount: Column) -> DataFrame:
        paid = rows.withColumn("_amount", amount).withColumn(
            "_payment", payment_at(F.col("_amount")))
        trial = {k: v for k, v in amount_indicators(
            F.col("_amount"), F.col("_payment")).items() if k in card.columns}
        scored = card.transform(paid.withColumns(trial))
        return scored.select(*[c for c in rows.columns if c not in trial],
                             *[F.col(f"_kept_{c}").alias(c) for c in trial if c in kept],
                             F.col("pd").alias("_pd"))

    moving = [c for c in amount_indicators(F.lit(1.0), F.lit(1.0)) if c in card.columns]
    rows = card.transform(inputs).select(*kept, F.col("pd").alias("initial_pd"))
    rows = rows.withColumns({f"_kept_{c}": F.col(c) for c in moving})
    rows = pd_of(rows, F.lit(LOWEST_AMOUNT))
    searched = ((F.col("initial_pd") > target) & (F.col("requested_amount") > LOWEST_AMOUNT)
                & (F.col("_pd") <= target))
    rows = rows.withColumns({
        "_low": F.when(searched, F.lit(LOWEST_AMOUNT)),
        "_high": F.when(searched, F.col("requested_amount"))}).drop("_pd")
    for step in range(BISECTIONS):
        rows = pd_of(rows, (F.col("_low") + F.col("_high")) / 2)
        middle = (F.col("_low") + F.col("_high")) / 2
        fits = F.col("_pd") <= target
        rows = rows.withColumns({
            "_low": F.when(fits, middle).otherwise(F.col("_low")),
            "_high": F.when(fits, F.col("_high")).otherwise(middle)}).drop("_pd")
        if step % 10 == 9:
            rows = cut_lineage(rows)
    return _sized(pd_of(rows, F.col("_low")).withColumn(
        "pd_at_maximum", F.when(F.col("_low").isNotNull(), F.col("_pd"))), target)
