"""Scorecard training, audit, selection, calibration and importance with Spark ML."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import partial
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Model, Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import (OneHotEncoder, SQLTransformer, StandardScaler,
                                StringIndexer, StringIndexerModel, VectorAssembler)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from riskframe.functions.numeric import round_to
from riskframe.operators import bias, boosting, metrics, ordered, permute
from riskframe.session import cut_lineage
from riskframe.sources import refdata

KEY = "application_reference"

# ---- fixed values -------------------------------------------------------------------
SCORECARD_VARIABLES = [
    "dti_after_pct", "above_hcsf_threshold", "residual_income_per_cu",
    "savings_months_of_expenses", "variable_income_share", "down_payment_ratio",
    "payment_shock", "requested_amount", "term_months", "apr", "has_co_borrower",
    "insurance_taken", "existing_loans", "revolving_loans", "loan_incidents_12m",
    "loans_repaid_clean", "days_overdrawn_12m", "rejected_debits_12m", "ficp_flagged",
    "fcc_flagged", "salary_domiciled", "max_overdraft_used", "products_held",
    "months_in_job", "relationship_months", "months_at_address", "in_probation_period",
    "undocumented_income_lines", "loan_type", "contract_stability", "contract_type",
    "housing_status", "channel", "occupation", "area_type",
]
EXPECTED_SIGNS = {
    "protective": ["residual_income_per_cu", "savings_months_of_expenses",
                   "loans_repaid_clean", "months_in_job", "relationship_months",
                   "months_at_address", "salary_domiciled", "has_co_borrower",
                   "down_payment_ratio", "products_held"],
    "adverse": ["dti_after_pct", "above_hcsf_threshold", "payment_shock",
                "variable_income_share", "days_overdrawn_12m", "rejected_debits_12m",
                "ficp_flagged", "fcc_flagged", "revolving_loans", "loan_incidents_12m",
                "in_probation_period", "max_overdraft_used", "undocumented_income_lines"],
}
SIGN_THRESHOLD = 0.05
RARE_BELOW = 20
AUC_GAIN_FOR_BOOSTING = 0.02
BRIER_GAIN_FOR_CALIBRATION = 0.01
FOLDS = 5
BOOSTING_ROUNDS, BOOSTING_STEP = 400, 0.06
#: Rounds, step and depth of the boosted candidates for the decision.
DECISION_BOOSTING = {"gb_depth6": (400, 0.06, 6), "gb_default": (300, 0.1, None)}
DECISION_ITERATIONS = 3000
FIT_ROWS, FIT_TASKS = 25_000, 12
IMPORTANCE_REPEATS, IMPORTANCE_FLOOR, IMPORTANCE_TOP = 5, 0.0002, 15
# -------------------------------------------------------------------------------------

_NUMERIC_TYPES = ("numeric", "integer", "boolean")


def numeric_of(columns: list[str]) -> list[str]:
    return [c for c in columns if refdata.DATA_TYPE[c] in _NUMERIC_TYPES]


def categorical_of(columns: list[str]) -> list[str]:
    return [c for c in columns if refdata.DATA_TYPE[c] not in _NUMERIC_TYPES]


def feature_frame(rows: DataFrame, columns: list[str], *carry: str | Column) -> DataFrame:
    """Model inputs with the types the dictionary declares."""
    return rows.select(
        *carry, *[F.col(c).cast("double").alias(c) for c in numeric_of(columns)],
        *[F.col(c).cast("string").alias(c) for c in categorical_of(columns)])


# ---- preprocessing --------------------------------------------------------------------
def level_counts(train: DataFrame, columns: list[str]) -> dict[str, dict[str | None, int]]:
    """Frequency of every level, all columns in one pass.

    Levels are codes; a column of free text is refused rather than pulled in.
    """
    entries = F.explode(F.array(*[
        F.struct(F.lit(c).alias("variable"), F.col(c).alias("level")) for c in columns]))
    counted = (train.select(entries.alias("e")).groupBy("e.variable", "e.level")
               .agg(F.count(F.lit(1)).alias("n")))
    found: dict[str, dict[str | None, int]] = {c: {} for c in columns}
    limit = 10_000
    for row in counted.limit(limit + 1).toLocalIterator():
        found[row.variable][row.level] = row.n
    if sum(len(v) for v in found.values()) > limit:
        raise ValueError(f"more than {limit} distinct levels: normalise free text first")
    return found


def _level_case(column: str, counts: dict[str | None, int]) -> str:
    """Level, ``infrequent`` for a rare one, the mode when missing, NULL when unseen."""
    def quoted(level: str) -> str:
        return "'" + level.replace("\\", "\\\\").replace("'", "\\'") + "'"

    known = {k: v for k, v in counts.items() if k is not None}
    mode = min(known, key=lambda k: (-known[k], k)) if known else "missing"
    known[mode] = known.get(mode, 0) + counts.get(None, 0)
    rare = sorted(k for k, v in known.items() if v < RARE_BELOW)
    frequent = sorted(k for k, v in known.items() if v >= RARE_BELOW)
    value = f"coalesce(`{column}`, {quoted(mode)})"
    branches = ""
    if frequent:
        branches += f" WHEN {value} IN ({', '.join(map(quoted, frequent))}) THEN {value}"
    if rare:
        branches += f" WHEN {value} IN ({', '.join(map(quoted, rare))}) THEN 'infrequent'"
    return f"CASE{branches} END AS `{column}__level`"


def preprocessor(train: DataFrame, columns: list[str]) -> Pipeline:
    """Median-impute and standardise numbers, one-hot the rest into ``features``.

    A level never seen in training encodes as all zeros: the indexer keeps it in a
    last slot and the encoder drops that slot.
    """
    numeric, categorical = numeric_of(columns), categorical_of(columns)
    imputed = [f"{c}__imputed" for c in numeric]
    medians = {r.variable: r.quantile for r in ordered.column_quantiles(train, numeric, [0.5]).collect()}
    filled = ", ".join(f"coalesce(`{c}`, {medians.get(c, 0.0)!r}D) AS `{c}__imputed`" for c in numeric)
    stages = [
        SQLTransformer(statement=f"SELECT *, {filled} FROM __THIS__"),
        VectorAssembler(inputCols=imputed, outputCol="numbers"),
        StandardScaler(inputCol="numbers", outputCol="standardised", withMean=True, withStd=True)]
    if categorical:
        counts = level_counts(train, categorical)
        cases = ", ".join(_level_case(c, counts[c]) for c in categorical)
        stages += [
            SQLTransformer(statement=f"SELECT *, {cases} FROM __THIS__"),
            StringIndexer(inputCols=[f"{c}__level" for c in categorical],
                          outputCols=[f"{c}__index" for c in categorical],
                          handleInvalid="keep", stringOrderType="alphabetAsc"),
            OneHotEncoder(inputCols=[f"{c}__index" for c in categorical],
                          outputCols=[f"{c}__hot" for c in categorical], dropLast=True)]
    stages.append(VectorAssembler(
        inputCols=["standardised"] + [f"{c}__hot" for c in categorical], outputCol="features"))
    return Pipeline(stages=stages)


def feature_names(model: PipelineModel, columns: list[str]) -> list[str]:
    names = numeric_of(columns)
    categorical = categorical_of(columns)
    for stage in model.stages:
        if isinstance(stage, StringIndexerModel) and categorical:
            for column, labels in zip(categorical, stage.labelsArray):
                names += [f"{column}_{label}" for label in labels]
            break
    return names


# ---- fitted cards -----------------------------------------------------------------------
@dataclass
class Card:
    """A fitted default-risk model with its inputs and optional calibrator."""

    name: str
    columns: list[str]
    model: PipelineModel
    calibration: str = "none"
    calibrator: object | None = None
    domain: dict = field(default_factory=dict)
    measures: dict = field(default_factory=dict)

    @property
    def linear(self) -> bool:
        return hasattr(self.model.stages[-1], "coefficients")

    @property
    def names(self) -> list[str]:
        return feature_names(self.model, self.columns)

    def coefficients(self) -> list[tuple[str, float]]:
        values = self.model.stages[-1].coefficients.toArray()
        return list(zip(self.names, (float(v) for v in values)))

    def fingerprint(self) -> str:
        """Stable identity of the fitted numbers."""
        last = self.model.stages[-1]
        body = ({"coefficients": self.coefficients(), "intercept": float(last.intercept)}
                if self.linear else {"trees": last.toDebugString})
        text = json.dumps({"name": self.name, "columns": self.columns, **body}, sort_keys=True)
        return hashlib.sha256(text.encode()).hexdigest()[:16]

    def transform(self, rows: DataFrame) -> DataFrame:
        """Adds raw_pd and, after calibration, pd."""
        carried = self.model.transform(_cast_inputs(rows, self.columns))
        scored = carried.withColumn(
            "raw_pd", round_to(vector_to_array("probability")[1], 6))
        return apply_calibration(scored, self.calibration, self.calibrator)


def _cast_inputs(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.withColumns({
        **{c: F.col(c).cast("double") for c in numeric_of(columns)},
        **{c: F.col(c).cast("string") for c in categorical_of(columns)}})


@contextmanager
def held(rows: DataFrame) -> Iterator[DataFrame]:
    """Rows kept for several passes; what the caller keeps already stays kept afterwards."""
    if rows.storageLevel.useDisk or rows.storageLevel.useMemory:
        yield rows
        return
    rows.persist()
    try:
        yield rows
    finally:
        rows.unpersist()


def gathered(rows: DataFrame, n: int) -> DataFrame:
    """Stored rows in tasks of about ``FIT_ROWS``: a fit is hundreds of passes, each paying for every task.

    The buckets of the tables would give as many tasks whatever the number of rows; with many
    rows their number stays as it is.
    """
    return rows.coalesce(max(FIT_TASKS, -(-n // FIT_ROWS)))


def _fit(name: str, train: DataFrame, columns: list[str], classifier) -> Card:
    stages = preprocessor(train, columns).getStages() + [classifier]
    return Card(name, columns, Pipeline(stages=stages).fit(train))


def logistic(train: DataFrame, columns: list[str], c: float, name: str | None = None,
             weight: str | None = None, label: str = "label") -> Card:
    """Ridge logistic regression; ``c`` scales the data term as a sum over rows."""
    with held(train):
        n, total = train.agg(F.count(F.lit(1)), F.sum(weight) if weight else F.count(F.lit(1))).first()
        estimator = LogisticRegression(
            featuresCol="features", labelCol=label, maxIter=300, regParam=1.0 / (c * float(total)),
            elasticNetParam=0.0, standardization=False)
        if weight:
            estimator.setWeightCol(weight)
        return _fit(name or f"logistic_C{c}", gathered(train, n), columns, estimator)


def boosted(train: DataFrame, columns: list[str], depth: int, rounds: int = BOOSTING_ROUNDS,
            name: str | None = None, label: str = "label", early_stopping: bool | None = None) -> Card:
    """Leaf-wise boosted trees on the same inputs as the linear cards (see ``boosting.fit``)."""
    with held(train):
        prepared = preprocessor(train, columns).fit(train)
        vectors = prepared.transform(train).select("application_id", label, "features")
        trees = boosting.fit(vectors, 2, rounds, BOOSTING_STEP, depth, early_stopping=early_stopping, label=label)
        return Card(name or f"gb_depth{depth}", columns, PipelineModel(stages=prepared.stages + [trees]))


def default_rows(rows: DataFrame, split: str, columns: list[str]) -> DataFrame:
    """Labelled rows of a split; unknown targets are left out, never filled."""
    kept = rows.where((F.col("split") == split) & F.col("default_flag").isNotNull())
    return feature_frame(kept, columns, "application_id", KEY,
                         F.col("default_flag").cast("double").alias("label"))


# ---- audit and selection ------------------------------------------------------------------
def coefficient_table(spark: SparkSession, card: Card) -> DataFrame:
    rows = card.coefficients() if card.linear else []
    return spark.createDataFrame(rows, "variable STRING, coefficient DOUBLE")


def expectations(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(v, side) for side, names in EXPECTED_SIGNS.items() for v in names],
        "variable STRING, expected STRING")


def sign_audit(coefficients: DataFrame) -> DataFrame:
    """Material coefficients against the expected business direction."""
    expected = F.broadcast(expectations(coefficients.sparkSession))
    against = (((F.col("expected") == "protective") & (F.col("coefficient") > SIGN_THRESHOLD))
               | ((F.col("expected") == "adverse") & (F.col("coefficient") < -SIGN_THRESHOLD)))
    return coefficients.join(expected, "variable").where(against)


def validation_auc(card: Card, rows: DataFrame) -> float:
    scored = card.transform(rows).select(F.col("raw_pd").alias("pd"), F.col("label").alias("y"))
    return metrics.metrics(scored).first()["auc"]


@dataclass
class Selection:
    cards: dict[str, Card]
    auc: dict[str, float]
    anomalies: dict[str, int]
    production: str | None
    challenger: str | None


def choose(auc: dict[str, float], anomalies: dict[str, int]
           ) -> tuple[str | None, str | None]:
    """(production, challenger): a boosted card must gain clearly over a clean linear one.

    With neither a clean linear nor a boosted candidate there is nothing to retain.
    """
    clean = [k for k in auc if k.startswith("logistic") and not anomalies[k]]
    trees = [k for k in auc if k.startswith("gb")]
    best_tree = max(trees, key=auc.get) if trees else None
    best_linear = max(clean, key=auc.get) if clean else None
    if best_linear is None:
        return best_tree, None
    if best_tree and auc[best_tree] - auc[best_linear] > AUC_GAIN_FOR_BOOSTING:
        return best_tree, best_linear
    return best_linear, best_tree


def candidates(rounds: int = BOOSTING_ROUNDS, with_boosting: bool = True) -> dict[str, Callable[[DataFrame], Card]]:
    """Name of each candidate and the function that fits it on training rows."""
    everything = refdata.columns_with_role("feature")
    plan = {"logistic_C0.1": (SCORECARD_VARIABLES, 0.1), "logistic_C0.5": (SCORECARD_VARIABLES, 0.5),
            "logistic_full": (everything, 0.1)}
    fits = {n: partial(logistic, columns=columns, c=c, name=n) for n, (columns, c) in plan.items()}
    if with_boosting:
        fits |= {f"gb_depth{d}": partial(boosted, columns=everything, depth=d, rounds=rounds) for d in (3, 6)}
    return fits


def select_card(rows: DataFrame, *, rounds: int = BOOSTING_ROUNDS,
                with_boosting: bool = True) -> Selection:
    """Fits the candidates on train side by side, compares them on val, applies the sign rule."""
    spark = rows.sparkSession
    everything = refdata.columns_with_role("feature")
    train = default_rows(rows, "train", everything).persist()
    val = default_rows(rows, "val", everything).persist()
    plan = candidates(rounds, with_boosting)
    try:
        train.count()           # stored once, before the candidates read it side by side
        with ThreadPool(len(plan)) as pool:
            one = inheritable_thread_target(spark)(lambda fit: fit(train))
            cards = dict(zip(plan, pool.map(one, plan.values())))
        auc = {n: validation_auc(card, val) for n, card in cards.items()}
    finally:
        train.unpersist()
        val.unpersist()
    anomalies = {n: sign_audit(coefficient_table(spark, card)).count()
                 for n, card in cards.items()}
    production, challenger = choose(auc, anomalies)
    return Selection(cards, auc, anomalies, production, challenger)


# ---- out-of-fold predictions and calibration --------------------------------------------------
def with_folds(rows: DataFrame, folds: int = FOLDS, key: str = "application_id",
               label: str = "label") -> DataFrame:
    """Stratified folds: the rank of a row within its class, modulo the number of folds.

    Fold sizes differ by one at most in every class, at any size, and no class meets in one task.
    """
    return ordered.hashed_rank(rows, label, key, "fold").withColumn("fold", (F.col("fold") % folds).cast("int"))


def out_of_fold(train: DataFrame, fit: Callable[[DataFrame], Card], folds: int = FOLDS) -> DataFrame:
    """(application_id, label, raw_pd) where no row is scored by a card that saw it.

    The folds are fitted side by side: a fit is many short jobs that wait for each other.
    """
    placed = with_folds(train.persist(), folds).persist()
    with ThreadPool(folds) as pool:
        one = inheritable_thread_target(train.sparkSession)(lambda i: fit(placed.where(F.col("fold") != i)))
        cards = pool.map(one, range(folds))
    return union_rows([card.transform(placed.where(F.col("fold") == i)).select("application_id", "label", "raw_pd")
                       for i, card in enumerate(cards)])


def union_rows(frames: list[DataFrame]) -> DataFrame:
    merged = frames[0]
    for frame in frames[1:]:
        merged = merged.unionByName(frame)
    return merged


def fit_isotonic(scores: DataFrame):
    """Isotonic calibrator of ``label`` by ``raw_pd``.

    Equal scores are merged with their weight first: six-digit scores leave at most
    1,000,001 points whatever the number of rows. Spark pools these inside score ranges, then
    the blocks of all ranges.
    """
    points = scores.groupBy("raw_pd").agg(F.avg("label").alias("rate"),
                                          F.count(F.lit(1)).cast("double").alias("weight"))
    return IsotonicRegression(featuresCol="raw_pd", labelCol="rate", weightCol="weight").fit(points)


def fit_calibrators(oof: DataFrame) -> dict[str, object]:
    """Isotonic and Platt calibrators on out-of-fold scores."""
    isotonic = fit_isotonic(oof)
    pair = (oof.groupBy("raw_pd", "label").agg(F.count(F.lit(1)).cast("double").alias("weight")))
    total = pair.agg(F.sum("weight")).first()[0]
    assembled = VectorAssembler(inputCols=["raw_pd"], outputCol="score_vector").transform(pair)
    platt = LogisticRegression(featuresCol="score_vector", labelCol="label", weightCol="weight",
                               regParam=1.0 / float(total), standardization=False,
                               maxIter=100).fit(assembled)
    return {"none": None, "isotonic": isotonic, "platt": platt}


def apply_calibration(scored: DataFrame, kind: str, calibrator) -> DataFrame:
    """Adds pd from raw_pd."""
    if kind == "none" or calibrator is None:
        return scored.withColumn("pd", F.col("raw_pd"))
    if kind == "isotonic":
        fitted = calibrator.transform(scored.drop("prediction"))
        return fitted.withColumn("pd", round_to(F.col("prediction"), 6)).drop("prediction")
    slope, shift = float(calibrator.coefficients[0]), float(calibrator.intercept)
    z = F.col("raw_pd") * F.lit(slope) + F.lit(shift)
    return scored.withColumn("pd", round_to(1.0 / (1.0 + F.exp(-z)), 6))


def calibrate(card: Card, oof: DataFrame, val: DataFrame) -> tuple[Card, dict[str, float]]:
    """Keeps a calibrator only if it improves the validation Brier by more than 1 %."""
    options = fit_calibrators(oof)
    raw = card.transform(val).select("raw_pd", "label").persist()
    brier = {}
    for kind, calibrator in options.items():
        scored = apply_calibration(raw, kind, calibrator).select(
            "pd", F.col("label").alias("y"))
        brier[kind] = metrics.metrics(scored).first()["brier"]
    raw.unpersist()
    best = min(brier, key=brier.get)
    kept = best if brier[best] < brier["none"] * (1 - BRIER_GAIN_FOR_CALIBRATION) else "none"
    bounds = metrics.domain_bounds(oof.select(F.col("raw_pd").alias("pd"),
                                              F.col("label").alias("y"))).first().asDict()
    return Card(card.name, card.columns, card.model, kept, options[kept], bounds), brier


def finished(card: Card, rows: DataFrame, fit: Callable[[DataFrame], Card]) -> Card:
    """The card that scores: calibrated out of fold with ``fit``, bounded, measured once on test."""
    oof = out_of_fold(default_rows(rows, "train", card.columns), fit).persist()
    try:
        card, _ = calibrate(card, oof, default_rows(rows, "val", card.columns))
    finally:
        oof.unpersist()
    scores = card.transform(default_rows(rows, "test", card.columns)).select("pd", F.col("label").alias("y"))
    card.measures = metrics.metrics(scores).first().asDict()
    return card


# ---- importance ---------------------------------------------------------------------------------
def variable_contributions(card: Card) -> Column:
    """Per input variable, its part of the logit; a category's levels are added up."""
    coefficients = [v for _, v in card.coefficients()]
    products = F.zip_with(vector_to_array("features"),
                          F.array(*[F.lit(v) for v in coefficients]), lambda x, b: x * b)
    numeric, categorical = numeric_of(card.columns), categorical_of(card.columns)
    parts = [F.element_at(products, i + 1) for i in range(len(numeric))]
    start = len(numeric) + 1
    for labels in _labels(card):
        levels = F.slice(products, start, len(labels))
        parts.append(F.aggregate(levels, F.lit(0.0), lambda total, x: total + x))
        start += len(labels)
    assert len(parts) == len(numeric) + len(categorical)
    return F.array(*parts)


def _labels(card: Card) -> list[list[str]]:
    for stage in card.model.stages:
        if isinstance(stage, StringIndexerModel):
            return [list(labels) for labels in stage.labelsArray]
    return []


def _swapped_linear(card: Card, rows: DataFrame, repeats: int) -> DataFrame:
    """(variable, repeat, pd, y) with one variable's logit part taken from the donor row."""
    intercept = float(card.model.stages[-1].intercept)
    parts = cut_lineage(card.model.transform(_cast_inputs(rows, card.columns))
                        .select("application_id", "label", variable_contributions(card).alias("parts")))
    placed = permute.with_donors(parts, ["parts"], repeats)
    margin = F.aggregate("parts", F.lit(intercept), lambda total, x: total + x)
    names = numeric_of(card.columns) + categorical_of(card.columns)
    moved = F.zip_with("parts", "donor.parts", lambda own, other: other - own)
    return (
        placed.select("label", "repeat", margin.alias("margin"), F.posexplode(moved).alias("at", "change"))
        .select(F.element_at(F.array(*[F.lit(n) for n in names]), F.col("at") + 1)
                .alias("variable"), "repeat",
                round_to(1.0 / (1.0 + F.exp(-(F.col("margin") + F.col("change")))), 6).alias("pd"),
                F.col("label").alias("y")))


def swapped_inputs(rows: DataFrame, columns: list[str], score: Callable[[DataFrame], DataFrame],
                   repeats: int, label: str = "label") -> DataFrame:
    """The same for any score that adds ``pd``: every variant is scored again."""
    stored = cut_lineage(rows.select("application_id", label, *columns))
    long = permute.with_donors(stored, columns, repeats).withColumn(
        "variable", F.explode(F.array(*[F.lit(c) for c in columns])))
    swapped = long.withColumns({
        c: F.when(F.col("variable") == c, F.col(f"donor.{c}")).otherwise(F.col(c))
        for c in columns}).drop("donor")
    return score(swapped).select("variable", "repeat", "pd", F.col(label).alias("y"))


def mean_loss(base: float, swapped: DataFrame) -> DataFrame:
    """(variable, importance): the AUC lost on the average of the repeats."""
    return (metrics.metrics(swapped, ["variable", "repeat"])
            .groupBy("variable")
            .agg(round_to(F.avg(F.lit(base) - F.col("auc")), 6).alias("importance")))


def permutation_importance(card: Card, rows: DataFrame,
                           repeats: int = IMPORTANCE_REPEATS) -> DataFrame:
    """(variable, importance): mean loss of AUC when one input is shuffled.

    Rows are encoded and stored once; all repeats and variables come from one join with the
    donors and one grouped measurement. A linear card only swaps parts of its logit.
    """
    base = validation_auc(card, rows)
    if card.linear:
        return mean_loss(base, _swapped_linear(card, rows, repeats))
    return mean_loss(base, swapped_inputs(
        rows, card.columns, lambda long: card.transform(long).withColumn("pd", F.col("raw_pd")), repeats))


def top_drivers(importance: DataFrame) -> DataFrame:
    return (importance.where(F.col("importance") > IMPORTANCE_FLOOR)
            .orderBy(F.col("importance").desc(), "variable").limit(IMPORTANCE_TOP))


# ---- decision model -------------------------------------------------------------------------------
@dataclass
class DecisionModel:
    name: str
    columns: list[str]
    model: PipelineModel
    labels: list[str]

    def predict(self, rows: DataFrame) -> DataFrame:
        """Adds predicted."""
        names = F.array(*[F.lit(label) for label in self.labels])
        return self.model.transform(_cast_inputs(rows, self.columns)).withColumn(
            "predicted", F.element_at(names, F.col("prediction").cast("int") + 1))


def decision_rows(rows: DataFrame, split: str, columns: list[str]) -> DataFrame:
    kept = rows.where((F.col("split") == split) & F.col("decision_result").isNotNull())
    return feature_frame(kept, columns, "application_id", KEY,
                         F.col("decision_result").alias("actual"))


def train_decision(rows: DataFrame, columns: list[str] | None = None, *, trees: int = 100,
                   rounds: int | None = None, with_boosting: bool = True
                   ) -> tuple[DecisionModel, dict[str, float]]:
    """Multi-class model of the decision: the candidate with the best validation accuracy.

    Two boosted candidates with softmax, of depth 6 and of the library's defaults, and a logistic
    one; without boosting a forest stands against the logistic one. ``rounds`` replaces the number
    of rounds of both boosted candidates.
    """
    columns = columns or refdata.columns_with_role("feature")
    train = decision_rows(rows, "train", columns).persist()
    val = decision_rows(rows, "val", columns).persist()
    labels = sorted(r.actual for r in train.select("actual").distinct().collect())
    index = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col("actual")) - 1
    train_i = train.withColumn("label", index.cast("double")).persist()
    n = train_i.count()
    linear = LogisticRegression(family="multinomial", maxIter=DECISION_ITERATIONS,
                                regParam=1.0 / (0.5 * n), standardization=False)
    forest = RandomForestClassifier(numTrees=trees, maxDepth=10, seed=0)
    plan: dict[str, Callable[[DataFrame], Model]] = {}
    if with_boosting:
        plan = {name: partial(boosting.fit, classes=len(labels), rounds=rounds or most, step=step, max_depth=depth)
                for name, (most, step, depth) in DECISION_BOOSTING.items()}
    plan["logistic"] = linear.fit
    if not with_boosting:
        plan["forest"] = forest.fit
    # The inputs are prepared once; every candidate learns from the same vectors.
    few = gathered(train_i, n)
    prepared = preprocessor(few, columns).fit(few)
    vectors = prepared.transform(few).select("application_id", "features", "label").persist()
    vectors.count()             # stored once, before the candidates read it side by side
    with ThreadPool(len(plan)) as pool:
        one = inheritable_thread_target(rows.sparkSession)(lambda fit: fit(vectors))
        models = dict(zip(plan, pool.map(one, plan.values())))
    fitted, scores = {}, {}
    for name, model in models.items():
        fitted[name] = DecisionModel(name, columns, PipelineModel(stages=prepared.stages + [model]), labels)
        scores[name] = metrics.accuracy(fitted[name].predict(val)).first()["accuracy"]
    for frame in (train, val, train_i, vectors):
        frame.unpersist()
    best = max(scores, key=scores.get)
    return fitted[best], scores


# ---- reject inference -------------------------------------------------------------------------------
REAL, INFERRED, ORACLE = "real (approved only)", "reject inference", "oracle (whole population)"


def population_frame(rows: DataFrame, split: str) -> DataFrame:
    kept = bias.population(rows).where(F.col("split") == split)
    return feature_frame(kept, SCORECARD_VARIABLES, "application_id", KEY, "approved",
                         F.col("target").cast("double").alias("target"))


def fuzzy_augmentation(train: DataFrame, base: Card, c: float = 0.5) -> Card:
    """Refit with every non-approved file split between both outcomes by its first PD."""
    scored = base.transform(train).select(
        "application_id", KEY, "approved", "target", "pd", *SCORECARD_VARIABLES)
    augmented = bias.fuzzy_rows(scored).withColumn("label", F.col("label").cast("double"))
    return logistic(augmented, SCORECARD_VARIABLES, c, INFERRED, weight="weight")


def selection_bias(rows: DataFrame, c: float = 0.5) -> tuple[DataFrame, dict[str, Card]]:
    """Three cards measured on the whole test population, one row per card.

    Adds to the usual measures the mean PD, the PD and rate of the non-approved,
    the AUC gap to the oracle and the share of it that reject inference recovers.
    """
    train = population_frame(rows, "train").withColumn("label", F.col("target")).persist()
    test = population_frame(rows, "test").persist()
    real = logistic(train.where("approved = 1"), SCORECARD_VARIABLES, c, REAL)
    cards = {REAL: real, INFERRED: fuzzy_augmentation(train, real, c),
             ORACLE: logistic(train, SCORECARD_VARIABLES, c, ORACLE)}
    scored = union_rows([
        card.transform(test).select(F.lit(name).alias("model"), "application_id", "approved",
                                    "pd", F.col("target").alias("y"))
        for name, card in cards.items()]).persist()
    measured = metrics.metrics(scored, ["model"])
    declined = F.col("approved") == 0

    def mean_where(value: str, condition: Column | None = None) -> Column:
        kept = F.col(value) if condition is None else F.when(condition, F.col(value))
        return round_to(F.avg(kept), 4)

    means = scored.groupBy("model").agg(
        mean_where("pd").alias("mean_pd"), mean_where("y").alias("actual_rate"),
        mean_where("pd", declined).alias("declined_pd"),
        mean_where("y", declined).alias("declined_rate"))
    gaps = union_rows([
        metrics.mean_gap(metrics.score_bands(scored.where(F.col("model") == name),
                                             "application_id"))
        .withColumn("model", F.lit(name)) for name in cards])
    report = measured.join(means, "model").join(gaps, "model").withColumn(
        "understatement", round_to(F.col("declined_pd") - F.col("declined_rate"), 4))
    auc = {r.model: r.auc for r in measured.select("model", "auc").collect()}
    gap = auc[ORACLE] - auc[REAL]
    recovered = (auc[INFERRED] - auc[REAL]) / gap if abs(gap) > 1e-9 else 0.0
    return report.withColumns({"auc_gap": F.lit(round(gap, 4)),
                               "recovered_share": F.lit(round(recovered, 4))}), cards


# ---- persistence ------------------------------------------------------------------------------------
def save_card(card: Card, folder: str) -> None:
    """Model, calibrator and a one-line description in a shared folder."""
    card.model.write().overwrite().save(f"{folder}/model")
    if card.calibrator is not None:
        card.calibrator.write().overwrite().save(f"{folder}/calibrator")
    about = {"name": card.name, "columns": card.columns, "calibration": card.calibration,
             "domain": card.domain, "measures": card.measures}
    spark = SparkSession.getActiveSession()
    spark.createDataFrame([(json.dumps(about),)], "value STRING").coalesce(1).write.mode(
        "overwrite").text(f"{folder}/about")


def load_card(spark: SparkSession, folder: str) -> Card:
    from pyspark.ml.classification import LogisticRegressionModel
    from pyspark.ml.regression import IsotonicRegressionModel

    about = json.loads(spark.read.text(f"{folder}/about").first()[0])
    kinds = {"isotonic": IsotonicRegressionModel, "platt": LogisticRegressionModel}
    kind = about["calibration"]
    calibrator = kinds[kind].load(f"{folder}/calibrator") if kind in kinds else None
    return Card(about["name"], about["columns"], PipelineModel.load(f"{folder}/model"), kind,
                calibrator, about["domain"], about["measures"])
