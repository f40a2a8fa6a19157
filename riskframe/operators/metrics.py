"""Scorecard measures over (pd, y) rows.

A probability is kept to six digits, so at most 1,000,001 distinct scores exist.
Everything below starts by counting rows per score; only those counts are ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from riskframe.functions.numeric import round_to, scaled
from riskframe.operators import ordered
from riskframe.session import cut_lineage

# ---- fixed values ---------------------------------------------------------------
CUTOFF_COSTS = [5, 10, 20]
GRID_START, GRID_STOP, GRID_SIZE = 0.01, 0.5, 200
# ---------------------------------------------------------------------------------


def score_groups(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row per (by, pd): number of positives and negatives."""
    return (rows.groupBy(*(by or []), round_to(F.col("pd"), 6).alias("pd"))
            .agg(F.sum(F.col("y").cast("bigint")).alias("pos"),
                 F.sum((1 - F.col("y")).cast("bigint")).alias("neg")))


def stored_groups(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The score groups, stored: what follows reads them several times, and scores no row again."""
    return cut_lineage(score_groups(rows, by))


def _score_bucket() -> Column:
    return F.floor(F.col("pd") * 1000)


def metrics(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """AUC, Gini, KS, average precision, Brier and base rate, per ``by`` group."""
    by = by or []
    g = ordered.running_totals(stored_groups(rows, by), "pd", measures=["pos", "neg"],
                               bucket=_score_bucket(), by=by, descending=True)
    pos, neg, pd = F.col("pos").cast("double"), F.col("neg").cast("double"), F.col("pd")
    tp, fp = F.col("cum_pos").cast("double"), F.col("cum_neg").cast("double")
    n_pos, n_neg = F.col("all_pos").cast("double"), F.col("all_neg").cast("double")

    def ratio(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b)

    raw = g.groupBy(*by).agg(
        F.sum(ratio(pos * ((n_neg - fp) + neg / 2), n_pos * n_neg)).alias("auc"),
        F.greatest(F.lit(0.0), F.max(ratio(tp, n_pos) - ratio(fp, n_neg))).alias("ks"),
        F.sum(ratio(pos, n_pos) * ratio(tp, tp + fp)).alias("ap"),
        (F.sum(pos * (1 - pd) * (1 - pd) + neg * pd * pd) / F.sum(pos + neg)).alias("brier"),
        (F.sum(pos) / F.sum(pos + neg)).alias("base_rate"))
    return raw.select(
        *by, round_to(F.col("auc"), 4).alias("auc"),
        round_to(2 * F.col("auc") - 1, 4).alias("gini"), round_to(F.col("ks"), 4).alias("ks"),
        round_to(F.col("ap"), 4).alias("average_precision"),
        round_to(F.col("brier"), 5).alias("brier"),
        round_to(F.col("base_rate"), 4).alias("base_rate"))


def band_of(rank: Column, n: Column, bands: int) -> Column:
    """Equal-width cut of the ranks 1..n; the remainder falls where a rank quantile puts it."""
    inner = F.floor(((rank - 1) * bands + n - 2) / F.greatest(n - 1, F.lit(1)))
    return F.greatest(F.lit(1), inner).cast("int")


def score_bands(rows: DataFrame, key: str, bands: int = 10) -> DataFrame:
    """Observed rate against mean PD per band of equal rank width.

    Equal scores are ranked by ``key``. A score whose rows all fall in one band is
    counted as a group; only the few scores that straddle a band edge, at most
    ``bands - 1`` of them, have their rows numbered, and that numbering is
    range-partitioned on (score, key) so one dominant score is spread over tasks.
    """
    groups = stored_groups(rows).withColumn("n", F.col("pos") + F.col("neg"))
    running = ordered.running_totals(groups, "pd", measures=["n"], bucket=_score_bucket())
    first, last, total = F.col("cum_n") - F.col("n") + 1, F.col("cum_n"), F.col("all_n")
    placed = running.withColumns({
        "first": first, "low": band_of(first, total, bands),
        "high": band_of(last, total, bands)})
    micro = F.rint(F.col("pd") * 1e6).cast("bigint")
    whole = placed.where("low = high").groupBy(F.col("low").alias("band")).agg(
        F.sum("n").alias("n"), F.sum("pos").alias("defaults"),
        F.sum(micro.cast("decimal(28,0)") * F.col("n")).alias("micro"))

    edge = placed.where("low <> high").select(
        F.col("pd").alias("edge_pd"), "first", F.col("n").alias("edge_n"),
        F.col("all_n").alias("total"))
    ahead = W.orderBy("edge_pd").rowsBetween(W.unboundedPreceding, -1)
    edge = edge.withColumn("start", F.coalesce(F.sum("edge_n").over(ahead), F.lit(0)))
    scored = rows.select(key, round_to(F.col("pd"), 6).alias("pd"), "y")
    split = ordered.global_row_number(
        scored.join(F.broadcast(edge), F.col("pd") == F.col("edge_pd")), ["pd", key])
    rank = F.col("first") + F.col("row_number") - 1 - F.col("start")
    parts = split.groupBy(band_of(rank, F.col("total"), bands).alias("band")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("y").cast("bigint")).alias("defaults"),
        F.sum(micro.cast("decimal(28,0)")).alias("micro"))

    merged = whole.unionByName(parts).groupBy("band").agg(
        F.sum("n").alias("n"), F.sum("defaults").alias("defaults"),
        F.sum("micro").cast("double").alias("micro"))
    mean_pd = F.col("micro") / F.lit(1e6) / F.col("n")
    observed = F.col("defaults") / F.col("n")
    return merged.select(
        F.concat(F.lit("D"), F.col("band").cast("string")).alias("band"), "n", "defaults",
        round_to(mean_pd, 4).alias("mean_pd"), round_to(observed, 4).alias("observed_rate"),
        round_to(F.abs(mean_pd - observed), 4).alias("gap"))


def mean_gap(bands: DataFrame) -> DataFrame:
    return bands.agg(round_to(F.avg("gap"), 4).alias("mean_gap"))


def _grid_value(index: Column) -> Column:
    """The index-th cut-off, from 0."""
    step = (GRID_STOP - GRID_START) / (GRID_SIZE - 1)
    return (F.when(index == GRID_SIZE - 1, F.lit(GRID_STOP))
            .otherwise(F.lit(GRID_START) + index * F.lit(step)))


def _cutoffs_reached(pd: Column) -> Column:
    """How many cut-offs are at or below a score."""
    guess = F.floor((pd - GRID_START) * (GRID_SIZE - 1) / (GRID_STOP - GRID_START)) + 1
    guess = F.least(F.lit(GRID_SIZE), F.greatest(F.lit(0), guess))
    up = (guess < GRID_SIZE) & (_grid_value(guess) <= pd)
    down = (guess > 0) & (_grid_value(guess - 1) > pd)
    return F.when(up, guess + 1).when(down, guess - 1).otherwise(guess)


def cutoffs(rows: DataFrame, costs: list[int] = CUTOFF_COSTS) -> DataFrame:
    """Cheapest cut-off per relative cost of a default.

    Each row is counted once under the number of cut-offs it reaches; the losses
    of all 200 cut-offs follow from running sums over those 201 counts.
    """
    histogram = (
        score_groups(rows).groupBy(_cutoffs_reached(F.col("pd")).alias("reached"))
        .agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")))
    spark = rows.sparkSession
    slots = spark.range(GRID_SIZE + 1).select(F.col("id").alias("reached"))
    full = slots.join(histogram, "reached", "left").na.fill(0, ["pos", "neg"])
    below = W.orderBy("reached").rowsBetween(W.unboundedPreceding, W.currentRow)
    everything = W.orderBy("reached").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    grid = (
        full.withColumns({
            "missed": F.sum("pos").over(below), "kept": F.sum("neg").over(below),
            "all_pos": F.sum("pos").over(everything), "all_neg": F.sum("neg").over(everything)})
        .where(F.col("reached") < GRID_SIZE)
        .withColumns({
            "cutoff": _grid_value(F.col("reached")),
            "avoided": F.col("all_pos") - F.col("missed"),
            "lost": F.col("all_neg") - F.col("kept"),
            "cost": F.explode(F.array(*[F.lit(c) for c in costs]))}))
    loss = F.col("cost") * F.col("missed") + F.col("lost")
    best = grid.groupBy("cost").agg(F.min_by(
        F.struct("cutoff", "avoided", "lost"), F.struct(loss, F.col("reached"))).alias("b"))
    return best.select(
        "cost", round_to(F.col("b.cutoff"), 6).alias("cutoff"),
        (F.col("b.avoided") + F.col("b.lost")).alias("declined"),
        F.col("b.avoided").alias("defaults_avoided"), F.col("b.lost").alias("good_lost"))


def domain_bounds(rows: DataFrame) -> DataFrame:
    """Largest score and 99.9 % quantile: where the card has been observed."""
    groups = stored_groups(rows).select(
        F.lit("pd").alias("variable"), F.col("pd").alias("value"),
        (F.col("pos") + F.col("neg")).alias("n"))
    found = ordered.exact_quantiles(groups, [0.999, 1.0], counted=True)
    return found.agg(
        round_to(F.max(F.when(F.col("probability") == 1.0, F.col("quantile"))), 4)
        .alias("max_observed_pd"),
        round_to(F.max(F.when(F.col("probability") == 0.999, F.col("quantile"))), 4)
        .alias("pd_q999"))


def confusion(predictions: DataFrame, labels: list[str]) -> DataFrame:
    """Rows actual, columns predicted."""
    return (predictions.groupBy("actual").pivot("predicted", labels)
            .agg(F.count(F.lit(1))).na.fill(0, labels))


def class_report(predictions: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class; 0 where undefined."""
    counts = predictions.groupBy("actual", "predicted").agg(F.count(F.lit(1)).alias("n"))
    sides = counts.select(F.explode(F.array(
        F.struct(F.col("actual").alias("label"), F.col("n").alias("support"),
                 F.lit(0).cast("bigint").alias("called"),
                 F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)
                 .alias("hit")),
        F.struct(F.col("predicted").alias("label"), F.lit(0).cast("bigint").alias("support"),
                 F.col("n").alias("called"), F.lit(0).cast("bigint").alias("hit")))).alias("s"))
    sums = sides.select("s.*").groupBy("label").agg(
        F.sum("support").alias("support"), F.sum("called").alias("called"),
        F.sum("hit").alias("hit"))
    precision = F.when(F.col("called") > 0, F.col("hit") / F.col("called")).otherwise(0.0)
    recall = F.when(F.col("support") > 0, F.col("hit") / F.col("support")).otherwise(0.0)
    both = precision + recall
    return sums.select(
        "label", round_to(precision, 4).alias("precision"), round_to(recall, 4).alias("recall"),
        round_to(F.when(both > 0, 2 * precision * recall / both).otherwise(0.0), 4).alias("f1"),
        "support")


def accuracy(predictions: DataFrame) -> DataFrame:
    """Accuracy and macro F1 in one row."""
    report = class_report(predictions)
    overall = predictions.agg(round_to(
        F.count(F.when(F.col("actual") == F.col("predicted"), 1)) / F.count(F.lit(1)), 4)
        .alias("accuracy"), F.lit(1).alias("_one"))
    macro = report.agg(round_to(F.avg("f1"), 4).alias("macro_f1"), F.lit(1).alias("_one"))
    return overall.join(F.broadcast(macro), "_one").drop("_one")
