"""Boosted trees against a single-machine version that looks at every split of every leaf."""

import numpy as np
import pytest
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from riskframe.operators import boosting, modelling
from riskframe.operators.boosting import MIN_HESSIAN, MIN_ROWS, UNITS


def slow_split(x, g, h, cuts):
    """Best (gain, input, bin) of one leaf, all tried one by one."""
    best = None
    for i, cut in enumerate(cuts):
        for b, limit in enumerate(cut):
            left = x[:, i] <= limit
            sides = [(g[s].sum() / UNITS, h[s].sum() / UNITS, s.sum()) for s in (left, ~left)]
            if any(n < MIN_ROWS or w < MIN_HESSIAN for _, w, n in sides):
                continue
            gain = sum(a * a / w for a, w, _ in sides) - (g.sum() / UNITS) ** 2 / (h.sum() / UNITS)
            if gain > 0 and (best is None or gain > best[0] + 1e-12):
                best = (gain, i, b)
    return best


def slow_tree(x, g, h, cuts, step, max_depth, max_leaves):
    """Score of each row, by opening the leaf with the largest gain until none is left."""
    leaves = [(np.ones(len(x), bool), 0)]
    splits = [slow_split(x, g, h, cuts)]
    while len(leaves) < max_leaves:
        open_ = [j for j, s in enumerate(splits) if s]
        if not open_:
            break
        j = max(open_, key=lambda j: splits[j][0])
        (rows, depth), (_, i, b) = leaves.pop(j), splits.pop(j)
        for side in (rows & (x[:, i] <= cuts[i][b]), rows & (x[:, i] > cuts[i][b])):
            leaves.append((side, depth + 1))
            splits.append(slow_split(x[side], g[side], h[side], cuts)
                          if max_depth is None or depth + 1 < max_depth else None)
    out = np.zeros(len(x))
    for rows, _ in leaves:
        out[rows] = -step * g[rows].sum() / h[rows].sum()
    return out


def slow_fit(x, y, classes, cuts, rounds, step, max_depth, max_leaves):
    share = np.array([(y == k).mean() for k in range(classes)])
    start = [np.log(share[1] / share[0])] if classes == 2 else np.log(share) - np.log(share).mean()
    scores = np.tile(start, (len(x), 1))
    for _ in range(rounds):
        p = boosting.probabilities(scores)
        new = scores.copy()
        for k in range(scores.shape[1]):
            label = k if classes > 2 else 1
            g = np.rint((p[:, label] - (y == label)) * UNITS)
            h = np.rint(p[:, label] * (1 - p[:, label]) * UNITS)
            new[:, k] += slow_tree(x, g, h, cuts, step, max_depth, max_leaves)
        scores = new
    return boosting.probabilities(scores)


def points(spark, n, classes, seed=3):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.normal(size=n).round(2), rng.integers(0, 6, n), rng.integers(0, 2, n)]).astype(float)
    signal = x[:, 0] + 0.6 * x[:, 1] * x[:, 2] + rng.normal(size=n) * 0.7
    y = np.digitize(signal, np.quantile(signal, np.arange(1, classes) / classes))
    rows = [(i, [float(v) for v in x[i]], float(y[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "application_id long, v array<double>, label double")
    return x, y, df.select("application_id", array_to_vector("v").alias("features"), "label")


@pytest.mark.parametrize("classes,max_depth,max_leaves", [(2, 3, 31), (2, None, 7), (3, 4, 6)])
def test_equals_single_machine(spark, monkeypatch, classes, max_depth, max_leaves):
    """Several tasks and refreshed scores, depth and leaf limits, two and three classes."""
    monkeypatch.setattr(boosting, "ROWS_PER_TASK", 150)
    monkeypatch.setattr(boosting, "REFRESH", 2)
    x, y, df = points(spark, 600, classes)
    model = boosting.fit(df.repartition(5), classes, 5, 0.3, max_depth, max_leaves, early_stopping=False)
    cuts = boosting.cut_points(df)
    want = slow_fit(x, y, classes, cuts, 5, 0.3, max_depth, max_leaves)
    got = model.transform(df).orderBy("application_id").select(
        vector_to_array("probability").alias("p"), "prediction").collect()
    assert np.abs(np.array([r.p for r in got]) - want).max() < 1e-6
    assert [int(r.prediction) for r in got] == list(want.argmax(axis=1))
    assert len(model.rounds) == 5


def test_cut_points(spark):
    """Few values are cut half-way between neighbours, many at quantiles; a constant has no cut."""
    df = spark.range(4000).select(array_to_vector(F.array(
        (F.col("id") % 3).cast("double"), F.col("id").cast("double"), F.lit(7.0))).alias("features"))
    few, many, none = boosting.cut_points(df)
    assert list(few) == [0.5, 1.5] and len(none) == 0
    assert len(many) == 254
    sizes = np.diff(np.searchsorted(np.arange(4000), many, side="right"))
    assert sizes.max() <= 18 and sizes.min() >= 13
    with pytest.raises(ValueError):
        boosting.cut_points(df.limit(0))


def test_ends_when_the_held_out_rows_gain_nothing(spark):
    noise = spark.range(3000).select(
        F.col("id").alias("application_id"), (F.xxhash64("id", F.lit(5)) % 2 == 0).cast("double").alias("label"),
        array_to_vector(F.array((F.xxhash64("id") % 1000).cast("double"))).alias("features"))
    assert len(boosting.fit(noise, 2, 60, 0.3, 3, early_stopping=True).rounds) < 40
    losses = [1.0 - 0.01 * i for i in range(30)]
    assert not boosting.stops(losses) and boosting.stops(losses + [losses[-1]] * 10)


def test_degenerate_rows(spark):
    """One class only, no split allowed, null labels: the shares of the classes remain."""
    df = spark.range(30).select(
        F.col("id").alias("application_id"), F.when(F.col("id") < 25, F.col("id") % 2).cast("double").alias("label"),
        array_to_vector(F.array(F.col("id").cast("double"))).alias("features"))
    model = boosting.fit(df, 2, 3, 0.1)
    assert model.rounds == []
    p = model.transform(df).select(vector_to_array("probability")[1].alias("p")).distinct().collect()
    assert [r.p for r in p] == [pytest.approx(12 / 25)]
    one = boosting.fit(df.withColumn("label", F.lit(1.0)), 2, 3, 0.1)
    assert one.transform(df).agg(F.min(vector_to_array("probability")[1])).first()[0] > 0.999


def test_save_and_load(spark, tmp_path):
    _, _, df = points(spark, 300, 2)
    model = boosting.fit(df, 2, 3, 0.3, 2, early_stopping=False)
    model.write().overwrite().save(str(tmp_path / "m"))
    back = boosting.HistogramBoostingModel.load(str(tmp_path / "m"))
    assert back.toDebugString == model.toDebugString
    assert back.transform(df).exceptAll(model.transform(df)).count() == 0


def test_card_of_trees(spark, tmp_path):
    """A boosted card scores rows with missing and unseen inputs and survives its folder."""
    rows = spark.range(400).select(
        F.col("id").alias("application_id"), F.when(F.col("id") % 7 > 0, F.col("id") % 90).cast("double").alias("dti_after_pct"),
        F.element_at(F.array(F.lit("AUTO"), F.lit("HOME")), (F.col("id") % 2 + 1).cast("int")).alias("loan_type"),
        (F.col("id") % 90 > 60).cast("double").alias("label"))
    card = modelling.boosted(rows, ["dti_after_pct", "loan_type"], 3, rounds=3)
    assert not card.linear
    modelling.save_card(card, str(tmp_path))
    back = modelling.load_card(spark, str(tmp_path))
    assert back.fingerprint() == card.fingerprint()
    odd = rows.withColumn("loan_type", F.when(F.col("application_id") > 200, F.lit("BOAT")))
    ours = {r.application_id: r.pd for r in card.transform(odd).select("application_id", "pd").collect()}
    theirs = {r.application_id: r.pd for r in back.transform(odd).select("application_id", "pd").collect()}
    assert ours == theirs and len(ours) == 400 and ours[80] > ours[15]


@pytest.mark.parametrize("classes,max_depth", [(2, 6), (3, None)])
def test_one_task_and_several_grow_the_same_trees(spark, monkeypatch, classes, max_depth):
    """Rows that one task holds are fitted in it; with many rows each pass is a job, added up by tasks."""
    _, _, df = points(spark, 900, classes)
    one = boosting.fit(df, classes, 4, 0.3, max_depth, 9, early_stopping=True)
    monkeypatch.setattr(boosting, "ONE_TASK_ROWS", 0)
    monkeypatch.setattr(boosting, "ROWS_PER_TASK", 100)
    monkeypatch.setattr(boosting, "REFRESH", 2)
    monkeypatch.setattr(boosting, "SUMS_AT_ONCE", 3)
    many = boosting.fit(df.repartition(12), classes, 4, 0.3, max_depth, 9, early_stopping=True)
    assert one.toDebugString == many.toDebugString and len(one.rounds) == 4


def test_boosted_fit_asks_for_all_rounds(monkeypatch):
    from riskframe.plans import catalog
    asked = []

    def fit(vectors, classes, rounds, step, depth, **_):
        asked.append((rounds, step, depth))
        raise InterruptedError

    class Any:
        storageLevel = StorageLevel.DISK_ONLY

        def __getattr__(self, _):
            return lambda *a, **k: self

        def __add__(self, _):
            return self

    monkeypatch.setattr(catalog, "model_rows", lambda *_: Any())
    monkeypatch.setattr(modelling, "default_rows", lambda *_: Any())
    monkeypatch.setattr(modelling, "preprocessor", lambda *_: Any())
    monkeypatch.setattr(modelling.boosting, "fit", fit)
    with pytest.raises(InterruptedError):
        catalog.boosted_fit(None, "")
    assert asked == [(400, 0.06, 3)]
