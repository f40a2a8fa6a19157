"""Exports and read-backs, rationale batches, stored tables."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from riskframe.operators import dataset, sampling
from riskframe.session import dropping_shuffles, shared_folder
from riskframe.sources import documents, exports, tables as storage


def test_export_round_trip(spark, tiny, tmp_path):
    rows = dataset.dataset(tiny).persist()
    summary = {r.file: (r.rows, r.columns) for r in exports.export(rows, str(tmp_path)).collect()}
    assert summary["X_train.csv"][1] == 75 and summary["protected_val.csv"][1] == 5
    back = exports.read_matrix(spark, str(tmp_path), "feature", "test")
    assert back.count() == rows.where("split = 'test'").count()
    assert dict(back.dtypes)["department"] == "string"      # codes stay text
    ours = rows.where("split = 'test'").select("application_reference", "department", "apr",
                                               "co_borrower_months_in_job")
    assert back.select(*ours.columns).exceptAll(ours.withColumn(
        "co_borrower_months_in_job", F.col("co_borrower_months_in_job").cast("bigint"))).count() == 0
    labelled = exports.training_rows(spark, str(tmp_path), "train", "default_flag")
    assert labelled.count() == rows.where(
        "split = 'train' AND default_flag IS NOT NULL").count()
    rows.unpersist()


def test_export_keeps_file_order(spark, tiny, tmp_path):
    exports.export(dataset.dataset(tiny), str(tmp_path))
    folder = tmp_path / "y" / "split=train"
    seen = []
    for name in sorted(n for n in os.listdir(folder) if n.endswith(".csv")):
        lines = (folder / name).read_text(encoding="utf-8").splitlines()
        seen += [int(line.split(",")[0].split("-")[-1]) for line in lines[1:]
                 if line.startswith("APP-")]
    assert seen == sorted(seen) and len(seen) > 500


def test_nested_batches(spark, tiny, tmp_path):
    rows = dataset.dataset(tiny)
    nested = exports.summaries(rows, tiny, sampling.stratified_sample(rows, 2, 25))
    exports.write_batches(nested, str(tmp_path / "b"), per_batch=25)
    back = spark.read.json(str(tmp_path / "b"))
    assert back.count() == nested.count()
    first = back.first()
    assert {"reference", "operation", "borrower", "financials", "behaviour", "decision",
            "reasons", "_stratum", "batch"} <= set(back.columns)
    assert isinstance(first.borrower.in_probation_period, bool)


def test_stale_batches_are_skipped(spark, tmp_path):
    def put(name, rows, when):
        path = tmp_path / name
        path.write_text(json.dumps(rows, ensure_ascii=False, indent=1), encoding="utf-8")
        os.utime(path, (when, when))

    put("batch_01_in.json", [{"reference": "A"}], 1000)
    put("batch_01_out.json", [{"reference": "A", "rationale": "é"}], 2000)
    put("batch_02_in.json", [{"reference": "B"}], 3000)
    put("batch_02_out.json", [{"reference": "B", "rationale": "old"}], 2000)
    put("batch_03_out.json", [{"reference": "C", "rationale": "no twin"},
                              {"reference": "D", "rationale": "two"}], 500)
    got = {r.reference: (r.rationale, r.file_number)
           for r in exports.read_rationales(spark, str(tmp_path)).collect()}
    assert got == {"A": ("é", 1), "C": ("no twin", 3), "D": ("two", 3)}

    # a second run takes only what the first did not, whatever the times say
    ledger = str(tmp_path / "ledger")
    files = exports.answer_files(spark, str(tmp_path), ledger)
    assert {r.state: r.files for r in exports.file_summary(files).collect()} == {"fresh": 2, "stale": 1}
    exports.record_answers(files, ledger)
    put("batch_03_out.json", [{"reference": "C", "rationale": "no twin"}, {"reference": "D", "rationale": "new"}], 600)
    put("batch_04_out.json", [{"reference": "E", "rationale": "later"}], 700)
    os.utime(tmp_path / "batch_01_out.json", (2500, 2500))
    again = exports.answer_files(spark, str(tmp_path), ledger)
    assert {r.stem: r.state for r in again.collect()} == {
        "batch_01": "seen", "batch_02": "stale", "batch_03": "fresh", "batch_04": "fresh"}
    got = {r.reference: r.rationale for r in exports.read_rationales(spark, str(tmp_path), ledger).collect()}
    assert got == {"C": "no twin", "D": "new", "E": "later"}


def test_rebuild_modes(spark, tiny, tmp_path):
    first = storage.rebuild(spark, str(tmp_path), lambda n: tiny[n].limit(5), overwrite=True)
    assert first["income"].count() == 5
    kept = storage.rebuild(spark, str(tmp_path), lambda n: tiny[n].limit(2))
    assert kept["income"].count() == 5
    fresh = storage.rebuild(spark, str(tmp_path), lambda n: tiny[n].limit(2), overwrite=True)
    assert fresh["income"].count() == 2
    assert storage.read_tables(spark, str(tmp_path))["decision"].columns == fresh["decision"].columns


def test_bucketed_blocks_join_without_exchange(tiny):
    joined = tiny["application"].withColumnRenamed("id", "application_id").hint("merge").join(
        tiny["household"], "application_id").join(tiny["indicators"].hint("merge"),
                                                  "application_id")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SortMergeJoin" in plan


def test_shared_folder_comes_from_the_session(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")


def test_provenance(tiny):
    row = exports.provenance(tiny, seed=1, intensity=0.5, reference_date="2002-01-01").first()
    assert row.n_applications == 1500 and "RECALIBRATE" in row.comment


def test_result_sinks(spark, tmp_path):
    bands = spark.createDataFrame([("D1", 3)], "band STRING, n INT")
    exports.write_results(spark, str(tmp_path), bands=bands, metrics={"auc": 0.7})
    assert spark.read.option("header", True).csv(str(tmp_path / "score_bands")).first().band == "D1"
    assert json.loads(spark.read.text(str(tmp_path / "metrics")).first()[0]) == {"auc": 0.7}


@pytest.mark.parametrize("name", ["loan_type", "reason", "income_type"])
def test_code_tables(tiny, name):
    assert tiny[name].select("code").distinct().count() == tiny[name].count()


def test_export_works_rows_out_once(spark, tiny, tmp_path):
    """Three roles, each ranged and written, from rows that are computed a single time."""
    seen = spark.sparkContext.accumulator(0)

    def passed(amount):
        seen.add(1)
        return amount

    rows = dataset.dataset(tiny).persist()
    n = rows.count()
    marked = rows.withColumn("requested_amount", F.udf(passed, "double")("requested_amount"))
    exports.export(marked, str(tmp_path))
    rows.unpersist()
    assert seen.value == n


def test_export_keeps_its_rows_on_disk(spark, tiny, tmp_path, monkeypatch):
    """Rows kept in memory would fill the executors while they are joined and sorted."""
    rows, levels = dataset.dataset(tiny), []
    persist = type(rows).persist
    monkeypatch.setattr(type(rows), "persist", lambda self, level=None: levels.append(level) or persist(self, level))
    exports.export(rows, str(tmp_path))
    assert levels and not any(level.useMemory for level in levels)


def shuffle_files(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = disk.getAllFiles()
    return {name for name in (files.apply(i).getName() for i in range(files.size())) if name.startswith("shuffle_")}


def test_stored_rows_leave_no_shuffle_files(spark, tmp_path):
    before = shuffle_files(spark)

    def store(name):
        spark.range(1000).repartition(3, "id").write.parquet(str(tmp_path / name))

    with dropping_shuffles(spark):
        store("a")
    until = time.time() + 20
    while shuffle_files(spark) - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffle_files(spark) - before and spark.read.parquet(str(tmp_path / "a")).count() == 1000
    store("b")
    assert shuffle_files(spark) - before


def test_streamed_documents_lie_compressed(spark, tiny, monkeypatch):
    from types import SimpleNamespace

    from paths import TINY
    from riskframe.plans import catalog
    given = []
    monkeypatch.setattr(catalog, "default_card", lambda *_: None)
    monkeypatch.setattr(catalog.streams, "score_stream", lambda _, folder, *more: given.append(folder) or SimpleNamespace(
        awaitTermination=lambda: None))
    catalog._streamed(spark, TINY)
    names = [n for n in os.listdir(given[0]) if n.startswith("part-")]
    assert names and all(n.endswith(".json.gz") for n in names)
    assert documents.read(spark, given[0]).count() == documents.assemble(tiny).count() > 1000


def test_model_rows_are_worked_out_once(spark, tiny, monkeypatch):
    """Every split and candidate reads stored rows: equal rows, and the tables are joined once."""
    from riskframe.plans import catalog
    asked = []
    monkeypatch.setattr(catalog, "rows_of", lambda *_: asked.append(1) or dataset.dataset(tiny))
    card = [catalog.card_rows(spark, "model rows test") for _ in range(3)][-1]
    labelled = dataset.dataset(tiny).where("default_flag IS NOT NULL").select(*card.columns)
    assert len(asked) == 1 and card.count() == labelled.count() > 0 and card.exceptAll(labelled).count() == 0
    asked.clear()
    stored = [catalog.model_rows(spark, "model rows test") for _ in range(3)][-1]
    card.unpersist()
    fresh = dataset.dataset(tiny).select(*stored.columns)
    assert len(asked) == 1 and stored.schema.simpleString() == fresh.schema.simpleString()
    assert stored.count() == fresh.count() and stored.exceptAll(fresh).count() == 0
