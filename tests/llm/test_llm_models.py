"""Trained operators: base counts by brute force, accuracy on held-out rows; the pipeline."""

import random
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from corpus import documents, frame, ordered, pairs, prose

import corpus_pipeline
from riskframe.llm import decontamination as D, language_id as G, order_minhash as O, quality_model as Q

SMALL = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def rows():
    return documents()


def read(spark, name):
    return spark.read.parquet(f"{SMALL}/{name}.parquet")


def test_quality_counts_by_brute_force(spark, rows):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = [tuple(r)[:1] + tuple(r)[2:8] for r in Q.scored(frame(spark, rows), none).collect()]
    assert ordered(got) == ordered(Q.reference(pairs(rows)))
    assert Q.scored(frame(spark, []), none).count() == 0


def test_quality_of_a_large_batch_takes_little_memory():
    """A worker holds a multiple of a small part of the texts, whatever the size of the batch."""
    chance = random.Random(5)
    texts = [" ".join(f"w{chance.randrange(3000)}" for _ in range(chance.randrange(1, 700))) for _ in range(3000)]
    ids = pa.array(range(len(texts)), pa.int64())
    weights = np.random.default_rng(5).normal(size=(Q.KINDS, Q.BUCKETS)).astype(np.float32)
    score = Q._scorer(SimpleNamespace(value=Q.Model(weights, 0.1, 1.0, 0.0)), Q.KEEP)

    def scored(at, step):
        part = pa.RecordBatch.from_arrays([x.slice(at, step) for x in (ids, ids, pa.array(texts))], ["doc_id", "uid", "text"])
        return pa.Table.from_batches(score(iter([part]))).to_pylist()

    tracemalloc.start()
    whole = scored(0, len(texts))
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert sum(map(len, texts)) > 4e6 and peak < 100e6
    few = scored(0, 50) + scored(50, 50)
    assert [{**r, "quality": round(r["quality"], 9)} for r in whole[:100]] == [{**r, "quality": round(r["quality"], 9)} for r in few]


def test_quality_on_labelled_rows(spark):
    docs, labels = read(spark, "documents"), read(spark, "labels")
    scored = Q.scored(docs, labels).join(labels, "doc_id").collect()
    good = [r for r in scored if r["quality"] is not None]
    table = {(r["doc_id"]): r for r in scored}
    assert len(table) == labels.count() and good
    kept = {r["doc_id"] for r in scored if r["kept"]}
    lab = {r["doc_id"]: r for r in labels.collect()}
    bad_kept = sum(lab[d]["quality"] == 0 for d in kept) / max(1, sum(r["quality"] == 0 for r in lab.values()))
    good_lost = sum(r["quality"] == 1 and not table[d]["base_failed"] and d not in kept for d, r in lab.items()) / len(lab)
    assert bad_kept < 0.15 and good_lost < 0.02


def test_quality_model_on_rows_it_has_not_seen(spark):
    docs, labels = read(spark, "documents"), read(spark, "labels")
    seen, unseen = labels.where("doc_id % 4 <> 1"), labels.where("doc_id % 4 = 1")
    got = Q.scored(docs, seen).withColumnRenamed("quality", "p").join(unseen, "doc_id").collect()
    right = sum((r["p"] >= Q.KEEP) == (r["quality"] == 1) for r in got)
    assert right / len(got) > 0.93


def test_language_on_held_out_rows(spark):
    docs = read(spark, "documents")
    got = G.op7(spark, SMALL).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert held and all(r["held_out"] == G.is_held_out(r["doc_id"]) for r in got)
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_of_every_case(spark, rows):
    model = G.train(read(spark, "documents"))
    got = G.identify(frame(spark, rows), model).collect()
    assert len(got) == len(rows)
    und = {i for i, t in pairs(rows) if t is None or not any(c.isalpha() for c in t)}
    assert {r["doc_id"] for r in got if r["lang_pred"] == "und"} == und
    assert all(r["score"] == 0 and r["rejected"] for r in got if r["lang_pred"] == "und")
    assert G.train(frame(spark, [])) is None
    assert all(r["lang_pred"] == "und" for r in G.identify(frame(spark, rows), None).collect())


def test_pipeline_stage_by_stage(spark, tmp_path):
    """Each stage keeps what its operator's brute-force version keeps of its own input."""
    docs = read(spark, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        out = stage(spark, docs, SMALL)
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "token output":
            assert docs.columns == columns
        left = {r["doc_id"] for r in docs.collect()}
        rows = [(r["doc_id"], r["text"]) for r in before.collect()]
        if name == "quality rules":
            failed = {r[0] for r in Q.reference(rows) if r[6]}
            assert not left & failed and len(left) > 0.8 * (len(rows) - len(failed))
        if name == "near-dedup":
            assert left == set(O.reference(rows).values())
        if name == "decontamination":
            bench = [(r["item_id"], r["text"]) for r in read(spark, "benchmark").collect()]
            assert left == {r[0] for r in D.reference(rows, bench) if not r[5]}
        if name == "mixing":
            assert docs.count() > len(rows) and left <= {r[0] for r in rows}
        if name == "token output":
            assert docs.count() == len(rows)


def test_pipeline_of_nothing(spark, tmp_path):
    read(spark, "documents").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        read(spark, name).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_of_every_case(spark, rows, tmp_path):
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        read(spark, name).write.parquet(f"{tmp_path}/{name}.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert got and None not in {r["n_tokens"] for r in got}


def test_long_text_is_read_whole(spark):
    rng = random.Random(1)
    text = prose(rng, 400_000) + " " + "#" * 9
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert Q.scored(docs, none).first()["n_symbols"] == 9
