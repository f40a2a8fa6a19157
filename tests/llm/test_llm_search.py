"""Window searches against brute force: decontamination and both substring operators."""

import numpy as np
import pytest
from corpus import documents, frame, ordered, pairs, prose
from hypothesis import given, settings, strategies as st

from riskframe.llm import decontamination as D, segments as S, substring_fm as A, substring_suffix as B
from riskframe.llm.fm_index import FMIndex


@pytest.fixture(scope="module")
def rows():
    return documents()


def bench_rows(rows):
    import random
    rng = random.Random(3)
    words = rows[4][1].split()
    return [(1, " ".join(words[5:30])), (2, rows[6][1][:200]), (2, rows[6][1][:200]), (3, None), (4, ""), (None, rows[9][1][:120]),
            (10, "One two THREE"), (5, prose(rng, 30)), (6, "...")]


def expected_windows(rows, bench):
    named = [(i, t) for i, t in bench if i is not None]
    got = {}
    for row, own in zip(D.reference(pairs(rows), bench), D.reference(pairs(rows), named)):
        got.setdefault(len(got), (row[0], row[1], row[2], own[3], own[4], row[5]))
    return list(got.values())


@pytest.mark.parametrize("block", [1 << 20, 300])
def test_decontamination_by_brute_force(spark, rows, block):
    bench = bench_rows(rows)
    b = spark.createDataFrame([(*x, "y") for x in bench], "item_id long, text string, uid string")
    docs = frame(spark, rows)
    got = D.digest(D.contaminated_spans(docs, b, block_bytes=block)).collect()
    want = expected_windows(rows, bench)
    assert ordered(got) == ordered(want)
    assert any(x[5] for x in want) and not all(x[5] for x in want)
    kept = D.clean(docs, b, block_bytes=block)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(w[0]) for w in want if not w[5])


def test_cut_removes_the_passages(spark, rows):
    b = spark.createDataFrame(bench_rows(rows), "item_id long, text string")
    docs = frame(spark, rows)
    cut = D.cut(docs, b)
    assert cut.columns == docs.columns and cut.count() == len(rows)
    # nothing that was under a window is left where it was; clean texts are untouched
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    hit = {r["doc_id"] for r in D.digest(D.contaminated_spans(docs, b)).collect() if r["contaminated"]}
    for r in cut.collect():
        if r["doc_id"] not in hit:
            assert r["doc_id"] in (3, None) or r["text"] == before[r["doc_id"]]


def test_empty_tables(spark):
    docs, bench = frame(spark, []), spark.createDataFrame([], "item_id long, text string")
    some = frame(spark, documents()[:3])
    assert D.digest(D.contaminated_spans(docs, bench)).count() == 0
    assert not any(r["contaminated"] for r in D.digest(D.contaminated_spans(some, bench)).collect())
    assert A.deduplicated(docs).count() == 0 and B.deduplicated(docs).count() == 0


@pytest.mark.parametrize("key_bytes", [S.KEY_BYTES, 100])
def test_substrings_by_brute_force(spark, rows, key_bytes, monkeypatch):
    monkeypatch.setattr(S, "KEY_BYTES", key_bytes)     # the small bound sends keys through single windows
    docs = frame(spark, rows)
    assert ordered(A.deduplicated(docs).drop("kept").collect()) == ordered(A.reference(pairs(rows)))
    assert ordered(B.deduplicated(docs).drop("kept").collect()) == ordered(B.reference(pairs(rows)))


def test_long_runs_and_heavy_keys(spark, monkeypatch):
    """Long repetitive texts in pieces, and runs of many lengths whose one key is dealt window by window."""
    monkeypatch.setattr(S, "PIECE_BYTES", 3000)
    monkeypatch.setattr(S, "KEY_BYTES", 20000)
    rng = __import__("random").Random(8)
    texts = ["a" * 9000, "ab " * 4000, " ".join(["word"] * 3000)] + ["b" * n for n in range(390, 690, 7)]
    texts += [" ".join(["run"] * n) for n in range(30, 130, 3)] + [prose(rng, 1500), prose(rng, 40) + "b" * 450]
    rows = [(i, t) for i, t in enumerate(texts)] + [(500, texts[-2]), (0, texts[0]), (0, texts[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert ordered(A.deduplicated(docs).drop("kept").collect()) == ordered(A.reference(rows))
    assert ordered(B.deduplicated(docs).drop("kept").collect()) == ordered(B.reference(rows))


@given(st.lists(st.tuples(st.integers(0, 40), st.lists(st.booleans(), min_size=1, max_size=30)), max_size=5), st.integers(1, 6))
def test_covered_units(spans, window):
    size = 80
    want = [False] * size
    for first, flags in spans:
        for i, f in enumerate(flags):
            if f:
                want[first + i:first + i + window] = [True] * window
    packed = [{"first": a, "flags": np.packbits(np.array(f), bitorder="little").tobytes()} for a, f in spans]
    assert S.covered_units(packed, window, size).tolist() == want


def test_kept_texts_are_real_outputs(spark, rows):
    docs = frame(spark, rows)
    for r in A.deduplicated(docs).where("n_removed > 0").collect():
        assert S.sha(r["kept"].encode()) == r["kept_sha256"] and len(r["kept"].split()) == r["n_words"] - r["n_removed"]
    for r in B.deduplicated(docs).where("n_removed > 0").collect():
        assert len(r["kept"]) == r["n_bytes"] - r["n_removed"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(1, 3), min_size=1, max_size=30), min_size=1, max_size=6), st.lists(st.integers(1, 3), min_size=1, max_size=4))
def test_fm_index_counts_and_locates(runs, pattern):
    text = np.array([x for r in runs for x in [*r, 0]])
    index = FMIndex(text, 3, sample=4)
    window = np.array([pattern])
    _, places = D.search(index, window, np.array([len(pattern)]))
    want = [i for i in range(len(text)) if text[i:i + len(pattern)].tolist() == pattern]
    assert sorted(places.tolist()) == want


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text("ab", min_size=400, max_size=460), min_size=1, max_size=5), st.integers(1, 2))
def test_suffix_order_finds_equal_windows(texts, copies):
    texts = texts + texts[:1] + ["a" * 430]
    raw = [t.encode() for t in texts]
    offsets = np.append(0, np.cumsum([len(r) for r in raw]))
    found = B.index(np.frombuffer(b"".join(raw), np.uint8), offsets, np.full(len(raw), copies))
    from collections import Counter
    seen = Counter(r[i:i + 400] for r in raw for i in range(len(r) - 399))
    for r, f in zip(raw, found):
        assert [seen[r[i:i + 400]] * copies > 1 for i in range(len(r) - 399)] == f.tolist()


def test_suffix_buckets_are_in_order():
    rng = np.random.default_rng(0)
    data = rng.integers(97, 99, 3000).astype(np.uint8)
    data[1500:2500] = data[100:1100]
    start, sizes = np.array([0, 1500]), np.array([1500, 1500])
    rank = B.sample_ranks(data, start, sizes)
    at = np.append(np.arange(0, 1450), np.arange(1500, 2950))
    one, two = B.prefixes(data, at)
    order = B.sort_bucket(data, at, one, two, rank)
    body = data.tobytes()
    tails = [body[i:1500 if i < 1500 else 3000] for i in order.tolist()]
    assert tails == sorted(tails)
