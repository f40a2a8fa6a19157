"""Filter audit, lexical search and sharding: against SQL on hard rows, and their inner parts by brute force."""

import random
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from compare import differences
from corpus import EXTRA, documents, frame, prose
from hypothesis import given, settings, strategies as st

from riskframe.llm import filter_audit as A, lexical_search as L, sharding as H


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents, benchmark and labels with nulls, repeated rows, ties and clashing columns."""
    rng, path = random.Random(5), tmp_path_factory.mktemp("hard")
    rows = documents()
    more = [(100 + i, prose(rng, rng.randint(1, 90)) + rng.choice(["", " # ", " ABCDEFG"]), None, rng.choice(["a", "b", "", None]), 1,
             *["x"] * EXTRA) for i in range(150)]
    more += [(400 + i, rows[2][1], None, rng.choice(["a", "c"]), 1, *["x"] * EXTRA) for i in range(120)]
    frame(spark, rows + more).write.parquet(f"{path}/documents.parquet")
    words = rows[4][1].split()
    bench = [(1, " ".join(words[5:30])), (2, rows[6][1][:200]), (2, rows[6][1][:200]), (3, None), (4, ""), (None, rows[9][1][:120]),
             (10, "One two THREE"), (5, prose(rng, 30)), (6, "..."), (7, "the the re re an"), (8, "word")]
    spark.createDataFrame([(*b, "y") for b in bench], "item_id long, text string, doc_id string").write.parquet(
        f"{path}/benchmark.parquet")
    labels = [(i % 60 if i % 7 else None, rng.choice([0, 1, None]), rng.choice([0, 1, None]), "z") for i in range(90)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int, source string").write.parquet(f"{path}/labels.parquet")
    return str(path)


@pytest.fixture(scope="module")
def duck(folder):
    import duckdb
    con = duckdb.connect()
    for name in ("documents", "benchmark", "labels"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet/*.parquet'")
    return con


@pytest.mark.parametrize("query, sql", [(A.op11, A.SQL), (L.op12, L.SQL), (H.op13, H.SQL)])
def test_hard_rows_by_sql(spark, folder, duck, query, sql):
    assert differences(query(spark, folder), duck, sql) == []


def test_reruns_agree(spark, folder):
    assert Counter(H.op13(spark, folder).collect()) == Counter(H.op13(spark, folder).collect())


@pytest.mark.parametrize("query", [A.op11, L.op12, H.op13])
def test_empty_tables(spark, folder, tmp_path, query):
    for name in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert query(spark, str(tmp_path)).collect() == []


# ---- filter audit --------------------------------------------------------------------

@given(st.lists(st.integers(0, 50), min_size=32, max_size=32))
@settings(max_examples=30, deadline=None)
def test_potential_gives_the_sum_over_orders(counts):
    game = A.removal_game(np.array(counts))
    total = [0] * 5
    for order in permutations(range(5)):
        seen = 0
        for i in order:
            total[i] += int(game[seen | 1 << i] - game[seen])
            seen |= 1 << i
    assert A.shapley(game).tolist() == total
    assert sum(total) == 120 * int(game[31])


def test_audit_steps_add_up(spark, folder):
    rows = A.op11(spark, folder).collect()
    parts = {r.part for r in rows}
    assert len(rows) == 600 * len(parts)
    sizes = Counter(r.source or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect())
    for part in parts:
        for order in ("ABCDE", "EDCBA"):
            mine = sorted((r for r in rows if r.part == part and r.filter_order == order), key=lambda r: r.step)
            assert sum(r.removed for r in mine) + mine[-1].kept == sizes[part]


# ---- lexical search ------------------------------------------------------------------

def small_corpus(rng, n, terms):
    """Documents of skewed vocabulary, many of them alike, as the tree takes them."""
    texts = [sorted(Counter(min(int(rng.expovariate(0.15)), terms - 1) for _ in range(rng.randint(0, 40))).items()) for _ in range(n)]
    texts += [texts[1]] * (n // 3)
    counts = np.array([c for t in texts for _, c in t], np.int64)
    rank = np.array([r for t in texts for r, _ in t], np.int64)
    cut = np.append(0, np.cumsum([len(t) for t in texts]))
    length = np.array([sum(c for _, c in t) for t in texts], np.int64)
    return texts, cut, rank, counts, length


@pytest.mark.parametrize("leaf, depth", [(1, 40), (4, 2), (32, 40)])
def test_tree_search_by_brute_force(monkeypatch, leaf, depth):
    monkeypatch.setattr(L, "LEAF", leaf)
    monkeypatch.setattr(L, "DEPTH", depth)
    rng, terms = random.Random(leaf), 60
    scored = leaves = 0
    scale = np.zeros(terms, np.int64)
    for _ in range(4):
        texts, cut, rank, counts, length = small_corpus(rng, 150, terms)
        doc = np.array(rng.sample(range(1000), len(texts)), np.int64)
        norms = 75 + (25 * length * len(texts)) // max(1, int(length.sum()))
        halves = [slice(0, len(texts) // 2), slice(len(texts) // 2, len(texts))]
        trees = []
        for h in halves:
            c = cut[h.start:h.stop + 1]
            trees.append(L.Tree(doc[h], length[h], norms[h], c - c[0], rank[c[0]:c[-1]], counts[c[0]:c[-1]], terms))
            leaves += 10 * int((trees[-1].child == trees[-1].child_end).sum())
        for _ in range(10):
            ranks = np.array(sorted(rng.sample(range(terms), rng.randint(1, 8))), np.int64)
            weights = np.array([rng.randint(1, 3) * (100 + 40 * int(r)) for r in ranks], np.int64)
            best = L.Best(5)
            for tree in trees:
                scored += tree.search(ranks, weights, best, scale)
            want = []
            for d, m, t in zip(doc.tolist(), norms.tolist(), texts):
                tf = dict(t)
                score = sum(w * ((10**9 * tf.get(r, 0)) // (1000 * tf.get(r, 0) + 12 * m)) for r, w in zip(ranks.tolist(), weights.tolist()))
                want += [(-score, d)] if score else []
            assert list(zip((-best.score).tolist(), best.doc.tolist())) == sorted(want)[:5]
    if leaf == 1:
        assert scored < leaves / 2          # bounds leave most of the tree out


@pytest.mark.parametrize("terms, repeats", [(40, 1 << 20), (1 << 20, 60)])
def test_items_in_blocks(spark, folder, terms, repeats):
    docs, bench = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "benchmark"))
    assert Counter(L.ranked(docs, bench, most_terms=terms, most_repeats=repeats).collect()) == Counter(L.ranked(docs, bench).collect())


# ---- sharding ------------------------------------------------------------------------

def shards_of(spark, rows):
    placed = H.interleaved(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    counts = Counter(r["shard"] for r in placed)
    assert sorted(counts) == list(range(24)) and max(counts.values()) - min(counts.values()) <= 1
    for shard, n in counts.items():
        assert sorted(r["slot"] for r in placed if r["shard"] == shard) == list(range(n))
    return placed


def test_every_shard_matches_the_mixture(spark):
    rows = [(i, "t" * (i % 9), f"s{min(i % 40, 9)}" if i % 50 else None) for i in range(6001)]
    placed = shards_of(spark, rows)
    sizes, cells = Counter(r["source"] for r in placed), Counter((r["source"], r["shard"]) for r in placed)
    # a range of ranks is right to within one row of each source; equal row counts move its ends by half of that in all
    for source, n in sizes.items():
        assert all(abs(cells[source, s] - n / 24) <= 2 + len(sizes) * n / len(rows) / 2 for s in range(24))


def test_rows_of_tiny_sources_are_spread(spark):
    rows = [(i, "t", "s") for i in range(3000)] + [(9000 + i, "only", f"own{i}") for i in range(1500)]
    alone = Counter(r["shard"] for r in shards_of(spark, rows) if r["source"] != "s")
    assert len(alone) == 24 and max(alone.values()) < 2 * 1500 / 24


def test_written_shards_keep_all_columns_and_order(spark, tmp_path):
    docs = frame(spark, documents()).withColumn("h", docs_one()).withColumn("Place", docs_one())
    H.write_shards(docs, f"{tmp_path}/out", shards=5)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert set(back.columns) == {*docs.columns, "shard", "slot"}
    assert Counter(map(tuple, back.select(*docs.columns).collect())) == Counter(map(tuple, docs.collect()))


def docs_one():
    from pyspark.sql import functions as F
    return F.lit(1)
