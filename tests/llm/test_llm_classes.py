"""Near-duplicate classes, mixing, licenses, URLs and token records."""

import random
from collections import defaultdict

import numpy as np
import pytest
from corpus import EXTRA, documents, frame, ordered, pairs, prose

from riskframe.llm import license_scan as L, mixing as M, order_minhash as O, token_records as K, url_templates as U
from riskframe.llm.components import components


@pytest.fixture(scope="module")
def rows():
    return documents()


def unique(rows):
    return [r for r in rows if r[0] is not None and r[0] != 3]


def test_classes_by_brute_force(spark, rows):
    mine = unique(rows)
    got = {r["doc_id"]: r["class_id"] for r in O.classes(frame(spark, mine)).collect()}
    assert got == O.reference(pairs(mine))


def test_one_document_of_each_class_stays(spark, rows):
    docs = frame(spark, rows)
    kept = O.deduplicated(docs)
    assert kept.columns == docs.columns
    table = O.classes(docs).collect()
    assert kept.count() == len({(r["class_id"], r["class_size"], r["uid"]) for r in table if r["representative"]})
    assert O.deduplicated(frame(spark, [])).count() == 0


def family(rng, members, changes, words=300):
    base = prose(rng, words, 0).split()
    out = []
    for i in range(members):
        w = list(base)
        for c in range(changes):
            w[rng.randrange(len(w))] = f"new{i}x{c}"
        out.append(" ".join(w))
    return out


def all_pairs(rows):
    """Classes and number of links by comparing all pairs with the operator's own measure of two texts."""
    import pyarrow as pa
    from riskframe.llm import text as T
    data, offsets = T.layout(pa.array([t for _, t in rows]))
    folded = T.LOWER[data]
    starts, ends, first = T.words(folded, offsets, T.PLAIN)
    codes = T.word_codes(folded, starts, ends)
    words = [codes[a:b] for a, b in zip(first[:-1], first[1:])]
    root, links = list(range(len(rows))), 0

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if O.similar(words[i], words[j]):
                links += 1
                root[max(find(i), find(j))] = min(find(i), find(j))
    return {rows[i][0]: rows[find(i)][0] for i in range(len(rows))}, links


@pytest.mark.parametrize("members, changes, seed", [(60, 3, 5), (60, 4, 6), (200, 4, 7), (200, 5, 8)])
def test_families_lose_no_link(spark, members, changes, seed):
    """Groups whose links are few and have no centre: the classes are those of all pairs."""
    rng = random.Random(seed)
    rows = [(i, t) for i, t in enumerate(family(rng, members, changes))] + [(1000 + i, prose(rng, 300, 0)) for i in range(20)]
    got = {r["doc_id"]: r["class_id"] for r in O.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want, links = all_pairs(rows)
    assert got == want and links > 10


def test_blocks_ask_for_a_forest_of_all_near_pairs(monkeypatch):
    """Blocks in pieces of few rows and pairs give the closest pairs between classes, each block for itself."""
    import pyarrow as pa
    for name, value in (("SLAB", 40), ("PIECE", 64), ("KEPT", 30)):
        monkeypatch.setattr(O, name, value)
    rng = np.random.default_rng(3)
    rows, sets = [], {}
    for bucket in range(12):
        base = rng.integers(0, 1 << 62, 120).astype(np.uint64)
        for m in range(int(rng.integers(2, 30))):
            s = base.copy()
            s[rng.choice(120, int(rng.integers(0, 18)), replace=False)] = rng.integers(0, 1 << 62, 1)[0] + np.arange(1).astype(np.uint64)
            s = np.unique(s)
            node = f"{bucket}-{m:02d}"
            sets[node] = set(s.tolist())
            parity, _ = O.parities(s, np.zeros(len(s), np.int64), np.array([len(s)]))
            cross = bucket % 3 == 0
            rows.append((bucket, 0, 1 if cross else 0, m % 2 if cross else 0, node, None, f"{bucket}-{m // 5}", len(s), parity.tobytes()))
    gone = {("4-00", "4-01"), ("4-02", "4-07")} & {(a, b) for a in sets for b in sets}
    rows += [(4, 0, 0, -1, a, b, None, 0, None) for a, b in gone]
    rows.sort(key=lambda r: r[:5])
    names = ["bucket", "i", "j", "side", "node", "other", "root", "size", "parity"]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.binary()]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[i:i + 23]), kinds)], names) for i in range(0, len(rows), 23)]
    asked, more = set(), set()
    for out in O._asked(1)(iter(batches)):
        for b, x, y in zip(*[out.column(c).to_pylist() for c in ("bucket", "a", "b")]):
            (more.add(b) if x is None else asked.add((b, min(x, y), max(x, y))))
    for bucket in range(12):
        members = [r for r in rows if r[0] == bucket and r[5] is None]
        near = {}
        for r in members:
            for q in members:
                if r[4] < q[4] and r[6] != q[6] and (r[3] != q[3] or r[2] == r[1]) and (r[4], q[4]) not in gone:
                    x, y = sets[r[4]], sets[q[4]]
                    if len(x & y) >= 0.8 * len(x | y):
                        near[r[4], q[4]] = (r[6], q[6])
        mine = {(a, b) for k, a, b in asked if k == bucket}
        assert not mine & gone

        def parts(pairs, ends):
            root = {r[6]: r[6] for r in members}

            def find(i):
                while root[i] != i:
                    i = root[i]
                return i
            for p in pairs:
                a, b = ends(p)
                root[find(a)] = find(b)
            return {frozenset(k for k in root if find(k) == find(r)) for r in root}
        of = {r[4]: r[6] for r in members}
        # what is asked for spans all near pairs, and a block that kept some back says so
        joint = parts(mine, lambda p: (of[p[0]], of[p[1]]))
        for group in parts(near, near.get):
            assert any(group <= j for j in joint)
        assert len(mine) < len({r[6] for r in members})
        assert bucket in more or set(near) <= mine


def test_order_matters(spark):
    rng = random.Random(6)
    parts = [prose(rng, 50, 0) for _ in range(8)]
    rows = [(1, " ".join(parts)), (2, " ".join(reversed(parts))), (3, " ".join(parts[:-1]))]
    got = {r["doc_id"]: r["class_id"] for r in O.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_edit_distance():
    rng = np.random.default_rng(2)
    for _ in range(60):
        a = rng.integers(0, 3, rng.integers(1, 14)).astype(np.uint64)
        b = rng.integers(0, 3, rng.integers(1, 14)).astype(np.uint64)
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            last, row = row, [i + 1]
            for j, y in enumerate(b):
                row.append(min(last[j] + int(x != y), last[j + 1] + 1, row[-1] + 1))
        assert O.edit_distance(a, b, 20) == row[-1]
        assert O.edit_distance(a, b, row[-1] - 1) is None


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 102), (101, 103)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 104)}}


def test_targets_by_repeated_resharing(spark):
    sizes = {"a": 10, "b": 500, "c": 300, "d": 7, "e": 100, None: 50, "f": 0}
    rows = spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, size long")
    names = sorted(k for k in sizes if k is not None) + [None]
    weight = {k: M.WEIGHTS[i % 3] for i, k in enumerate(names)}
    left, target, open_ = 1.5 * sum(sizes.values()), {}, set(names)
    while True:
        share = {k: left * weight[k] / sum(weight[x] for x in open_) for k in open_}
        over = {k for k in open_ if share[k] >= 2 * sizes[k]}
        if not over:
            target |= share
            break
        for k in over:
            target[k] = 2 * sizes[k]
            left -= target[k]
        open_ -= over
    got = {r["source"]: r["target"] for r in M.targets(rows).collect()}
    assert got == pytest.approx(target)


def test_mix_comes_near_its_targets(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(["w"] * rng.randint(0, 200)), f"s{i % 4}" if i % 2 else "hot") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sized = M.sized(docs)
    taken, goal = defaultdict(int), {}
    for r in M.copies(sized, M.targets(sized)).collect():
        assert 0 <= r["copies"] <= 2
        taken[r["source"]] += r["copies"] * r["size"]
        goal[r["source"]] = r["target"]
    for k in goal:
        assert abs(taken[k] - goal[k]) <= 200 + 0.002 * goal[k]


def test_mix_of_every_case(spark, rows):
    docs = frame(spark, rows)
    sized = M.sized(docs)
    table = M.copies(sized, M.targets(sized))
    assert table.count() == len(rows)
    mix = M.mixed(docs)
    assert mix.columns == docs.columns and mix.count() == sum(r["copies"] for r in table.collect())
    assert M.mixed(frame(spark, [])).count() == 0


def test_licenses_by_plain_scan(spark, rows):
    extra = [(900, "x\nlicensed  UNDER the Apache License, Version 2.0.\nMIT license and mit license"), (901, "under version the licensed Apache 2.0"),
             (902, "no " * 100 + "All rights reserved " + "no " * 100), (903, "rights all\nreserved")]
    docs = frame(spark, rows + [(*e, None, None, None, *["x"] * EXTRA) for e in extra])
    got = L.scan(docs).collect()
    assert len(got) == len(rows) + len(extra)
    templates = [(label, set(L.split(t))) for label, t in L.TEMPLATES]
    text = {**{r[0]: r[1] for r in rows if r[0] not in (3, None)}, **dict(extra)}
    for r in got:
        if r["doc_id"] not in text:
            continue
        words = L.split(text[r["doc_id"]] or "")
        base = [(i, label) for p, label in L.PHRASES for i in range(len(words)) if words[i:i + len(L.split(p))] == L.split(p)]
        labels, best = {x for _, x in base}, 0.0
        for line in (text[r["doc_id"]] or "").split("\n"):
            w = L.split(line)
            for b in range(0, max(1, len(w)), L.STRIDE):
                if b and b >= len(w) - (L.BLOCK - L.STRIDE):
                    break
                for label, t in templates:
                    share = len(t & set(w[b:b + L.BLOCK])) / len(t)
                    if len(t & set(w[b:b + L.BLOCK])) >= L.need(len(t)):
                        labels.add(label)
                        best = max(best, share)
        assert (r["n_words"], r["n_base"], r["labels"]) == (len(words), len(base), ",".join(sorted(labels)))
        assert r["base_labels"] == ",".join(sorted({x for _, x in base}))
        assert r["first_word"] == min((i for i, _ in base), default=None) and r["last_word"] == max((i for i, _ in base), default=None)
        assert r["score"] == (1.0 if base else best)
    assert L.scan(frame(spark, [])).count() == 0


def test_urls(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.Example.NET/en/1?x=/de/", "https://example.com/de/5.html#t", "x://Éa.org/fr/", "a://b://c/d",
            "http://www.net", "http://q.net/", "http://myexample.com/de/1", "http://h.org?x/y"]
    urls += [f"http://h.io/good/{i}" for i in range(60)] + [f"http://h.io/bad/{i}.html" for i in range(60, 120)] + [f"http://h.io/{i}/x/y/z/1/2/3/{i}" for i in range(120, 150)]
    pages = spark.createDataFrame([(i, u, "z") for i, u in enumerate(urls)], "page_id long, url string, host string")
    labels = spark.createDataFrame([(i, 0 if 60 <= i < 120 else 1, 0) for i in range(150)], "doc_id long, quality int, toxic int")
    got = {r["page_id"]: r for r in U.filtered(pages, labels).collect()}
    assert len(got) == len(urls)
    assert [(got[i]["host"], got[i]["path"], got[i]["rule"]) for i in range(12)] == [
        ("", "", None), ("", "", None), ("", "", None), ("", "", None), ("a.example.net", "/en/1", "example.net/en/"),
        ("example.com", "/de/5.html", "example.com/de/"), ("Éa.org", "/fr/", "org/fr/"), ("b:", "//c/d", None),
        ("www.net", "", None), ("q.net", "/", "net/"), ("myexample.com", "/de/1", None), ("h.org", "", None)]
    assert [got[i]["verdict"] for i in (4, 5, 6, 9)] == ["allow", "block", "allow", "block"]
    assert got[20]["template"] == "/good/*" and got[20]["verdict"] == "allow"
    assert got[80]["template"] == "/bad/*" and got[80]["verdict"] == "block"
    assert got[140]["template"].endswith("/**")
    assert U.filtered(pages.limit(0), labels).count() == 0
    assert all(r["rule"] or r["verdict"] == "allow" for r in U.filtered(pages, labels.limit(0)).collect())


@pytest.mark.parametrize("size", [K.FILE_BYTES, 2000])
def test_token_records_round_trip(spark, rows, size, monkeypatch):
    monkeypatch.setattr(K, "FILE_BYTES", size)
    mine = [r for r in rows if r[0] != 3]
    assert ordered(K.token_output(frame(spark, mine)).collect()) == ordered(K.reference(pairs(mine)))
    assert K.token_output(frame(spark, [])).count() == 0


def test_encoder_equals_whole_texts():
    rng = random.Random(4)
    alphabet = [" ", " ", "a", "the", "é", "\n", "\t", "'s", "12", "!", "\u00a0", "\u2003", "\u3000", "日", "<|endoftext|>", "\x85", "ß", "×", "–", "–", "I'll", ",", "-"]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 30))) for _ in range(1500)]
    plain = [t.replace("<|endoftext|>", "|>") for t in texts]
    import pyarrow as pa
    from riskframe.llm import text as T
    encoder = K.Encoder(K.vocabulary_path())
    for texts in (plain, plain, texts):       # the second time from memory
        ids, counts = encoder.encode(*T.layout(pa.array(texts)))
        ends = np.cumsum(counts)
        for t, e, c in zip(texts, ends, counts):
            assert ids[e - c:e].tolist() == encoder.tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


def test_broken_records_are_noticed():
    body = K.MAGIC + bytes([2]) + K.frame(b"\1" * 8 + b"\0" + b"\2\0")
    assert [x[1].tolist() for x in K.records(memoryview(body))] == [[2]]
    for i in (10, 20, 25, 31):
        with pytest.raises((ValueError, Exception)):
            list(K.records(memoryview(body[:i] + bytes([body[i] ^ 1]) + body[i + 1:])))


def test_token_records_leave_the_worker_one_by_one(monkeypatch):
    """A worker holds a record and a small buffer, never a whole file."""
    from types import SimpleNamespace

    import pyarrow as pa
    import pyspark
    from pyarrow import fs
    writes, closed = {}, {}

    class Out:
        def __init__(self, path):
            self.path = path
            writes[path] = []

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.close()

        def write(self, body):
            writes[self.path].append(bytes(body))

        def close(self):
            closed[self.path] = b"".join(writes[self.path])

    store = SimpleNamespace(open_output_stream=lambda path, **_: Out(path),
                            move=lambda a, b: closed.__setitem__(b, closed.pop(a)))
    monkeypatch.setattr(fs, "FileSystem", SimpleNamespace(from_uri=lambda uri: (store, uri)))
    monkeypatch.setattr(pyspark.TaskContext, "get", classmethod(lambda _: SimpleNamespace(partitionId=lambda: 0)))
    texts = [f"word{i} and some more words" for i in range(500)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(500), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    (row,) = [r for b in K._writer("there", K.vocabulary_path())(iter([batch])) for r in b.to_pylist()]
    content = closed["there/part-000000-000000.rec"]
    assert row["docs"] == 500 and row["bytes"] == len(content)
    assert [d for d, _ in K.records(memoryview(content))] == list(range(500))
    assert len(closed["there/part-000000-000000.idx"]) == 500 * 16
    records = next(w for p, w in writes.items() if ".rec" in p)
    assert max(map(len, records)) < len(content) / 100


def test_token_encoder_asks_for_few_pieces_at_a_time(monkeypatch):
    """The library's answer holds far more than the ids: a worker asks for at most 4,000 new pieces at once."""
    encoder, sent = K.Encoder(K.vocabulary_path()), []
    library = encoder.tokenizer

    class Spy:
        def encode(self, part, **options):
            sent.append(len(part))
            return library.encode(part, **options)

    encoder.tokenizer = Spy()
    data = " ".join(f"w{i}" for i in range(9_000)).encode()
    ids, counts = encoder.encode(np.frombuffer(data, np.uint8), np.array([0, len(data)], np.int64))
    assert ids.tolist() == library.encode(data.decode(), add_special_tokens=False).ids and counts.tolist() == [len(ids)]
    assert sum(sent) == 9_000 and max(sent) <= 4_000 and K.PART <= 1 << 20
