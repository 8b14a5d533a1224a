"""MinHash, embeddings, components and the pipeline against plain versions."""

import random
from collections import defaultdict

import numpy as np
import pytest

from rankloom.llm import minhash, multiindex
from rankloom.llm.components import connected_components


class Sets:
    def __init__(self, items):
        self.up = {x: x for x in items}

    def top(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.top(a), self.top(b)
        self.up[max(a, b)] = min(a, b)


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def plain_near(rows, k, percent):
    s = {d: shingles(t, k) for d, t in rows}
    u = Sets(s)
    ids = list(s)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            n = len(s[a] & s[b])
            if n and 100 * n >= percent * len(s[a] | s[b]):
                u.join(a, b)
    return {d: (len(s[d]), u.top(d)) for d in s}


def family(rng, n, size, edits):
    base = [f"w{rng.randint(0, 5000)}" for _ in range(size)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(size)] = f"x{rng.randint(0, 10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("k", [2, 5])
def test_minhash(spark, k, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 16)
    rng = random.Random(k)
    texts = family(rng, 60, 150, 12) + family(rng, 40, 40, 3) + [f"alone {i} " + " ".join(str(rng.random()) for _ in range(20)) for i in range(50)]
    texts += ["one", "ONE", "one two", "", None, "  \n ", "Same Words Here Now Please Do", "same\x0bwords here\tnow please do", "zz " * 5000, "É x", "é x"]
    rng.shuffle(texts)
    rows = [(i * 3, t) for i, t in enumerate(texts)]
    d = spark.createDataFrame([(i, t, 1, "c") for i, t in rows], "doc_id bigint, text string, n_shingles int, component string")
    got = {r.doc_id: r for r in minhash.near_duplicates(d, shingle=k).collect()}
    want = plain_near(rows, k, 80)
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_minhash_edges(spark):
    d = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (1, "a b c"), (1, "a b c"), (2, "a b c")], "doc_id bigint, text string")
    rows = sorted(((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(d, shingle=2).collect()), key=repr)
    assert rows == sorted([(None, None, True), (None, None, True), (1, 1, True), (1, 1, True), (2, 1, False)], key=repr)
    assert minhash.near_duplicates(d.limit(0), shingle=2).count() == 0


def near_by_text(rows, k, percent):
    """Components where rows of one id are one document, linked if any of their texts is."""
    sets, u = [(i, shingles(t, k)) for i, t in rows if i is not None], Sets(i for i, _ in rows if i is not None)
    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            n = len(a & b)
            if n and 100 * n >= percent * len(a | b):
                u.join(i, j)
    return {i: u.top(i) for i, _ in sets}


@pytest.mark.parametrize("seed", range(3))
def test_minhash_ids_with_several_texts(spark, seed, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 8)
    rng = random.Random(seed)
    texts = family(rng, 25, 60, 6) + family(rng, 25, 60, 6) + family(rng, 10, 60, 2)
    a, b = texts[0], texts[25]
    rows = [(1, a), (7, a), (7, b), (9, b + " word")] + [(rng.randint(10, 40), rng.choice(texts)) for _ in range(90)] + [(3, None), (3, ""), (3, a + " more")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = {(r.doc_id, r.component_id) for r in minhash.near_duplicates(d, shingle=2).collect()}
    assert got == set(near_by_text(rows, 2, 80).items())


@pytest.mark.parametrize("k", [1, 2, 5])
def test_long_texts_are_shingled_whole(k, monkeypatch):
    """Texts beyond BYTES go block by block, words across block ends included, with the same hashes as in one block."""
    rng = random.Random(k)
    texts = [" ".join("x" * rng.randint(1, 40) + str(rng.randint(0, 99)) for _ in range(300)).encode(), b"a" * 5000, b"  " * 900 + b"b c", b"one\x0btwo " * 400, b"q " * 129, b"z" * 128 + b" " + b"y" * 127]
    whole = [minhash.Shingler(k).sets([t])[0].tolist() for t in texts]
    monkeypatch.setattr(minhash, "BYTES", 128)
    assert [minhash.Shingler(k).sets([t])[0].tolist() for t in texts] == whole
    assert [len(x) for x in whole] == [len(shingles(t.decode(), k)) for t in texts]


def test_a_very_long_text_takes_bounded_memory():
    import tracemalloc

    text = (" ".join(f"w{i % 9973}" for i in range(900_000))).encode()
    work = minhash.Shingler(2)
    tracemalloc.start()
    work.sets([text])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12 * len(text)


def test_minhash_skips_sets_of_strangers(spark, monkeypatch):
    """Documents that only share a bucket by chance cost no text; hubs with many partners are dealt in parts."""
    monkeypatch.setattr(minhash, "LOAD", 200)
    rng = random.Random(9)
    texts = family(rng, 70, 100, 8)
    rows = list(enumerate(texts))
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(d, shingle=2).collect()}
    assert got == plain_near(rows, 2, 80)


def test_estimate(spark):
    rng = random.Random(1)
    a = [str(rng.random()) for _ in range(400)]
    b = a[:360] + [str(rng.random()) for _ in range(40)]
    d = spark.createDataFrame([(1, " ".join(a)), (2, " ".join(b))], "doc_id bigint, text string")
    s = {r.doc_id: r for r in minhash.signatures(d, shingle=1).collect()}
    pair = spark.createDataFrame([(list(s[1].sig), list(s[2].sig))], "a array<bigint>, b array<bigint>")
    true = len(set(a) & set(b)) / len(set(a) | set(b))
    assert pair.select(minhash.estimate("a", "b")).first()[0] == pytest.approx(true, abs=0.12)
    assert pair.select(minhash.estimate("a", "a")).first()[0] == pytest.approx(1.0)


def test_components(spark):
    rng = random.Random(2)
    for shape in ([(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 80)], [(99, i) for i in range(50)], [(rng.randint(0, 150), rng.randint(0, 150)) for _ in range(110)], []):
        rng.shuffle(shape)
        u = Sets({x for e in shape for x in e})
        for a, b in shape:
            u.join(a, b)
        got = {r.node: r.component for r in connected_components(spark.createDataFrame([*shape, (None, 1)], "a bigint, b bigint")).collect()}
        assert got == {x: u.top(x) for e in shape if e[0] != e[1] for x in e} | {x: u.top(x) for x in got}


def plain_vectors(rows, threshold):
    n, u, groups = {r[0]: 0 for r in rows}, Sets(r[0] for r in rows), defaultdict(list)
    for i, v, label in rows:
        if label is None or v is None or not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        groups[label, len(v)].append((i, np.array(v, np.float32).astype(np.float64)))
    for g in groups.values():
        for x, (i, a) in enumerate(g):
            for j, b in g[:x]:
                if a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= threshold:
                    n[i] += 1
                    n[j] += 1
                    u.join(i, j)
    return {i: (n[i], u.top(i)) for i in n}


@pytest.mark.parametrize("block", [16, 1024])
def test_vectors(spark, block):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(400, 8))
    v[50:90] = v[:40]
    v[90:200] = v[0] + rng.normal(size=(110, 8)) * 0.05
    v[200:260] = v[:60] * 3
    rows = [(i, [float(x) for x in np.float32(x)], int(i % 3)) for i, x in enumerate(v)]
    rows += [(400, None, 1), (401, [0.0] * 8, 1), (402, [float("nan")] * 8, 1), (403, [1.0, None], 1), (404, [1.0, 2.0], 1), (405, [1.0, 2.0], 1), (406, [2.0], 1), (407, [2.0], 1), (408, [1.0] * 8, None), (409, [float("inf")] * 8, 1), (410, [], 1)]
    d = spark.createDataFrame([(*r, "x") for r in rows], "vec_id bigint, embedding array<float>, label int, weight string")
    got = {r.vec_id: r for r in multiindex.near_duplicates(d, threshold=0.95, block=block).collect()}
    assert {i: (r.n_links, r.component_id) for i, r in got.items()} == plain_vectors(rows, 0.95)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    assert multiindex.near_duplicates(d.limit(0)).count() == 0
    nulls = multiindex.near_duplicates(d.limit(2).selectExpr("cast(null as bigint) as vec_id", "embedding", "label")).collect()
    assert [(r.vec_id, r.n_links, r.component_id, r.kept) for r in nulls] == [(None, 0, None, True)] * 2


@pytest.mark.parametrize("tile", [1, 7, 512])
def test_tiles_of_a_block_equal_the_whole(tile):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 6))
    x[20:50] = x[rng.integers(0, 20, 30)] + rng.normal(size=(30, 6)) * 0.1
    left, right = np.arange(0, 60, 2), np.arange(10, 60)
    link = multiindex.linked_rows(x, left, right, 0.95, tile)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert (link == ((unit[left] @ unit[right].T >= 0.95) & (left[:, None] != right[None, :]))).all() and link.sum() > 20
    w = rng.integers(1, 9, 60)
    n, n_other = multiindex.weights_linked(link, w[left], w[right], tile)
    assert (n == (link * w[right]).sum(axis=1)).all() and (n_other == (link * w[left][:, None]).sum(axis=0)).all()
    # Rows and columns are two nodes, even of one row of x.
    u = Sets([*left.tolist(), *(1000 + right).tolist()])
    for a, b in zip(*np.nonzero(link), strict=True):
        u.join(int(left[a]), int(1000 + right[b]))
    top, top_other = multiindex.least_reached(link, left, 1000 + right, tile)
    assert top.tolist() == [u.top(a) for a in left.tolist()] and top_other.tolist() == [u.top(1000 + b) for b in right.tolist()]
    assert [len(v) for v in multiindex.least_reached(link[:0], left[:0], right, tile)] == [0, 50]


def test_vectors_ids_with_several_values(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(12, 8))
    v[6:] = v[:6] + rng.normal(size=(6, 8)) * 0.02
    fixed = [(1, v[0]), (7, v[0]), (7, v[1]), (9, v[7])]
    rows = [(i, [float(y) for y in np.float32(x)], 1) for i, x in fixed + [(int(rng.integers(10, 30)), v[rng.integers(0, 12)]) for _ in range(60)]]
    distinct = [(i, list(x), label) for i, x, label in sorted({(i, tuple(x), label) for i, x, label in rows})]
    for data in (rows[:4], rows):
        want_rows = [r for r in distinct if r in data]
        n, u = defaultdict(int), Sets(i for i, *_ in want_rows)
        for x, (i, a, _) in enumerate(want_rows):
            for j, b, _ in want_rows[:x]:
                a_, b_ = np.array(a), np.array(b)
                if a_ @ b_ / (np.linalg.norm(a_) * np.linalg.norm(b_)) >= 0.98:
                    n[i] += 1
                    n[j] += 1
                    u.join(i, j)
        d = spark.createDataFrame(data, "vec_id bigint, embedding array<float>, label int").repartition(3)
        got = {(r.vec_id, r.n_links, r.component_id) for r in multiindex.near_duplicates(d, threshold=0.98, block=8).collect()}
        assert got == {(i, n[i], u.top(i)) for i, *_ in want_rows}
    assert n[7] >= 2


def test_cells_hold_every_partner():
    """The traversal's recall against brute force: no partner lies in a cell that isn't visited."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 16))
    x[500:] = x[rng.integers(0, 500, 1000)] + rng.normal(size=(1000, 16)) * 0.03
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    books = multiindex.Codebooks(list(x[:400]), 6)
    row, cell, visitor = books.cells(x, 2 - 2 * 0.98 + 1e-9)
    own = dict(zip(row[~visitor].tolist(), cell[~visitor].tolist(), strict=True))
    visits = defaultdict(set)
    for r, c in zip(row.tolist(), cell.tolist(), strict=True):
        visits[r].add(c)
    a, b = np.nonzero(np.triu(x @ x.T >= 0.98, 1))
    assert len(a) > 500
    assert all(own[j] in visits[i] or own[i] in visits[j] for i, j in zip(a.tolist(), b.tolist(), strict=True))
    assert len(row) < 1500 * 36 / 2


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as c

    P = pytest.importorskip("public_tokenizers")
    assert [n for n, _ in c.STAGES] and len(c.STAGES) == 4
    rng = random.Random(3)
    en, de = "the house of and water with light all over here now".split(), "das haus und der wasser mit licht ganz hier oben jetzt".split()
    make = lambda w, n: " ".join(f"{rng.choice(w)}" + (f"{rng.choice('abcdefg')}" if rng.random() < 0.3 else "") for _ in range(n))
    rows = [(i, make(en if i % 2 else de, 120), "en" if i % 2 else "de") for i in range(60)]
    rows += [(100, rows[0][1], "de"), (101, rows[1][1] + " tail", "en"), (102, None, "en"), (103, "12 34", "en"), (104, make(en, 20), "en"), (105, "spam ham ram " * 60, "en"), (None, make(en, 90), "en"), (5, rows[5][1], "en")]
    d = spark.createDataFrame([(*r, "s", 1, "x") for r in rows], "doc_id bigint, text string, lang string, source string, score int, row string")
    d.write.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in c.STAGES:
        d = spark.read.parquet(str(tmp_path / "documents.parquet")) if name == "language_id" else spark.read.parquet(str(tmp_path / last))
        stage(spark, d, str(tmp_path)).write.parquet(str(tmp_path / name))
        last = name
    ids = lambda n: sorted((r.doc_id for r in spark.read.parquet(str(tmp_path / n)).collect()), key=repr)
    first = set(ids("language_id"))
    assert {102, 103}.isdisjoint(first)
    assert set(range(60)) <= first
    assert {104, 105}.isdisjoint(ids("quality_rules"))
    kept = ids("near_dedup")
    assert {100, 101}.isdisjoint(kept)
    assert kept.count(5) == 1
    assert None in kept
    assert spark.read.parquet(str(tmp_path / "near_dedup")).columns == ["doc_id", "text", "lang", "source", "score", "row"]
    assert set(ids("best_fit_packing")) == set(kept)
    ran = c.run(spark, str(tmp_path))
    key = lambda df: sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in df.collect()), key=repr)
    assert key(ran) == key(spark.read.parquet(str(tmp_path / "best_fit_packing")))
    assert P
