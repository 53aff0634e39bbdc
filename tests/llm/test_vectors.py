"""Near-duplicate vectors and nearest neighbours against brute force."""

import os
import subprocess
import sys

import numpy as np

from quarry.llm import ann, embdedup


def make(n=500, dims=16, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dims))
    x[n // 2 : n // 2 + 120] = x[7] + 0.08 * rng.standard_normal((120, dims))
    x[n // 2 + 120 : n // 2 + 160] = x[8] + 0.05 * rng.standard_normal((40, dims))
    x[20:30] = x[19]
    x[30] = 3 * x[19]
    return x.astype(np.float32)


def odd(dims=16):
    return [(2000, None, 1), (2001, [], 1), (2002, [0.0] * dims, 1), (2003, [float("nan")] * dims, 1), (2004, [None] * dims, 1), (2005, [float("inf")] + [1.0] * (dims - 1), 1)]


SCHEMA = "vec_id long, embedding array<float>, label int, node string, u int"


def table(spark, x, labels):
    rows = [(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, labels, strict=True))]
    rows += [(i, v, k) for i, v, k in odd()] + [(3000, x[19].tolist(), None), (3001, x[19].tolist()[:8], 1)]
    return spark.createDataFrame([(*r, "a", 1) for r in rows], SCHEMA), rows


def test_duplicates(spark):
    x = make()
    labels = np.arange(len(x)) % 2
    labels[250:410] = 1
    labels[[7, 8]] = 1
    df, rows = table(spark, x, labels)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embdedup.duplicates(df, 0.98).collect()}
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    near = (u @ u.T >= 0.98) & (labels[:, None] == labels)
    np.fill_diagonal(near, False)
    root = np.arange(len(x))
    while True:
        new = np.minimum(root, np.where(near, root[None, :], len(x)).min(1))
        if (new == root).all():
            break
        root = new
    assert len(got) == len(rows)
    for i in range(len(x)):
        assert got[i] == (near[i].sum(), root[i], root[i] == i), i
    for i, *_ in rows[len(x) :]:
        assert got[i] == (0, i, True)
    assert embdedup.duplicates(df.limit(0)).count() == 0


def test_duplicates_hot_copies_and_missing_ids(spark):
    rows = [(i, [1.0, 0.0, 0.0, 0.0], 1, "", 0) for i in range(5, 900)] + [(None, [1.0, 0.01, 0.0, 0.0], 1, "", 0), (None, [0.0, 0.0, 1.0, 0.0], 1, "", 0)]
    got = embdedup.duplicates(spark.createDataFrame(rows, SCHEMA), 0.98).collect()
    assert {(r.n_links, r.component_id, r.kept) for r in got if r.vec_id is not None} == {(895, 5, True), (895, 5, False)}
    assert sorted((r.n_links, r.component_id or 0, r.kept) for r in got if r.vec_id is None) == [(0, 0, True), (895, 5, False)]


def nearest(x, q, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u[q]
    order = [i for i in np.lexsort((np.arange(len(x)), -s)) if i != q][:k]
    return [(int(i), float(s[i])) for i in order]


def test_walk_sees_cells_by_rising_distance():
    rng = np.random.default_rng(1)
    a, b = rng.random(9), rng.random(7)
    counts = rng.integers(0, 3, 63)
    order = [int(c) for c in np.argsort((a[:, None] + b).ravel()) if counts[c]]
    for enough in (1, 10, 1000):
        got = ann.walk(a, b, counts, enough)
        assert got == order[: len(got)] and (counts[got].sum() >= enough or len(got) == len(order))
        assert counts[got[:-1]].sum() < enough


def test_search(spark):
    x = make(1900, 16).astype(np.float64)
    df, _ = table(spark, x.astype(np.float32), np.zeros(len(x)))
    x = x.astype(np.float32).astype(np.float64)
    got = {}
    for r in ann.search(df.withColumnRenamed("node", "row"), 50, 5).collect():
        if r.query_id < 1900:
            got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    full = np.vstack([x, x[19]])
    names = [*range(len(x)), 3000]
    assert set(got) >= {q for q in range(0, 1900, 50)}
    hits = total = 0
    for q in range(0, 1900, 50):
        some = sorted(got[q])
        assert [r for r, *_ in some] == [1, 2, 3, 4, 5]
        assert [(-s, i) for _, i, s in some] == sorted((-s, i) for _, i, s in some)
        want = {names[i] for i, _ in nearest(full, q, 5)}
        hits, total = hits + len(want & {i for _, i, _ in some}), total + 5
        u = full / np.linalg.norm(full, axis=1, keepdims=True)
        for _, i, s in some:
            assert abs(s - u[q] @ u[names.index(i)]) < 1e-12
    assert hits / total >= 0.9


def test_recall_of_vectors_without_clusters(spark):
    x = np.random.default_rng(8).standard_normal((6000, 64)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {}
    for r in ann.search(df, 50, 5).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    x = x.astype(np.float64)
    hits = sum(len(got[q] & {i for i, _ in nearest(x, q, 5)}) for q in range(0, 6000, 50))
    assert hits >= 0.9 * 5 * 120


def test_a_worker_holds_little_for_the_threshold():
    code = "import resource; from quarry.llm import embdedup; a = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss; embdedup.code(64); print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - a)"
    assert int(subprocess.run([sys.executable, "-c", code], capture_output=True, check=True, env=os.environ).stdout) < 200 * 1024


def test_large_filters_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(embdedup, "TOGETHER", 40)
    monkeypatch.setattr(embdedup, "GROUP", 8)
    test_duplicates(spark)


def test_search_of_copies_and_few(spark):
    rows = [(i, [1.0, 0.0], 0, "", 0) for i in range(0, 400)] + [(500, [0.0, 1.0], 0, "", 0), (500, [0.0, 1.0], 0, "", 0), (None, [1.0, 0.0], 0, "", 0), (550, [1.0], 0, "", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {}
    for r in ann.search(df, 50, 5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    assert sorted(got[0]) == [(1, 1), (2, 2), (3, 3), (4, 4), (5, 5)]
    assert sorted(got[50]) == [(1, 0), (2, 1), (3, 2), (4, 3), (5, 4)]
    assert sorted(got[500]) == [(1, 0), (2, 1), (3, 2), (4, 3), (5, 4)]
    assert 550 not in got
    assert ann.search(df.limit(0)).count() == 0
