"""Components and near duplicates against brute force."""

import random
import re

import numpy as np

from quarry.llm import minhash
from quarry.llm.components import components


def find(p, a):
    while p[a] != a:
        a = p[a]
    return a


def test_components(spark):
    rnd = random.Random(2)
    pairs = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, i) for i in range(4000, 4100)] + [(7, 7)]
    p = {x: x for e in pairs for x in e}
    for a, b in pairs:
        a, b = find(p, a), find(p, b)
        p[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {x: find(p, x) for x in linked}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def shingles(text, n):
    w = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", w)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def corpus():
    rnd = random.Random(4)
    vocabulary = [f"w{i}" for i in range(300)] + ["É", "é", "\x85", "a\x1cb", " "]
    base = [[rnd.choice(vocabulary) for _ in range(rnd.choice([3, 20, 120]))] for _ in range(60)]
    texts = [" ".join(b) for b in base]
    for _ in range(500):  # chains of copies with a few changed words
        w = rnd.choice(texts).split(" ")
        for _ in range(rnd.randint(0, 4)):
            w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
        texts.append(rnd.choice([" ", "\n", "\t "]).join(w))
    hot = [rnd.choice(vocabulary) for _ in range(100)]
    for _ in range(700):
        w = list(hot)
        for _ in range(rnd.randint(0, 9)):
            w[rnd.randrange(100)] = f"n{rnd.random()}"
        texts.append(" ".join(w))
    return [*texts, None, "", " \n", "one", "ONE", "one two", "One  two", "x" * 100_000, "a b " * 30_000]


def test_duplicates(spark):
    texts = corpus()
    for n in (2, 5):
        rows = [(i, t, 0, "x") for i, t in enumerate(texts)]
        docs = spark.createDataFrame([*rows, rows[3], rows[3]], "doc_id long, text string, node int, bucket string")
        got = minhash.duplicates(docs, n).collect()
        assert len(got) == len(texts) + 2
        sets = [shingles(t, n) for t in texts]
        p, where = {i: i for i in range(len(texts))}, {}
        for i, s in enumerate(sets):
            for x in s:
                where.setdefault(x, []).append(i)
        for i, s in enumerate(sets):
            shared = np.zeros(len(texts), int)
            for x in s:
                shared[where[x]] += 1
            for j in np.flatnonzero(shared[:i]):
                if 100 * shared[j] >= 80 * (len(s) + len(sets[j]) - shared[j]):
                    a, b = find(p, i), find(p, int(j))
                    p[max(a, b)] = min(a, b)
        for r in got:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), find(p, r.doc_id), find(p, r.doc_id) == r.doc_id), r


def test_duplicates_without_ids(spark):
    docs = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (4, "a b c"), (None, "d e"), (None, "d e"), (None, None)], "doc_id long, text string")
    got = sorted(((r.doc_id or 0, r.n_shingles, r.component_id or 0, r.kept) for r in minhash.duplicates(docs, 2).collect()))
    assert got == [(0, 0, 0, True), (0, 1, 0, True), (0, 1, 0, True), (0, 2, 4, False), (0, 2, 4, False), (4, 2, 4, True)]
    assert minhash.duplicates(docs.limit(0)).count() == 0
