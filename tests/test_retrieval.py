"""Words, stems and searches against plain Python."""

import math
from collections import Counter

import pytest

from quarry.errors import SqlError
from quarry.functions.text import STOP_WORDS, stem
from quarry.operators.retrieval import Index, show

DOCS = [(1, "El gato negro, el GATO blanco."), (2, "¿Perro y gato? ¡Perros!"), (3, "covid-19 pez 42 pez pez"), (4, None), (5, ""), (6, "blanco negro: perro")]


@pytest.fixture(scope="module")
def index(spark):
    return Index.build(spark.createDataFrame(DOCS, "id int, t string"), "id", "t")


def test_words(index):
    got = {}
    for r in index.postings.collect():
        got.setdefault(r.id, {})[r.term] = r.tf
    assert got == {1: {"gato": 2, "negro": 1, "blanco": 1}, 2: {"perro": 1, "gato": 1, "perros": 1}, 3: {"pez": 3}, 6: {"blanco": 1, "negro": 1, "perro": 1}}
    assert show(index.postings, "id", [3]).first().bag_of_words == '{"pez":3}'
    assert "el" in STOP_WORDS and index.list("nada").count() == 0


def test_stems(spark):
    pairs = {"gatos": "gat", "perros": "perr", "corriendo": "corr", "canciones": "cancion", "rápidamente": "rapid", "niñas": "niñ", "nacional": "nacional", "organización": "organiz", "hablaríamos": "habl", "biología": "biolog", "solución": "solucion", "cheques": "chequ", "chicharrones": "chicharron", "haciéndola": "hac", "torniquete": "torniquet", "tortura": "tortur", "a": "a", "": ""}
    assert {w: stem(w) for w in pairs} == pairs
    stemmed = Index.build(spark.createDataFrame(DOCS, "id int, t string"), "id", "t", stems=True)
    assert {r.id for r in stemmed.list("perros").collect()} == {2, 6}


@pytest.mark.parametrize("words,want", [("gato AND perro", {2}), ("gato OR perro", {1, 2, 6}), ("gato AND-NOT perro", {1}), ("gato AND NOT perro", {1}), ("pez OR NOT gato", {3, 6}), ("NOT gato", {3, 6}), ("NOT gato AND perro OR pez", {3, 6}), ("nada", set()), ("gato AND perro OR pez", {2, 3})])
def test_boolean(index, words, want):
    assert {r.id for r in index.boolean(words).collect()} == want


def test_boolean_refuses(index):
    for bad in ("", "gato perro", "gato AND", "gato XOR perro", "NOT"):
        with pytest.raises(SqlError):
            index.boolean(bad)


def test_cosine(index):
    bags = {1: {"gato": 2, "negro": 1, "blanco": 1}, 2: {"perro": 1, "gato": 1, "perros": 1}, 3: {"pez": 3}, 6: {"blanco": 1, "negro": 1, "perro": 1}}
    df = Counter(t for b in bags.values() for t in b)
    w = lambda b: {t: (1 + math.log10(n)) / (df[t] + 1) for t, n in b.items() if t in df}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    q = w({"gato": 2, "negro": 1, "zzz": 1})
    want = {i: sum(q.get(t, 0) * x for t, x in w(b).items()) / norm(q) / norm(w(b)) for i, b in bags.items()}
    got = {r.id: r.score for r in index.cosine("gato negro gato zzz", None, True).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-12 for i in want)
    top = [r.id for r in index.cosine("gato negro gato zzz", 2).collect()]
    assert top == sorted(want, key=lambda i: -want[i])[:2]
    assert index.cosine("zzz").count() == index.cosine("").count() == 0


def test_write(index, spark, tmp_path):
    index.write(f"file://{tmp_path}/i")
    again = Index.open(spark, f"file://{tmp_path}/i", "id")
    assert {r.id for r in again.boolean("gato OR pez").collect()} == {1, 2, 3}
    for words in ("gato negro gato zzz", "pez", "zzz", ""):
        assert [tuple(r) for r in again.cosine(words).collect()] == [tuple(r) for r in index.cosine(words).collect()]
    assert "PushedFilters: [IsNotNull(term), EqualTo(term,gato)]" in again.list("gato")._jdf.queryExecution().toString()
