"""Toxicity by held-out accuracy, and the stages of the pipeline."""

import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from quarry.llm import queries, toxicity

BAD = ["vilex", "grumblot", "snarfid"]


def text(rnd, bad):
    words = ["".join(rnd.choice(["the", "re", "on", "an", "ti", "ou"]) for _ in range(rnd.randint(1, 3))) for _ in range(rnd.randint(1, 160))]
    for _ in range(rnd.randint(2, 4) if bad else 0):
        words.insert(rnd.randint(0, len(words)), rnd.choice(BAD) + rnd.choice(["", "en", "schaft", "."]))
    return " ".join(words)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rnd, base = random.Random(6), f"file://{tmp_path_factory.mktemp('tables')}"
    toxic = [rnd.random() < 0.3 for _ in range(900)]
    rows = [(i, text(rnd, t), "en", "s", 0) for i, t in enumerate(toxic)]
    rows += [(900, rows[3][1], "en", "s", 0), (901, "mail a@b.co or call +1 (017) 555-7713 about it now", "en", "s", 0), (902, None, None, None, None), (903, "", "en", "s", 0), (None, "the reon anti outhe rean", "en", "s", 0)]
    rows += [rows[-1], rows[5]]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([(i, 1, int(t)) for i, t in enumerate(toxic) if i % 2], "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    return base, rows, toxic


def test_gradient_agrees_with_differences():
    net = toxicity.Network({"ab": 0, "cd": 1})
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x = net.inputs(["ab", "cd", "ef", "ghi"])[0].astype(np.float64)
    rows, y, w = np.array([[0, 1, 2, -1], [3, 1, -1, -1]]), np.array([1.0, 0]), np.array([0.5, 0.5])
    g, _, _ = net.gradient(x, rows, y, w)
    for name in ("wf", "wb", "uf", "ub", "cf", "cb", "a", "v", "o", "bias"):
        at = tuple(np.unravel_index(net.p[name].size // 2, net.p[name].shape))
        old, ends = net.p[name][at], []
        for step in (1e-4, -1e-4):
            net.p[name][at] = old + step
            ends.append(net.gradient(x, rows, y, w)[2])
        net.p[name][at] = old
        assert abs(g[name][at] - (ends[0] - ends[1]) / 2e-4) < 1e-5, name


def test_windows_cover_every_word_and_overlap():
    for n in (0, 1, toxicity.WINDOW, toxicity.WINDOW + 1, 500):
        starts = toxicity.windows(n)
        assert {i for s in starts for i in range(s, min(n, s + toxicity.WINDOW))} == set(range(n))
        assert all(b - a <= toxicity.STRIDE for a, b in zip(starts, starts[1:], strict=False))


def test_toxicity_on_the_held_out_fold(spark, folder):
    base, rows, toxic = folder
    out = queries.op10_toxicity(spark, base).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    held = [r for r in out if r.held_out]
    assert {r.doc_id for r in held} == {r[0] for r in rows if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0}
    right = [r.predicted == toxic[r.doc_id] for r in held if r.doc_id < 900]
    assert np.mean(right) > 0.97
    net = toxicity.train([], [])
    assert (toxicity.Scorer(net).scores(["", "a b"]) < 0.5).all()


def test_pipeline(spark, folder):
    base, rows, toxic = folder
    docs = spark.read.parquet(f"{base}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_duplicates", "personal_data", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, base)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        got = [r.doc_id for r in docs.collect()]
        if name == "toxicity":
            assert sum(toxic[i] for i in got if i is not None and i < 900) <= 3
            assert sum(not toxic[i] for i in got if i is not None and i < 900) >= 0.98 * toxic.count(False)
        if name == "near_duplicates":
            assert {902, 903, 901} <= set(got) and got.count(None) == 1 and 900 not in got and len(got) == len(set(got))
        if name == "personal_data":
            assert docs.where("doc_id = 901").first().text == "mail [EMAIL] or call [PHONE] about it now"
            assert sorted(map(str, got)) == sorted(str(r.doc_id) for r in before.collect())
    out = corpus_pipeline.run(spark, base).collect()
    assert sorted(map(str, got)) == sorted(str(r.doc_id) for r in out if r.piece == 0)


def test_stages_keep_columns_whose_names_clash(spark, folder):
    base, rows, _ = folder
    rows = [(*r, 7.5, "mine", i, {"k": i}) for i, r in enumerate(rows[:60] + rows[900:903])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, toxicity double, spans string, `a.b` int, runs map<string,int>")
    want = {r[0]: r[5:] for r in rows}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, base)
        assert docs.schema.names == before.schema.names, name
        assert all((r["toxicity"], r["spans"], r["a.b"], r["runs"]) == want[r["doc_id"]] for r in docs.collect()), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, base).count() == docs.count()


def test_an_empty_table(spark, folder, tmp_path):
    base, path = folder[0], f"file://{tmp_path}"
    spark.read.parquet(f"{base}/documents.parquet").limit(0).write.parquet(f"{path}/documents.parquet")
    spark.read.parquet(f"{base}/labels.parquet").write.parquet(f"{path}/labels.parquet")
    assert corpus_pipeline.run(spark, path).count() == 0
    assert toxicity.score(spark.read.parquet(f"{path}/documents.parquet"), toxicity.train([], [])).count() == 0


def test_fewer_passes_give_the_same_logits():
    rng = np.random.default_rng(3)
    net = toxicity.Network({"ab": 0})
    net.p = {k: rng.standard_normal(v.shape).astype(np.float32) for k, v in net.p.items()}
    x = rng.standard_normal((50, 3 * toxicity.STATES)).astype(np.float32)
    rows = rng.integers(0, 50, (9, toxicity.WINDOW))
    rows[3, 5:] = rows[4, 1:] = -1
    want, _ = net.run(x, x[::-1], rows)
    assert np.allclose(net.logits(x + net.p["cf"], x[::-1] + net.p["cb"], rows), want, atol=1e-4)


def test_half_a_window_of_words_lies_whole_in_some_window():
    for n in (1, 24, 48, 49, 60, 73, 200, 501):
        starts, k = toxicity.windows(n), min(n, toxicity.WINDOW // 2)
        assert all(any(s <= at and at + k <= s + toxicity.WINDOW for s in starts) for at in range(n - k + 1))
