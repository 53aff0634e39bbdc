"""Token ids against the library, places against the rules, sequences against best fit decreasing."""

import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from quarry.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def best_fit(lengths, size):
    free = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, w in enumerate(free) if w >= n]
        if fits:
            free[min(fits, key=free.__getitem__)] -= n
        else:
            free.append(size - n)
    return len(free)


def filled(p, histogram):
    lengths = np.repeat(list(histogram), list(histogram.values()))
    ranks = np.concatenate([np.arange(c) for c in histogram.values()]) if histogram else np.zeros(0, int)
    sequence, offset = p.places(lengths, ranks)
    assert p.given == {n: c for n, c in histogram.items() if c}
    at = {}
    for s, o, n in sorted(zip(sequence.tolist(), offset.tolist(), lengths.tolist(), strict=True)):
        assert o == at.get(s, 0)
        at[s] = o + n
    assert len(at) == p.sequences and all(n <= p.size for n in at.values())


def test_plan():
    rnd = random.Random(5)
    for n in (0, 1, 3, 50, 700, 3000):
        lengths = [min(4096, max(1, int(rnd.lognormvariate(6.3, 1.1)))) for _ in range(n)]
        histogram = {x: lengths.count(x) for x in set(lengths)}
        p = packing.plan(histogram, 4096)
        filled(p, histogram)
        assert p.sequences <= best_fit(lengths, 4096) * 1.01 + 2
    for histogram in ({4096: 7}, {1: 5}, {2049: 10, 2047: 10}, {1400: 9}, {100: 1_000_000, 3000: 5}):
        filled(packing.plan(histogram, 4096), histogram) if sum(histogram.values()) < 1000 else packing.plan(histogram, 4096)
    assert packing.plan({2049: 10, 2047: 10}, 4096).sequences == 10


def test_plan_of_few_lengths_that_fill_sequences_together():
    for histogram, most in (
        ({1640: 300, 1228: 600}, 300),
        ({1640: 300, 1228: 600, 500: 100, 98: 20}, 313),
        ({1640: 3000, 1228: 6000, 700: 10, 596: 5000}, 3836),
        ({1365: 30_000, 1366: 15_000, 400: 5}, 15_008),
    ):
        p = packing.plan(histogram, 4096)
        filled(p, histogram)
        assert p.sequences <= most
    rnd = random.Random(9)
    lengths = [rnd.randint(800, 1900) for _ in range(20_000)] + [1640] * 6_000 + [1228] * 12_000
    histogram = {x: lengths.count(x) for x in set(lengths)}
    p = packing.plan(histogram, 4096)
    filled(p, histogram)
    assert p.sequences <= sum(lengths) / 4096 * 1.015


def test_pack(spark):
    rnd = random.Random(7)
    texts = ["".join(rnd.choice(["the ", "Été", "ﬁ", "İ", "'s", "9", "漢", "\x1c", "́", "é", " ", "\n", " ", "###", "<|endoftext|>", "<|StartOfText|>", "Straße ", "Σ", "ς"]) for _ in range(rnd.randint(0, 40))) for _ in range(300)]
    texts += [t.replace("<|", "") for t in texts]
    texts += ["a <|endoftext|> b", None, "", "word " * 9000, "x" * 3000, "same text"] + ["same text"] * 40
    rows = [(i, t, 1, 2) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, rows[-1], (None, "no id", 1, 2)], "doc_id long, text string, length int, rank int")
    out = packing.pack(docs, PATH, 4096, 1).collect()
    t = Tokenizer.from_file(PATH)
    at = {}
    for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at.get(r.sequence_id, 0)
        at[r.sequence_id] = r.offset + r.length
        ids = [*t.encode((texts[r.doc_id] if r.doc_id is not None else "no id") or "", add_special_tokens=False).ids, 1]
        part = np.array(ids[r.start : r.start + 4096], dtype="<u4")
        assert r.start == 4096 * r.piece and r.length == len(part) and r.ids_crc32 == zlib.crc32(part.tobytes()), texts[r.doc_id]
    assert max(at.values()) <= 4096
    assert len(out) == len(texts) + 2 + 2
    assert len(at) <= -(-sum(at.values()) // 4096) + 1
    assert packing.pack(docs.limit(0), PATH).count() == 0
