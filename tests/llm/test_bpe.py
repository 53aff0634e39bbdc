"""Byte-level BPE against a plain loop by the rank file."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import regex

from quarry.llm import bpe, queries

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def ranks():
    with open(PATH, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def brute(text, of):
    """Each piece of the whole text: the leftmost pair of least rank is merged until no pair is a token."""
    out = []
    for piece in regex.findall(PATTERN, text or ""):
        parts = [bytes([b]) for b in piece.encode()]
        while piece.encode() not in of or len(parts) > 1:
            least, at = min(((of.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1)), default=(1 << 60, 0))
            if piece.encode() in of:
                parts = [piece.encode()]
            elif least == 1 << 60:
                break
            else:
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
        out += [of[p] for p in parts]
    return out


def texts():
    rnd = random.Random(11)
    bits = ["the", " the", " ", "  ", "\n", "\r\n", "\t", " ", "　", "\x1c", "\x85", "'s", "'LL", "9", "2024", "É", "é", "é", "漢字", "\U0001f600", "\x00", "###", "...", "<|endoftext|>", "Straße", "aaaa", "ZQXJ", "_", "-", "unbelievable", "​", "﻿"]
    out = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 40))) for _ in range(400)]
    out += ["".join(rnd.choice(" \n\t a") for _ in range(60)) for _ in range(100)]
    out += ["".join(rnd.choice("abehilnorstz") for _ in range(n)) for n in (2, 3, 4, 5, 31, 32, 33, 255, 256, 257, 258, 1500)]
    return out + [" " * 700, "\n" * 300 + "x", "x" + " " * 300, "a" * 1000, "漢" * 400, "=" * 600, "word " * 3000, "", " ", "same"]


def test_merges_in_step_and_alone():
    rnd, held = random.Random(2), bpe.Ranks(PATH)
    pieces = [bytes(rnd.choice(b"abehilnorst \xc3\xa9") for _ in range(rnd.randint(2, 64))) for _ in range(300)]
    want = [bpe.merge_alone(p, held) for p in pieces]
    lengths, ids = bpe.merge_in_step(pieces, held)
    assert [x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])] == want
    of = ranks()
    for p, ids in zip(pieces, want, strict=True):
        parts = [p[i : i + 1] for i in range(len(p))]
        while len(parts) > 1 and (least := min((of.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))))[0] < 1 << 60:
            parts[least[1] : least[1] + 2] = [b"".join(parts[least[1] : least[1] + 2])]
        assert ids == [of[x] for x in parts]


def test_chunks_that_are_kept_change_nothing():
    of, e = ranks(), bpe.Encoder(PATH, PATTERN)
    for _ in range(2):
        offsets, ids = e.encode(texts())
        assert [x.tolist() for x in np.split(ids, offsets[1:-1])] == [brute(t, of) for t in texts()]
        e._empty()
    with pytest.raises(ValueError, match="spaces inside"):
        bpe.Encoder(PATH, r"[^,]+,?")


def test_decode(spark):
    some = [t for t in texts() if t][:200] + ["a" * 1_000_000]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(some)] + [(None, None, "x")], "doc_id long, text string, decoded string")
    tokens = bpe.encode(df, PATH, PATTERN)
    got = {r.doc_id: bytes(r.decoded) for r in bpe.decode(tokens.unionByName(spark.createDataFrame([(-1, None)], tokens.schema)), PATH, PATTERN).collect()}
    assert got == {i: t.encode() for i, t in enumerate(some)} | {None: b"", -1: b""}
    assert bpe.encode(df.limit(0), PATH, PATTERN).count() == 0
    with pytest.raises(Exception, match="out of range"):
        bpe.decode(spark.createDataFrame([(1, [60_000])], tokens.schema), PATH, PATTERN).collect()


def test_op1(spark, tmp_path):
    of, some = ranks(), [*texts(), None]
    rows = [(i, t, "other") for i, t in enumerate(some)]
    df = spark.createDataFrame([*rows, rows[0], (None, "no id", "")], "doc_id long, text string, ids string")
    df.repartition(3).write.parquet(f"file://{tmp_path}/documents.parquet")
    out = queries.op1_byte_bpe(spark, f"file://{tmp_path}").collect()
    assert len(out) == len(rows) + 2
    for r in out:
        t = (some[r.doc_id] if r.doc_id is not None else "no id") or ""
        ids = brute(t, of)
        assert r.n_tokens == len(ids), t[:100]
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), t[:100]
        assert r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest(), t[:100]
