"""Byte-level BPE encoding and decoding.

The merges of many pieces run in step: each piece has a segment tree over its byte positions whose leaves hold
(rank of the pair that starts here, position), so that its root is the leftmost pair of least rank. A merge updates three
leaves (the pair itself, the live neighbour to the left, the swallowed neighbour to the right) and their paths to the root.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from quarry.llm.common import Numbers, Pool, held, ship, slices, texts_of, utf8

NONE = np.iinfo(np.int32).max
#: Pieces longer than this go one by one; a leaf holds (rank, position) in 31 bits, so a position there has 8 of them.
LONGEST_IN_STEP, PLACE_BITS = 256, 8
#: Leaves of the trees that are built at once.
IN_STEP = 1 << 17
#: Longer chunks are not kept in the cache; entries, and ids of all of them, that empty it.
LONGEST_CACHED, CACHED, IDS_CACHED = 48, 350_000, 8_000_000
#: White space besides space and line feed.
RARE = "".join(chr(i) for i in range(0x3001) if regex.match(r"\s", chr(i)) and chr(i) not in " \n")
#: In front of a text's first chunk, which has no space before it; two lone surrogates, which no decoded text holds.
FIRST = "\ud800\ud800"


class Ranks:
    """A rank file: tokens by id, the rank of a whole piece, and the rank of a pair of ids."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.of = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        if max(self.of.values()) >= 1 << (31 - PLACE_BITS):
            raise ValueError("a rank does not fit beside a position")
        tokens = [b""] * (max(self.of.values()) + 1)
        for token, rank in self.of.items():
            tokens[rank] = token
        self.bytes_of = Pool.of(list(range(len(tokens))), np.array(list(map(len, tokens))), np.frombuffer(b"".join(tokens), dtype=np.uint8))
        self.byte = np.array([self.of[bytes([i])] for i in range(256)], dtype=np.int32)
        self.pair = {}
        for token, rank in self.of.items():
            for i in range(1, len(token)):
                if (a := self.of.get(token[:i])) is not None and (b := self.of.get(token[i:])) is not None:
                    self.pair[a << 32 | b] = rank
        # an open hash table, at most a quarter full
        bits = max(4, (4 * len(self.pair)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NONE, np.int32)
        left, ranks = np.array(list(self.pair), dtype=np.int64), np.array(list(self.pair.values()), dtype=np.int32)
        at = self._slots(left)
        while len(left):
            free = self.keys[at] == -1
            self.keys[at[free]], self.values[at[free]] = left[free], ranks[free]
            lost = self.keys[at] != left
            left, ranks, at = left[lost], ranks[lost], (at[lost] + 1) & self.mask
        two = np.arange(256)
        self.first = self.ranks(self.byte[np.repeat(two, 256)], self.byte[np.tile(two, 256)])

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks of pairs, NONE where a pair is no token; an id below 0 has no pair."""
        key = left.astype(np.int64) << 32 | right
        at = self._slots(key)
        held = self.keys[at]
        out = np.where(held == key, self.values[at], NONE)
        rest = np.flatnonzero((held != key) & (held != -1) & (key >= 0))
        while len(rest):
            at[rest] = (at[rest] + 1) & self.mask
            held = self.keys[at[rest]]
            hit = held == key[rest]
            out[rest[hit]] = self.values[at[rest[hit]]]
            rest = rest[~hit & (held != -1)]
        return out


def merge_in_step(pieces: list[bytes], ranks: Ranks) -> tuple[np.ndarray, np.ndarray]:
    """How many ids each piece has, and all of them; each loop does one merge in every piece that still has a pair."""
    n, longest = len(pieces), max(map(len, pieces))
    depth = max(1, (longest - 1).bit_length())
    width = 1 << depth
    raw = np.zeros((n, width), dtype=np.int64)
    lengths = np.fromiter(map(len, pieces), dtype=np.int64, count=n)
    place = np.arange(width)
    inside = place < lengths[:, None]
    raw[inside] = np.frombuffer(b"".join(pieces), dtype=np.uint8)
    ids = np.full((n, width + 1), -1, dtype=np.int32)  # the last column stands for "no neighbour"
    ids[:, :width] = np.where(inside, ranks.byte[raw], -1)
    after = np.tile(np.arange(1, width + 2), (n, 1))
    after[:, width] = width
    before = np.tile(np.arange(-1, width), (n, 1))
    before[:, 0] = width
    tree = np.full((n, 2 * width), NONE, dtype=np.int32)
    first = ranks.first[raw[:, :-1] << 8 | raw[:, 1:]]
    tree[:, width:-1] = np.where((first < NONE) & inside[:, 1:], first << PLACE_BITS | place[:-1].astype(np.int32), NONE)
    for i in range(width - 1, 0, -1):
        np.minimum(tree[:, 2 * i], tree[:, 2 * i + 1], out=tree[:, i])
    ids_, after_, before_, tree_ = ids.ravel(), after.ravel(), before.ravel(), tree.ravel()
    rows = np.flatnonzero(tree[:, 1] < NONE)
    top, base = rows * (2 * width), rows * (width + 1)
    while len(top):
        root = tree_[top + 1]
        at, token = (root & ((1 << PLACE_BITS) - 1)).astype(np.int64), root >> PLACE_BITS
        here = base + at
        swallowed = after_[here]
        following = np.minimum(after_[base + swallowed], width)
        ids_[here] = token
        ids_[base + swallowed] = -1
        after_[here] = following
        before_[base + following] = at
        preceding = before_[here]
        ids_[base + width] = -1
        both = ranks.ranks(np.concatenate([token, ids_[base + preceding]]), np.concatenate([ids_[base + following], token]))
        own, left = both[: len(at)], both[len(at) :]
        preceding = np.where(preceding < width, preceding, at)
        # the leaves of the pair, of its live neighbour to the left and of what it swallowed, then their paths to the root
        tree_[top + width + preceding] = np.where(left < NONE, left << PLACE_BITS | preceding.astype(np.int32), NONE)
        tree_[top + width + at] = np.where(own < NONE, own << PLACE_BITS | at.astype(np.int32), NONE)
        tree_[top + width + swallowed] = NONE
        node, tops = np.concatenate([at, preceding, swallowed]) + width, np.concatenate([top, top, top])
        for _ in range(depth):
            node >>= 1
            up = tops + node
            down = up + node
            tree_[up] = np.minimum(tree_[down], tree_[down + 1])
        live = tree_[top + 1] < NONE
        if not live.all():
            top, base = top[live], base[live]
    live = ids[:, :width] >= 0
    return live.sum(1), ids[:, :width][live]


def merge_alone(piece: bytes, ranks: Ranks) -> list[int]:
    """The same merges in one long piece."""
    n = len(piece)
    width = 1 << max(1, (n - 1).bit_length())
    ids = ranks.byte[np.frombuffer(piece, dtype=np.uint8)].tolist()
    none, pair = 1 << 62, ranks.pair.get
    tree = [none] * (2 * width)
    for i in range(n - 1):
        if (r := pair(ids[i] << 32 | ids[i + 1])) is not None:
            tree[width + i] = r << 32 | i
    for i in range(width - 1, 0, -1):
        tree[i] = min(tree[2 * i], tree[2 * i + 1])

    def put(i: int, value: int) -> None:
        i += width
        tree[i] = value
        while i > 1:
            i >>= 1
            tree[i] = min(tree[2 * i], tree[2 * i + 1])

    def key(i: int, j: int) -> int:
        r = pair(ids[i] << 32 | ids[j])
        return none if r is None else r << 32 | i

    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while tree[1] < none:
        token, at = divmod(tree[1], 1 << 32)
        swallowed = after[at]
        following, preceding = after[swallowed], before[at]
        ids[at], ids[swallowed], after[at] = token, -1, following
        put(swallowed, none)
        if following < n:
            before[following] = at
        put(at, key(at, following) if following < n else none)
        if preceding >= 0:
            put(preceding, key(preceding, at))
    return [x for x in ids if x >= 0]


def merge(pieces: list[bytes], ranks: Ranks) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The places of some pieces, how many ids each of them has, and all of these; a piece that is a token is that token."""
    whole = np.fromiter((ranks.of.get(p, -1) for p in pieces), dtype=np.int32, count=len(pieces))
    lengths = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
    known = np.flatnonzero(whole >= 0)
    yield known, np.ones(len(known), np.int64), whole[known]
    bits = np.maximum(1, np.ceil(np.log2(np.maximum(lengths, 2)))).astype(np.int64)
    bits[whole >= 0] = 0
    bits[(whole < 0) & (lengths > LONGEST_IN_STEP)] = 99
    for b in np.unique(bits[bits > 0]).tolist():
        some = np.flatnonzero(bits == b)
        if b == 99:
            for i in some.tolist():
                ids = np.array(merge_alone(pieces[i], ranks), dtype=np.int32)
                yield np.array([i]), np.array([len(ids)]), ids
            continue
        step = max(64, IN_STEP >> b)
        for i in range(0, len(some), step):
            yield some[i : i + step], *merge_in_step([pieces[k] for k in some[i : i + step].tolist()], ranks)


class Encoder:
    """Encodes texts with one rank file and one pattern.

    A text is cut before spaces, where every piece that the pattern matches lies in one chunk, whatever stands around it: any
    space will do unless white space stands on both sides of it. That holds for patterns whose matches take a space only as
    their first character or as part of white space, as those of byte-level vocabularies do; an Encoder refuses others that it
    can tell. Chunks repeat and so do their pieces, so the ids of both are kept.
    """

    def __init__(self, path: str, pattern: str):
        self.ranks, self.pattern = Ranks(path), regex.compile(pattern)
        if any(" " in m.strip(" ") or (m.endswith(" ") and m.strip()) for m in self.pattern.findall("a b, c. 1 2 ' s it's d e: f")):
            raise ValueError("the pattern's matches hold spaces inside")
        self.cut = regex.compile(r"(?<=\S) (?=\S)")
        self._empty()

    def _empty(self) -> None:
        self.chunk, self.chunk_ids = Numbers(), Pool(np.int32)
        self.piece, self.piece_ids = Numbers(), Pool(np.int32)

    def chunks(self, text: str) -> list[str]:
        """The chunks without the space before each but the first, which gets a mark in front."""
        uneven = "  " in text or "\n " in text or any(c in text for c in RARE)
        parts = self.cut.split(text) if uneven else text.split(" ")
        parts[0] = FIRST + parts[0]
        return parts

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Where each text's ids begin (and the last ends), and all ids."""
        if max(len(self.chunk), len(self.piece)) > CACHED or max(self.chunk_ids.used, self.piece_ids.used) > IDS_CACHED:
            self._empty()
        parts = [self.chunks(x) if x else [] for x in texts]
        sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
        numbers = np.fromiter(map(self.chunk.__getitem__, chain.from_iterable(parts)), dtype=np.int64, count=int(sizes.sum()))
        self._learn(*self.chunk.fresh())
        lengths, ids = self.chunk_ids.take(numbers)
        ends = np.concatenate([[0], np.cumsum(lengths)])
        return ends[np.concatenate([[0], np.cumsum(sizes)])], ids

    def _learn(self, chunks: list[str], numbers: np.ndarray) -> None:
        """The ids of chunks that are new."""
        find = self.pattern.findall
        pieces = [find(c[len(FIRST) :] if c.startswith(FIRST) else " " + c) for c in chunks]
        sizes = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        of = np.fromiter(map(self.piece.__getitem__, chain.from_iterable(pieces)), dtype=np.int64, count=int(sizes.sum()))
        new, at = self.piece.fresh()
        for some, lengths, ids in merge([x.encode() for x in new], self.ranks):
            self.piece_ids.put(at[some], lengths, ids)
        lengths, ids = self.piece_ids.take(of)
        ends = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(sizes)])]
        self.chunk_ids.put(numbers, np.diff(ends), ids)
        for known, some in ((self.chunk, chunks), (self.piece, new)):
            for c in some:
                if len(c) > LONGEST_CACHED or c.startswith(FIRST):
                    del known[c]

    def decode(self, offsets: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each run's bytes begin (and the last ends), and all bytes; an id out of range fails."""
        if len(ids) and not 0 <= ids.min() <= ids.max() < len(self.ranks.bytes_of.lengths):
            raise ValueError("an id is out of range")
        lengths, data = self.ranks.bytes_of.take(ids)
        return np.concatenate([[0], np.cumsum(lengths)])[offsets], data


def encoder(path: str, pattern: str) -> Encoder:
    return held(("bpe", path, pattern), lambda: Encoder(path, pattern))


def binary(offsets: np.ndarray, data: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])


def encode(docs: DataFrame, path: str, pattern: str, decoded: bool = False) -> DataFrame:
    """doc_id, ids array<int>, and, if asked for, decoded binary: the bytes that the ids stand for.

    Null and empty texts have no ids. Rows are kept as they are: repeated rows and null doc_ids stay. A text of any length is
    one row. Other columns are left out, whatever their names.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, pattern)
        for whole in batches:
            for batch in slices(whole):
                offsets, ids = e.encode(texts_of(batch))
                out = [batch.column(0), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))]
                if decoded:
                    out.append(binary(*e.decode(offsets, ids)))
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "ids", "decoded"][: len(out)])

    return docs.select("doc_id", utf8("text").alias("t")).mapInArrow(run, "doc_id long, ids array<int>" + ", decoded binary" * decoded)


def decode(tokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, decoded binary, from doc_id and ids array<int>; null ids count as none, an id out of range fails."""
    ship(tokens.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, pattern)
        for batch in batches:
            runs = pc.fill_null(batch.column(1), [])
            ids = runs.flatten().to_numpy(zero_copy_only=False)
            offsets = np.concatenate([[0], np.cumsum(pc.list_value_length(runs).to_numpy(zero_copy_only=False))])
            yield pa.RecordBatch.from_arrays([batch.column(0), binary(*e.decode(offsets, ids))], ["doc_id", "decoded"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded binary")
