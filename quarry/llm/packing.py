"""Best-fit packing of tokenised documents by linear grouping.

Everything that depends on the number of documents is distributed; the plan is made from the histogram of lengths, which has
at most `size` rows however many documents there are. Large lengths are rounded up within groups of equal cardinality, few
sizes that way; configurations (which sizes share a sequence) are optimised by column generation; actual documents take the
places of their group, so real gaps are at least the planned ones; small lengths, longest first, go where least is left.
All of it works on runs of equal sequences, so its cost follows the number of different lengths.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm.common import Numbers, Pool, held, keep, ship, slices, texts_of, utf8

#: A length is large if it is more than a share of a sequence. Large lengths are cut into groups of equal cardinality; a length
#: that would fill a group has one of its own. No share is best for all histograms: a low one lets more lengths share a
#: configuration but rounds more of them up. So these pairs of a share and a number of groups are tried in turn, and the plan
#: with the fewest sequences is taken; one within CLOSE of the least number that the tokens need ends the search.
TRIES = ((0.45, 48), (1 / 5, 48), (1 / 10, 48), (1 / 5, 128))
CLOSE = 0.0005
#: Chunks between white space, or words in them, and ids of all of them, that empty a worker's cache; longer ones are not kept.
CACHED, IDS_CACHED, LONGEST_CACHED = 500_000, 8_000_000, 48
#: Pieces of one length among which places are dealt in one task, about.
RANKED_TOGETHER = 1_000

WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
ASCII_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\x09-\x0d\x200-9a-z]+")


#: Keys that no text holds: for the id at each document's end, and in front of what the library gets as it is.
END, WHOLE = "\ud800", "\ud801"
#: Words that the library gets in one text, with spaces between.
JOINED = 256


class Tokens:
    """Ids by the tokenizers library, word by word: its pre-tokenizer never looks over white space, so words can be kept.

    A text in which the library may see an added token, such as its end of text, is given to the library whole.
    """

    def __init__(self, path: str, end: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.end = Tokenizer.from_file(path), end
        self.added = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        suffix = self.tokenizer.model.end_of_word_suffix
        self.ends_word = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        self.ends_word[[i for t, i in self.tokenizer.get_vocab().items() if suffix and t.endswith(suffix)]] = True
        self._empty()

    def _empty(self) -> None:
        self.chunk, self.chunk_ids = Numbers(), Pool(np.uint32)
        self.word, self.word_ids = Numbers(), Pool(np.uint32)
        self.chunk_ids.put(np.array([self.chunk[END]]), np.ones(1, np.int64), np.array([self.end], np.uint32))
        self.chunk.fresh()

    def _words(self, chunk: str) -> list[str]:
        if chunk.isascii():
            low = chunk.lower()
            return [low] if low.isalpha() else ASCII_WORD.findall(low)
        if chunk[0] == WHOLE:
            return [chunk]
        if "\u0130" in chunk or "\u03a3" in chunk:  # Python's lower case of these is not the library's
            return [WHOLE + chunk]
        low = unicodedata.normalize("NFC", chunk).lower()
        return [low] if low.isalpha() else WORD.findall(low)

    def _cut(self, text: str) -> list[str]:
        low = text.lower()
        if any(t in low for t in self.added):
            return [WHOLE + text]
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # white space to Python alone
            return [c for c in regex.split(r"\s+", text) if c]
        return low.split() if text.isascii() else text.split()

    def _ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each word has, and all of them.

        The library gets many words as one text; a word's last id is one that ends words, which tells them apart again.
        """
        texts = [" ".join(words[i : i + JOINED]) for i in range(0, len(words), JOINED)]
        ids = np.fromiter(chain.from_iterable(e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)), dtype=np.uint32)
        ends = np.flatnonzero(self.ends_word[ids])
        if len(ends) == len(words):
            return np.diff(ends, prepend=-1), ids
        each = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        lengths = np.fromiter(map(len, each), dtype=np.int64, count=len(each))
        return lengths, np.fromiter(chain.from_iterable(each), dtype=np.uint32, count=int(lengths.sum()))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Where each text's ids begin (and the last ends), and all ids; each text's are followed by `end`."""
        if max(len(self.chunk), len(self.word)) > CACHED or max(self.chunk_ids.used, self.word_ids.used) > IDS_CACHED:
            self._empty()
        parts = [[*self._cut(x), END] for x in texts]
        sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
        numbers = np.fromiter(map(self.chunk.__getitem__, chain.from_iterable(parts)), dtype=np.int64, count=int(sizes.sum()))
        self._learn(*self.chunk.fresh())
        lengths, ids = self.chunk_ids.take(numbers)
        return np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(sizes)])], ids

    def _learn(self, chunks: list[str], numbers: np.ndarray) -> None:
        """The ids of chunks that are new."""
        words = [self._words(c) for c in chunks]
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        of = np.fromiter(map(self.word.__getitem__, chain.from_iterable(words)), dtype=np.int64, count=int(sizes.sum()))
        new, at = self.word.fresh()
        whole = {i for i, w in enumerate(new) if w[0] == WHOLE}
        for i in whole:
            ids = self.tokenizer.encode(new[i][1:], add_special_tokens=False).ids
            self.word_ids.put(at[i : i + 1], np.array([len(ids)]), np.array(ids, np.uint32))
        plain = np.array([i for i in range(len(new)) if i not in whole], dtype=np.int64)
        for i in range(0, len(plain), 32 * JOINED):
            some = plain[i : i + 32 * JOINED]
            self.word_ids.put(at[some], *self._ids([new[k] for k in some.tolist()]))
        lengths, ids = self.word_ids.take(of)
        ends = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(sizes)])]
        self.chunk_ids.put(numbers, np.diff(ends), ids)
        for known, some in ((self.chunk, chunks), (self.word, new)):
            for c in some:
                if len(c) > LONGEST_CACHED:
                    del known[c]


def tokens(path: str, end: int) -> Tokens:
    return held(("packing", path, end), lambda: Tokens(path, end))


def pieces(docs: DataFrame, path: str, size: int, end: int, ids: bool = False) -> DataFrame:
    """Cut each document's ids and the id `end` into pieces of at most `size`: doc_id, piece, start, length, ids_crc32 [, ids]."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokens(path, end)
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + ids]
        for whole in batches:
            for batch in slices(whole):
                ends, flat = t.encode(texts_of(batch))
                n = np.diff(ends)
                count = -(-n // size)
                doc = np.repeat(np.arange(len(n)), count)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
                start = piece * size
                length = np.minimum(size, n[doc] - start)
                at, raw = ends[:-1][doc] + start, memoryview(flat.astype("<u4", copy=False)).cast("B")
                crc = [zlib.crc32(raw[a:b]) for a, b in zip((4 * at).tolist(), (4 * (at + length)).tolist(), strict=True)]
                out = [batch.column(0).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
                if ids:
                    out.append(pa.ListArray.from_arrays(pa.array(np.append(at, len(flat)).astype(np.int32)), pa.array(flat.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(out, names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * ids
    return docs.select("doc_id", utf8("text").alias("t")).mapInArrow(run, schema)


@dataclass
class Run:
    """`count` sequences numbered from `first` on, each filled up to `used` with the same lengths."""

    first: int
    count: int
    used: int


@dataclass
class Plan:
    """Where the pieces of each length go: the k-th to sequence first + (k - at), at the offset, for the last run with at <= k."""

    size: int
    sequences: int = 0
    runs: dict[int, list[tuple[int, int, int]]] = field(default_factory=dict)  # length: [(at, first, offset)]
    given: dict[int, int] = field(default_factory=dict)

    def open(self, count: int) -> Run:
        self.sequences += count
        return Run(self.sequences - count, count, 0)

    def put(self, length: int, run: Run) -> None:
        """One more piece of this length into each sequence of the run."""
        at = self.given.get(length, 0)
        self.runs.setdefault(length, []).append((at, run.first, run.used))
        self.given[length] = at + run.count
        run.used += length

    def places(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for n in np.unique(lengths).tolist():
            some = np.flatnonzero(lengths == n)
            at, first, start = np.array(self.runs[n]).T
            i = np.searchsorted(at, ranks[some], side="right") - 1
            sequence[some], offset[some] = first[i] + ranks[some] - at[i], start[i]
        return sequence, offset


def configurations(sizes: list[int], counts: list[int], size: int) -> list[tuple[np.ndarray, int]]:
    """How many of each size share a sequence, and in how many sequences: Gilmore and Gomory's column generation.

    A revised simplex over a basis of len(sizes) columns; its duals price a new column by a knapsack that adds one item a
    round. What rounding down leaves is not in the result.
    """
    m, most = len(sizes), size // min(sizes)
    columns = np.diag([size // s for s in sizes]).astype(np.float64)
    inverse = np.diag([1 / (size // s) for s in sizes])
    x = inverse @ np.array(counts, dtype=np.float64)
    for _ in range(40 * m):
        dual = inverse.sum(0)
        worth, picks = np.zeros(size + 1), []
        for _ in range(most):
            better, pick = worth.copy(), np.full(size + 1, -1)
            for i, s in enumerate(sizes):
                gain = worth[: size + 1 - s] + dual[i]
                up = gain > better[s:] + 1e-12
                better[s:][up], pick[s:][up] = gain[up], i
            picks.append(pick)
            worth = better
        if worth[size] <= 1 + 1e-6:
            break
        column, w = np.zeros(m), size
        for pick in reversed(picks):
            if (i := pick[w]) >= 0:
                column[i] += 1
                w -= sizes[i]
        step = inverse @ column
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        r = int(ratio.argmin())
        x -= ratio[r] * step
        x[r] = ratio[r]
        x = np.maximum(x, 0)
        inverse[r] /= step[r]
        others = np.arange(m) != r
        inverse[others] -= np.outer(step[others], inverse[r])
        columns[:, r] = column
    out, left = [], np.array(counts, dtype=np.int64)
    for r in np.argsort(-x).tolist():
        c = columns[:, r].astype(np.int64)
        if k := min([int(x[r] + 1e-6), *(left[c > 0] // c[c > 0]).tolist()]):
            out.append((c, k))
            left -= k * c
    return out


def plan(histogram: dict[int, int], size: int) -> Plan:
    """Places for a histogram {length: count} of lengths from 1 to size; an empty one has no sequences."""
    least, best = -(-sum(n * c for n, c in histogram.items()) // size), None
    for large, groups in TRIES:
        tried = plan_at(histogram, size, large, groups)
        if best is None or tried.sequences < best.sequences:
            best = tried
        if best.sequences <= least * (1 + CLOSE):
            break
    return best


def plan_at(histogram: dict[int, int], size: int, large: float, groups: int) -> Plan:
    """The plan whose large lengths are those above this share of a sequence."""
    out, left = Plan(size), {n: c for n, c in sorted(histogram.items(), reverse=True) if c}
    if c := left.pop(size, 0):
        out.put(size, out.open(c))
    open_runs: dict[int, list[Run]] = {}

    def close(run: Run) -> None:
        if run.count and run.used < size:
            open_runs.setdefault(size - run.used, []).append(run)

    if total := sum(c for n, c in left.items() if n > large * size):
        # groups of equal cardinality, longest first; each rounded up to its longest; frequent lengths alone, as they are
        each, cut, room = -(-total // groups), [], 0
        for n, c in ((n, c) for n, c in left.items() if n > large * size):
            if c >= each:
                cut.append([[n, c]])
                room = 0
                continue
            while c:
                if not room:
                    cut.append([])
                    room = each
                take = min(c, room)
                cut[-1].append([n, take])
                c, room = c - take, room - take
        by_top: dict[int, list[list[int]]] = {}
        for g in cut:
            by_top.setdefault(g[0][0], []).extend(g)
        tops = list(by_top)
        for column, k in configurations(tops, [sum(c for _, c in by_top[t]) for t in tops], size):
            slots = [(by_top[tops[i]], int(column[i])) for i in np.flatnonzero(column)]
            while k:  # as many sequences as get the same actual lengths
                take = max(1, min(k, *(g[0][1] // q for g, q in slots)))
                run = out.open(take)
                for g, q in slots:
                    for _ in range(q):
                        out.put(g[0][0], run)
                        left[g[0][0]] -= take
                        g[0][1] -= take
                        if not g[0][1]:
                            g.pop(0)
                close(run)
                k -= take
    for n, c in left.items():  # what rounding down left, then the small ones: longest first, where least is left
        while c:
            fits = [w for w in open_runs if w >= n]
            if fits:
                w = min(fits)
                run = open_runs[w].pop()
                if not open_runs[w]:
                    del open_runs[w]
            else:
                run, w = out.open(-(-c // (size // n))), size
            q = min(w // n, c)
            full = min(run.count, c // q)
            close(Run(run.first + full, run.count - full, run.used))
            run.count = full
            for _ in range(q):
                out.put(n, run)
            close(run)
            c -= full * q
    return out


def pack(docs: DataFrame, path: str, size: int = 4096, end: int = 1, ids: bool = False) -> DataFrame:
    """Every piece of every document with its sequence and its place there: the columns of `pieces`, sequence_id, offset.

    Null and empty texts are the id `end` alone. Repeated rows and null doc_ids are documents of their own; other columns are
    left out. Pieces of one length get their ranks in buckets of about RANKED_TOGETHER, so that a length which many documents
    share is no hot key; the histogram that goes to the driver has `size` rows at most.
    """
    cut = keep(pieces(docs, path, size, end, ids), "pieces")
    counts = cut.groupBy("length").count()
    histogram = {r["length"]: r["count"] for r in counts.collect()}
    planned = plan(histogram, size)
    buckets = F.broadcast(counts.select("length", F.ceil(F.col("count") / RANKED_TOGETHER).alias("buckets")))
    dealt = cut.join(buckets, "length").withColumn("bucket", F.expr("pmod(xxhash64(doc_id, piece, ids_crc32, start), buckets)")).drop("buckets")
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = dealt.groupBy("length", "bucket").count().select("length", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece")
    ranked = dealt.withColumn("rank", F.row_number().over(inside) - 1).join(first, ["length", "bucket"])
    names = [f.name for f in cut.schema.fields]
    ranked = ranked.select(*names, (F.col("first") + F.col("rank")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sequence, offset = planned.places(b.column("length").to_numpy(), b.column("rank").to_numpy())
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema.fields)
    return ranked.mapInArrow(place, schema + ", sequence_id long, offset long")
