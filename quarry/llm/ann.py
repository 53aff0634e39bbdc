"""Approximate nearest neighbours by an inverted multi-index.

Unit vectors are cut into halves, each half is quantised by its own centroids, and a pair of centroids is a cell. A query walks
the pairs by rising sum of squared distances, with a heap, until the cells that it has seen hold enough entries; all of those are
reranked by the exact cosine. How many are enough is read from a bounded sample of trial vectors, whose exact answers are
known: so many that RECALL of these answers lie in the cells seen. Equal vectors are one entry that keeps as many of its
smallest ids as an answer can need.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm.common import keep, ship
from quarry.llm.vectors import unit, usable

#: Vectors that k-means reads at most (those that hash lowest), components of all of them, and its rounds.
SAMPLE, COMPONENTS, ROUNDS = 20_000, 2_000_000, 8
#: Entries in a cell on average, where that leaves from 32 to 256 centroids for a half.
IN_CELL = 4
#: Trial vectors (no queries, those that hash lowest), and the share of their exact answers that the cells seen must hold.
TRIALS, RECALL = 128, 0.96
#: Entries of a cell that stay together, and entries and queries that meet in one task, about.
BLOCK, GROUP = 512, 4_096


def centroids(x: np.ndarray, k: int) -> np.ndarray:
    """Lloyd's rounds from k of the rows."""
    c = x[np.random.default_rng(20_240_603).permutation(len(x))[:k]].copy()
    for _ in range(ROUNDS):
        own = ((c**2).sum(1) - 2 * x @ c.T).argmin(1)
        order = np.argsort(own, kind="stable")
        starts = np.flatnonzero(np.diff(own[order], prepend=-1))
        if len(starts):
            c[own[order][starts]] = np.add.reduceat(x[order], starts, axis=0) / np.diff(np.append(starts, len(x)))[:, None]
    return c


def halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cut = -(-x.shape[1] // 2)
    return x[:, :cut], x[:, cut:]


def distances(x: np.ndarray, books: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
    return [(h**2).sum(1)[:, None] + (c**2).sum(1) - 2 * h @ c.T for h, c in zip(halves(x), books, strict=True)]


def walk(a: np.ndarray, b: np.ndarray, counts: np.ndarray, enough: int) -> list[int]:
    """Cells (i * len(b) + j) by rising a[i] + b[j] until they hold enough entries; cells without entries are left out."""
    oa, ob = np.argsort(a).tolist(), np.argsort(b).tolist()
    sa, sb = a[oa].tolist(), b[ob].tolist()
    reached, heap, out, seen = [0] * len(oa), [(sa[0] + sb[0], 0, 0)], [], 0
    while heap and seen < enough:
        _, i, j = heapq.heappop(heap)
        cell = oa[i] * len(ob) + ob[j]
        if counts[cell]:
            out.append(cell)
            seen += int(counts[cell])
        reached[i] = j + 1
        # the next pair of this row, and of the next row where its turn has come
        if j + 1 < len(ob) and (i == 0 or reached[i - 1] > j + 1):
            heapq.heappush(heap, (sa[i] + sb[j + 1], i, j + 1))
        if i + 1 < len(oa) and reached[i + 1] == j:
            heapq.heappush(heap, (sa[i + 1] + sb[j], i + 1, j))
    return out


def search(vectors: DataFrame, every: int = 50, k: int = 5, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each vector whose vec_id is divisible by `every`.

    Nearness is the cosine in double precision, ties go to the smaller vec_id; a query's own id is no candidate, rows that repeat
    an id with the same vector count once. Vectors that are null, empty, zero or hold null or non-finite components, and rows
    without an id, take no part; only vectors of equal length are compared, so with fewer candidates answers are
    shorter. Each length has an index of its own. The sample, the trials and their answers, the cells' counts (65,536 at
    most) and sums go to the driver.
    """
    ship(vectors.sparkSession)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v")).where(F.col("vec_id").isNotNull() & usable("v"))
    key = F.sha2(F.concat_ws(",", F.transform("v", lambda x: (x.cast("double") + F.lit(0.0)).cast("string"))), 256)
    keyed = rows.select("vec_id", "v", key.alias("key"))
    ids = keyed.select("key", "vec_id").distinct()
    few = ids.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("vec_id"))).where(F.col("n") <= k + 1)
    entries = keyed.groupBy("key").agg(F.first("v").alias("v")).join(few.groupBy("key").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "key")
    entries = keep(entries.withColumn("row", F.monotonically_increasing_id()), "entries")
    asked = ids.where(F.col("vec_id") % every == 0).join(entries.select("key", "row"), "key").select("row", F.col("vec_id").alias("query_id"))
    asked = keep(asked, "asked")
    lengths = [(r["d"], r["n"]) for r in entries.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy("d").collect()]
    near = None
    for dims, n in lengths:
        found = _search(entries.where(F.size("v") == dims), asked.select("row").distinct(), n, k + 1, recall)
        near = found if near is None else near.unionByName(found)
    schema = "query_id long, rank int, vec_id long, score double"
    if near is None:
        return vectors.sparkSession.createDataFrame([], schema)
    by_entry = Window.partitionBy("q").orderBy(F.desc("score"), F.col("ids")[0])
    near = near.withColumn("n", F.row_number().over(by_entry)).where(F.col("n") <= k + 1)
    each = near.join(asked, near["q"] == asked["row"]).select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    by_id = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return each.withColumn("rank", F.row_number().over(by_id)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def trials(entries: DataFrame, index: DataFrame, queries: DataFrame, k: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Trial vectors, and (trial, cell) of each of their exact k nearest entries; a trial's own entry is none of them."""
    some = entries.join(queries, "row", "left_anti").select("row", "v", "key").orderBy(F.xxhash64("key", F.lit(1)), "key").limit(TRIALS).collect()
    own, x = np.array([r["row"] for r in some]), np.array([r["v"] for r in some], dtype=np.float64)
    if not len(some):
        return x, []
    x = unit(x)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.zeros(0), np.zeros(0, np.int32))] * len(x)
        for b in batches:
            for at in range(0, b.num_rows, 4_096):
                part = b.slice(at, 4_096)
                row, cell = part.column("row").to_numpy(), part.column("cell").to_numpy()
                score = x @ unit(np.array(part.column("v").to_pylist(), dtype=np.float64)).T
                score[row == own[:, None]] = -2
                for i, (s, c) in enumerate(best):
                    s, c = np.concatenate([s, score[i]]), np.concatenate([c, cell])
                    top = np.argsort(-s, kind="stable")[:k]
                    best[i] = s[top], c[top]
        found = [(i, float(p), int(q)) for i, (s, c) in enumerate(best) for p, q in zip(s, c, strict=True) if p > -2]
        columns = zip(*found, strict=True) if found else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.float64(), pa.int32()), strict=True)], ["trial", "score", "cell"])

    found = index.select("row", "v", "cell").mapInArrow(nearest, "trial int, score double, cell int")
    of = Window.partitionBy("trial").orderBy(F.desc("score"), "cell")
    return x, [(r["trial"], r["cell"]) for r in found.withColumn("n", F.row_number().over(of)).where(F.col("n") <= k).collect()]


def needed(x: np.ndarray, answers: list[tuple[int, int]], books: tuple[np.ndarray, np.ndarray], counts: np.ndarray, recall: float) -> int:
    """How many entries a walk must see so that it meets this share of the answers' cells."""
    if not answers:
        return int(counts.sum())
    a, b = distances(x, books)
    depths, cells = [], [[] for _ in x]
    for i, c in answers:
        cells[i].append(c)
    for i, some in enumerate(cells):
        order = np.argsort((a[i][:, None] + b[i]).ravel(), kind="stable")
        seen = np.cumsum(counts[order]) - counts[order]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        depths += (seen[place[some]] + 1).tolist()
    return int(np.quantile(depths, recall, method="higher"))


def _search(entries: DataFrame, queries: DataFrame, n: int, k: int, recall: float) -> DataFrame:
    """q, ids, score: of each query row the k nearest entries that each task saw."""
    dims = len(entries.first()["v"])
    sample = entries.select("v").orderBy(F.xxhash64("key"), "key").limit(max(256, min(SAMPLE, COMPONENTS // dims))).collect()
    x = halves(unit(np.array([r["v"] for r in sample], dtype=np.float64)))
    size = min(len(sample), max(32, min(256, int((n / IN_CELL) ** 0.5))))
    books = tuple(centroids(h, size) for h in x)

    def rows_of(b: pa.RecordBatch) -> np.ndarray:
        return unit(np.array(b.column("v").to_pylist(), dtype=np.float64))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                a, c = distances(rows_of(b), books)
                yield pa.RecordBatch.from_arrays([b.column("row"), b.column("v"), b.column("ids"), pa.array(a.argmin(1) * size + c.argmin(1), pa.int32())], ["row", "v", "ids", "cell"])

    kind = entries.schema["v"].dataType.simpleString()
    index = keep(entries.select("row", "v", "ids").mapInArrow(place, f"row long, v {kind}, ids array<long>, cell int"), "index")
    counts = np.zeros(size * size, dtype=np.int64)
    for r in index.groupBy("cell").count().collect():
        counts[r["cell"]] = r["count"]
    enough = needed(*trials(entries, index, queries, k - 1), books, counts, recall)
    shards, blocks = max(1, -(-n // GROUP)), np.maximum(1, -(-counts // BLOCK))

    def shard(cell: np.ndarray, block: np.ndarray) -> np.ndarray:
        mixed = (cell.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (block.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        return ((mixed >> np.uint64(17)) % np.uint64(shards)).astype(np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell = b.column("cell").to_numpy()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shard(cell, b.column("row").to_numpy() % blocks[cell]))], [*b.schema.names, "shard"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            out: list[tuple] = []
            for q, v, a, c in zip(b.column("row").to_pylist(), b.column("v").to_pylist(), *distances(rows_of(b), books), strict=True):
                cells = np.array(walk(a, c, counts, enough))
                each = np.repeat(cells, blocks[cells])
                block = np.arange(len(each)) - np.repeat(np.cumsum(blocks[cells]) - blocks[cells], blocks[cells])
                where = shard(each, block)
                for s in np.unique(where).tolist():
                    out.append((q, v, s, np.unique(each[where == s]).tolist()))
            names, types = ["q", "v", "shard", "cells"], [pa.int64(), b.schema.field("v").type, pa.int64(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    chosen = keep(entries.select("row", "v").join(queries, "row"), "queries")
    parts = max(1, -(-chosen.count() // GROUP))
    probes = chosen.mapInArrow(probe, f"q long, v {kind}, shard long, cells array<int>").withColumn("part", F.pmod(F.xxhash64("q"), F.lit(parts)))
    dealt = index.mapInArrow(deal, f"row long, v {kind}, ids array<long>, cell int, shard long")
    dealt = dealt.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))

    none = pd.DataFrame({"q": np.zeros(0, np.int64), "ids": np.zeros(0, object), "score": np.zeros(0)})

    def rerank(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return none
        x = unit(np.stack(left["v"].to_numpy()).astype(np.float64))
        cell, ids = left["cell"].to_numpy(), left["ids"].to_numpy()
        first = np.array([i[0] for i in ids])
        out = []
        for q, v, cells in zip(right["q"], right["v"], right["cells"], strict=True):
            some = np.flatnonzero(np.isin(cell, cells))
            score = np.einsum("ij,j->i", x[some], unit(np.asarray(v, dtype=np.float64)[None])[0])
            out += [(q, ids[some[i]], score[i]) for i in np.lexsort((first[some], -score))[:k]]
        return pd.DataFrame(out, columns=["q", "ids", "score"]) if out else none

    return dealt.groupBy("shard", "part").cogroup(probes.groupBy("shard", "part")).applyInPandas(rerank, "q long, ids array<long>, score double")
