"""Near-duplicate vectors by spherical-cap filters.

A filter's direction is a codeword of a random product code: one unit vector for each block of rotated coordinates, joined.
A vector goes to every filter whose direction it exceeds a threshold on; the list is decoded by adding block scores in
falling order and pruning with the best that later blocks can still give. Filters that share the codewords of their first
blocks, as many as their entries allow, form a group, so that a vector goes there once for all of them. Vectors that share a
filter are compared; a link counts in the group of the least filter that both share, so none counts twice.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import NO_ID, fresh_path, id_below, keep, scratch, ship
from quarry.llm.components import components
from quarry.llm.vectors import unit, usable

BLOCKS, WORDS = 3, 64
#: Filters that a random vector passes on average, which sets the threshold; and at least, by a lower threshold of its own.
PASSED, LEAST = 24, 16
#: Random vectors that the threshold is read from, and how many of them at once.
PROBES, PROBED = 64, 8
#: Entries of filters that share a group at most; a filter with more entries than GROUP is compared in pairs of blocks of about that many.
TOGETHER, GROUP = 8_192, 512
#: Entries in a task, about.
TASK = 16_384


@lru_cache(maxsize=16)
def code(dims: int, blocks: int = BLOCKS, words: int = WORDS, passed: float = PASSED) -> tuple[np.ndarray, list[np.ndarray], float]:
    """A rotation, the codebooks, and the threshold that random vectors exceed for `passed` of all directions on average.

    Scores of PROBED vectors by all directions are held at a time (16 MB as set here), and the highest ones so far.
    """
    rng = np.random.default_rng(20_240_602)
    turn = np.linalg.qr(rng.standard_normal((dims, dims)))[0]
    blocks = min(blocks, dims)
    books = [b / np.linalg.norm(b, axis=1, keepdims=True) / blocks**0.5 for b in (rng.standard_normal((words, len(x))) for x in np.array_split(np.arange(dims), blocks))]
    wanted = int(passed * PROBES)
    if wanted >= PROBES * words**blocks:
        return turn, books, -2.0
    best = np.zeros(0)
    for _ in range(0, PROBES, PROBED):
        probe = rng.standard_normal((PROBED, dims))
        probe /= np.linalg.norm(probe, axis=1, keepdims=True)
        scores = np.zeros((PROBED, 1))
        for book, part in zip(books, np.array_split(probe, blocks, axis=1), strict=True):
            scores = (scores[:, :, None] + (part @ book.T)[:, None, :]).reshape(PROBED, -1)
        scores = scores.ravel()
        if len(best) == wanted:
            scores = scores[scores > best.min()]
        best = np.concatenate([best, scores])
        if len(best) > wanted:
            best = np.partition(best, len(best) - wanted)[len(best) - wanted :]
    return turn, books, float(best.min())


def decode(x: np.ndarray, turn: np.ndarray, books: list[np.ndarray], threshold: float) -> list[np.ndarray]:
    """For each unit vector the sorted numbers of all filters whose direction it exceeds the threshold on.

    A vector that exceeds it on fewer than LEAST lowers its own threshold, step by step.
    """
    parts = [p @ b.T for p, b in zip(np.array_split(x @ turn, len(books), axis=1), books, strict=True)]
    orders = [np.argsort(-p, axis=1) for p in parts]
    ranked = [np.take_along_axis(p, o, axis=1) for p, o in zip(parts, orders, strict=True)]
    least = min(LEAST, int(np.prod([float(len(b)) for b in books])))

    def listed(i: int, need: float) -> np.ndarray:
        score, number = np.zeros(1), np.zeros(1, np.int64)
        rest = sum(r[i, 0] for r in ranked)
        for book, order, rank in zip(books, orders, ranked, strict=True):
            rest -= rank[i, 0]
            # codewords fall in score, so each partial sum keeps a prefix of them
            fit = np.searchsorted(-rank[i], score + rest - need + 1e-15, side="right")
            of = np.repeat(np.arange(len(score)), fit)
            at = np.arange(len(of)) - np.repeat(np.cumsum(fit) - fit, fit)
            score, number = score[of] + rank[i, at], number[of] * len(book) + order[i, at]
        return np.sort(number)

    out = []
    for i in range(len(x)):
        need = min(threshold, sum(r[i, 0] for r in ranked))
        while len(found := listed(i, need)) < least:
            need -= 0.01
        out.append(found)
    return out


def links(vectors: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """From node, label, copies, v: the number of linked rows by node, and edges that span the same components."""
    ship(vectors.sparkSession)

    def filters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                some = b.slice(at, 2000)
                x = some.column("v").to_pylist()
                found: list = [None] * len(x)
                for dims in {len(v) for v in x}:
                    own = [i for i, v in enumerate(x) if len(v) == dims]
                    for i, f in zip(own, decode(unit(np.array([x[i] for i in own], dtype=np.float64)), *code(dims)), strict=True):
                        found[i] = f
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(found, pa.list_(pa.int32()))], [*some.schema.names, "filters"])

    kind = vectors.schema["v"].dataType.simpleString()
    listed = keep(vectors.select("node", "label", "copies", "v").mapInArrow(filters, f"node long, label int, copies long, v {kind}, filters array<int>"), "filters")
    thin = listed.select("node", "label", F.size("v").alias("dims"), F.explode("filters").alias("filter"))
    counts = keep(thin.groupBy("label", "dims", "filter").agg(F.count("*").alias("n")).where("n > 1"), "counts")

    # the shortest prefix of a filter's codewords whose filters have TOGETHER entries at most: it spans 1, WORDS or WORDS^2 filters
    spans = [WORDS**k for k in range(BLOCKS - 1, 0, -1)]
    sized = counts
    for span in spans:
        low = (F.col("filter") - F.col("filter") % span).alias(f"low{span}")
        sums = counts.groupBy("label", "dims", low).agg(F.sum("n").alias(f"n{span}"))
        sized = sized.withColumn(f"low{span}", low).join(sums, ["label", "dims", f"low{span}"])
    span = F.coalesce(*(F.when(F.col(f"n{x}") <= TOGETHER, F.lit(x)) for x in spans), F.lit(1))
    blocks = F.when(span == 1, F.ceil(F.col("n") / GROUP)).otherwise(1).cast("int")
    groups = sized.select("label", "dims", "filter", (F.col("filter") - F.col("filter") % span).alias("low"), blocks.alias("blocks"))
    entries = counts.agg(F.sum("n")).first()[0] or 0
    tasks = max(1, -(-entries // TASK))

    # each vector once in a group; each pair of blocks (i <= j) of a large filter is a group of its own
    members = thin.join(groups, ["label", "dims", "filter"]).groupBy("node", "label", "dims", "low", "blocks").agg(F.sort_array(F.collect_list("filter")).alias("here"))
    members = members.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    members = members.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    members = members.withColumn("group", F.xxhash64("label", "dims", "low", "i", "j"))
    rows = members.select("node", "group", "low", "here", "own", "i", "j").join(listed.drop("label"), "node").withColumn("task", F.pmod("group", F.lit(tasks)))

    def compare(some: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"u": [], "v": [], "n": []}, dtype="int64")
        return pd.concat([none, *(out for _, g in some.groupby("group", sort=False) if (out := compare_group(g, threshold)) is not None)])

    found = keep(rows.groupBy("task").applyInPandas(compare, "u long, v long, n long"), "links")
    return found.where("u = v").groupBy("u").agg(F.sum("n").alias("n")), found.where("u <> v").select("u", "v")


def membership(lists: list[np.ndarray]) -> np.ndarray:
    """A row of 0 and 1 for each list over the filters that several of them hold."""
    flat = np.concatenate(lists)
    held, column, n = np.unique(flat, return_inverse=True, return_counts=True)
    out = np.zeros((len(lists), len(held)), dtype=np.float32)
    out[np.repeat(np.arange(len(lists)), [len(x) for x in lists]), column] = 1
    return out[:, n > 1]


def compare_group(g: pd.DataFrame, threshold: float) -> pd.DataFrame | None:
    """u, u, n: rows that a node links to within a group; u, v, 0: a forest of these links. None if there are no links."""
    node, copies, own = g["node"].to_numpy(), g["copies"].to_numpy(), g["own"].to_numpy()
    i, j, low = g["i"].iat[0], g["j"].iat[0], g["low"].iat[0]
    x = unit(np.stack(g["v"].to_numpy()).astype(np.float64))
    left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
    a, b = [], []
    for at in range(0, len(left), GROUP):
        near = np.argwhere(x[left[at : at + GROUP]] @ x[right].T >= threshold - 1e-9)
        p, q = left[at + near[:, 0]], right[near[:, 1]]
        one = p < q if i == j else np.ones(len(p), bool)
        p, q = p[one], q[one]
        a.append(p)
        b.append(q)
    a, b = np.concatenate(a), np.concatenate(b)
    if len(a):
        exact = np.concatenate([np.einsum("ij,ij->i", x[a[k : k + 65_536]], x[b[k : k + 65_536]]) >= threshold for k in range(0, len(a), 65_536)])
        a, b = a[exact], b[exact]
    if not len(a):
        return None
    # a pair counts here if the least filter that both share is one of the group's
    used = np.unique(np.concatenate([a, b]))
    here, every = g["here"].to_numpy(), g["filters"].to_numpy()
    inside, before = membership([np.asarray(here[k]) for k in used]), membership([np.asarray(every[k])[np.asarray(every[k]) < low] for k in used])
    row = np.zeros(len(g), np.int64)
    row[used] = np.arange(len(used))
    counts = np.zeros(len(a), bool)
    order = np.argsort(a, kind="stable")
    for at in range(0, len(used), GROUP):
        some = order[np.searchsorted(row[a[order]], at) : np.searchsorted(row[a[order]], at + GROUP)]
        p, q = row[a[some]] - at, row[b[some]]
        counts[some] = (inside[at : at + GROUP] @ inside.T)[p, q] > 0
        counts[some] &= (before[at : at + GROUP] @ before.T)[p, q] == 0
    a, b = a[counts], b[counts]
    n = np.zeros(len(g), np.int64)
    np.add.at(n, a, copies[b])
    np.add.at(n, b, copies[a])
    # a forest is enough for the components
    p, edges = list(range(len(g))), []
    for s, t in zip(a.tolist(), b.tolist(), strict=True):
        while p[s] != s:
            p[s] = s = p[p[s]]
        while p[t] != t:
            p[t] = t = p[p[t]]
        if s != t:
            p[t] = s
            edges.append((s, t))
    some = np.flatnonzero(n)
    out = pd.DataFrame({"u": node[some], "v": node[some], "n": n[some]})
    return pd.concat([out, pd.DataFrame({"u": [node[s] for s, _ in edges], "v": [node[t] for _, t in edges], "n": 0})]).astype("int64")


def duplicates(vectors: DataFrame, threshold: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id (the smallest vec_id reachable), kept, for every row of vec_id, embedding, label.

    Vectors that are null, empty, zero or hold null or non-finite components, and rows without a label, link with nothing;
    vectors of other lengths do not link. Equal vectors of one label are one node that knows how many they are. Rows
    that repeat a vec_id are vectors of their own. Rows without a vec_id link, but give no component its name; a
    component without names has none, and such rows are kept only there. An id from NO_ID on is an error.
    """
    rows = vectors.select(id_below(NO_ID, "vec_id"), F.col("label").cast("int").alias("label"), F.col("embedding").alias("v"))
    zero = F.lit(0.0).cast(rows.schema["v"].dataType.elementType)
    rows = rows.withColumn("ok", usable("v") & F.col("label").isNotNull()).withColumn("v", F.when(F.col("ok"), F.transform("v", lambda x: x + zero)))
    key = F.when(F.col("ok"), F.sha2(F.concat_ws(",", F.col("label").cast("string"), F.transform("v", lambda x: x.cast("double").cast("string"))), 256)).alias("key")
    keyed = keep(rows.select("vec_id", "label", "v", key, F.monotonically_increasing_id().alias("row")), "vectors")
    nodes = keyed.where("key is not null").groupBy("key").agg(F.min("row").alias("node"), F.min("vec_id").alias("least"), F.first("label").alias("label"), F.first("v").alias("v"), F.count("*").alias("copies"))
    nameless = F.lit(NO_ID) + F.shiftrightunsigned(F.xxhash64("key"), 25)
    first = F.coalesce("least", nameless)
    nodes = keep(nodes.withColumn("name", first), "nodes")
    spark = vectors.sparkSession
    linked, joined_path = fresh_path(spark, "linked"), fresh_path(spark, "joined")
    with scratch(spark):
        counts, edges = links(nodes, threshold)
        counts = keep(counts, "", linked)
        joined = keep(components(edges), "", joined_path)
    named = nodes.select("node", "name").join(joined, "node", "left").withColumn("root", F.coalesce("component", "node"))
    least = named.groupBy("root").agg(F.min("name").alias("component_id"))
    of = named.join(least, "root").select("node", "component_id")
    per_key = nodes.select("node", "key", "copies").join(of, "node").join(counts.withColumnRenamed("u", "node"), "node", "left")
    per_key = per_key.select("key", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = keyed.select("vec_id", "key").join(per_key, "key", "left")
    component = F.when(F.col("component_id") < NO_ID, F.col("component_id")).when(F.col("component_id").isNull(), F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))
