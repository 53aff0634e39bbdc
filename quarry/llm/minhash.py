"""Near duplicates by MinHash: many universal hash minima, bands, verification, components.

Documents with equal sets of shingles form a class, the node of a graph. Classes that share a band are candidates. Of a
bucket, first each member is checked against the least one. Where buckets then still hold several components, all members are
compared with those outside the largest component, in blocks: signatures propose, full sets decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import NO_ID, as_binary, fresh_path, id_below, keep, scratch, ship, slices, utf8
from quarry.llm.components import components

MIX = np.uint64(0x9E3779B97F4A7C15)
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Members of a bucket that meet in one task, about.
BLOCK = 512
#: A pair's estimate may fall short of the threshold by so many standard deviations before it is dropped unverified.
DEVIATIONS = 4.5
#: Parts into which the members of a bucket are dealt where they meet what is known of it; buckets of up to WIDE have one.
SALTS, WIDE = 64, 512


def scrambled(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _keys(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return scrambled(np.arange(1, n + 1, dtype=np.uint64) * MIX) | np.uint64(1)


@lru_cache(maxsize=4)
def family(hashes: int) -> tuple[np.ndarray, np.ndarray]:
    """Universal functions x -> (a x + b) mod 2^64, its upper half: odd a, any b, fixed by a seed."""
    rng = np.random.default_rng(20_240_601)
    a = rng.integers(0, 1 << 64, hashes, dtype=np.uint64, endpoint=False) | np.uint64(1)
    return a, rng.integers(0, 1 << 64, hashes, dtype=np.uint64, endpoint=False)


def shingles(offsets: np.ndarray, data: np.ndarray, words: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's shingles of so many words; of all its words if it has fewer.

    A word's hash is multilinear in its bytes; a shingle's is a scrambled sum of its words' hashes times powers. Equal
    hashes stand for equal shingles.
    """
    n = len(offsets) - 1
    if not len(data):
        return [np.zeros(0, np.uint64)] * n
    with np.errstate(over="ignore"):
        low, gap = LOWER[data], SPACE[data]
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[offsets] = True
        starts = np.flatnonzero(~gap & (edge[:-1] | np.concatenate([[True], gap[:-1]])))
        if not len(starts):
            return [np.zeros(0, np.uint64)] * n
        bounds = np.flatnonzero(gap | edge[:-1])
        after = np.searchsorted(bounds, starts, side="right")
        ends = np.append(bounds, len(data))[after]
        lengths = ends - starts
        longest = 1 << int(lengths.max() - 1).bit_length()
        first = np.cumsum(lengths) - lengths
        inside = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
        letters = low[inside + np.repeat(starts, lengths)].astype(np.uint64) + np.uint64(1)
        word = scrambled(np.add.reduceat(letters * _keys(max(64, longest))[inside], first) + lengths.astype(np.uint64))
        of = np.searchsorted(starts, offsets, side="left")
        out = []
        whole = np.zeros(max(0, len(word) - words + 1), np.uint64)
        for i in range(words):
            whole = whole * MIX + word[i : i + len(whole)]
        whole = scrambled(whole)
        for a, b in zip(of[:-1].tolist(), of[1:].tolist(), strict=True):
            if b - a >= words:
                out.append(np.unique(whole[a : b - words + 1]))
            elif b > a:
                short = np.uint64(b - a)
                for x in word[a:b]:
                    short = short * MIX + x
                out.append(scrambled(np.array([short], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray], hashes: int) -> np.ndarray:
    """The minimum of each hash over each set; all ones for an empty set."""
    out = np.full((len(sets), hashes), 0xFFFFFFFF, dtype=np.uint32)
    some = [i for i, s in enumerate(sets) if len(s)]
    if not some:
        return out
    a, b = family(hashes)
    at = 0
    with np.errstate(over="ignore"):
        while at < len(some):
            end, size = at, 0
            while end < len(some) and (end == at or size + len(sets[some[end]]) <= 32_768):
                size += len(sets[some[end]])
                end += 1
            x = np.concatenate([sets[i] for i in some[at:end]])
            starts = np.cumsum([0, *(len(sets[i]) for i in some[at : end - 1])])
            y = np.empty_like(x)
            for k in range(hashes):
                np.multiply(x, a[k], out=y)
                np.add(y, b[k], out=y)
                out[some[at:end], k] = np.minimum.reduceat(y, starts) >> np.uint64(32)
            at = end
    return out


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    """A key for each band of so many rows; the band's number is part of it."""
    n, hashes = signature.shape
    with np.errstate(over="ignore"):
        out = np.tile(np.arange(hashes // rows, dtype=np.uint64) * MIX, (n, 1))
        parts = signature.reshape(n, hashes // rows, rows).astype(np.uint64)
        for i in range(rows):
            out = scrambled(out * MIX + parts[:, :, i])
    return out.view(np.int64)


def sketch(docs: DataFrame, words: int, hashes: int, rows: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, set_hash, and, for sets that are not empty, signature and bands."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole):
                sets = shingles(*as_binary(b.column(1)), words)
                signature = signatures(sets, hashes)
                bands = band_keys(signature, rows)
                none = [len(s) == 0 for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0),
                        b.column(2),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                        pa.array([None if e else s.tobytes() for s, e in zip(signature, none, strict=True)], pa.binary()),
                        pa.array([None if e else s for s, e in zip(bands, none, strict=True)], pa.list_(pa.int64())),
                    ],
                    ["doc_id", "text_hash", "n_shingles", "set_hash", "signature", "bands"],
                )

    return docs.select("doc_id", utf8("text").alias("t"), text_hash()).mapInArrow(run, "doc_id long, text_hash long, n_shingles long, set_hash binary, signature binary, bands array<long>")


def text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash")


def sets_of(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """node, shingles: the sets of the wanted classes (node, doc_id, text_hash), read from one document of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole):
                sets = shingles(*as_binary(b.column(1)), words)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["node", "shingles"])

    texts = docs.select(F.col("doc_id").alias("__id"), utf8("text").alias("t"), text_hash().alias("__hash"))
    rows = texts.join(wanted, F.col("__id").eqNullSafe(F.col("doc_id")) & (F.col("__hash") == F.col("text_hash"))).select("node", "t")
    return rows.mapInArrow(run, "node long, shingles array<long>")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose sets share at least so many percent of their union."""
    a = sets.select(F.col("node").alias("u"), F.col("shingles").alias("__a"))
    b = sets.select(F.col("node").alias("v"), F.col("shingles").alias("__b"))
    both = pairs.join(b, "v").join(a, "u")
    shared = F.size(F.array_intersect("__a", "__b")).cast("long")
    return both.where(100 * shared >= percent * (F.size("__a").cast("long") + F.size("__b") - shared)).select("u", "v")


def salt(n: Column | int) -> Column:
    """A node's part of a bucket that has n members."""
    own = F.pmod(F.xxhash64("node", F.lit(3)), F.lit(SALTS)).cast("int")
    return own if isinstance(n, int) else F.when(n > WIDE, own).otherwise(0)


def salted(known: DataFrame) -> DataFrame:
    """A row for each part of a bucket, from one for each bucket with its number of members n."""
    return known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.when(F.col("n") > WIDE, F.lit(SALTS - 1)).otherwise(0)))).drop("n")


def bucketed(banded: DataFrame) -> DataFrame:
    """bucket, node, least (of the bucket), n (of its members), from bucket and node; buckets of one member are left out.

    Members of a bucket are counted by part first, and what is known of the bucket goes back to its parts: no task gets all
    members of a bucket.
    """
    dealt = banded.withColumn("salt", salt(SALTS))
    parts = dealt.groupBy("bucket", "salt").agg(F.min("node").alias("least"), F.max("node").alias("greatest"), F.count("*").alias("n"))
    whole = parts.groupBy("bucket").agg(F.min("least").alias("least"), F.max("greatest").alias("greatest"), F.sum("n").alias("n"), F.collect_list("salt").alias("salts"))
    known = whole.where("least < greatest").select("bucket", "least", "n", F.explode("salts").alias("salt"))
    return dealt.join(known.hint("merge"), ["bucket", "salt"]).select("bucket", "node", "least", "n")


def meetings(rows: DataFrame) -> DataFrame:
    """most, node, label, blocks, parts, from bucket, node, label, n (of its members), salt of the members of open buckets.

    The nodes of all buckets in which a label is the most frequent one meet once, however many buckets they share. All of them
    are dealt into blocks of about BLOCK; those of other labels also visit every block, in parts of about BLOCK.
    """
    labels = rows.groupBy("bucket", "label", "n").count()
    most = labels.groupBy("bucket", "n").agg(F.max_by("label", F.struct("count", "label")).alias("most"))
    met = keep(rows.drop("n").join(salted(most).hint("merge"), ["bucket", "salt"]).select("most", "node", "label").distinct(), "met")
    sizes = met.groupBy("most").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"), F.ceil(F.sum((F.col("label") != F.col("most")).cast("long")) / BLOCK).alias("parts"))
    every = sizes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return met.withColumn("salt", salt(SALTS)).join(every.hint("merge"), ["most", "salt"]).drop("salt")


def links_between(met: DataFrame, signed: DataFrame, hashes: int, percent: int) -> DataFrame:
    """u, v: links between different labels that meet, one at least for each visitor and label that it links to.

    Signatures propose, full sets decide, and nothing but links leaves a task.
    """
    t = percent / 100
    least = t - DEVIATIONS * (t * (1 - t) / hashes) ** 0.5
    full = met.join(signed, "node")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    own = F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks"))
    part = F.pmod(F.xxhash64("node", F.lit(2)), F.col("parts"))
    cols = ["most", "node", "label", "signature", "shingles"]
    members = full.select(*cols, own.alias("block"), every("parts").alias("part"), F.lit(False).alias("visits"))
    visitors = full.where("label <> most").select(*cols, every("blocks").alias("block"), part.alias("part"), F.lit(True).alias("visits"))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        sign = np.frombuffer(b"".join(g["signature"]), dtype=np.uint32).reshape(len(g), hashes)
        node, label, visits = g["node"].to_numpy(), g["label"].to_numpy(), g["visits"].to_numpy()
        sets = [np.asarray(x).view(np.uint64) for x in g["shingles"]]
        here, out = np.flatnonzero(~visits), []
        for j in np.flatnonzero(visits).tolist():
            other = here[label[here] != label[j]]
            alike = (sign[other] == sign[j]).sum(1)
            close = other[np.argsort(-alike, kind="stable")[: int((alike >= least * hashes).sum())]]
            while len(close):
                some, close = close[:64], close[64:]
                sizes = np.array([len(sets[i]) for i in some])
                x = np.concatenate([sets[i] for i in some])
                place = np.minimum(np.searchsorted(sets[j], x), len(sets[j]) - 1)
                shared = np.add.reduceat((sets[j][place] == x).astype(np.int64), np.cumsum(sizes) - sizes)
                linked = some[100 * shared >= percent * (sizes + len(sets[j]) - shared)]
                # one link to a label is enough
                _, first = np.unique(label[linked], return_index=True)
                out += [(node[j], node[i]) for i in linked[first]]
                close = close[~np.isin(label[close], label[linked])]
        return pd.DataFrame(out, columns=["u", "v"], dtype="int64")

    return members.unionByName(visitors).groupBy("most", "block", "part").applyInPandas(run, "u long, v long")


def duplicates(docs: DataFrame, words: int = 5, percent: int = 80, hashes: int = 128, rows: int = 4) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable), kept, text_hash, for every row of docs.

    A pair at the threshold is missed with probability (1 - t^rows)^(hashes / rows): 5e-8 as set here. Null and blank texts have
    no shingles and are their own component. A row that repeats an id stays, with its own text's component. A row without an id
    gets the smallest id it is linked to, else none, and is kept only if it has none. An id from NO_ID on is an error. Columns
    besides doc_id and text are left out.
    """
    docs = docs.select(id_below(NO_ID, "doc_id"), "text")
    drawn = keep(sketch(docs, words, hashes, rows), "sketch")
    first = drawn.where("n_shingles > 0").groupBy("set_hash").agg(F.min("doc_id").alias("doc_id"), F.min_by("text_hash", "doc_id").alias("text_hash"), F.first("text_hash").alias("any_text"), F.first("signature").alias("signature"), F.first("bands").alias("bands"))
    node = F.coalesce("doc_id", F.lit(NO_ID) + F.shiftrightunsigned(F.xxhash64("set_hash"), 25))
    classes = keep(first.withColumn("node", node).withColumn("text_hash", F.coalesce("text_hash", "any_text")).drop("any_text"), "classes")
    path = fresh_path(docs.sparkSession, "joined")
    with scratch(docs.sparkSession):
        joined = keep(components(_links(docs, classes, words, percent, hashes)), "", path)
    of = classes.select("set_hash", "node").join(joined, "node", "left").select("set_hash", F.coalesce("component", "node").alias("component"))
    out = drawn.select("doc_id", "text_hash", "n_shingles", "set_hash").join(of, "set_hash", "left")
    component = F.when(F.col("component") < NO_ID, F.col("component")).when(F.col("component").isNull(), F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"), "text_hash")


def _links(docs: DataFrame, classes: DataFrame, words: int, percent: int, hashes: int) -> DataFrame:
    """u, v: links between classes that span the same components as all links do."""
    banded = classes.select("node", F.explode("bands").alias("bucket"))
    members = keep(bucketed(banded), "members")
    stars = keep(members.where("node <> least").select(F.col("least").alias("u"), F.col("node").alias("v")).distinct(), "stars")
    involved = stars.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    sets = keep(sets_of(docs, involved.join(classes, "node").select("node", "doc_id", "text_hash"), words), "sets")
    links = keep(verified(stars, sets, percent), "links")

    label = components(links).select("node", F.col("component").alias("label"))
    open_ = members.where("n > 2").join(label, "node", "left").select("bucket", "node", "n", F.coalesce("label", "node").alias("label"))
    still = open_.groupBy("bucket", "n").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a < b").select("bucket", "n")
    met = meetings(open_.withColumn("salt", salt(F.col("n"))).join(salted(still).hint("merge"), ["bucket", "salt"]))
    signed = classes.select("node", "signature").join(sets, "node")
    return keep(links.unionByName(links_between(met, signed, hashes, percent)), "links")


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, all columns, of which `duplicates` keeps; of rows that repeat both an id and a text with words, one."""
    found = keep(duplicates(docs, words, percent), "found")
    gone = found.where(~F.col("kept")).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    left = docs.join(gone, docs["doc_id"].eqNullSafe(gone["__id"]) & (text_hash() == gone["__hash"]), "left_anti")
    more = found.where(F.col("kept") & (F.col("n_shingles") > 0)).groupBy("doc_id", "text_hash").count().where("count > 1").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"))
    if more.isEmpty():
        return left
    same = left["doc_id"].eqNullSafe(more["__id"]) & (text_hash() == more["__hash"])
    return left.join(more, same, "left_anti").unionByName(left.join(more, same, "left_semi").dropDuplicates(["doc_id", "text"]))
