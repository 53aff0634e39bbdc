"""Text retrieval: bags of words, an inverted index, boolean and cosine search.

A term's weight in a document is (1 + log10 tf) / (df + 1); both vectors are normalised, the document's over all its terms.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.errors import SqlError
from quarry.functions.text import STOP_WORDS, stem, tokens


def bag(docs: DataFrame, key: str, text: str, stop: tuple[str, ...] = STOP_WORDS, stems: bool = False) -> DataFrame:
    """key, term, tf."""
    if stems:
        words = docs.select(key, F.explode(tokens(F.col(text), stop, True)).alias("term"))
    else:  # stop words go after the words stand in rows, where a set of constants is compiled code
        words = docs.select(key, F.explode(tokens(F.col(text), ())).alias("term"))
        words = words.where(~F.col("term").isin(*stop)) if stop else words
    return words.groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def as_maps(bags: DataFrame, key: str) -> DataFrame:
    """key, bag_of_words map<string, long>: a document's terms together."""
    return bags.groupBy(key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("term", "tf")))).alias("bag_of_words"))


@dataclass
class Index:
    """postings: key, term, tf; df: term, df; norms: key, nd, the length of a document's vector of weights.

    Built in memory these are plans; written, tables: postings sorted by term, so that a list reads the files that hold it.
    """

    postings: DataFrame
    key: str
    stems: bool = False
    df: DataFrame | None = None
    norms: DataFrame | None = None

    @classmethod
    def build(cls, docs: DataFrame, key: str, text: str, stop: tuple[str, ...] = STOP_WORDS, stems: bool = False) -> Index:
        return cls(bag(docs, key, text, stop, stems), key, stems)

    @classmethod
    def open(cls, spark: SparkSession, path: str, key: str, stems: bool = False) -> Index:
        return cls(*(spark.read.parquet(f"{path}/postings"),), key, stems, spark.read.parquet(f"{path}/df"), spark.read.parquet(f"{path}/norms"))

    def write(self, path: str) -> Index:
        """Store the index; texts are read and cut into words once."""
        spark = self.postings.sparkSession
        self.postings.repartitionByRange("term").sortWithinPartitions("term", self.key).write.mode("overwrite").parquet(f"{path}/postings")
        held = Index(spark.read.parquet(f"{path}/postings"), self.key, self.stems)
        held.frequencies().repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/df")
        held.df = spark.read.parquet(f"{path}/df")
        held.lengths().write.mode("overwrite").parquet(f"{path}/norms")
        return Index.open(spark, path, self.key, self.stems)

    def frequencies(self) -> DataFrame:
        """term, df."""
        return self.df if self.df is not None else self.postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))

    def lengths(self) -> DataFrame:
        """key, nd."""
        return self.norms if self.norms is not None else self.weights().groupBy(self.key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("nd"))

    def term(self, word: str) -> str:
        return stem(word) if self.stems else word

    def list(self, word: str) -> DataFrame:
        """The postings of a word's term: key, tf; none if no document has it."""
        return self.postings.where(F.col("term") == self.term(word)).select(self.key, "tf")

    def both(self, a: DataFrame, b: DataFrame) -> DataFrame:
        return a.join(b.withColumnRenamed("tf", "__tf"), self.key).select(self.key, (F.col("tf") + F.col("__tf")).alias("tf"))

    def either(self, a: DataFrame, b: DataFrame) -> DataFrame:
        return a.unionByName(b).groupBy(self.key).agg(F.sum("tf").alias("tf"))

    def without(self, a: DataFrame, b: DataFrame) -> DataFrame:
        return a.join(b, self.key, "left_anti")

    def boolean(self, query: str) -> DataFrame:
        """The documents of "w1 OP w2 OP w3", OP one of AND, OR, AND-NOT, OR-NOT, read from left to right; NOT may come first."""
        parts = re.sub(r"\b(AND|OR)\s+NOT\b", r"\1-NOT", query).split()
        everything = lambda: self.postings.select(self.key).distinct()
        of = lambda word: self.list(word).select(self.key)
        if parts and parts[0] == "NOT":
            parts.pop(0)
            out = everything().join(of(parts[0]), self.key, "left_anti") if parts else None
        else:
            out = of(parts[0]) if parts else None
        if out is None or len(parts) % 2 == 0 or any(p not in ("AND", "OR", "AND-NOT", "OR-NOT") for p in parts[1::2]):
            raise SqlError("syntactic", f"no boolean query: {query}")
        for op, word in zip(parts[1::2], parts[2::2], strict=True):
            other = of(word)
            if op == "AND":
                out = out.join(other, self.key, "left_semi")
            elif op == "AND-NOT":
                out = out.join(other, self.key, "left_anti")
            else:
                out = out.unionByName(other if op == "OR" else everything().join(other, self.key, "left_anti")).distinct()
        return out

    def weights(self) -> DataFrame:
        """key, term, w."""
        w = (1 + F.log10("tf")) / (F.col("df") + 1)
        return self.postings.join(self.frequencies(), "term").select(self.key, "term", w.alias("w"))

    def cosine(self, query: str, k: int | None = 5, everything: bool = False) -> DataFrame:
        """key, score: the k best documents, or all if k is None; with `everything`, documents without a term of the query too."""
        counts = Counter(self.term(w) for w in query.split())
        spark = self.postings.sparkSession
        asked = spark.createDataFrame([(t, n) for t, n in counts.items()], "term string, n long")
        of = F.col("term").isin(*counts)
        q = asked.join(self.frequencies().where(of), "term").select("term", "df", ((1 + F.log10("n")) / (F.col("df") + 1)).alias("q"))
        norm = q.agg(F.sqrt(F.sum(F.col("q") * F.col("q"))).alias("nq"))
        # only the lists of the query's terms are read, and the lengths of the documents in them
        w = (1 + F.log10("tf")) / (F.col("df") + 1)
        dots = self.postings.where(of).join(F.broadcast(q), "term").groupBy(self.key).agg(F.sum(w * F.col("q")).alias("dot"))
        out = self.lengths().join(dots, self.key, "left" if everything else "inner").join(F.broadcast(norm)).where(F.col("nq").isNotNull())  # one row: the query's length
        out = out.select(self.key, F.coalesce(F.col("dot") / (F.col("nd") * F.col("nq")), F.lit(0.0)).alias("score"))
        return out if k is None else out.orderBy(F.desc(F.round("score", 9)), self.key).limit(k)


def show(bags: DataFrame, key: str, ids: list, width: int = 80) -> DataFrame:
    """A document's key and the start of its bag of words."""
    return as_maps(bags.where(F.col(key).isin(ids)), key).select(key, F.substring(F.to_json("bag_of_words"), 1, width).alias("bag_of_words"))
