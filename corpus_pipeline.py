"""A corpus from documents to packed sequences: toxic documents go, one of each group of near duplicates stays, personal data
is masked, and what is left is packed.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of documents. Between stages the rows are written as
Parquet and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import minhash, packing, pii, toxicity
from quarry.llm.common import drop, fresh_path, keep, named, read, scratch, unused


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that score below TOXIC; the network learns from the labels of `sf_dir`."""
    net, own = toxicity.fit(docs, read(spark, sf_dir, "labels")), unused(docs, "own_toxicity")
    return toxicity.score(docs, net, own).where(F.col(own) < toxicity.TOXIC).drop(own)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents that share 80 % of their five-word shingles, the one with the smallest id.

    Documents without words are no duplicates and stay. Of rows that repeat an id and a text, one stays.
    """
    return minhash.one_of_each(docs, 5, 80)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with each run of personal data replaced by its kind; n_chars, where there is one, follows the text."""
    own = unused(docs, "own_spans")
    masked = pii.redact(pii.find(docs, spans=own), spans=own)
    return masked.select(*(F.length("text").cast("long").alias(c) if c == "n_chars" else named(c) for c in docs.columns))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of what is left with its place in a sequence of at most 4096 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), 4096, 1)


STAGES = [("toxicity", without_toxic), ("near_duplicates", without_near_duplicates), ("personal_data", without_personal_data), ("packing", packed)]

#: The first stage is a trained network: SQL cannot express it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, one after the other."""
    out, last = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = fresh_path(spark, f"pipeline-{name}")
        with scratch(spark):  # what a stage wrote goes when its result is written, and so does what it read
            out = keep(stage(spark, out, sf_dir), "", path)
        if last:
            drop(spark, last)
        last = path
    return out
