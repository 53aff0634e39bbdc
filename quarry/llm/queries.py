"""The queries of this package, with production parameters over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import ann, bpe, embdedup, minhash, packing, pii, secrets, toxicity, urls, warc
from quarry.llm.common import fresh_path, read
from quarry.llm.spans import as_text, digest


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and the bytes they stand for, as digests."""
    out = bpe.encode(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, decoded=True)
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def _is(kind: str) -> Callable:
    return lambda s: s["kind"] == kind


def _spans(df: DataFrame, kinds: list[str], *more: Column) -> DataFrame:
    base = F.filter("spans", lambda s: s["kind"].isin(kinds))
    counts = (F.size(F.filter("spans", _is(k))).cast("long").alias(f"n_{k}") for k in kinds)
    return df.select("doc_id", *counts, digest(as_text(base)).alias("base_sha256"), as_text(F.col("spans")).alias("spans"), *more)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data, and their scores in the same order."""
    found = pii.find(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return _spans(found, pii.BASE, F.array_join(F.transform("spans", lambda s: s["score"].cast("string")), ",").alias("scores"))


RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page's URL."""
    return urls.judge(read(spark, sf_dir, "pages").select("page_id", "url"), RULES)


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents that share 80 % of their shingles of two words."""
    return minhash.duplicates(read(spark, sf_dir, "documents"), 2, 80).drop("text_hash")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece with its place in a sequence of at most 4096 tokens."""
    return packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 4096, 1)


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of each whose id is divisible by 50."""
    return ann.search(read(spark, sf_dir, "embeddings"), 50, 5)


def op7_embdedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of one label linked by a cosine of 0.98 or more."""
    return embdedup.duplicates(read(spark, sf_dir, "embeddings"), 0.98)


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets, through a ledger that starts empty."""
    return _spans(secrets.findings(read(spark, sf_dir, "documents").select("doc_id", "text")), secrets.BASE)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record, read back from the archives that hold it."""
    path = fresh_path(spark, "archives")
    warc.write(read(spark, sf_dir, "pages"), path)
    return warc.read_archives(spark, path).drop("payload")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by a network trained on the labels outside the held-out fold."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    net = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    out = toxicity.score(docs, net).withColumn("held_out", F.coalesce(toxicity.fold() == 0, F.lit(False)))
    return out.select("doc_id", "held_out", F.col("toxicity").alias("score"), (F.col("toxicity") >= toxicity.TOXIC).cast("int").alias("predicted"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of corpus_pipeline.py over documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_byte_bpe, op2_pii, op3_urls, op4_minhash, op5_packing, op6_ann, op7_embdedup, op8_secrets, op9_warc, op10_toxicity, pipeline)
}

_REACHED = """reached AS (SELECT id, id AS c FROM nodes UNION SELECT links.b, reached.c FROM reached JOIN links ON links.a = reached.id),
components AS (SELECT id, min(c) AS component_id FROM reached GROUP BY 1)"""

#: The other queries segment, tokenise, pack, train or search in ways that SQL cannot say; tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {
    "op4_minhash": rf"""WITH RECURSIVE words AS (
    SELECT doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
nodes AS (SELECT id, CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM words),
each AS (SELECT id, len(s) AS n, unnest(s) AS x FROM nodes),
shared AS (SELECT a.id AS a, b.id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k FROM each a JOIN each b ON a.x = b.x AND a.id <> b.id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared WHERE 100 * k >= 80 * (na + nb - k)), {_REACHED}
SELECT id AS doc_id, len(s)::BIGINT AS n_shingles, component_id, id = component_id AS kept FROM nodes JOIN components USING (id)""",
    "op7_embdedup": f"""WITH RECURSIVE nodes AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings),
links AS (SELECT a.id AS a, b.id AS b FROM nodes a JOIN nodes b ON a.label = b.label AND a.id <> b.id AND list_cosine_similarity(a.v, b.v) >= 0.98), {_REACHED}
SELECT id AS vec_id, (SELECT count(*) FROM links WHERE a = id) AS n_links, component_id, id = component_id AS kept FROM nodes JOIN components USING (id)""",
    "op9_warc": """WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
q AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY d) ELSE page_id END AS first FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
CASE WHEN first <> page_id THEN first END AS refers_to FROM q""",
}
