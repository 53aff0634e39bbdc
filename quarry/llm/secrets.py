"""Secret scans over an incremental ledger of blobs. DataFrame functions only.

Each version of a path is named by the SHA-256 of its text. A ledger holds, for each blob and version of the rules, what was
found; a scan looks only at pairs that it lacks, and what it holds is joined back to every path. Copies are scanned once.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import fresh_path, hadoop_fs, named
from quarry.llm.spans import with_matches

BASE = ["assign", "access", "hex"]
KINDS = [*BASE, "pem", "github", "slack", "jwt"]
PATTERNS = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""",
    "access": r"AKIA[A-Z0-9]{16,}+",
    "hex": r"(?<![0-9a-f])[0-9a-f]{24,}+",
    "pem": r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----",
    "github": r"(?<![A-Za-z0-9_])gh[pousr]_[A-Za-z0-9]{36,}+",
    "slack": r"(?<![A-Za-z0-9])xox[abprs]-[A-Za-z0-9-]{10,}+",
    "jwt": r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+",
}
#: What stands before the value of an assignment, and the value's least length.
BEFORE_VALUE, LEAST = r"""\A(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", 6
RULES = hashlib.sha256(repr((sorted(PATTERNS.items()), BEFORE_VALUE, LEAST)).encode()).hexdigest()[:16]

FINDINGS = "blob string, rules string, spans array<struct<kind:string,start:int,end:int>>"


def scan(blobs: DataFrame) -> DataFrame:
    """blob, rules, spans by start, then kind as listed, from blob and text; null texts count as empty."""
    df = blobs.select("blob", F.coalesce("text", F.lit("")).alias("t"))
    has = lambda x: F.instr("t", x) > 0
    df = with_matches(df, "t", PATTERNS, {"access": has("AKIA"), "pem": has("-----BEGIN"), "github": has("gh"), "slack": has("xox"), "jwt": has("eyJ"), "assign": has(":") | has("=")})

    def kind(k: str) -> Column:
        some = F.col(k)
        if k == "assign":
            some = F.filter(some, lambda s: F.length(F.regexp_replace(s["text"], BEFORE_VALUE, "")) >= LEAST)
        return F.transform(some, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(k)).alias("at"), s["end"].alias("end")))

    ordered = F.array_sort(F.concat(*(kind(k) for k in KINDS)))
    names = F.array(*map(F.lit, KINDS))
    spans = F.transform(ordered, lambda s: F.struct(F.element_at(names, s["at"] + 1).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return df.select("blob", F.lit(RULES).alias("rules"), spans.alias("spans"))


def ledger(df: DataFrame, path: str) -> DataFrame:
    """What a ledger holds; a ledger that is not there yet is empty."""
    fs, p = hadoop_fs(df.sparkSession, path)
    if not fs.exists(p):
        return df.sparkSession.createDataFrame([], FINDINGS)
    return df.sparkSession.read.schema(FINDINGS).parquet(path)


def blob_of(text: str | Column) -> Column:
    t = F.col(text) if isinstance(text, str) else text
    return F.sha2(F.coalesce(t, F.lit("")).cast("binary"), 256)


def update(versions: DataFrame, path: str) -> DataFrame:
    """Scan the blobs of `versions` (text) that the ledger at `path` lacks under the present rules; returns the ledger.

    One row for each blob goes through the exchange: copies meet in the tasks that read them, so a text that a third of all
    rows share is no hot key.
    """
    known = ledger(versions, path).where(F.col("rules") == RULES).select("blob")
    new = versions.select(blob_of("text").alias("blob"), "text").groupBy("blob").agg(F.first("text").alias("text")).join(known, "blob", "left_anti")
    scan(new).write.mode("append").parquet(path)
    return ledger(versions, path)


def findings(versions: DataFrame, path: str | None = None) -> DataFrame:
    """The columns of `versions` but for text (and any named spans), and `spans`: its findings in text.

    Every row stays: repeated rows, null ids, null texts (as empty ones) and rows without findings, whose spans are empty.
    Blobs with findings are joined to all their rows; a hot blob's rows are split by SALTS.
    """
    held = update(versions, path or fresh_path(versions.sparkSession, "ledger"))
    some = held.where((F.col("rules") == RULES) & (F.size("spans") > 0)).select("blob", "spans").dropDuplicates(["blob"])
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    some = some.select(F.col("blob").alias("__blob"), F.col("spans").alias("__spans"), salts.alias("__salt"))
    kept = [named(c) for c in versions.columns if c.lower() not in ("spans", "text")]
    rows = versions.select(*kept, blob_of("text").alias("__own"), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int").alias("__part"))
    out = rows.join(some, (rows["__own"] == some["__blob"]) & (rows["__part"] == some["__salt"]), "left")
    return out.select(*kept, F.coalesce("__spans", F.array().cast("array<struct<kind:string,start:int,end:int>>")).alias("spans"))


#: Parts into which the rows of each blob are dealt.
SALTS = 16
