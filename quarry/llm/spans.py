"""Spans of regular expressions in texts, by DataFrame functions alone.

A pattern's matches and the gaps between them (split at the same pattern) give each match's place: code points, end exclusive.
Sums of lengths run within blocks and over blocks of BLOCK matches, so that a text with very many matches costs about their
number times BLOCK, not its square.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 128

SPAN = "array<struct<start:int,end:int,text:string>>"


def _total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0), lambda a, x: a + x)


def with_matches(df: DataFrame, text: str, patterns: dict[str, str], probes: dict[str, Column] | None = None) -> DataFrame:
    """For each name a column of that name: array<struct<start, end, text>> of its pattern's leftmost matches, in order.

    A pattern must match no empty text. Where a name's probe is false, its pattern is not tried; the probe must hold
    wherever the pattern matches. `text` must not be null.
    """
    t, probes, names = F.col(text), probes or {}, list(patterns)
    kept = df.columns

    def found(name: str) -> Column:
        m = F.regexp_extract_all(t, F.lit(patterns[name]), F.lit(0))
        return F.when(probes[name], m).otherwise(F.array().cast("array<string>")) if name in probes else m

    df = df.select(*kept, *(found(n).alias(n) for n in names))

    def gaps(name: str) -> Column:
        m = F.col(name)
        pairs = F.zip_with(m, F.slice(F.split(t, patterns[name], -1), F.lit(1), F.size(m)), lambda x, gap: F.struct(x.alias("text"), F.length(x).alias("n"), (F.length(x) + F.length(gap)).alias("step")))
        return F.when(F.size(m) > 0, pairs).otherwise(F.array().cast("array<struct<text:string,n:int,step:int>>")).alias(name)

    df = df.select(*kept, *(gaps(n) for n in names))

    def blocks(name: str) -> Column:
        m = F.col(name)
        count = F.ceil(F.size(m) / F.lit(BLOCK)).cast("int")
        sums = F.transform(F.sequence(F.lit(0), count - 1), lambda b: _total(F.transform(F.slice(m, b * BLOCK + 1, F.lit(BLOCK)), lambda x: x["step"])))
        return F.when(F.size(m) > BLOCK, sums).alias(f"{name}__sums")

    df = df.select(*kept, *names, *(blocks(n) for n in names))

    def places(name: str) -> Column:
        m, sums = F.col(name), F.col(f"{name}__sums")

        def place(x: Column, i: Column) -> Column:
            b = F.floor(i / F.lit(BLOCK)).cast("int")
            inside = _total(F.transform(F.slice(m, b * BLOCK + 1, i - b * BLOCK + 1), lambda y: y["step"]))
            end = inside + F.when(b > 0, _total(F.slice(sums, F.lit(1), F.greatest(b, F.lit(1))))).otherwise(0)
            return F.struct((end - x["n"]).alias("start"), end.alias("end"), x["text"].alias("text"))

        return F.transform(m, place).alias(name)

    return df.select(*kept, *(places(n) for n in names))


def as_text(spans: Column) -> Column:
    """kind:start:end of an array of structs, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)
