"""Constraints as sets: each probe gives the rows that break one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def duplicates(df: DataFrame, column: str) -> DataFrame:
    """Values that several rows share, and how often."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def nulls(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(f"`{column}`").isNull())


def failing(df: DataFrame, check: str) -> DataFrame:
    """Rows for which a SQL predicate is false; an unknown passes."""
    return df.where(~F.coalesce(F.expr(check), F.lit(True)))
