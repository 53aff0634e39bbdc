"""Algebra of the key sets that predicates select; on one table it is the algebra of the predicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame


def intersect(*masks: Column) -> Column:
    return reduce(lambda a, b: a & b, masks)


def union(*masks: Column) -> Column:
    return reduce(lambda a, b: a | b, masks)


def difference(a: Column, b: Column) -> Column:
    return a & ~b


def keys(df: DataFrame, key: str, mask: Column) -> DataFrame:
    """The keys of the rows that a mask selects, to combine with those of other tables by intersect, union and exceptAll."""
    return df.where(mask).select(key)
