"""Joins on keys of which a few may be in a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARE = 512


def with_values(rows: DataFrame, values: DataFrame, key: str, count: str, share: int = SHARE, how: str = "inner") -> DataFrame:
    """rows with the columns of their key's row in values, in which each key (also a null one) has one row and count, the
    number of rows that have it.

    Keys of more than one row in `share` are no more than `share` and are broadcast, so their rows stay where they are; all
    others are joined by a shuffle, in which no key has a larger part of the rows."""
    total = values.agg(F.sum(count)).first()[0] or 0
    told = values.select(F.col(key).alias("_key"), *(c for c in values.columns if c != key))
    often, seldom = told.where(F.col(count) * share > total), told.where(F.col(count) * share <= total)
    same = F.col(key).eqNullSafe(F.col("_key"))
    met = rows.join(F.broadcast(often), same).drop("_key")
    rest = rows.join(F.broadcast(often.select("_key")), same, "left_anti").join(seldom, same, how).drop("_key")
    return met.unionByName(rest)
