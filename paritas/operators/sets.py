"""Set operations on keys, lookups, and plain outer joins of two relations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def only_in(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys of a that b has not."""
    return a.select(*keys).join(b.select(*keys), list(keys), "left_anti")


def in_both(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys of a that b has too."""
    return a.select(*keys).join(b.select(*keys), list(keys), "left_semi")


def lookup(df: DataFrame, wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of df with a key among wanted; the planner broadcasts wanted where its size allows."""
    return df.join(wanted.select(*keys).distinct(), list(keys), "left_semi")


def outer(a: DataFrame, b: DataFrame, keys: Sequence[str], how: str = "full") -> DataFrame:
    """All columns of a as `<name>_1` and of b as `<name>_2`, joined on equal keys; how is full, left or right."""
    if how not in ("full", "left", "right"):
        raise ValueError(f"how must be full, left or right, not {how!r}")
    left, right = a.select([F.col(c).alias(f"{c}_1") for c in a.columns]), b.select([F.col(c).alias(f"{c}_2") for c in b.columns])
    return left.join(right, [F.col(f"{k}_1") == F.col(f"{k}_2") for k in keys], how)


def union_all(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b)


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()
