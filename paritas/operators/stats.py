"""Statistics of a comparison, and orders, selections and merges of differences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paritas.operators.diff import MISMATCH, SOURCE_MISSING, TARGET_MISSING


def _derived(df: DataFrame) -> DataFrame:
    src, tgt = F.col("source_row_count"), F.col("target_row_count")
    total = F.col("source_missing_count") + F.col("target_missing_count") + F.col("mismatch_count")
    rows = F.greatest(src, tgt)
    return df.select(
        "source_row_count", "target_row_count", "source_missing_count", "target_missing_count", "mismatch_count",
        total.alias("total_differences"),
        (F.least(src, tgt) - F.col("mismatch_count")).alias("unchanged_count"),
        F.when(rows > 0, total / rows).otherwise(F.lit(0.0)).alias("difference_percentage"),
        F.when(src > 0, F.round((src - total) * 100.0 / src, 2)).otherwise(F.lit(0.0)).cast("double").alias("accuracy_rate"),
        F.when(total > 0, F.lit("DIFF")).otherwise(F.lit("EQUAL")).alias("status"),
    )


def statistics(diff: DataFrame, source: DataFrame, target: DataFrame) -> DataFrame:
    """One row: rows of both sides, differences by operation, their share of the larger side, accuracy and status."""
    found = diff.agg(*[F.count_if(F.col("operation") == op).alias(f"{op}_count") for op in (SOURCE_MISSING, TARGET_MISSING, MISMATCH)])
    s, t = source.agg(F.count(F.lit(1)).alias("source_row_count")), target.agg(F.count(F.lit(1)).alias("target_row_count"))
    one = F.lit(1).alias("one")  # three rows of one each
    rows = s.select("*", one).join(t.select("*", one), "one").join(found.select("*", one), "one")
    return _derived(rows.drop("one"))


def merged(stats: DataFrame) -> DataFrame:
    """Statistics of parts of one comparison as one row: the larger row counts, and the sums of differences."""
    made = stats.agg(*[F.max(f"{s}_row_count").alias(f"{s}_row_count") for s in ("source", "target")], *[F.sum(f"{op}_count").alias(f"{op}_count") for op in (SOURCE_MISSING, TARGET_MISSING, MISMATCH)])
    return _derived(made)


def by_operation(diff: DataFrame) -> DataFrame:
    return diff.groupBy("operation").agg(F.count(F.lit(1)).alias("differences"))


def by_column(diff: DataFrame) -> DataFrame:
    """How many mismatches changed each column."""
    return diff.where(F.col("operation") == MISMATCH).select(F.explode("changed").alias("column")).groupBy("column").agg(F.count(F.lit(1)).alias("differences"))


def of_operation(diff: DataFrame, operation: str) -> DataFrame:
    return diff.where(F.col("operation") == operation)


def natural_order(keys: Sequence[str]) -> list[Column]:
    """An order by keys in which text that holds numbers sorts as these, before other text."""
    out: list[Column] = []
    for k in keys:
        number = F.col(k).cast("string").try_cast("double")
        out += [number.asc_nulls_last(), F.col(k).cast("string").asc_nulls_first()]
    return out


def ordered(diff: DataFrame, keys: Sequence[str]) -> DataFrame:
    return diff.orderBy(*natural_order(keys), "operation")


def top(diff: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    return ordered(diff, keys).limit(n)
