"""Statements, or rows, that make one side like the other."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paritas.functions.predicates import quoted
from paritas.operators.diff import MISMATCH, SOURCE_MISSING, TARGET_MISSING


#: Dialects in whose string literals a backslash escapes what follows it.
BACKSLASH = {"spark", "mysql", "tidb", "doris", "starrocks", "clickhouse"}


def sql_literal(c: Column, dtype: T.DataType, dialect: str = "spark") -> Column:
    """The values of a column as SQL literals of a dialect; NaN and infinities as casts of their text."""
    if isinstance(dtype, T.FloatType | T.DoubleType):
        odd = F.isnan(c) | (F.abs(c) == float("inf"))
        text = F.when(odd, F.concat(F.lit("CAST('"), c.cast("string"), F.lit("' AS DOUBLE)"))).otherwise(c.cast("string"))
    elif isinstance(dtype, T.NumericType):
        text = c.cast("string")
    elif isinstance(dtype, T.BooleanType):
        text = F.upper(c.cast("string"))
    elif isinstance(dtype, T.BinaryType):
        text = F.concat(F.lit("X'"), F.hex(c), F.lit("'"))
    else:
        inner = c.cast("string")
        if dialect in BACKSLASH:
            inner = F.replace(inner, F.lit("\\"), F.lit("\\\\"))
        text = F.concat(F.lit("'"), F.replace(inner, F.lit("'"), F.lit("''")), F.lit("'"))
    return F.coalesce(text, F.lit("NULL"))


def repair_sql(diff: DataFrame, keys: Sequence[str], columns: Sequence[str], table: str, fix: str = "target", names: dict[str, str] | None = None, dialect: str = "spark") -> DataFrame:
    """(operation, keys, statement): an UPDATE, INSERT or DELETE of table for each difference, found by all key columns.

    Rows of a mismatch are updated in their changed columns. names gives the table's column names where they differ.
    """
    if fix not in ("source", "target"):
        raise ValueError(f"fix must be source or target, not {fix!r}")
    types, own = {f.name: f.dataType for f in diff.schema}, names or {}
    column = {c: quoted(own.get(c, c), dialect) for c in (*keys, *columns)}
    side = 1 if fix == "target" else 2  # whose values are right
    value = {c: sql_literal(F.col(f"{c}_{side}"), types[f"{c}_{side}"], dialect) for c in columns} | {k: sql_literal(F.col(k), types[k], dialect) for k in keys}
    where = F.concat_ws(" AND ", *[F.when(F.col(k).isNull(), F.lit(f"{column[k]} IS NULL")).otherwise(F.concat(F.lit(f"{column[k]} = "), value[k])) for k in keys])
    sets = F.concat_ws(", ", *[F.when(F.array_contains("changed", c), F.concat(F.lit(f"{column[c]} = "), value[c])) for c in columns])
    insert = F.concat(F.lit(f"INSERT INTO {table} ({', '.join(column.values())}) VALUES ("), F.concat_ws(", ", *[value[c] for c in column]), F.lit(")"))
    update = F.concat(F.lit(f"UPDATE {table} SET "), sets, F.lit(" WHERE "), where)
    delete = F.concat(F.lit(f"DELETE FROM {table} WHERE "), where)
    lacking = TARGET_MISSING if fix == "target" else SOURCE_MISSING
    statement = F.when(F.col("operation") == MISMATCH, update).when(F.col("operation") == lacking, insert).otherwise(delete)
    return diff.select("operation", *keys, statement.alias("statement"))


def repaired(target: DataFrame, diff: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """target with the differences of a join diff with unique keys applied to it, so that it equals the source: a merge as a query."""
    touched = diff.select(*keys)
    kept = target.select(*keys, *columns).join(touched, list(keys), "left_anti")
    right = diff.where(F.col("operation") != SOURCE_MISSING).select(*keys, *[F.col(f"{c}_1").alias(c) for c in columns])
    return kept.unionByName(right)
