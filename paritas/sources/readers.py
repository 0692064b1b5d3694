"""Readers of resources by kind, schemas, catalog facts, and the preparation of a side."""

from __future__ import annotations

import re
import warnings
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paritas.functions.predicates import key_range, literal, time_window
from paritas.spec import DERIVED, Comparison, Mapping, Resource, Side, Value

Reader = Callable[[SparkSession, Resource], DataFrame]


def _file(kind: str) -> Reader:
    return lambda spark, r: spark.read.format(kind).options(**r.options).load(r.path)


#: JDBC drivers of the databases that a resource may name as its kind.
JDBC_DRIVERS = {
    "mysql": "com.mysql.cj.jdbc.Driver", "tidb": "com.mysql.cj.jdbc.Driver", "doris": "com.mysql.cj.jdbc.Driver", "starrocks": "com.mysql.cj.jdbc.Driver",
    "postgresql": "org.postgresql.Driver", "sqlserver": "com.microsoft.sqlserver.jdbc.SQLServerDriver", "oracle": "oracle.jdbc.OracleDriver",
    "clickhouse": "com.clickhouse.jdbc.ClickHouseDriver", "presto": "com.facebook.presto.jdbc.PrestoDriver", "trino": "io.trino.jdbc.TrinoDriver",
}


def jdbc_options(kind: str, resource: Resource) -> dict[str, str]:
    """Options of Spark's JDBC source: a table, or a query that the database runs; parallel where bounds are given."""
    out = {"fetchsize": "1000"} | resource.options
    if kind in JDBC_DRIVERS:
        out.setdefault("driver", JDBC_DRIVERS[kind])
    if re.match(r"(?i)\s*(select|with)\b", resource.path):
        if "partitionColumn" in out:  # Spark takes partition bounds with dbtable only
            out["dbtable"] = f"({resource.path}) t"
        else:
            out["query"] = resource.path
    else:
        out["dbtable"] = resource.path
    if "partitionColumn" in out and not {"lowerBound", "upperBound", "numPartitions"} <= set(out):
        raise ValueError("a partitionColumn needs lowerBound, upperBound and numPartitions")
    return out


def _jdbc(kind: str) -> Reader:
    return lambda spark, r: spark.read.format("jdbc").options(**jdbc_options(kind, r)).load()


def _frame(spark: SparkSession, r: Resource) -> DataFrame:
    if r.frame is None:
        raise ValueError("a resource of kind frame has no DataFrame")
    return r.frame


#: Readers by kind; register() adds more.
READERS: dict[str, Reader] = {
    "table": lambda spark, r: spark.table(r.path),
    "sql": lambda spark, r: spark.sql(r.path),
    "frame": _frame,
    **{k: _file(k) for k in ("parquet", "orc", "csv", "json", "text")},
    **{k: _jdbc(k) for k in ("jdbc", *JDBC_DRIVERS)},
}


def register(kind: str, reader: Reader) -> None:
    """Adds a reader for a kind of resource, under a name that is not taken."""
    if kind in READERS:
        raise ValueError(f"there is a reader for {kind} already")
    READERS[kind] = reader


def read(spark: SparkSession, resource: Resource) -> DataFrame:
    kind = resource.kind.lower()
    if kind not in READERS:
        raise ValueError(f"no reader for {resource.kind!r}; there are {', '.join(sorted(READERS))}")
    return READERS[kind](spark, resource)


def schema(spark: SparkSession, resource: Resource) -> T.StructType:
    """The schema, from analysis alone."""
    return read(spark, resource).schema


@dataclass(frozen=True)
class TableFacts:
    exists: bool
    columns: tuple[tuple[str, str, bool], ...] = ()
    partition_columns: tuple[str, ...] = ()
    details: tuple[tuple[str, str], ...] = ()


def table_facts(spark: SparkSession, name: str) -> TableFacts:
    """What the catalog has of a table; the queries of other catalogs' information schemas in one call."""
    if not spark.catalog.tableExists(name):
        return TableFacts(False)
    fields = spark.table(name).schema.fields
    cols = spark.catalog.listColumns(name)
    details = [(r["col_name"], r["data_type"]) for r in spark.sql(f"DESCRIBE TABLE EXTENDED {name}").collect()]
    return TableFacts(True, tuple((f.name, f.dataType.simpleString(), f.nullable) for f in fields), tuple(c.name for c in cols if c.isPartition), tuple(details))


def relations(spark: SparkSession, database: str | None = None, views: bool | None = None) -> list[str]:
    """Names of the catalog's tables and views in a database; only views, or none, where that is asked for."""
    found = spark.catalog.listTables(database)
    return sorted(t.name for t in found if views is None or views == (t.tableType in ("VIEW", "TEMPORARY")))


def databases(spark: SparkSession) -> list[str]:
    return sorted(d.name for d in spark.catalog.listDatabases())


#: Queries of information schemas, for JDBC resources of kind query. The standard's view and column names.
INFORMATION = {
    "columns": "SELECT column_name, data_type, is_nullable FROM information_schema.columns WHERE table_schema = {schema} AND table_name = {table} ORDER BY ordinal_position",
    "primary_key": "SELECT k.column_name FROM information_schema.table_constraints c JOIN information_schema.key_column_usage k ON k.constraint_name = c.constraint_name AND k.table_schema = c.table_schema AND k.table_name = c.table_name WHERE c.constraint_type = 'PRIMARY KEY' AND c.table_schema = {schema} AND c.table_name = {table} ORDER BY k.ordinal_position",
    "foreign_keys": "SELECT k.constraint_name, k.column_name FROM information_schema.table_constraints c JOIN information_schema.key_column_usage k ON k.constraint_name = c.constraint_name AND k.table_schema = c.table_schema AND k.table_name = c.table_name WHERE c.constraint_type = 'FOREIGN KEY' AND c.table_schema = {schema} AND c.table_name = {table}",
    "tables": "SELECT table_name FROM information_schema.tables WHERE table_schema = {schema} AND table_type = 'BASE TABLE' ORDER BY table_name",
    "views": "SELECT table_name FROM information_schema.views WHERE table_schema = {schema} ORDER BY table_name",
    "schemas": "SELECT schema_name FROM information_schema.schemata ORDER BY schema_name",
}


def information_sql(what: str, schema_name: str = "", table: str = "") -> str:
    """The query of another database's information schema that tells what of a schema or table."""
    if what not in INFORMATION:
        raise ValueError(f"no metadata {what!r}; there are {', '.join(INFORMATION)}")
    return INFORMATION[what].format(schema=literal(schema_name), table=literal(table))


def analyze_table(spark: SparkSession, name: str, columns: tuple[str, ...] = ()) -> None:
    """Collects statistics for the optimizer."""
    spark.sql(f"ANALYZE TABLE {name} COMPUTE STATISTICS" + (f" FOR COLUMNS {', '.join(columns)}" if columns else ""))


def require_partition_filter(side: Side) -> None:
    """Raises if a side of a partitioned table has no filter that names every partition column."""
    named = {w.lower() for w in re.findall(r"[A-Za-z_][A-Za-z0-9_]*", re.sub(r"'(?:[^']|'')*'", "", side.filter or ""))}
    if missing := [c for c in side.resource.partition_columns if c.lower() not in named]:
        raise ValueError(f"the filter of {side.resource.path or 'a side'} must name the partition columns {', '.join(missing)}")


# -- sides ----------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Prepared:
    """Both sides filtered and projected to the source's names, with the target's own names for output."""

    source: DataFrame
    target: DataFrame
    keys: tuple[str, ...]
    columns: tuple[str, ...]
    target_names: dict[str, str]


def compared_columns(frame: DataFrame, side: Side) -> list[str]:
    """The side's columns: the named ones, else all but keys and derived checksums; never the excluded ones."""
    out = {c.lower() for c in side.exclude}
    if side.columns is not None:
        return [c for c in side.columns if c.lower() not in out]
    keys = {k.lower() for k in side.keys}
    return [c for c in frame.columns if c.lower() not in out | keys | DERIVED]


def restricted(frame: DataFrame, side: Side) -> DataFrame:
    """The side's rows: filter, key range and update window, all of which reach the scan."""
    if side.filter:
        frame = frame.where(F.expr(side.filter))
    if side.low is not None or side.high is not None:
        frame = frame.where(key_range(side.keys, side.low, side.high, side.inclusive))
    if side.update_column:
        frame = frame.where(time_window(side.update_column, side.updated_from, side.updated_to))
    return frame


def _value(v: Value):
    return F.col(v.column) if v.column is not None else F.expr(v.expression) if v.expression is not None else F.lit(v.literal)


def mapped(frame: DataFrame, mappings: tuple[Mapping, ...], source: bool) -> DataFrame:
    return frame.select([_value(m.source if source else m.target).alias(m.name) for m in mappings])


def prepare(spark: SparkSession, comparison: Comparison) -> Prepared:
    sides = []
    for side in (comparison.source, comparison.target):
        if side.resource.partition_columns:
            require_partition_filter(side)
        sides.append(restricted(read(spark, side.resource), side))
    if comparison.mappings:
        keys = tuple(m.name for m in comparison.mappings if m.key)
        columns = tuple(m.name for m in comparison.mappings if m.compare and not m.key)
        a, b = (mapped(f, comparison.mappings, first) for f, first in zip(sides, (True, False), strict=True))
        return Prepared(a, b, keys, columns, {c: c for c in keys + columns})
    ours, theirs = (compared_columns(f, s) for f, s in zip(sides, (comparison.source, comparison.target), strict=True))
    if len(ours) != len(theirs):
        warnings.warn(f"{len(ours)} source columns against {len(theirs)} target columns: the first {min(len(ours), len(theirs))} are compared", stacklevel=2)
    pairs = list(zip((*comparison.source.keys, *ours), (*comparison.target.keys, *theirs), strict=False))
    n = len(comparison.source.keys)
    names = [a for a, _ in pairs]
    a = sides[0].select(*names)
    b = sides[1].select([F.col(theirs_).alias(ours_) for ours_, theirs_ in pairs])
    return Prepared(a, b, tuple(names[:n]), tuple(names[n:]), dict(pairs))


def probe(spark: SparkSession, comparison: Comparison) -> tuple[int, int]:
    """The rows of both sides, without a comparison."""
    return tuple(restricted(read(spark, s.resource), s).count() for s in (comparison.source, comparison.target))  # type: ignore[return-value]


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
