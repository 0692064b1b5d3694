"""Column types of other databases as Spark types, and back as DDL."""

from __future__ import annotations

import re

from pyspark.sql import types as T

#: Names that databases give to types, by the Spark type that holds their values. Fixed values.
NATIVE = {
    "byte": ("tinyint", "int1"),
    "short": ("smallint", "int2", "year", "smallserial"),
    "int": ("int", "integer", "int4", "mediumint", "serial"),
    "long": ("bigint", "int8", "bigserial", "largeint"),
    "float": ("float4", "real", "binary_float"),
    "double": ("double", "double precision", "float8", "float", "binary_double"),
    "decimal": ("decimal", "numeric", "number", "dec", "money"),
    "boolean": ("boolean", "bool", "bit"),
    "date": ("date",),
    "timestamp_ntz": ("datetime", "datetime2", "timestamp without time zone", "smalldatetime"),
    "timestamp": ("timestamp", "timestamptz", "timestamp with time zone", "datetimeoffset"),
    "binary": ("binary", "varbinary", "blob", "tinyblob", "mediumblob", "longblob", "bytea", "raw", "image"),
    "string": ("char", "varchar", "varchar2", "nvarchar", "nchar", "character varying", "character", "text", "tinytext", "mediumtext", "longtext", "clob", "string", "enum", "set", "json", "jsonb", "uuid", "xml", "inet", "time", "time without time zone", "time with time zone"),
}
_NAMES = {n: kind for kind, names in NATIVE.items() for n in names}
_PLAIN: dict[str, T.DataType] = {
    "byte": T.ByteType(), "short": T.ShortType(), "int": T.IntegerType(), "long": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(), "boolean": T.BooleanType(),
    "date": T.DateType(), "timestamp_ntz": T.TimestampNTZType(), "timestamp": T.TimestampType(), "binary": T.BinaryType(), "string": T.StringType(),
}
#: Names of Spark's types in other databases' DDL, where these differ from the first. Fixed values.
DDL = {
    "default": {"byte": "SMALLINT", "short": "SMALLINT", "int": "INTEGER", "long": "BIGINT", "float": "REAL", "double": "DOUBLE PRECISION", "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP", "binary": "BLOB", "string": "TEXT", "decimal": "DECIMAL"},
    "mysql": {"byte": "TINYINT", "float": "FLOAT", "double": "DOUBLE", "timestamp_ntz": "DATETIME", "binary": "LONGBLOB"},
    "postgresql": {"binary": "BYTEA", "timestamp": "TIMESTAMP WITH TIME ZONE", "decimal": "NUMERIC"},
    "oracle": {"long": "NUMBER(19)", "double": "BINARY_DOUBLE", "float": "BINARY_FLOAT", "boolean": "NUMBER(1)", "string": "CLOB", "decimal": "NUMBER"},
    "sqlserver": {"byte": "SMALLINT", "double": "FLOAT", "boolean": "BIT", "timestamp_ntz": "DATETIME2", "timestamp": "DATETIMEOFFSET", "binary": "VARBINARY(MAX)", "string": "NVARCHAR(MAX)"},
    "clickhouse": {"byte": "Int8", "short": "Int16", "int": "Int32", "long": "Int64", "float": "Float32", "double": "Float64", "boolean": "Bool", "date": "Date", "timestamp_ntz": "DateTime64(6)", "timestamp": "DateTime64(6)", "binary": "String", "string": "String", "decimal": "Decimal"},
}
for _same, _as in (("tidb", "mysql"), ("doris", "mysql"), ("starrocks", "mysql")):
    DDL[_same] = DDL[_as] | ({"string": "STRING"} if _same != "tidb" else {})
DDL["presto"] = DDL["trino"] = {"byte": "TINYINT", "double": "DOUBLE", "binary": "VARBINARY", "string": "VARCHAR"}


def from_native(text: str) -> T.DataType:
    """The Spark type of a native one such as varchar(20), decimal(10,2), bigint unsigned or int[]; strings for unknown names."""
    name = re.sub(r"\s+", " ", text.strip().lower())
    if name.endswith("[]"):
        return T.ArrayType(from_native(name[:-2]))
    unsigned = " unsigned" in name
    name = name.replace(" unsigned", "").replace(" zerofill", "")
    m = re.fullmatch(r"([a-z0-9_ ]+?)\s*(?:\(([^)]*)\))?((?: with(?:out)? time zone| varying)?)", name)
    if not m:
        return T.StringType()
    base, numbers = (m[1] + m[3]).strip(), [int(x) for x in re.findall(r"\d+", m[2] or "")]
    kind = _NAMES.get(base, "string")
    if base == "tinyint" and numbers == [1]:
        return T.BooleanType()
    if base == "bit" and numbers and numbers[0] > 1:
        return T.BinaryType()
    if kind == "decimal":
        precision = min(numbers[0], 38) if numbers else 38
        scale = min(numbers[1] if len(numbers) > 1 else 0 if numbers else 18, precision)
        return T.DecimalType(precision, scale)
    if unsigned and kind in ("byte", "short", "int", "long"):
        return {"byte": T.ShortType(), "short": T.IntegerType(), "int": T.LongType(), "long": T.DecimalType(20, 0)}[kind]
    return _PLAIN[kind]


def to_native(dtype: T.DataType, dialect: str = "default") -> str:
    """The name of a Spark type in a database's DDL; nested types are texts, as JSON."""
    names = DDL["default"] | DDL.get(dialect, {})
    if isinstance(dtype, T.DecimalType):
        return f"{names['decimal']}({dtype.precision},{dtype.scale})"
    for kind, plain in _PLAIN.items():
        if type(dtype) is type(plain):
            return names[kind]
    return names["string"]


def create_table(name: str, schema: T.StructType, dialect: str = "default") -> str:
    """CREATE TABLE IF NOT EXISTS for a schema."""
    from paritas.functions.predicates import quoted

    quotes = "spark" if dialect == "default" else dialect
    columns = ", ".join(f"{quoted(f.name, quotes)} {to_native(f.dataType, dialect)}{'' if f.nullable else ' NOT NULL'}" for f in schema)
    return f"CREATE TABLE IF NOT EXISTS {name} ({columns})"


