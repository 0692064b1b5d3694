"""What to compare, and how."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame

from paritas.functions.comparators import Equal
from paritas.functions.normalize import Rules
from paritas.functions.predicates import checked_filter

#: Column names that hold checksums of a row and are left out unless they are asked for.
DERIVED = {"checksum", "row_checksum", "record_checksum", "row_hash", "record_hash", "row_md5", "paritas_checksum", "paritas_row_hash"}


def _one_of(name: str, value: str, known: tuple[str, ...]) -> str:
    if value.lower() not in known:
        raise ValueError(f"{name} must be one of {', '.join(known)}, not {value!r}")
    return value.lower()


@dataclass(frozen=True)
class Value:
    """What one side gives for a mapped column: a column, an SQL expression or a literal."""

    column: str | None = None
    expression: str | None = None
    literal: Any = None
    is_literal: bool = False

    def __post_init__(self) -> None:
        given = (self.column is not None) + (self.expression is not None) + self.is_literal
        if given != 1:
            raise ValueError("a mapped value is exactly one of column, expression and literal")
        if self.expression is not None and any(x in self.expression for x in (";", "--", "/*")):
            raise ValueError(f"an expression holds a comment or several statements: {self.expression!r}")


@dataclass(frozen=True)
class Mapping:
    """A compared column under a name of its own; a key with key=True, carried but not compared with compare=False."""

    name: str
    source: Value
    target: Value
    key: bool = False
    compare: bool = True


@dataclass(frozen=True)
class Resource:
    """Where a side's rows are: kind table, sql, a file format, jdbc, or frame for a DataFrame at hand."""

    kind: str
    path: str = ""
    options: dict[str, str] = field(default_factory=dict)
    frame: DataFrame | None = None
    partition_columns: tuple[str, ...] = ()


@dataclass(frozen=True)
class Side:
    """One of the two relations. Keys and compared columns of both sides pair by position, under the source's names."""

    resource: Resource
    keys: tuple[str, ...] = ()
    columns: tuple[str, ...] | None = None
    exclude: tuple[str, ...] = ()
    filter: str | None = None
    update_column: str | None = None
    updated_from: Any = None
    updated_to: Any = None
    low: tuple[Any, ...] | None = None
    high: tuple[Any, ...] | None = None
    inclusive: bool = False
    rules: Rules = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.filter is not None:
            checked_filter(self.filter)
        if self.columns is not None and (both := set(self.columns) & set(self.keys)):
            raise ValueError(f"{', '.join(sorted(both))} cannot be both key and compared column")


@dataclass(frozen=True)
class Strategy:
    """How rows are compared. prefer lists strategies in order; fallback allows the later ones.

    buckets: digests by which a checksum comparison skips what is equal; 0: none, one pass over both sides; None: as many as
    suit the number of rows.
    """

    mode: str = "checksum"
    algorithm: str = "xor"
    local: str = "full"
    prefer: tuple[str, ...] = ()
    fallback: bool = True
    buckets: int | None = 0
    max_differences: int = 1_000_000
    validate_unique_keys: bool = False
    strict_nulls: bool = False
    equal: dict[str, Equal] = field(default_factory=dict)

    def __post_init__(self) -> None:
        object.__setattr__(self, "mode", _one_of("mode", self.mode, ("checksum", "join", "merge")))
        object.__setattr__(self, "algorithm", _one_of("algorithm", self.algorithm, ("concat", "xor")))
        object.__setattr__(self, "local", _one_of("local", self.local, ("full", "row-hash")))
        if (self.buckets is not None and self.buckets < 0) or self.max_differences < 0:
            raise ValueError("neither buckets nor max_differences may be negative")


@dataclass(frozen=True)
class Comparison:
    source: Side
    target: Side
    strategy: Strategy = field(default_factory=Strategy)
    mappings: tuple[Mapping, ...] = ()

    def __post_init__(self) -> None:
        if (self.source.filter is None) != (self.target.filter is None):
            raise ValueError("a filter is given for one side only")
        keys = [m.name for m in self.mappings if m.key]
        if self.mappings:
            if not keys:
                raise ValueError("no mapping is a key")
            if len({m.name.lower() for m in self.mappings}) < len(self.mappings):
                raise ValueError("two mappings have one name")
        elif not self.source.keys or len(self.source.keys) != len(self.target.keys):
            raise ValueError(f"{len(self.source.keys)} source keys, but {len(self.target.keys)} target keys")
