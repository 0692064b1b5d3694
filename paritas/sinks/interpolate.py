"""Output columns from templates such as "${operation}:${src.amount}"."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PLACE = re.compile(r"\$\{([^}]+)\}")


@dataclass(frozen=True)
class Output:
    """A column of an output: its name, template, type, and the value where the template gives an empty text."""

    name: str
    template: str
    type: str | None = None
    default: str | None = None


def diff_places(keys: Sequence[str], columns: Sequence[str], attributes: Mapping[str, str] | None = None, target_names: Mapping[str, str] | None = None) -> dict[str, Column]:
    """What placeholders mean in a row of differences."""
    lists = F.array_join("changed", ",")
    own = {v: k for k, v in (target_names or {}).items()}
    places = {"operation": F.col("operation"), "primaryKey": F.array_join(F.array(*[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys]), ","), "changedColumns": lists, "changedColumns1": lists, "changedColumns2": lists}
    for c in columns:
        places[f"src.{c}"] = F.col(f"{c}_1")
    for c in {*columns, *own}:
        if own.get(c, c) in columns:
            places[f"tgt.{c}"] = F.col(f"{own.get(c, c)}_2")
    for k in keys:
        places[f"src.{k}"] = F.when(F.col("operation") != "source_missing", F.col(k))
        places[f"tgt.{(target_names or {}).get(k, k)}"] = F.when(F.col("operation") != "target_missing", F.col(k))
    return places | {(k if k in _RUN else f"attr.{k}"): F.lit(v) for k, v in (attributes or {}).items()}


#: Placeholders that tell of the whole run.
_RUN = ("taskId", "sourceTable", "targetTable", "strategy", "algorithm", "timestamp")


def result_places(attributes: Mapping[str, str] | None = None) -> dict[str, Column]:
    """What placeholders mean in a row of statistics."""
    names = {"status": "status", "totalDifferences": "total_differences", "sourceMissingCount": "source_missing_count", "targetMissingCount": "target_missing_count", "mismatchCount": "mismatch_count", "sourceRowCount": "source_row_count", "targetRowCount": "target_row_count", "accuracyRate": "accuracy_rate"}
    every = F.to_json(F.struct(*[F.col(c).alias(k) for k, c in names.items()]))
    return {k: F.col(c) for k, c in names.items()} | {"statistics_json": every} | {(k if k in _RUN else f"attr.{k}"): F.lit(v) for k, v in (attributes or {}).items()}


def compiled(template: str, places: Mapping[str, Column], default: str | None = None) -> Column:
    """A template as a column: of a single placeholder with its own type, else text in which unknown places are empty."""
    whole = _PLACE.fullmatch(template)
    if whole and whole[1] in places:
        value = places[whole[1]]
        return value if default is None else F.coalesce(value.cast("string"), F.lit(default))
    parts, at = [], 0
    for m in _PLACE.finditer(template):
        if m.start() > at:
            parts.append(F.lit(template[at : m.start()]))
        parts.append(F.coalesce(places[m[1]].cast("string"), F.lit("")) if m[1] in places else F.lit(""))
        at = m.end()
    parts.append(F.lit(template[at:]))
    text = F.concat(*parts)
    return text if default is None else F.when(text == "", F.lit(default)).otherwise(text)


def column_name(name: str) -> str:
    """name with every character but letters, digits and underscores replaced."""
    return re.sub(r"[^a-zA-Z0-9_]", "_", name)


def column_names(names: Sequence[str]) -> list[str]:
    out = [column_name(n) for n in names]
    seen: dict[str, str] = {}
    for n, given in zip(out, names, strict=True):
        if n.lower() in seen:
            raise ValueError(f"columns {seen[n.lower()]!r} and {given!r} would both be {n}")
        seen[n.lower()] = given
    return out


def project(df: DataFrame, outputs: Sequence[Output], places: Mapping[str, Column], defaults: Mapping[str, Column] | None = None) -> DataFrame:
    """The outputs as columns; with defaults, these columns, replaced or followed by the outputs."""
    made = {n: compiled(o.template, places, o.default).cast(o.type) if o.type else compiled(o.template, places, o.default) for n, o in zip(column_names([o.name for o in outputs]), outputs, strict=True)}
    return df.select([c.alias(n) for n, c in ({**(defaults or {}), **made}).items()])
