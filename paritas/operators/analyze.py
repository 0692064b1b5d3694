"""Patterns in differences, found by rules: drifted times, lost precision, encodings, nulls, truncation, missing windows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paritas.operators.diff import MISMATCH, TARGET_MISSING

#: Words in column names that tell times and amounts. Fixed values.
TIME_WORDS = ("time", "date", "ts", "created", "updated")
AMOUNT_WORDS = ("amount", "price", "rate", "value")
#: Least confidence, what each row adds to it, and the most it can be, by pattern. Fixed values.
CONFIDENCE = {
    "TIME_DRIFT": (0.5, 0.1, 0.9),
    "PRECISION_LOSS": (0.6, 0.05, 0.85),
    "ENCODING_ISSUE": (0.55, 0.05, 0.8),
    "NULL_HANDLING": (0.7, 0.05, 0.9),
    "TRUNCATION": (0.65, 0.05, 0.85),
}
#: Share of differences that must be missing in the target for TIME_WINDOW.
WINDOW_SHARE = 0.05
HINTS = {
    "TIME_DRIFT": "Align the time zones or the precision of both sides' times.",
    "PRECISION_LOSS": "Compare with a precision that both sides keep, or widen the narrower column.",
    "ENCODING_ISSUE": "Check the character sets of both sides and of the transfer.",
    "NULL_HANDLING": "Agree on null or empty text for missing values.",
    "TRUNCATION": "Widen the target's column to the source's length.",
    "TIME_WINDOW": "Check whether the last load into the target is complete.",
}


def _named(column: str, words: Sequence[str]) -> bool:
    return any(w in column.lower() for w in words)


def _pair(c: str) -> tuple[Column, Column]:
    return F.col(f"{c}_1").cast("string"), F.col(f"{c}_2").cast("string")


def _drift(c: str) -> Column:
    return F.lit(_named(c, TIME_WORDS))


def _precision(c: str) -> Column:
    a, b = (x.try_cast("double") for x in _pair(c))
    gap = F.abs(a - b)
    return F.coalesce((gap > 0) & (gap < 1), F.lit(False))


def _encoding(c: str) -> Column:
    a, b = _pair(c)
    return F.coalesce((a != b) & (F.length(a) != F.length(b)) & a.rlike(r"[^\x00-\x7F]"), F.lit(False))


def _nulls(c: str) -> Column:
    a, b = (F.coalesce(x, F.lit("")) == "" for x in _pair(c))
    return a != b


def _truncated(c: str) -> Column:
    a, b = _pair(c)
    return F.coalesce((b != "") & (F.length(b) < F.length(a)) & a.startswith(b), F.lit(False))


#: Patterns of mismatching rows: whether a column's pair of values shows it.
PATTERNS: dict[str, Callable[[str], Column]] = {"TIME_DRIFT": _drift, "PRECISION_LOSS": _precision, "ENCODING_ISSUE": _encoding, "NULL_HANDLING": _nulls, "TRUNCATION": _truncated}


def register(name: str, shows: Callable[[str], Column], confidence: tuple[float, float, float], hint: str) -> None:
    """Adds a pattern."""
    PATTERNS[name], CONFIDENCE[name], HINTS[name] = shows, confidence, hint


def _reported(name: str, c: str) -> bool:
    return name != "PRECISION_LOSS" or _named(c, AMOUNT_WORDS)


def analyze(diff: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A row for each pattern that the differences show, all from one pass of conditional counts.

    pattern, affected_rows, confidence, affected_columns (text, joined by commas), repair_hint.
    """
    mismatch = F.col("operation") == MISMATCH
    shown = {name: [shows(c) for c in columns] for name, shows in PATTERNS.items()}
    aggregates = [F.count(F.lit(1)).alias("total"), F.count_if(F.col("operation") == TARGET_MISSING).alias("missing")]
    for name, flags in shown.items():
        any_flag = F.exists(F.array(*flags), lambda x: x) if flags else F.lit(False)
        aggregates.append(F.count_if(mismatch & any_flag).alias(f"n_{name}"))
        aggregates += [F.count_if(mismatch & f).alias(f"n_{name}_{i}") for i, f in enumerate(flags)]
    one = diff.agg(*aggregates)
    rows = []
    for name in shown:
        least, step, most = CONFIDENCE[name]
        n = F.col(f"n_{name}")
        named = F.array_compact(F.array(*[F.when(F.col(f"n_{name}_{i}") > 0, F.lit(c)) for i, c in enumerate(columns) if _reported(name, c)] or [F.lit(None).cast("string")]))
        rows.append(F.struct(F.lit(name).alias("pattern"), n.alias("affected_rows"), F.least(F.lit(most), F.lit(least) + F.lit(step) * n).alias("confidence"), F.array_join(named, ",").alias("affected_columns"), F.lit(HINTS[name]).alias("repair_hint")))
    share = F.when(F.col("total") > 0, F.col("missing") / F.col("total")).otherwise(F.lit(0.0))
    n = F.when(share >= WINDOW_SHARE, F.col("missing")).otherwise(F.lit(0).cast("bigint"))
    rows.append(F.struct(F.lit("TIME_WINDOW").alias("pattern"), n.alias("affected_rows"), F.least(F.lit(0.8), F.lit(0.4) + share).alias("confidence"), F.lit("").alias("affected_columns"), F.lit(HINTS["TIME_WINDOW"]).alias("repair_hint")))
    return one.select(F.explode(F.array(*rows)).alias("p")).select("p.*").where("affected_rows > 0")


def summary(found: DataFrame, total: int) -> dict[str, object]:
    """Of at most a row for each pattern: mean confidence (0.5 without patterns, 1 without differences), hints and a sentence."""
    rows = found.orderBy(F.desc("confidence")).collect()
    confidence = 1.0 if total == 0 else sum(r["confidence"] for r in rows) / len(rows) if rows else 0.5
    text = "No differences." if total == 0 else f"{total} differences; " + (", ".join(f"{r['pattern']} in {r['affected_rows']} rows" for r in rows) if rows else "no known pattern") + "."
    return {"confidence": confidence, "hints": list(dict.fromkeys(r["repair_hint"] for r in rows)), "summary": text, "patterns": [r.asDict() for r in rows]}
