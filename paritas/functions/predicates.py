"""Row predicates: null-safe difference, key ranges in lexicographic order, seek pages, time windows, and checked filters."""

from __future__ import annotations

import re
from collections.abc import Sequence
from datetime import date, datetime
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def differs(a: Column, b: Column) -> Column:
    """True where a and b differ, nulls equal to each other only."""
    return ~a.eqNullSafe(b)


def any_differs(pairs: Sequence[tuple[Column, Column]]) -> Column:
    """True where any pair differs; false without pairs."""
    return reduce(or_, (differs(a, b) for a, b in pairs), F.lit(False))


def all_null(columns: Sequence[Column]) -> Column:
    return reduce(and_, (c.isNull() for c in columns), F.lit(True))


def _lexicographic(keys: Sequence[str], bound: Sequence[object], strict: bool, above: bool) -> Column:
    """keys after (above) or before bound in lexicographic order, expanded so that scans can use the first key."""
    if len(keys) != len(bound):
        raise ValueError(f"{len(keys)} keys but {len(bound)} values in a bound")
    found: Column | None = None
    for name, value in reversed(list(zip(keys, bound, strict=True))):
        key, at = F.col(name), F.lit(value)
        beyond = key > at if above else key < at
        if found is None:
            found = beyond if strict else (key >= at if above else key <= at)
        else:
            found = beyond | ((key == at) & found)
    if found is None:
        raise ValueError("a key range needs keys")
    return found


def key_range(keys: Sequence[str], low: Sequence[object] | None, high: Sequence[object] | None, inclusive: bool = False) -> Column:
    """low <= keys < high (<= high if inclusive), composite keys in lexicographic order; a bound of None is open."""
    parts = []
    if low is not None:
        parts.append(_lexicographic(keys, low, strict=False, above=True))
        if len(keys) > 1:  # the first key alone reaches the scan
            parts.append(F.col(keys[0]) >= F.lit(low[0]))
    if high is not None:
        parts.append(_lexicographic(keys, high, strict=not inclusive, above=False))
        if len(keys) > 1:
            parts.append(F.col(keys[0]) <= F.lit(high[0]))
    return reduce(and_, parts, F.lit(True))


def after_key(keys: Sequence[str], last: Sequence[object]) -> Column:
    """Keys strictly after last: the seek predicate of a page."""
    return _lexicographic(keys, last, strict=True, above=True)


def time_window(column: str, start: object | None, end: object | None) -> Column:
    """start <= column < end."""
    if start is not None and end is not None and not start < end:  # type: ignore[operator]
        raise ValueError(f"the window of {column} ends at {end}, not after its start {start}")
    parts = [F.col(column) >= F.lit(start)] if start is not None else []
    parts += [F.col(column) < F.lit(end)] if end is not None else []
    return reduce(and_, parts, F.lit(True))


def key_in(keys: Sequence[str], values: Sequence[Sequence[object]]) -> Column:
    """Keys among a short list of values; for long lists use operators.sets.lookup."""
    if len(keys) == 1:
        return F.col(keys[0]).isin([v[0] for v in values])
    return reduce(or_, (reduce(and_, (F.col(k) == F.lit(x) for k, x in zip(keys, v, strict=True))) for v in values), F.lit(False))


def literal(value: object) -> str:
    """value as a SQL literal."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, datetime):
        return f"TIMESTAMP '{value:%Y-%m-%d %H:%M:%S}'"
    if isinstance(value, date):
        return f"DATE '{value:%Y-%m-%d}'"
    if isinstance(value, int | float):
        return repr(value)
    return "'" + str(value).replace("'", "''") + "'"


#: Quotes around an identifier, by dialect.
QUOTES = {
    "spark": "``", "mysql": "``", "tidb": "``", "doris": "``", "starrocks": "``", "clickhouse": "``",
    "postgresql": '""', "oracle": '""', "presto": '""', "trino": '""', "sqlserver": "[]",
}


def quoted(name: str, dialect: str = "spark") -> str:
    left, right = QUOTES[dialect]
    return left + name.replace(right, right * 2) + right


_TOKEN = re.compile(r"\s+|'(?:[^']|'')*'|`[^`]+`|[A-Za-z_][A-Za-z0-9_.]*|\d+(?:\.\d+)?|<=>|<>|!=|<=|>=|[=<>(),+\-*/%]")
#: Words that a filter may have beside column names, and words that it may not.
ALLOWED = {"AND", "OR", "NOT", "IN", "IS", "NULL", "LIKE", "BETWEEN", "TRUE", "FALSE"}
BLOCKED = {
    "SELECT", "INSERT", "UPDATE", "DELETE", "DROP", "ALTER", "CREATE", "TRUNCATE", "MERGE", "GRANT", "REVOKE", "EXEC",
    "EXECUTE", "UNION", "FROM", "WHERE", "JOIN", "INTO", "CALL", "SET", "HAVING", "GROUP", "ORDER", "LIMIT", "OFFSET", "WITH",
}


def checked_filter(text: str) -> str:
    """text if it is a plain predicate over columns and literals: no statements, comments, subqueries or function calls."""
    at, words = 0, []
    if "--" in text or "/*" in text or ";" in text:
        raise ValueError(f"a filter holds a comment or several statements: {text!r}")
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"a filter holds {text[at:at + 10]!r}, which is not allowed: {text!r}")
        token = m.group()
        if not token.isspace():
            words.append(token)
        at = m.end()
    for i, token in enumerate(words):
        upper = token.upper()
        if upper in BLOCKED:
            raise ValueError(f"a filter may not use {token}: {text!r}")
        called = i + 1 < len(words) and words[i + 1] == "("
        if called and re.match(r"[A-Za-z_`]", token) and upper not in ALLOWED:
            raise ValueError(f"a filter may not call {token}(): {text!r}")
    if words.count("(") != words.count(")"):
        raise ValueError(f"a filter's parentheses do not match: {text!r}")
    if not words:
        raise ValueError("a filter is empty")
    return text
