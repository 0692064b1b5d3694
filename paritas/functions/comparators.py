"""Looser equality for single columns, used only where a comparison asks for it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Equal = Callable[[Column, Column], Column]


def exact(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def within(tolerance: float = 1e-6) -> Equal:
    """Numbers whose difference is at most tolerance of the larger size, of 1 at least."""

    def equal(a: Column, b: Column) -> Column:
        x, y = a.cast("double"), b.cast("double")
        near = F.abs(x - y) / F.greatest(F.abs(x), F.abs(y), F.lit(1.0)) <= tolerance
        return F.coalesce(near, a.isNull() & b.isNull())

    return equal


def hours_apart(hours: int = 8) -> Equal:
    """Moments that are equal or exactly so many hours apart, as after a lost time zone."""

    def equal(a: Column, b: Column) -> Column:
        seconds = F.abs(F.unix_timestamp(a.cast("timestamp")) - F.unix_timestamp(b.cast("timestamp")))
        return a.eqNullSafe(b) | F.coalesce(seconds == hours * 3600, F.lit(False))

    return equal


def trimmed(a: Column, b: Column) -> Column:
    return F.trim(a).eqNullSafe(F.trim(b))


def year_of_date(a: Column, b: Column) -> Column:
    """A date against a year as a number."""
    return F.coalesce(F.year(a) == b.cast("int"), a.isNull() & b.isNull())
