"""Numeric column helpers. Money stays DECIMAL until a ratio is taken."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col_of(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def rounded(value: Column, digits: int | None) -> Column:
    return value if digits is None else F.round(value, digits)


def ratio(top: Column | str, bottom: Column | str, digits: int | None = None) -> Column:
    """``top / bottom`` in double, NULL where the bottom is zero (ANSI division would fail)."""
    return rounded(F.try_divide(col_of(top).cast("double"), col_of(bottom).cast("double")), digits)


def percent(top: Column | str, bottom: Column | str, digits: int | None = None) -> Column:
    return rounded(F.try_divide(col_of(top).cast("double") * 100, col_of(bottom).cast("double")), digits)


def mean(value: Column | str, digits: int | None = None) -> Column:
    """Average of an exact type: the sum is exact, so the result does not depend on task order."""
    c = col_of(value)
    return ratio(F.sum(c), F.count(c), digits)


def share(condition: Column, digits: int | None = None) -> Column:
    """Share of rows for which the condition holds; NULL counts as not holding."""
    return ratio(F.count_if(condition), F.count(F.lit(1)), digits)


def sum_if(condition: Column, value: Column | str) -> Column:
    return F.coalesce(F.sum(F.when(condition, col_of(value))), F.lit(0))


def money(value: Column | str) -> Column:
    """A DOUBLE amount as exact decimal, so that sums are reproducible on any cluster."""
    return col_of(value).cast("decimal(18,4)")
