"""Small column expressions shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(num: str | Column, den: str | Column) -> Column:
    """num / den, null when den is zero or missing."""
    return F.try_divide(col(num).cast("double"), col(den).cast("double"))


def flag(cond: Column) -> Column:
    """1 where the condition holds, else 0; a null condition counts as 0."""
    return F.when(cond, F.lit(1)).otherwise(F.lit(0))


def zero(c: str | Column) -> Column:
    """Missing values as 0."""
    return F.coalesce(col(c), F.lit(0))


def sum0(c: str | Column) -> Column:
    """A sum that is 0, not null, when every input is missing."""
    return F.coalesce(F.sum(col(c)), F.lit(0))


def any_of(conds: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conds)
