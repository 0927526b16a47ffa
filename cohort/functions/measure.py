"""Differences, parts and simple measures."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .recode import ColumnOrName, as_column


def day_gap(later: ColumnOrName, earlier: ColumnOrName) -> Column:
    """Days from ``earlier`` to ``later``."""
    return F.datediff(as_column(later), as_column(earlier))


def year_gap(later: ColumnOrName, earlier: ColumnOrName) -> Column:
    """Difference of the calendar years."""
    return F.year(as_column(later)) - F.year(as_column(earlier))


def month_day(c: ColumnOrName) -> Column:
    return F.date_format(as_column(c), "MM-dd")


def abs_difference(a: ColumnOrName, b: ColumnOrName) -> Column:
    return F.abs(as_column(a) - as_column(b))


def first_present(*cs: ColumnOrName) -> Column:
    return F.coalesce(*[as_column(c) for c in cs])


def joined_text(*cs: ColumnOrName, sep: str = " ") -> Column:
    """Concatenate with a separator; any null makes the result null."""
    parts: list[Column] = []
    for c in cs:
        parts += [F.lit(sep), as_column(c)]
    return F.concat(*parts[1:])


def harmonic_mean(c: ColumnOrName) -> Column:
    """Aggregate: count / sum of reciprocals. Zeros are left out."""
    nonzero = F.nullif(as_column(c).cast("double"), F.lit(0.0))
    return F.count(nonzero) / F.nullif(F.sum(F.lit(1.0) / nonzero), F.lit(0.0))
