"""Yes/no flags, labels and scores."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, functions as F

from .recode import ColumnOrName, as_column

YES, NO = "YES", "NO"


def has_value(c: ColumnOrName) -> Column:
    return as_column(c).isNotNull()


def presence_flag(c: ColumnOrName) -> Column:
    return F.when(as_column(c).isNull(), NO).otherwise(YES)


def positive_flag(c: ColumnOrName, negative: str, case_insensitive: bool = False) -> Column:
    """NO for the negative value and for null, else YES."""
    value = F.coalesce(as_column(c), F.lit(negative))
    if case_insensitive:
        value, negative = F.lower(value), negative.lower()
    return F.when(value == negative, NO).otherwise(YES)


def changed_flag(before: ColumnOrName, after: ColumnOrName) -> Column:
    """YES when both are known and differ."""
    return F.when(as_column(before) != as_column(after), YES).otherwise(NO)


def label(c: ColumnOrName, yes_values: Iterable[str]) -> Column:
    """YES for the listed values, NO for everything else, null included."""
    return F.when(as_column(c).isin(*yes_values), YES).otherwise(NO)


def score(rules: Sequence[tuple[Column, int]]) -> Column:
    """Sum of the weights whose condition holds."""
    return reduce(add, [F.when(test, weight).otherwise(0) for test, weight in rules])
