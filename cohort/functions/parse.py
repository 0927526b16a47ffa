"""Lenient parsing: bad text becomes null instead of failing the job (ANSI mode is on)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .recode import ColumnOrName, as_column


def parse_date(c: ColumnOrName) -> Column:
    """Text to date, ``2013-04-09`` or ``2013/04/09``."""
    c = as_column(c).cast("string")
    return F.coalesce(F.try_to_date(c, "yyyy-MM-dd"), F.try_to_date(c, "yyyy/MM/dd"))


def lenient_int(c: ColumnOrName) -> Column:
    """Leading digits of a text as int; null when it does not start with a digit."""
    return F.regexp_extract(as_column(c), r"^\s*(\d+)", 1).try_cast("int")


def lenient_number(c: ColumnOrName) -> Column:
    return as_column(c).try_cast("double")


def synth_date(year: Column, month: Column, day: Column) -> Column:
    """Date from parts; a day the year does not have gives null."""
    text = F.concat(
        year.cast("int").cast("string"), F.lit("-"), month.cast("string"), F.lit("-"), day.cast("string")
    )
    return F.try_to_date(text, "yyyy-M-d")
