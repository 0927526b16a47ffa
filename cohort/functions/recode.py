"""Recoding and repairing values."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, functions as F

ColumnOrName = Column | str


def as_column(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _folded(c: Column) -> Column:
    return F.upper(F.trim(c))


def recode(c: ColumnOrName, mapping: Mapping[str, str], case_insensitive: bool = False) -> Column:
    """Replace exact values. Synonyms of one target share a single membership test."""
    c = as_column(c)
    if not mapping:
        return c
    sources_of: dict[str, list[str]] = {}
    for source, target in mapping.items():
        sources_of.setdefault(target, []).append(source.strip().upper() if case_insensitive else source)
    probe = _folded(c) if case_insensitive else c
    chain = None
    for target, sources in sources_of.items():
        test = probe.isin(*sources)
        chain = F.when(test, target) if chain is None else chain.when(test, target)
    return chain.otherwise(c)


def group_into(c: ColumnOrName, members: Iterable[str], target: str) -> Column:
    """Collapse a list of values into one."""
    return recode(c, {m: target for m in members})


def _like_matches(text: str, pattern: str) -> bool:
    regex = "".join({"%": ".*", "_": "."}.get(ch, re.escape(ch)) for ch in pattern)
    return re.fullmatch(regex, text, re.S) is not None


def recode_like(c: ColumnOrName, rules: Sequence[tuple[str, str]], case_insensitive: bool = False) -> Column:
    """Ordered LIKE patterns, first match wins.

    Running the rules as successive updates gives the same answer as long as no result matches a
    later pattern with another target; that is checked here.
    """
    c = as_column(c)
    for i, (_, target) in enumerate(rules):
        for later, other in rules[i + 1 :]:
            if other != target and _like_matches(target, later):
                raise ValueError(f"result {target!r} would be changed again by pattern {later!r}")
    chain = None
    for pattern, target in rules:
        test = c.ilike(pattern) if case_insensitive else c.like(pattern)
        chain = F.when(test, target) if chain is None else chain.when(test, target)
    return c if chain is None else chain.otherwise(c)


def null_if(c: ColumnOrName, bad: Column) -> Column:
    """Null where ``bad`` holds."""
    return F.when(bad, F.lit(None)).otherwise(as_column(c))


def rescale_if(c: ColumnOrName, wrong_unit: Column, factor: float) -> Column:
    """Multiply where the magnitude shows the wrong unit."""
    c = as_column(c)
    return F.when(wrong_unit, c * F.lit(factor)).otherwise(c)


def clamp(c: ColumnOrName, low=None, high=None) -> Column:
    """Limit to ``[low, high]``; null stays null."""
    c = as_column(c)
    out = c
    if low is not None:
        out = F.greatest(out, F.lit(low))
    if high is not None:
        out = F.least(out, F.lit(high))
    return F.when(c.isNotNull(), out)


def strip_chars(c: ColumnOrName, pattern: str = r"\s|[.]") -> Column:
    """Remove everything the regular expression matches."""
    return F.regexp_replace(as_column(c), pattern, "")


def normalize_case(c: ColumnOrName) -> Column:
    return F.upper(as_column(c))


def repair_if(c: ColumnOrName, bad: Column, replacement: Column) -> Column:
    """Replace an implausible value by an expression over other columns."""
    return F.when(bad, replacement).otherwise(as_column(c))


def fill_when(c: ColumnOrName, basis: Column, if_true, if_false) -> Column:
    """Fill a null from a condition on another column; unknown basis leaves it null."""
    return F.coalesce(as_column(c), F.when(basis, F.lit(if_true)).when(~basis, F.lit(if_false)))
