"""Joins. Sides are broadcast by Spark only when their size is known to be small."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from .check import assert_unique


def _names(on: Sequence[str] | str) -> list[str]:
    return [on] if isinstance(on, str) else list(on)


def inner(a: DataFrame, b: DataFrame, on: Sequence[str] | str | Mapping[str, str]) -> DataFrame:
    """Equi-join; a mapping ``{key of a: key of b}`` joins differently named keys and keeps a's."""
    if isinstance(on, Mapping):
        for left, right in on.items():
            b = b.withColumnRenamed(right, left)
        on = list(on)
    return a.join(b, on=_names(on), how="inner")


def restrict_to(df: DataFrame, cohort: DataFrame, on: Mapping[str, str] | Sequence[str] | str) -> DataFrame:
    """Rows whose key is in the cohort. ``on`` may map ``{key of df: key of cohort}``.

    The cohort keys are made distinct first: that removes hot copies on the side a skew split
    cannot divide, and its shuffle is the one the join needs anyway.
    """
    pairs = on if isinstance(on, Mapping) else {k: k for k in _names(on)}
    keys = cohort.select(*[F.col(theirs).alias(ours) for ours, theirs in pairs.items()]).distinct()
    return df.join(keys, on=list(pairs), how="left_semi")


def exclude(df: DataFrame, keys: DataFrame, on: Sequence[str] | str) -> DataFrame:
    """Rows whose key is not in ``keys`` (the complement of a sample)."""
    names = _names(on)
    return df.join(keys.select(*names).distinct(), on=names, how="left_anti")


def assemble(base: DataFrame, parts: Sequence[DataFrame], on: str) -> DataFrame:
    """Left join several one-row-per-key tables; all joins share one partitioning on the key."""
    return reduce(lambda left, part: left.join(part, on=on, how="left"), parts, base)


def lookup(
    df: DataFrame, dim: DataFrame, on: Mapping[str, str] | Sequence[str] | str, check: bool = False
) -> DataFrame:
    """Left join to a dimension by its natural key; ``check`` raises if the dimension key repeats."""
    pairs = on if isinstance(on, Mapping) else {k: k for k in _names(on)}
    for ours, theirs in pairs.items():
        if ours != theirs:
            dim = dim.withColumnRenamed(theirs, ours)
    if check:
        assert_unique(dim, *pairs)
    return df.join(dim, on=list(pairs), how="left")


def before(df: DataFrame, ref: DataFrame, on: Mapping[str, str] | str, ts: str, ref_ts: str) -> DataFrame:
    """Rows that lie before some reference row of the same key, each once.

    "Earlier than any" is "earlier than the greatest", so the reference side is reduced to one
    value per key and the range condition cannot multiply rows.
    """
    pairs = on if isinstance(on, Mapping) else {on: on}
    last = ref.groupBy(*[F.col(theirs).alias(ours) for ours, theirs in pairs.items()]).agg(
        F.max(ref_ts).alias("__last")
    )
    return df.join(last, on=list(pairs), how="inner").filter(F.col(ts) < F.col("__last")).select(*df.columns)
