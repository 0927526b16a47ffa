"""Discretization."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from .recode import ColumnOrName, as_column


def bucketize(
    c: ColumnOrName,
    edges: Sequence[float],
    labels: Sequence[str],
    gaps: Sequence[tuple[float, float]] = (),
) -> Column:
    """Label left-closed intervals ``(-inf, e0) [e0, e1) ... [en, inf)``.

    ``gaps`` are left-closed stretches that belong to no interval and give null.
    """
    if len(labels) != len(edges) + 1:
        raise ValueError("need one label more than edges")
    if list(edges) != sorted(edges):
        raise ValueError("edges must ascend")
    c = as_column(c)
    chain = F.when(c.isNull(), F.lit(None))
    for low, high in gaps:
        chain = chain.when((c >= low) & (c < high), F.lit(None))
    for edge, name in zip(edges, labels):
        chain = chain.when(c < edge, name)
    return chain.otherwise(labels[-1])


# Upper end of each day interval, and its name.
DELAY_BINS = [(3, "3D"), (7, "1W"), (14, "2W"), (30, "1M"), (60, "2M"), (180, "6M")]
DELAY_NONE, DELAY_LONGEST, DELAY_MISSING = "NONE", "1Y", "NOT PRESENT"


def discretize_delay(days: ColumnOrName, gap_to: str | None = None) -> Column:
    """Name a number of days. Exactly one day lies in no interval and gives ``gap_to``."""
    d = as_column(days)
    chain = F.when(d.isNull(), DELAY_MISSING).when(d < 1, DELAY_NONE).when(d <= 1, F.lit(gap_to))
    for end, name in DELAY_BINS:
        chain = chain.when(d <= end, name)
    return chain.otherwise(DELAY_LONGEST)
