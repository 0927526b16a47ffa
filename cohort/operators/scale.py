"""Scaling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def minmax(df: DataFrame, cols: Sequence[str] | str) -> DataFrame:
    """Scale to [0, 1]; nulls are ignored and stay null, a constant column becomes null.

    The ends enter as scalar subqueries, merged by the optimizer into one pass.
    """
    cols = [cols] if isinstance(cols, str) else list(cols)
    ends = df.agg(*[f(c).cast("double").alias(f"{n}_{c}") for c in cols for n, f in (("lo", F.min), ("hi", F.max))])

    def end(name: str):
        return ends.select(name).scalar()

    return df.withColumns(
        {
            c: (F.col(c) - end(f"lo_{c}")) / F.nullif(end(f"hi_{c}") - end(f"lo_{c}"), F.lit(0.0))
            for c in cols
        }
    )
