"""Filling gaps with constants, statistics and other columns. Model-based fills are in ``models``."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.measure import harmonic_mean
from ..sizing import small_or_plain
from .quantiles import exact_quantiles


def fill_const(df: DataFrame, values: Mapping) -> DataFrame:
    return df.na.fill(dict(values))


def fill_blank(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Everything to text, null to the empty string, in one projection."""
    chosen = set(cols or df.columns)
    return df.select(
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in chosen else F.col(c) for c in df.columns]
    )


def coalesce_from(df: DataFrame, target: str, *sources: str) -> DataFrame:
    """Fill a column from other columns, in order."""
    return df.withColumn(target, F.coalesce(target, *sources))


def fill_median(df: DataFrame, col: str, exact: bool = True) -> DataFrame:
    """Median fill; ``exact=False`` settles for the one-pass sketch."""
    if exact:
        middle = F.lit(exact_quantiles(df, col, [0.5])[col][0]).cast("double")
    else:
        middle = df.agg(F.percentile_approx(col, 0.5, 10_000).alias("m")).scalar()
    return df.withColumn(col, F.coalesce(col, middle))


def fill_mode(df: DataFrame, col: str, tie: str = "label", order_by: str | None = None) -> DataFrame:
    """Most frequent value fill.

    Ties go to the smallest value (``tie='label'``) or the one seen first by ``order_by``
    (``tie='order'``).
    """
    if (tie == "order") != (order_by is not None) or tie not in ("label", "order"):
        raise ValueError("tie is 'label', or 'order' with order_by")
    rows = df.filter(F.col(col).isNotNull())
    first = F.min(order_by) if tie == "order" else F.lit(0)
    top = (
        rows.groupBy(F.col(col).alias("v"))
        .agg(F.count(F.lit(1)).alias("n"), first.alias("o"))
        .orderBy(F.desc("n"), F.asc("o"), F.asc("v"))
        .limit(1)
        .select("v")
    )
    return df.withColumn(col, F.coalesce(F.col(col), top.scalar()))


STATISTICS = {"harmonic": harmonic_mean, "mean": F.avg, "min": F.min, "max": F.max}


def fill_group_stat(df: DataFrame, col: str, keys: Sequence[str], stat: str = "harmonic") -> DataFrame:
    """Fill from a statistic of the row's group; rows with a null key stay as they are."""
    stats = df.groupBy(*keys).agg(STATISTICS[stat](col).alias("__stat"))
    joined = df.join(small_or_plain(stats), on=list(keys), how="left")
    return joined.withColumn(col, F.coalesce(F.col(col), F.col("__stat"))).select(*df.columns)
