"""Filling a column by a model fitted on the rows that have it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .classify import fit


def fill_by_model(
    df: DataFrame,
    target: str,
    features: Sequence[str],
    name: str = "rpart",
    bad: Column | None = None,
    seed: int = 1,
    compressed: bool = True,
    **params,
) -> DataFrame:
    """Predict ``target`` where it is null, or implausible by ``bad``.

    One pass scores all rows and keeps the known values, so nothing is split and joined again.
    Values are predicted as classes and put back in the column's own type.
    """
    hole = F.col(target).isNull()
    if bad is not None:
        hole = hole | F.coalesce(bad, F.lit(False))
    fitted = fit(df.filter(~hole), target, features, name, seed, compressed=compressed, **params)
    kind = df.schema[target].dataType
    scored = fitted.predict(df, out="__filled")
    value = F.when(hole, F.col("__filled").cast(kind)).otherwise(F.col(target))
    return scored.withColumn(target, value).drop("__filled")
