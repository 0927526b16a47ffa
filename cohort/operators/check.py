"""Key checks."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Window, functions as F

from .aggregate import duplicated_keys


class DuplicateKeyError(ValueError):
    pass


def assert_unique(df: DataFrame, *key: str) -> DataFrame:
    """Raise if a key occurs twice; shows at most five offenders. Runs a job, returns ``df``."""
    offenders = duplicated_keys(df, *key).limit(5).collect()
    if offenders:
        raise DuplicateKeyError(f"{key} not unique, e.g. {[tuple(r) for r in offenders]}")
    return df


def unique_rows(df: DataFrame, *key: str) -> DataFrame:
    """``df`` as it is, but the run fails with the key if one occurs twice.

    The check is part of the plan: it needs the rows of a key side by side, which a join or an aggregate on the key
    needs as well, so it adds neither a job nor, next to one of these, a shuffle.
    """
    name = ", ".join(key)
    message = F.concat(F.lit(f"({name}) not unique, e.g. "), F.coalesce(F.to_json(F.struct(*key)), F.lit("null")))
    counted = df.withColumn("__same", F.count(F.lit(1)).over(Window.partitionBy(*key)))
    return counted.filter(F.when(F.col("__same") > 1, F.raise_error(message)).otherwise(F.lit(True))).drop("__same")


@contextmanager
def naming_duplicates():
    """Turn the failure of a run inside by ``unique_rows`` into a ``DuplicateKeyError``."""
    try:
        yield
    except PySparkException as e:
        if "not unique, e.g. " not in str(e):
            raise
        raise DuplicateKeyError(str(e).split("] ", 1)[-1].split(" SQLSTATE")[0]) from e
