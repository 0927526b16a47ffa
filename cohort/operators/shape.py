"""Projection, alignment of sources, row filters and value rules."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..sizing import small_or_plain


def project(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Keep and rename in one projection: ``{old: new}``."""
    return df.select(*[F.col(old).alias(new) for old, new in columns.items()])


def align(df: DataFrame, mapping: Mapping[str, str | Column]) -> DataFrame:
    """Give one source the common layout: ``{common name: its column or expression}``."""
    return df.select(
        *[(F.col(src) if isinstance(src, str) else src).alias(name) for name, src in mapping.items()]
    )


def union_distinct(*dfs: DataFrame) -> DataFrame:
    """Rows of all sources, exact duplicates once.

    ``distinct`` is a grouped aggregate, so copies collapse inside each input split before the shuffle.
    """
    out = dfs[0]
    for df in dfs[1:]:
        out = out.unionByName(df)
    return out.distinct()


def append_rows(*dfs: DataFrame) -> DataFrame:
    out = dfs[0]
    for df in dfs[1:]:
        out = out.unionByName(df)
    return out


def complete_cases(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    return df.na.drop("any", subset=list(cols) if cols else None)


def drop_values(df: DataFrame, col: str, bad: Sequence, case_insensitive: bool = False) -> DataFrame:
    """Delete rows holding one of the invalid values; null is kept."""
    value = F.lower(col) if case_insensitive else F.col(col)
    return df.filter(F.col(col).isNull() | ~value.isin(*[b.lower() if case_insensitive else b for b in bad]))


def delete_keys(df: DataFrame, keys: DataFrame | Sequence[Mapping], on: Sequence[str] | None = None) -> DataFrame:
    """Delete known bad records, given as a list of ``{column: value}`` or as a table of keys."""
    if isinstance(keys, DataFrame):
        return df.join(keys.select(*on).distinct(), on=list(on), how="left_anti")
    for record in keys:
        hit = F.lit(True)
        for col, value in record.items():
            hit = hit & F.col(col).eqNullSafe(F.lit(value))
        df = df.filter(~hit)
    return df


def apply_rules(df: DataFrame, rules: Sequence[tuple[Column, str, Column | str | None]]) -> DataFrame:
    """Sequential ``(condition, column, value)`` updates; each rule sees the ones before it."""
    for test, col, value in rules:
        new = value if isinstance(value, Column) else F.lit(value)
        df = df.withColumn(col, F.when(test, new).otherwise(F.col(col)))
    return df


def collapse_rare(df: DataFrame, col: str, min_count: int | Column, other: str = "other") -> DataFrame:
    """Replace values seen fewer than ``min_count`` times; null stays null.

    Frequent values are never more than rows / min_count; they are broadcast only if few.
    """
    frequent = (
        df.filter(F.col(col).isNotNull())
        .groupBy(F.col(col).alias("__value"))
        .count()
        .filter(F.col("count") >= min_count)
        .select("__value")
    )
    joined = df.join(small_or_plain(frequent), F.col(col) == F.col("__value"), "left")
    kept = F.when(F.col(col).isNull() | F.col("__value").isNotNull(), F.col(col)).otherwise(other)
    return joined.withColumn(col, kept).drop("__value")


def recode_by_table(df: DataFrame, col: str, table: DataFrame, source: str, target: str) -> DataFrame:
    """Exact recode by a lookup table too large to write out; unlisted values stay."""
    pairs = table.select(F.col(source).alias("__from"), F.col(target).alias("__to"))
    joined = df.join(pairs, F.col(col) == F.col("__from"), "left")
    return joined.withColumn(col, F.coalesce("__to", col)).drop("__from", "__to")
