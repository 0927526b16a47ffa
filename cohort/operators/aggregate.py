"""Aggregates. All of them combine inside each input split before the shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from .quantiles import as_number, exact_quantiles


def group_totals(df: DataFrame, keys: Sequence[str], counts: Sequence[str] = (), sums: Sequence[str] = ()) -> DataFrame:
    """``count_<c>`` and ``sum_<c>`` per key; nulls are not counted."""
    aggs = [F.count(c).alias(f"count_{c}") for c in counts] + [F.sum(c).alias(f"sum_{c}") for c in sums]
    return df.groupBy(*keys).agg(*aggs)


def duplicated_keys(df: DataFrame, *key: str) -> DataFrame:
    """Keys with more than one row, and how many (``n``)."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def freq(df: DataFrame, col: str, nulls: bool = True) -> DataFrame:
    """Frequency table ``(col, n)``; nulls are a group unless excluded."""
    rows = df if nulls else df.filter(F.col(col).isNotNull())
    return rows.groupBy(col).agg(F.count(F.lit(1)).alias("n"))


def distinct_values(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*cols).distinct()


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"))


def _one_row_to_many(row: DataFrame, fields: list[str], per_column: dict[str, list[Column]]) -> DataFrame:
    """Turn a single aggregated row into one row per described column."""
    structs = [
        F.struct(F.lit(name).alias("column"), *[v.alias(f) for f, v in zip(fields, values)])
        for name, values in per_column.items()
    ]
    return row.select(F.inline(F.array(*structs)))


def missing_ratio(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Share of nulls per column, all columns in one pass."""
    cols = list(cols or df.columns)
    row = df.agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in cols])
    return _one_row_to_many(row, ["missing_ratio"], {c: [F.col(c)] for c in cols})


def summary(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Count, nulls, minimum, quartiles, mean, maximum of numeric columns (exact quartiles)."""
    quartiles = exact_quantiles(df, cols, [0.25, 0.5, 0.75])
    fields = ["n", "n_missing", "min", "q1", "median", "mean", "q3", "max"]
    aggs = []
    for c in cols:
        x = as_number(c)
        aggs += [F.count(x).alias(f"n_{c}"), F.sum(x.isNull().cast("long")).alias(f"z_{c}")]
        aggs += [F.min(x).alias(f"lo_{c}"), F.max(x).alias(f"hi_{c}"), F.avg(x).alias(f"m_{c}")]
    values = {
        c: [
            F.col(f"n_{c}"),
            F.col(f"z_{c}"),
            F.col(f"lo_{c}"),
            *[F.lit(quartiles[c][i]).cast("double") for i in (0, 1)],
            F.col(f"m_{c}"),
            F.lit(quartiles[c][2]).cast("double"),
            F.col(f"hi_{c}"),
        ]
        for c in cols
    }
    return _one_row_to_many(df.agg(*aggs), fields, values)


def entropy(df: DataFrame, col: str, normalize_by_classes: bool = True) -> DataFrame:
    """Entropy in bits of the non-null values, by default divided by the number of classes.

    One row, ``entropy``. Uses ``H = log2 N - sum(n log2 n) / N``, so the class counts are summed
    once and never joined to their total.
    """
    n = F.col("n").cast("double")
    total, weighted = F.sum(n), F.sum(n * F.log2(n))
    bits = F.abs(F.log2(total) - weighted / total)
    value = bits / F.count(F.lit(1)) if normalize_by_classes else bits
    return freq(df, col, nulls=False).agg(value.alias("entropy"))


def prior(df: DataFrame, col: str, value="YES") -> DataFrame:
    """Percentage of rows with the given class, as one row ``prior``."""
    hit = F.when(F.col(col) == value, 1.0).otherwise(0.0)
    return df.agg((F.avg(hit) * 100).alias("prior"))


def as_text(df: DataFrame, c: str) -> Column:
    """A column as text, different values as different texts."""
    plain = not isinstance(df.schema[c].dataType, (T.ArrayType, T.MapType, T.StructType))
    return F.col(c).cast("string") if plain else F.to_json(F.struct(c))


def profile(df: DataFrame, dictionary: DataFrame | None = None, exact_distinct: bool = True) -> DataFrame:
    """Quality report: one row per column, checked against a data dictionary.

    Columns: ``column, missing_ratio, n_distinct, min, max`` and, with a dictionary
    ``(attribute, measurement)``, ``declared`` (null when the column is not described).
    """
    aggs = []
    for c in df.columns:
        aggs += [
            F.avg(F.col(c).isNull().cast("int")).alias(f"miss_{c}"),
            F.min(c).cast("string").alias(f"min_{c}"),
            F.max(c).cast("string").alias(f"max_{c}"),
        ]
        if not exact_distinct:
            aggs.append(F.approx_count_distinct(c).alias(f"dist_{c}"))

    values = {c: [F.col(f"miss_{c}"), F.col(f"min_{c}"), F.col(f"max_{c}")] for c in df.columns}
    if exact_distinct:
        # one pass for all columns: (column, value) pairs, made distinct inside each split before they are shuffled
        pairs = [F.struct(F.lit(c).alias("column"), as_text(df, c).alias("v")) for c in df.columns]
        distinct = df.select(F.inline(F.array(*pairs))).distinct().groupBy("column").agg(F.count("v").alias("n_distinct"))
        report = _one_row_to_many(df.agg(*aggs), ["missing_ratio", "min", "max"], values)
        report = report.join(distinct, "column", "left").withColumn("n_distinct", F.coalesce("n_distinct", F.lit(0).cast("long")))
    else:
        values = {c: [v[0], F.col(f"dist_{c}"), *v[1:]] for c, v in values.items()}
        report = _one_row_to_many(df.agg(*aggs), ["missing_ratio", "n_distinct", "min", "max"], values)
    report = report.select("column", "missing_ratio", "n_distinct", "min", "max")
    if dictionary is None:
        return report
    declared = dictionary.select(F.col("attribute").alias("column"), F.col("measurement").alias("declared"))
    return report.join(declared, "column", "left")
