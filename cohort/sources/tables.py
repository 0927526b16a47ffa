"""Sources and sinks: columnar files, catalog tables, databases, CSV, metrics log."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..operators.identify import number_rows
from ..sizing import small_or_plain


def scan(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One table of a source kept as Parquet under a common root."""
    return spark.read.parquet(f"{root.rstrip('/')}/{name}.parquet")


def scan_table(spark: SparkSession, database: str, name: str) -> DataFrame:
    """One table of a source registered in the catalog."""
    return spark.read.table(f"{database}.{name}")


def scan_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    partition_column: str,
    low: int,
    high: int,
    partitions: int,
    properties: Mapping[str, str] | None = None,
) -> DataFrame:
    """One table of a source database, read in parallel over ranges of a numeric key."""
    return spark.read.jdbc(
        url,
        table,
        column=partition_column,
        lowerBound=low,
        upperBound=high,
        numPartitions=partitions,
        properties=dict(properties or {}),
    )


def stage(df: DataFrame, name: str, persist: bool = False) -> DataFrame:
    """Name an intermediate result; it stays lazy, and is kept only when reused."""
    if persist:
        df = df.persist(StorageLevel.MEMORY_AND_DISK)
    df.createOrReplaceTempView(name)
    return df


_CSV = {"header": True, "sep": ",", "quote": '"', "escape": '"', "lineSep": "\n"}


def write_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    """Comma separated, every field quoted, header line, null as the empty string."""
    df.write.mode(mode).options(**_CSV, quoteAll=True, nullValue="", emptyValue="").csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, multiline: bool = False) -> DataFrame:
    """Read with a fixed schema; empty fields are null. ``multiline`` admits line breaks in fields."""
    return spark.read.schema(schema).options(**_CSV, nullValue="", multiLine=multiline).csv(path)


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """Data dictionary CSV: attribute, description, measurement type, category."""
    return read_csv(spark, path, "attribute string, description string, measurement string, category string")


def dictionary(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """The levels of text columns in alphabetical order: ``(column, value, code)``, codes from 0.

    All columns are read in one pass. The distinct values are numbered where they lie, so a column may have any
    number of them; none reaches the driver.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols])
    values = df.select(F.inline(pairs)).filter(F.col("value").isNotNull()).distinct()
    return number_rows(values, "column", "value", out="code")


def apply_dictionary(df: DataFrame, levels: DataFrame, cols: Sequence[str], suffix: str = "_code") -> DataFrame:
    """Add the codes of a dictionary; null and unseen values get the number of levels."""
    counted = levels.filter(F.col("column").isin(*cols)).groupBy("column").agg(F.count(F.lit(1)).alias("n"))
    sizes = {r["column"]: r["n"] for r in counted.collect()}  # one number a column
    kept = df.columns
    for c in cols:
        own = levels.filter(F.col("column") == c).select(F.col("value").alias("__value"), F.col("code").alias(c + suffix))
        df = df.join(small_or_plain(own), F.col(c).cast("string") == F.col("__value"), "left").drop("__value")
        df = df.withColumn(c + suffix, F.coalesce(F.col(c + suffix), F.lit(sizes.get(c, 0))).cast("double"))
    return df.select(*kept, *[c + suffix for c in cols])


def encode(df: DataFrame, cols: Sequence[str], suffix: str = "_code") -> tuple[DataFrame, DataFrame]:
    """Dictionary-encode text columns, levels in alphabetical order; null and unseen get the last code.

    Returns the coded rows and the dictionary, which ``apply_dictionary`` puts on other rows.
    """
    levels = dictionary(df, cols)
    return apply_dictionary(df, levels, cols, suffix), levels


def append_metrics(df: DataFrame, path: str, stamp: bool = True) -> None:
    """Append experiment results to a Parquet log, with the time if wanted."""
    when = F.current_timestamp() if stamp else F.lit(None).cast("timestamp")
    df.withColumn("logged_at", when).write.mode("append").parquet(path)


def log_metrics(df: DataFrame, path: str, run: str, stamp: bool = True) -> None:
    """Write the results of one run to a Parquet log kept by run, with the time if wanted.

    A run that is logged again, because it or a stage of it was repeated, replaces its own rows and no others.
    """
    when = F.current_timestamp() if stamp else F.lit(None).cast("timestamp")
    rows = df.withColumns({"run": F.lit(run), "logged_at": when})
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(path)


def stage_bucketed(df: DataFrame, name: str, key: str, buckets: int, path: str | None = None) -> DataFrame:
    """Write an intermediate result as a table bucketed and sorted by a key, and read it back.

    It is shuffled once, here: joins and aggregates on the key between tables of equally many buckets need no
    further exchange. ``path`` names the folder of the table if it isn't to lie in the warehouse.
    """
    writer = df.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key)
    (writer.option("path", path) if path else writer).saveAsTable(name)
    return df.sparkSession.read.table(name)
