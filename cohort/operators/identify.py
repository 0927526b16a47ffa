"""De-identification."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sizing import checkpoint, small_or_plain

ID_PREFIX = 3  # hex digits: at most 4096 buckets


def _digest(c: Column, algo: str, salt: str) -> Column:
    text = F.concat(F.lit(salt), c.cast("string"))
    if algo == "sha256":
        return F.sha2(text, 256)
    if algo == "md5":
        return F.md5(text)
    if algo == "crc32":
        return F.lpad(F.lower(F.hex(F.crc32(text))), 8, "0")
    raise ValueError(f"unknown algorithm {algo!r}")


def deidentify(df: DataFrame, cols: Sequence[str] | str, algo: str = "sha256", salt: str = "") -> DataFrame:
    """Replace values by a digest of salt and text; null stays null."""
    cols = [cols] if isinstance(cols, str) else list(cols)
    return df.withColumns({c: _digest(F.col(c), algo, salt) for c in cols})


def surrogate_ids(df: DataFrame, key: str, out: str = "ID", salt: str = "", prefix: int = ID_PREFIX) -> DataFrame:
    """Dense ids 1..n for the distinct non-null keys: ``(key, out)``.

    Ids follow the order of a salted digest, so they repeat between runs and say nothing about the
    key. The first ``prefix`` hex digits split the distinct keys evenly whatever the data; ids are
    numbered inside each bucket and shifted by the sizes of the buckets before it (at most
    ``16 ** prefix`` numbers, the only thing the driver sees).
    """
    keys = df.select(key).filter(F.col(key).isNotNull()).distinct()
    hashed = keys.withColumn("__h", F.md5(F.concat(F.lit(salt), F.col(key).cast("string")))).withColumn(
        "__b", F.substring("__h", 1, prefix)
    )
    sizes = sorted((r["__b"], r["count"]) for r in hashed.groupBy("__b").count().collect())
    offsets, total = [], 0
    for bucket, n in sizes:
        offsets.append((bucket, total))
        total += n
    shift = df.sparkSession.createDataFrame(offsets, "__b string, __shift long")
    inside = F.row_number().over(Window.partitionBy("__b").orderBy("__h", key))
    return hashed.join(F.broadcast(shift), "__b").select(key, (F.col("__shift") + inside).alias(out))


def replace_ids(df: DataFrame, key: str, ids: DataFrame, out: str = "ID") -> DataFrame:
    """Put the surrogate in place of the real key."""
    joined = df.join(ids.select(F.col(key), F.col(out).alias("__id")), on=key, how="inner")
    return joined.withColumn(key, F.col("__id")).drop("__id")


def number_rows(df: DataFrame, group: str, *order: str, out: str = "number") -> DataFrame:
    """``df`` with each row's place (from 0) in its group's order.

    Rows are dealt by ranges of group and order, so a group of any size lies in many tasks; the sizes of the
    ranges, the only thing that is gathered, say where each begins. Ties follow the place they were read from.
    A null group is a group.
    """
    by = ["__group", *order, "__tie"]
    keyed = df.withColumn("__group", F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")))
    dealt = keyed.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by)
    dealt = dealt.drop("__tie").withColumn("__row", F.monotonically_increasing_id())
    dealt = checkpoint(dealt.withColumn("__part", F.shiftright("__row", 33)))
    sizes = dealt.groupBy("__group", "__part").agg(F.min("__row").alias("__first"), F.count(F.lit(1)).alias("__size"))
    upto = Window.partitionBy("__group").orderBy("__part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    shift = F.sum("__size").over(upto) - F.col("__size") - F.col("__first")
    placed = dealt.join(small_or_plain(sizes.select("__group", "__part", shift.alias("__shift"))), ["__group", "__part"])
    return placed.withColumn(out, F.col("__row") + F.col("__shift")).select(*df.columns, out)
