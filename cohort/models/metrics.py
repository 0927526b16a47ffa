"""Evaluation as plain aggregates."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F


def confusion(df: DataFrame, pred: str, truth: str) -> DataFrame:
    """Counts per (prediction, truth)."""
    return df.groupBy(pred, truth).agg(F.count(F.lit(1)).alias("n"))


def binary_metrics(df: DataFrame, pred: str, truth: str, positive: str = "NO", weight: str | None = None) -> DataFrame:
    """One row: the four counts, accuracy, positive and negative predictive value, sensitivity, specificity.

    Rows without prediction or truth do not count; an undefined ratio is null.
    """
    known = df.filter(F.col(pred).isNotNull() & F.col(truth).isNotNull())
    p, t = F.col(pred) == positive, F.col(truth) == positive
    w = F.col(weight).cast("long") if weight else F.lit(1).cast("long")

    def tally(test, name):
        return F.coalesce(F.sum(F.when(test, w)), F.lit(0).cast("long")).alias(name)

    cells = known.agg(tally(p & t, "tp"), tally(~p & t, "fn"), tally(p & ~t, "fp"), tally(~p & ~t, "tn"))
    tp, fn, fp, tn = (F.col(c).cast("double") for c in ("tp", "fn", "fp", "tn"))

    def ratio(a, b):
        return a / F.nullif(b, F.lit(0.0))

    return cells.select(
        "tp",
        "fn",
        "fp",
        "tn",
        ratio(tp + tn, tp + fn + fp + tn).alias("accuracy"),
        ratio(tp, tp + fp).alias("ppv"),
        ratio(tn, tn + fn).alias("npv"),
        ratio(tp, tp + fn).alias("sensitivity"),
        ratio(tn, tn + fp).alias("specificity"),
    )


def chi2_screen(df: DataFrame, label: str, cols: Sequence[str]) -> DataFrame:
    """Chi-square test of independence of each column from the label.

    Rows ``(column, statistic, degrees, p_value)``; keep those with a small ``p_value``. All columns are
    counted in one pass; the cells stay distributed however many values a column has, and only one row per
    column reaches the driver.
    """
    rows = df.na.drop("any", subset=[label, *cols])
    pairs = [F.struct(F.lit(i).alias("c"), F.col(c).cast("string").alias("v")) for i, c in enumerate(cols)]
    cells = rows.select(F.col(label).cast("string").alias("q"), F.inline(F.array(*pairs))).groupBy("c", "v", "q")
    cells = cells.agg(F.count(F.lit(1)).cast("double").alias("k"))
    # the label's counts are the same for every column
    labels = rows.groupBy(F.col(label).cast("string").alias("q")).agg(F.count(F.lit(1)).cast("double").alias("qn"))
    size = labels.agg(F.sum("qn").alias("n"), F.count(F.lit(1)).alias("classes")).first()
    if not size["n"]:
        return df.sparkSession.createDataFrame([], "column string, statistic double, degrees long, p_value double")
    expected = F.sum("k").over(Window.partitionBy("c", "v")) * F.col("qn") / F.lit(size["n"])
    parts = cells.join(labels, "q").withColumn("e", expected)
    # cells without rows add their expected count, which is what the others leave of the total
    statistic = F.sum((F.col("k") - F.col("e")) ** 2 / F.col("e")) + F.lit(size["n"]) - F.sum("e")
    found = parts.groupBy("c").agg(statistic.alias("x"), F.count_distinct("v").alias("values")).orderBy("c").collect()
    out = []
    for r in found:
        degrees = (r["values"] - 1) * (size["classes"] - 1)
        x = max(r["x"], 0.0)
        out.append((cols[r["c"]], x, degrees, chi2_tail(x, degrees)))
    return df.sparkSession.createDataFrame(out, "column string, statistic double, degrees long, p_value double")


def chi2_tail(x: float, degrees: int) -> float:
    """Probability that a chi-square variable exceeds ``x``: the upper incomplete gamma function, regularised."""
    if degrees <= 0 or x <= 0:
        return 1.0
    a, z = degrees / 2, x / 2
    scale = math.exp(a * math.log(z) - z - math.lgamma(a))
    if z < a + 1:  # series of the lower function
        term = total = 1 / a
        n = a
        while term > total * 1e-17:
            n += 1
            term *= z / n
            total += term
        return max(0.0, 1 - scale * total)
    tiny = 1e-300  # continued fraction of the upper function
    b = z + 1 - a
    c, d = 1 / tiny, 1 / b
    value = d
    for i in range(1, 100_000):
        step = -i * (i - a)
        b += 2
        d = 1 / (step * d + b or tiny)
        c = b + step / c or tiny
        value *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return scale * value
