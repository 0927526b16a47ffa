"""What used to be cut or refused: many classes, many values, deep prefixes, NaN, mixed case, repeated subjects."""

import math
import random

import pytest
from conftest import bag
from pyspark.sql import functions as F

from cohort import functions as fn
from cohort import models as ml
from cohort import operators as op
from cohort.models.metrics import chi2_tail
from cohort.operators.sample import poisson_steps
from cohort.plans import wide


def test_fill_with_more_than_a_thousand_classes(spark):
    rows = spark.range(2 * 1001).select(
        F.format_string("f%04d", F.col("id") % 1001).alias("f"),
        F.when(F.col("id") < 1001, F.format_string("c%04d", F.col("id") % 1001)).alias("t"),
    )
    out = ml.fill_by_model(rows, "t", ["f"], "rpart", depth=12)
    assert out.filter("t is null").count() == 0
    assert out.select("t").distinct().count() > 500


def test_chi_square_of_many_values(spark):
    rows = spark.range(44_000).select((F.col("id") % 11_000).cast("string").alias("v"), (F.col("id") % 2).alias("y"))
    r = ml.chi2_screen(rows, "y", ["v"]).first()
    # even and odd values: each value has one label only
    assert r["degrees"] == 10_999 and r["statistic"] == pytest.approx(44_000) and r["p_value"] < 1e-12


def test_chi_square_tail():
    assert chi2_tail(4, 2) == pytest.approx(math.exp(-2), rel=1e-13)
    assert chi2_tail(3.84, 1) == pytest.approx(math.erfc(math.sqrt(1.92)), rel=1e-13)
    for x, half in ((30.0, 4), (2.0, 10), (80.0, 25)):
        want = math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(half))
        assert chi2_tail(x, 2 * half) == pytest.approx(want, rel=1e-11)
    assert chi2_tail(0, 3) == 1.0 and chi2_tail(5, 0) == 1.0


def test_poisson_steps_reach_the_resolution_of_the_draw():
    steps = poisson_steps()
    assert 1 - steps[-1] < 2.0**-48 <= 1 - steps[-2] and len(steps) > 12


@pytest.mark.parametrize("digits", [1, 3])
def test_stratum_whose_edge_prefix_is_deep(spark, digits):
    rows = spark.range(4000).select("id", (F.col("id") % 2).alias("g"))
    got = op.sample_stratified(rows, "id", ["g"], 0.37, 5, rank_rows=0, digits=digits)
    assert bag(got) == bag(op.sample_stratified(rows, "id", ["g"], 0.37, 5))
    assert got.groupBy("g").count().agg(F.min("count"), F.max("count")).first()[:] == (740, 740)


def test_nan_is_missing_and_infinity_is_a_value(frame):
    nan, inf = float("nan"), float("inf")
    df = frame([(1.0,), (nan,), (2.0,), (None,), (3.0,), (inf,), (-inf,)], "x double")
    for fetch in (1, 20_000):
        assert op.exact_quantiles(df, "x", [0, 0.25, 0.5, 1], fetch=fetch) == {"x": [-inf, 1.0, 2.0, inf]}
    r = op.summary(df, ["x"]).first()
    assert (r["n"], r["n_missing"], r["median"], r["max"]) == (5, 2, 2.0, inf)
    only = op.fill_median(frame([(1.0,), (nan,), (None,), (3.0,)], "x double"), "x")
    assert only.filter("x = 2").count() == 1
    random.seed(1)
    xs = [random.choice([nan, None, inf, -inf, random.random()]) for _ in range(500)]
    known = sorted(x for x in xs if x is not None and not math.isnan(x))
    got = op.exact_quantiles(frame([(x,) for x in xs], "x double"), "x", [0.5], fetch=1)["x"][0]
    middle = (len(known) - 1) / 2
    assert got == pytest.approx((known[math.floor(middle)] + known[math.ceil(middle)]) / 2)


def test_trees_of_a_compressed_forest_differ(spark):
    df = spark.range(400).select(
        F.concat(F.lit("a"), F.col("id") % 7).alias("a"), F.concat(F.lit("b"), F.col("id") % 5).alias("b"),
        F.concat(F.lit("c"), F.col("id") % 3).alias("c"), F.concat(F.lit("d"), F.col("id") % 2).alias("d"),
        F.when(F.abs(F.xxhash64("id")) % 4 + F.col("id") % 3 > 2, "YES").otherwise("NO").alias("y"),
    )
    fitted = ml.fit(df, "y", ["a", "b", "c", "d"], "rforest", compressed=True, ntree=10)
    assert len({t.toDebugString.split("\n", 1)[1] for t in fitted.members[0].trees}) > 1
    counted = df.groupBy("y", "a", "b").count()
    weighted = ml.fit(counted, "y", ["a", "b"], "rforest", weight="count", ntree=10)
    assert len({t.toDebugString.split("\n", 1)[1] for t in weighted.members[0].trees}) > 1


def test_equality_without_case(frame):
    df = frame([("a", "Negative"), ("a", "3+"), ("b", "NEGATIVE"), ("c", "Image unclear"), ("d", None)], "k string, r string")
    assert bag(op.drop_values(df, "r", ["IMAGE UNCLEAR"], case_insensitive=True).select("k")) == [("a",), ("a",), ("b",), ("d",)]
    kept = op.dedup_prefer(df, "k", "r", "NEGATIVE", case_insensitive=True)
    assert bag(kept.filter("k in ('a', 'b')")) == [("a", "3+"), ("b", "NEGATIVE")]
    flags = [r[0] for r in df.select(fn.positive_flag("r", "NEGATIVE", case_insensitive=True)).collect()]
    assert flags == ["NO", "YES", "NO", "YES", "NO"]
    assert op.drop_values(df, "r", ["IMAGE UNCLEAR"]).count() == 5  # exact unless asked


def test_profile_reads_its_input_twice(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    plan = op.profile(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[-1].count("FileScan") <= 2


def test_restriction_lies_below_the_aggregates(spark):
    from __spark_entry__ import queries

    plan = queries()["cohort_outcome"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    first = plan.index("Join LeftSemi")
    assert "max(struct" in plan[:first] and "max(struct" not in plan[first:]  # the picks lie above the restriction


def test_wide_table_refuses_repeated_subjects(spark):
    from cohort.plans.catalog import Tables
    from cohort.plans.source_tables import two_sources

    a, b = two_sources(Tables(spark, "/root/testdata/sf0.001"))
    b = {**b, "person": b["person"].withColumn("MaritalStatus", F.lit("OTHER"))}
    with pytest.raises(ValueError):
        wide.wide_table(a, b)
    assert wide.wide_table(a, b, check=False).count() > 0
