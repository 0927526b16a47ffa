"""What the physical plans look like: pruning, pushdown, no cross joins, no windows over raw keys."""

import contextlib
import io
import re

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from cohort import operators as op
from cohort.sizing import small_or_plain

SMALL = "/root/testdata/sf0.001"


def plan(df, mode="simple"):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain(mode)
    return out.getvalue()


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(queries()["project_filter"](spark, SMALL), "formatted")
    assert "In(l_returnflag, [A,R])" in text and "GreaterThanOrEqual(l_quantity,10.0)" in text
    schema = re.search(r"ReadSchema: struct<(.*?)>", text).group(1)
    assert "l_comment" not in schema and "l_shipdate" not in schema
    assert schema.count(":") == 5


@pytest.mark.parametrize("name", ["pick_one", "pick_one_mixed", "latest_one", "latest_ties", "max_id", "dedup_prefer", "dedup_keep_one"])
def test_picks_are_aggregates_without_windows(spark, name):
    text = plan(queries()[name](spark, SMALL))
    assert "Window" not in text and "partial_" in text


@pytest.mark.parametrize("name", ["sample_exact", "split_3way", "bootstrap", "fold_id", "recode_map", "flags", "synth_date"])
def test_row_wise_results_need_no_shuffle(spark, name):
    assert "Exchange" not in plan(queries()[name](spark, SMALL)).replace("BroadcastExchange", "")


def test_no_pairs_are_formed(spark, no_broadcast):
    for name in ["result_before_ref", "wide_table", "star_assembly", "cohort_outcome", "fill_harmonic", "minmax", "collapse_rare"]:
        text = plan(queries()[name](spark, SMALL))
        assert "Cartesian" not in text and "NestedLoop" not in text, name


def test_assembly_shares_one_partitioning(spark, no_broadcast):
    def side(i):
        return spark.range(1000).select(F.col("id").alias("k"), F.col("id").alias(f"v{i}"))

    text = plan(op.assemble(side(0), [side(1), side(2), side(3)], "k"))
    assert text.count("Exchange hashpartitioning") == 4 and text.count("SortMergeJoin") == 3


def test_cohort_distinct_shuffle_is_the_join_shuffle(spark, no_broadcast):
    facts, cohort = spark.range(100).withColumnRenamed("id", "k"), spark.range(50).withColumnRenamed("id", "k")
    text = plan(op.restrict_to(facts, cohort, "k"))
    assert text.count("Exchange hashpartitioning") == 2 and "LeftSemi" in text


@pytest.mark.parametrize("name", ["surrogate_ids", "sample_stratified", "delay_bins", "cohort_outcome"])
def test_windows_are_partitioned(spark, name):
    text = plan(queries()[name](spark, SMALL))
    assert "SinglePartition" not in text
    assert "Window" in text or name == "sample_stratified"  # its cuts are found before and joined as a small table


def test_broadcast_only_when_small(spark, no_broadcast):
    small, large = spark.range(10), spark.range(11)
    assert "BroadcastHashJoin" in plan(spark.range(99).join(small_or_plain(small, 10), "id"))
    assert "BroadcastHashJoin" not in plan(spark.range(99).join(small_or_plain(large, 10), "id"))


def test_scaling_reads_its_column_once_more(spark):
    text = plan(queries()["minmax"](spark, SMALL))
    assert "mergedValue" in text
