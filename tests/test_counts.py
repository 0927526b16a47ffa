"""Counts that fits read lie in few tasks, and fits join them before they count tables as their own."""

from __future__ import annotations

from itertools import product

import pytest
from conftest import bag
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from __spark_entry__ import SMALL
from cohort import models as ml
from cohort import operators as op
from cohort.models import classify, search
from cohort.models.encoding import WEIGHT, compress, counted
from cohort.models.forest import Trees
from cohort.models.nets import Nets
from cohort.operators.sample import _cuts, cuts_of_parts, order_hash
from cohort.plans import wide as wide_plan
from cohort.plans.catalog import Tables
from cohort.plans.source_tables import two_sources


def _rows(spark, n=400):
    a = F.concat(F.lit("k"), (F.col("id") % 6).cast("string"))
    return spark.range(n).select("id", a.alias("a"), F.when(F.col("id") % 6 < 3, "YES").otherwise("NO").alias("y"))


def test_counts_do_not_keep_the_tasks_of_a_shuffle(spark):
    few = counted(_rows(spark), ["y", "a"])
    assert few.rdd.getNumPartitions() == 1
    assert sorted(r[WEIGHT] for r in few.collect()) == [66.0, 66.0, 67.0, 67.0, 67.0, 67.0]


def test_rows_are_joined_to_few_tasks_before_they_meet_the_codes(spark, monkeypatch):
    seen, plain = [], PipelineModel.transform

    def transform(self, df, params=None):
        seen.append(df.rdd.getNumPartitions())
        return plain(self, df) if params is None else plain(self, df, params)

    monkeypatch.setattr(PipelineModel, "transform", transform)
    rows = _rows(spark).repartition(6, "id")
    for compressed in (True, False):
        seen.clear()
        fitted = ml.fit(rows, "y", ["a"], "rpart", compressed=compressed)
        assert seen == [1]
        assert fitted.predict(rows).filter("predicted <> y").count() == 0


def test_cuts_of_parts_are_those_of_each_part(spark):
    rows = spark.range(3000).select("id")
    (one,) = cuts_of_parts(rows, "id", [(None, "7", lambda n: n // 2)], fetch=1)
    assert one == _cuts(rows, "id", 7, lambda n: [n // 2])[1][0]
    inside = rows.filter(order_hash("id", 7) <= one)
    assert inside.count() == 1500
    parts = [(("7", one), "7t", lambda n: n // 5), (None, "7t", lambda n: n // 5), (None, "7t", lambda n: 0)]
    want = [_cuts(df, "id", "7t", lambda n: [n // 5])[1][0] for df in (inside, rows)]
    assert cuts_of_parts(rows, "id", parts, fetch=1) == [*want, ""]


@pytest.mark.parametrize("name, params", [("rforest", {"ntree": 3}), ("nnet", {"repeats": 1, "max_iter": 60})])
def test_many_rows_of_few_combinations_are_fitted_as_counts(spark, monkeypatch, name, params):
    monkeypatch.setattr(classify, "MANY_ROWS", 300)
    rows = _rows(spark)
    fitted = ml.fit(rows, "y", ["a"], name, **params)
    assert isinstance(fitted.members[0], (Trees, Nets))
    assert fitted.predict(rows).filter("predicted <> y").count() == 0
    # nearly as many combinations as rows: fitted on the rows
    plain = ml.fit(rows.withColumn("id", F.col("id").cast("double")), "y", ["id"], name, **params)
    assert not isinstance(plain.members[0], (Trees, Nets))


def test_folds_are_fitted_on_their_counts(spark, monkeypatch):
    seen, plain = [], search.fit

    def fit(train, *args, **kwargs):
        seen.append(train.count())
        return plain(train, *args, **kwargs)

    monkeypatch.setattr(search, "fit", fit)
    found = ml.cross_validate(_rows(spark), "id", "y", ["a"], "rpart", k=2).collect()
    assert seen == [6, 6] and [r["accuracy"] for r in found] == [1.0, 1.0]


def test_stages_of_the_wide_table_are_written_before_they_are_joined(spark):
    out = wide_plan.wide_table(*two_sources(Tables(spark, SMALL)))
    text = out._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("LogicalRDD") >= 8  # the cohort and seven stages


def _strata(spark):
    """Ids that come twice, some in two strata; strata without a drawn row; nulls."""
    once = spark.range(900).select(
        F.when(F.col("id") > 3, F.col("id") % 800).alias("id"),
        F.when(F.col("id") % 50 != 0, F.concat(F.lit("s"), (F.col("id") * 7 % 3).cast("string"))).alias("s"),
        F.when(F.col("id") % 9 > 3, "YES").when(F.col("id") % 9 > 0, "NO").alias("y"),
        (F.col("id") % 5).cast("string").alias("a"),
    )
    rare = spark.createDataFrame([(3 * i, "rare", "NO", "0") for i in range(4)], "id long, s string, y string, a string")
    return once.unionByName(rare).unionByName(once.filter("id > 100 AND id < 200").withColumn("s", F.lit("s1")))


def _spied(monkeypatch, note):
    """Let ``note`` see what the grid's fits and metrics are given."""
    for name, plain in (("fit", search.fit), ("binary_metrics", search.binary_metrics)):

        def spy(df, *rest, _name=name, _plain=plain, **more):
            note(_name, df, rest, more)
            return _plain(df, *rest, **more)

        monkeypatch.setattr(search, name, spy)


@pytest.mark.parametrize("strata, limits", [(["s"], (0.4, 1.0)), (["s", "y"], (0.4, 1.0)), (["s"], (1.0,))])
def test_cells_of_a_grid_hold_the_rows_drawn_one_by_one(spark, monkeypatch, strata, limits):
    rows, seeds, got = _strata(spark), (3, 8), []
    rows = rows if limits == (1.0,) else rows.filter("id IS NOT NULL")
    _spied(monkeypatch, lambda _, df, *__: got.append(bag(df.select("y", "a", WEIGHT))))
    ml.run_grid(rows, "id", "y", ["a"], limits, seeds, {"rpart": {}}, strata=strata, parallelism=1)
    want, both = [], 0
    for limit, seed in product(limits, seeds):
        part = rows if limit == 1 else op.sample_exact(rows, "id", limit, seed)
        test = op.sample_stratified(part, "id", strata, 0.2, f"{seed}t")
        train = op.exclude(part, test, "id")
        both += part.count() - train.count() - test.count()  # ids drawn in one stratum only
        want += [bag(compress(df, ["y", "a"])) for df in (train, test)]
    assert got == want and all(want) and both > 0


def test_forests_on_rows_get_the_rows_not_drawn(spark, monkeypatch):
    rows, got = _strata(spark), []
    _spied(monkeypatch, lambda name, df, *_: got.append(bag(df.select("y", "a"))) if name == "fit" else None)
    ml.run_grid(rows, "id", "y", ["a"], [1.0], [3], {"rforest": {"ntree": 2}}, strata=["s"])
    test = op.sample_stratified(rows, "id", ["s"], 0.2, "3t")
    assert got == [bag(op.exclude(rows, test, "id").select("y", "a"))]


def test_the_passes_of_a_grid_do_not_grow_with_its_cells(spark, monkeypatch):
    written, plain = [], search.checkpoint
    monkeypatch.setattr(search, "checkpoint", lambda df: written.append(df) or plain(df))
    sizes = []
    for limits, seeds in (([1.0], [3]), ([0.4, 0.7, 1.0], [3, 8])):
        written.clear()
        ml.run_grid(_rows(spark, 3000), "id", "y", ["a"], limits, seeds, {"rpart": {}}, strata=["y"])
        sizes.append(len(written))
    assert sizes[0] == sizes[1]


def test_a_grid_on_many_rows_fits_forests_on_its_counts(spark, monkeypatch):
    weights = []
    _spied(monkeypatch, lambda name, df, rest, more: weights.append(more["weight"]) if name == "fit" else None)
    models = {"rforest": {"ntree": 3}, "nnet": {"repeats": 1, "max_iter": 60}}
    for many in (10**6, 150):
        monkeypatch.setattr(classify, "MANY_ROWS", many)
        grid = ml.run_grid(_rows(spark), "id", "y", ["a"], [0.3, 1.0], [3], models, strata=["y"], parallelism=1)
        assert grid.filter("accuracy < 1").count() == 0
    assert weights == [None] * 4 + [None, None, WEIGHT, WEIGHT]


@pytest.mark.parametrize("limits", [(0.3, 1.0), (1.0,)])
def test_cuts_far_from_their_likely_place_are_found(spark, monkeypatch, limits):
    rows = _strata(spark).filter("id IS NOT NULL")
    grids = []
    for near in (0.0, 1.0):
        monkeypatch.setattr(search, "NEAR", near)
        grids.append(bag(ml.run_grid(rows, "id", "y", ["a"], limits, [3], {"rpart": {}}, strata=["s"])))
    assert grids[0] == grids[1]
