"""Kernel machines, forests that draw by digest, averaged nets, and the plan-level checks and stores around them."""

import math

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from conftest import bag
from cohort import models as ml
from cohort import operators as op
from cohort import sources as src
from cohort.models import forest, kernel, nets, rounds
from cohort.models.kernel import FourierFeatures
from cohort.plans import wide
from cohort.plans.catalog import Tables
from cohort.plans.source_tables import two_sources
from test_plans import plan

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rings(spark):
    rows = spark.range(400).select("id", F.radians((F.col("id") * 37 % 360).cast("double")).alias("a"), (F.col("id") % 3).alias("k"))
    radius = F.col("k") * 2 + 1.0
    return rows.select("id", (radius * F.cos("a")).alias("x"), (radius * F.sin("a")).alias("y"), F.concat(F.lit("ring"), "k").alias("ring")).cache()


@pytest.fixture(scope="module")
def urgent(spark):
    rows = spark.range(800).select("id", (F.xxhash64("id") % 5).alias("p"))
    return rows.select("id", F.concat(F.lit("p"), "p").alias("p"), F.lit("same").alias("constant"), F.when(F.col("p") > 0, "YES").otherwise("NO").alias("y")).cache()


# --- kernel machines


def test_cosines_approach_the_kernel(frame):
    from pyspark.ml.functions import array_to_vector, vector_to_array

    points = np.array([[0.0, 0.0], [1.0, 0.5], [-2.0, 1.0]])
    df = frame([(i, p.tolist()) for i, p in enumerate(points)], "i int, x array<double>").withColumn("__x", array_to_vector("x"))
    got = FourierFeatures(gamma=0.3, n=20_000, seed=4).transform(df).select("i", vector_to_array("__x").alias("z")).orderBy("i")
    z = np.array([r.z for r in got.collect()])
    want = np.exp(-0.3 * ((points[:, None] - points[None]) ** 2).sum(2))
    assert np.abs(z @ z.T - want).max() < 0.03


def test_radial_machines_part_rings_where_linear_ones_fail(rings):
    def accuracy(**params):
        fitted = ml.fit(rings, "ring", ["x", "y"], "svm", cost=10.0, max_iter=20, **params)
        scored = fitted.predict(rings)
        assert scored.columns == [*rings.columns, "predicted"]
        return scored.agg(F.avg((F.col("ring") == F.col("predicted")).cast("int"))).first()[0]

    assert accuracy(kernel="radial", gamma=0.5) == 1.0
    assert accuracy() < 0.7


def test_votes_go_pair_by_pair_and_ties_to_the_first(frame):
    rows = [(c, c * 1.0, c) for c in range(4) for _ in range(5)]
    df = frame(rows, "i int, x double, c int").select("x", F.col("c").cast("string").alias("c"))
    fitted = ml.fit(df.withColumn("g", F.concat(F.lit("g"), "c")), "c", ["g"], "svm", cost=10.0, max_iter=15)
    machines = fitted.members[0]
    assert machines.pairs == [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)]
    assert fitted.predict(df.withColumn("g", F.concat(F.lit("g"), "c"))).filter("c != predicted").count() == 0


def test_missing_numbers_get_no_vote(rings, frame):
    fitted = ml.fit(rings, "ring", ["x", "y"], "svm", kernel="radial")
    got = fitted.predict(frame([(None, 1.0), (0.0, 1.0)], "x double, y double")).collect()
    assert got[0].predicted is None and got[1].predicted in {"ring0", "ring1", "ring2"}


def test_gradients_of_the_machines():
    rng = np.random.default_rng(1)
    x, y, w = rng.normal(size=(30, 4)), rng.integers(0, 3, 30), rng.uniform(0.5, 2, 30)
    sides = np.array([[-1, -1, 0], [1, 0, -1], [0, 1, 1.0]])
    points = rng.normal(size=(3, 5))
    _, grad = kernel.hinges(x, y, w, points, sides, 1.5)
    for i in range(5):
        step = np.zeros(5)
        step[i] = 1e-6
        slope = (kernel.hinges(x, y, w, points + step, sides, 1.5)[0] - kernel.hinges(x, y, w, points - step, sides, 1.5)[0]) / 2e-6
        assert grad[:, i] == pytest.approx(slope, abs=1e-4)


# --- forests


def test_poisson_counts_have_mean_and_variance_of_the_weight(spark):
    for weight in (1.0, 4.0, 500.0, 3e9):
        drawn = spark.range(6000).select(op.poisson_copies(F.col("id"), F.lit(weight), "s").alias("n"))
        r = drawn.agg(F.avg("n").alias("m"), F.var_samp("n").alias("v"), F.min("n").alias("low")).first()
        assert r.m == pytest.approx(weight, rel=5 / math.sqrt(6000 * min(weight, 100))) and r.low >= 0
        assert r.v == pytest.approx(weight, rel=0.1)
    same = spark.range(300).select(op.poisson_copies(F.col("id"), F.lit(1.0), 1).alias("n"), op.left_out("id", 1).alias("out"))
    assert same.filter("(n = 0) != out").count() == 0


def test_forests_on_counts_take_any_weight(frame):
    rows = [("a", "YES", 3e9), ("a", "NO", 10.0), ("b", "NO", 3e9), ("b", "YES", 5.0), ("c", "NO", 1.0)]
    counted = frame(rows, "g string, y string, w double")
    fitted = ml.fit(counted, "y", ["g"], "rforest", weight="w", ntree=10)
    assert len(fitted.members[0].models) == 10
    got = {r.g: r.predicted for r in fitted.predict(counted).collect()}
    assert got["a"] == "YES" and got["b"] == "NO"


def test_trees_differ_and_repeat(spark):
    noise = spark.range(300).select("id", F.concat(F.lit("g"), F.col("id") % 7).alias("g"), F.when(F.xxhash64("id") % 2 == 0, "YES").otherwise("NO").alias("y"))
    counted = noise.groupBy("g", "y").agg(F.count(F.lit(1)).alias("w"))

    def grown(df, **how):
        return [t.toDebugString.split("\n", 1)[1] for t in ml.fit(df, "y", ["g"], "rforest", ntree=10, **how).members[0].trees]

    first = grown(counted, weight="w")
    assert len(set(first)) > 5 and first == grown(counted.repartition(3), weight="w")
    assert len(set(grown(noise, id_col="id"))) > 5


def test_a_handful_of_rows_is_enough(frame):
    rows = frame([(1, "a", "YES"), (2, "b", "NO"), (3, "c", "NO")], "id int, g string, y string")
    fitted = ml.fit(rows, "y", ["g"], "rforest", id_col="id", ntree=8)
    assert fitted.predict(rows).filter("predicted is null").count() == 0
    votes = ml.oob_votes(fitted, rows, "y", "id")
    assert votes.count() == 3 and set(votes.columns) == {"id", "y", "votes", "predicted"}


def test_out_of_bag_rows_are_those_a_tree_never_drew(urgent):
    fitted = ml.fit(urgent, "y", ["p", "constant"], "rforest", 3, id_col="id", ntree=6, mtry=2)
    trees = fitted.members[0]
    drawn = urgent.select(*[op.poisson_copies(F.col("id"), F.lit(1.0), f"3-{i}").alias(f"n{i}") for i in range(6)], F.array(*trees.unseen("id")).alias("out"))
    assert drawn.filter(" or ".join(f"(n{i} = 0) != out[{i}]" for i in range(6))).count() == 0
    votes = ml.oob_votes(fitted, urgent, "y", "id")
    total = votes.agg(F.sum(F.expr("votes[0] + votes[1]"))).first()[0]
    assert total == sum(drawn.agg(F.sum(F.expr(f"cast(out[{i}] as int)"))).first()[0] for i in range(6))
    assert ml.oob_error(fitted, urgent, "y", "id") == 0


def test_forests_without_digests_tell_no_out_of_bag_votes(urgent):
    with pytest.raises(ValueError):
        ml.oob_votes(ml.fit(urgent, "y", ["p"], "rforest", ntree=2), urgent, "y", "id")


def test_permuting_hurts_only_what_informs(urgent):
    fitted = ml.fit(urgent, "y", ["p", "constant"], "rforest", id_col="id", ntree=5, mtry=2)
    got = {r.feature: r for r in ml.permuted_importance(fitted, urgent, "y", "id").collect()}
    assert got["p"].decrease > 0.2 and got["p"].z > 0
    assert got["constant"].decrease == 0 and got["constant"].z is None


def test_the_search_goes_both_ways(urgent, monkeypatch):
    errors = {4: 0.4, 2: 0.3, 1: 0.29, 8: 0.1, 9: 0.05}
    monkeypatch.setattr("cohort.models.classify.fit", lambda *a, mtry, **k: type("Fake", (), {"members": [1], "mtry": mtry}))
    monkeypatch.setattr(forest, "oob_error", lambda fitted, *a: errors[fitted.mtry])
    columns = [f"c{i}" for i in range(9)]
    got = ml.tune_mtry(urgent, "y", columns, "id", start=4).orderBy("step").collect()
    assert [(r.mtry, r.best) for r in got] == [(4, False), (2, False), (1, False), (8, False), (9, True)]
    wide_step = ml.tune_mtry(urgent, "y", columns, "id", start=4, step_factor=0.45).orderBy("step").collect()
    assert [r.mtry for r in wide_step] == [4, 9, 1]


# --- nets


def test_gradients_of_the_nets():
    rng = np.random.default_rng(0)
    x, y, w = rng.normal(size=(20, 4)), rng.integers(0, 3, 20), rng.uniform(0.5, 2, 20)
    n = 4 * 5 + 5 + 5 * 3 + 3
    points = rng.normal(size=(2, n))
    _, grad = nets.loss_and_gradient(x, y, w, points, 5, 3)
    for i in range(n):
        step = np.zeros(n)
        step[i] = 1e-6
        slope = (nets.loss_and_gradient(x, y, w, points + step, 5, 3)[0] - nets.loss_and_gradient(x, y, w, points - step, 5, 3)[0]) / 2e-6
        assert grad[:, i] == pytest.approx(slope, abs=1e-4)


def test_the_descent_finds_a_known_minimum():
    search = rounds.descend(np.array([-1.2, 1.0]), 200, 1e-14)
    w = next(search)
    while True:
        a, b = w
        value = 100 * (b - a * a) ** 2 + (1 - a) ** 2
        grad = np.array([-400 * a * (b - a * a) - 2 * (1 - a), 200 * (b - a * a)])
        try:
            w = search.send((value, grad))
        except StopIteration as stop:
            assert stop.value == pytest.approx([1, 1], abs=1e-4)
            break


def test_decay_shrinks_and_without_it_nets_learn(urgent):
    free = ml.fit(urgent, "y", ["p", "constant"], "nnet", repeats=4, decay=0.0, max_iter=60)
    assert free.predict(urgent).filter("y != predicted").count() == 0
    tied = ml.fit(urgent, "y", ["p", "constant"], "nnet", repeats=4, decay=1e7, max_iter=60)
    assert np.abs(free.members[0].points).max() > 1 and np.abs(tied.members[0].points).max() < 1e-3


def test_counts_and_rows_give_the_same_nets(urgent):
    rows = ml.fit(urgent, "y", ["p"], "nnet", repeats=3, decay=0.5, max_iter=40).members[0].points
    counts = ml.fit(urgent, "y", ["p"], "nnet", repeats=3, decay=0.5, max_iter=40, compressed=True).members[0].points
    assert np.abs(rows - counts).max() < 1e-3


def test_sums_of_many_tasks_are_added_in_two_steps(urgent, monkeypatch):
    monkeypatch.setattr("cohort.models.classify.ROWS_PER_TASK", 20)
    many = ml.fit(urgent.repartition(40), "y", ["p"], "nnet", repeats=2, decay=0.5, max_iter=10).members[0].points
    monkeypatch.undo()
    one = ml.fit(urgent, "y", ["p"], "nnet", repeats=2, decay=0.5, max_iter=10).members[0].points
    assert np.abs(many - one).max() < 1e-6


# --- loops


def test_the_grid_is_the_product_and_repeats(urgent):
    models = {"rpart": {}, "nnet": {"repeats": 2, "decay": 0.1, "max_iter": 20}, "svm": {"kernel": "radial"}}
    grid = ml.run_grid(urgent, "id", "y", ["p"], [0.5, 1], [10, 20], models, strata=["y"])
    assert grid.count() == 12 and grid.filter("accuracy < 0.99").count() == 0


def test_tuning_on_counts_equals_tuning_on_rows(urgent):
    both = [ml.tune(urgent, "y", ["p"], "rpart", {"depth": [1, 4]}, id_col="id", compressed=c) for c in (True, False)]
    assert bag(both[0]) == bag(both[1])


# --- dictionary, uniqueness, staging, log


def test_a_dictionary_of_a_million_values_stays_distributed(spark):
    df = spark.range(0, 1_000_000, 1, 8).select(F.format_string("v%07d", F.col("id") * 7919 % 1_000_000).alias("x"), "id")
    coded, levels = src.encode(df.unionByName(df.limit(5)), ["x"])
    r = coded.agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("x_code") != F.substring("x", 2, 7).cast("double")).cast("int")).alias("wrong")).first()
    assert r.n == 1_000_005 and r.wrong == 0
    other = src.apply_dictionary(spark.sql("SELECT 'v0000003' AS x UNION ALL SELECT 'new' UNION ALL SELECT NULL"), levels, ["x"])
    assert sorted(r.x_code for r in other.collect()) == [3.0, 1_000_000.0, 1_000_000.0]


def test_dictionaries_of_odd_columns(frame):
    df = frame([(None, "b", True), ("", "a", None), ("", "a", False), ("é", None, True)], "x string, value string, column boolean")
    coded, levels = src.encode(df, ["x", "value", "column"])
    assert bag(levels) == [("column", "false", 0), ("column", "true", 1), ("value", "a", 0), ("value", "b", 1), ("x", "", 0), ("x", "é", 1)]
    assert bag(coded.select("x_code", "value_code", "column_code")) == [(0.0, 0.0, 0.0), (0.0, 0.0, 2.0), (1.0, 2.0, 1.0), (2.0, 1.0, 1.0)]
    assert src.encode(df.limit(0), ["x"])[0].count() == 0


def test_numbers_run_through_each_group(frame):
    df = frame([("a", 3), ("a", 1), (None, 5), ("a", 1), (None, 4), ("", 9)], "g string, v int")
    assert bag(op.number_rows(df, "g", "v")) == sorted([("a", 1, 0), ("a", 1, 1), ("a", 3, 2), (None, 4, 0), (None, 5, 1), ("", 9, 0)], key=repr)


def test_uniqueness_is_checked_in_the_run(frame):
    fine = frame([(1, "a"), (2, "b"), (None, "c")], "k int, v string")
    assert bag(op.unique_rows(fine, "k")) == bag(fine)
    twice = op.unique_rows(fine.unionByName(fine), "k", "v")
    with pytest.raises(PySparkException, match="k, v.*not unique"):
        twice.collect()


def test_the_wide_table_computes_each_stage_once(spark):
    sources = two_sources(Tables(spark, SMALL))
    scans = [plan(wide.wide_table(*sources, check=c)).count("FileScan") for c in (False, True)]
    assert scans[0] == scans[1]

    def jobs(check):
        group = f"wide-{check}"
        spark.sparkContext.setJobGroup(group, "")
        wide.wide_table(*sources, check=check)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    assert jobs(True) == jobs(False)
    one, two = sources
    repeated = two | {"enc_suspect_id": two["enc_suspect_id"].unionByName(two["enc_suspect_id"].withColumn("FEVER", F.lit("other")))}
    with pytest.raises(PySparkException, match="PatientID.*not unique"):
        wide.wide_table(one, repeated, check=True).write.format("noop").mode("overwrite").save()


def test_staged_tables_join_without_exchange(spark):
    from cohort.plans import relation_queries

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(relation_queries.staged_star(Tables(spark, SMALL)))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Exchange" not in text.replace("BroadcastExchange", "") and "SortMergeJoin" in text


def test_a_repeated_run_replaces_itself(frame, spark, tmp_path):
    path = str(tmp_path / "log")
    src.log_metrics(frame([(1, 0.5)], "step int, accuracy double"), path, "a")
    src.log_metrics(frame([(1, 0.6)], "step int, accuracy double"), path, "b", stamp=False)
    src.log_metrics(frame([(1, 0.7), (2, 0.8)], "step int, accuracy double"), path, "a")
    rows = spark.read.parquet(path)
    assert bag(rows.select("run", "step", "accuracy")) == [("a", 1, 0.7), ("a", 2, 0.8), ("b", 1, 0.6)]
    assert rows.filter("logged_at is null").count() == 1
