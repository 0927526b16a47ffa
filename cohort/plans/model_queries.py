"""Model fits on the test tables. Their results are not expressible in SQL, so they have no counterpart."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import functions as fn
from .. import models as ml
from .. import operators as op
from ..sizing import checkpoint
from .catalog import Tables, holed, query

FEATURES = ["l_returnflag", "size_group", "discount", "p_type"]


def outcome_rows(t: Tables) -> DataFrame:
    """A binary outcome per line: late against early lines, with text and numeric features."""
    lines = t.lineitem.groupBy("l_orderkey", "l_partkey").agg(
        F.min("l_returnflag").alias("l_returnflag"),
        F.sum("l_quantity").alias("quantity"),
        F.avg("l_discount").alias("discount"),
    )
    parts = t.part.select("p_partkey", "p_size", "p_type")
    rows = op.inner(lines, parts, {"l_partkey": "p_partkey"})
    noisy = F.col("quantity") + F.col("p_size") + F.when(F.col("l_returnflag") == "R", 15).otherwise(0)
    return rows.select(
        F.concat_ws("-", "l_orderkey", "l_partkey").alias("id"),
        "l_returnflag",
        fn.bucketize("p_size", [10, 20, 30, 40], ["A", "B", "C", "D", "E"]).alias("size_group"),
        "discount",
        "p_type",
        F.when(noisy > 55, "YES").otherwise("NO").alias("outcome"),
    )


def kept_rows(t: Tables) -> DataFrame:
    """The same written out once: splits, fits and scores read them many times."""
    return checkpoint(outcome_rows(t))


def _scored(t: Tables, name: str, **params) -> DataFrame:
    train, test = op.split(kept_rows(t), "id", [0.8, 0.2], seed=300)
    fitted = ml.fit(train, "outcome", FEATURES, name, seed=300, **params)
    return ml.binary_metrics(fitted.predict(test), "predicted", "outcome")


@query("logit")
def logit(t: Tables) -> DataFrame:
    return _scored(t, "glm")


@query("forest")
def forest(t: Tables) -> DataFrame:
    return _scored(t, "rforest", ntree=20, depth=5)


@query("svc")
def svc(t: Tables) -> DataFrame:
    return _scored(t, "svm", cost=1.072)


@query("mlp_avg")
def mlp_avg(t: Tables) -> DataFrame:
    return _scored(t, "nnet", repeats=2, size=3, max_iter=40)


@query("tree")
def tree(t: Tables) -> DataFrame:
    return _scored(t, "rpart")


@query("analyze")
def analyze(t: Tables) -> DataFrame:
    train, test = op.split(kept_rows(t), "id", [0.8, 0.2], seed=300)
    accuracy = ml.analyze(train, test, "outcome", FEATURES, "glm")
    return t.spark.createDataFrame([("glm", accuracy)], "model string, accuracy double")


@query("importance")
def importance(t: Tables) -> DataFrame:
    fitted = ml.fit(outcome_rows(t), "outcome", FEATURES, "rforest", ntree=10, depth=5)
    return t.spark.createDataFrame(ml.importance(fitted), "feature string, importance double")


@query("kmeans_bins")
def kmeans_bins(t: Tables) -> DataFrame:
    centres = ml.kmeans_1d(t.part, "p_size", 5)
    return t.spark.createDataFrame([(c,) for c in centres], "centre double")


@query("model_fill_tree")
def model_fill_tree(t: Tables) -> DataFrame:
    rows = outcome_rows(t).withColumn("outcome", F.when(F.xxhash64("id") % 7 != 0, F.col("outcome")))
    return ml.fill_by_model(rows, "outcome", ["l_returnflag", "size_group", "p_type"], "rpart")


@query("model_fill_forest")
def model_fill_forest(t: Tables) -> DataFrame:
    rows = t.part.select("p_partkey", "p_type", "p_brand", holed("p_size", "p_partkey").alias("p_size"))
    grouped = fn.bucketize("p_size", [10, 20, 30, 40], ["A", "B", "C", "D", "E"])
    return ml.fill_by_model(rows.withColumn("size_group", grouped), "size_group", ["p_type", "p_brand"], "rforest", ntree=10)


@query("model_fill_bad")
def model_fill_bad(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_orderkey", "l_returnflag", "l_linestatus", "l_linenumber")
    return ml.fill_by_model(rows, "l_linenumber", ["l_returnflag", "l_linestatus"], "rpart", bad=F.col("l_linenumber") > 5)


@query("screen_columns")
def screen_columns(t: Tables) -> DataFrame:
    train, test = op.split(kept_rows(t), "id", [0.8, 0.2], seed=10)
    return ml.screen_columns(train, test, "outcome", FEATURES, params={"rforest": {"ntree": 10}})


@query("forward_select")
def forward_select(t: Tables) -> DataFrame:
    train, test = op.split(kept_rows(t), "id", [0.8, 0.2], seed=10)
    return ml.forward_select(train, test, "outcome", ["l_returnflag"], ["p_type", "size_group", "discount"], name="glm")


@query("tune_grid")
def tune_grid(t: Tables) -> DataFrame:
    train, cv, _ = op.split(kept_rows(t), "id", [0.6, 0.2, 0.2], seed=10)
    return ml.tune(train, "outcome", FEATURES, "rforest", {"mtry": [1, 2, 3, 4], "ntree": [20]}, cv=cv)


@query("tune_bootstrap")
def tune_bootstrap(t: Tables) -> DataFrame:
    train, _ = op.split(kept_rows(t), "id", [0.8, 0.2], seed=10)
    return ml.tune(train, "outcome", FEATURES, "svm", {"cost": [0.5, 1.072]}, id_col="id")


@query("cross_validate")
def cross_validate(t: Tables) -> DataFrame:
    return ml.cross_validate(outcome_rows(t), "id", "outcome", FEATURES, "rpart", k=5)


@query("run_grid")
def run_grid(t: Tables) -> DataFrame:
    """Three shares, four seeds and three models, as the reference runs them."""
    models = {"svm": {"kernel": "radial"}, "rforest": {"ntree": 20}, "nnet": {"size": 5, "repeats": 10, "decay": 0.001}}
    features = ["l_returnflag", "size_group", "discount"]
    return ml.run_grid(outcome_rows(t), "id", "outcome", features, models=models, strata=["outcome"])
