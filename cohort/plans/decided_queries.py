"""Learners on data that decides their answer, with exact SQL counterparts.

Orders fall into two classes with a wide gap between their prices, so any separating learner scores every
test row right; well-separated groups have their averages as cluster centres; a column that decides the
label has all the importance.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import models as ml
from .. import operators as op
from .catalog import Tables, query

_SPLIT = """
    WITH r AS (SELECT CASE WHEN o_totalprice > 200000 THEN 'YES' ELSE 'NO' END AS outcome,
                      row_number() OVER (ORDER BY md5('300|' || o_orderkey)) AS rn, count(*) OVER () AS n FROM orders)
    SELECT count(*) FILTER (outcome = 'NO')::bigint AS tp, 0::bigint AS fn, 0::bigint AS fp,
           count(*) FILTER (outcome = 'YES')::bigint AS tn, 1.0::double AS accuracy, 1.0::double AS ppv, 1.0::double AS npv,
           1.0::double AS sensitivity, 1.0::double AS specificity
    FROM r WHERE rn <= floor(n * 0.2)
"""


def _separable(t: Tables, name: str, **params) -> DataFrame:
    dear = F.col("o_totalprice") > 200_000
    rows = t.orders.select(
        "o_orderkey",
        (F.col("o_totalprice") + F.when(dear, 500_000.0).otherwise(0.0)).alias("price"),
        F.when(dear, "YES").otherwise("NO").alias("outcome"),
    )
    train, test = op.split(rows, "o_orderkey", [0.8, 0.2], seed=300)
    fitted = ml.fit(train, "outcome", ["price"], name, seed=300, **params)
    return ml.binary_metrics(fitted.predict(test), "predicted", "outcome")


@query("svc_separable", _SPLIT)
def svc_separable(t: Tables) -> DataFrame:
    return _separable(t, "svm", max_iter=100)


@query("mlp_separable", _SPLIT)
def mlp_separable(t: Tables) -> DataFrame:
    return _separable(t, "nnet", repeats=2)


@query("logit_separable", _SPLIT)
def logit_separable(t: Tables) -> DataFrame:
    return _separable(t, "glm")


@query(
    "kmeans_separated",
    "SELECT round(avg(p_size % 3 * 1000 + p_size / 100.0), 6) AS centre FROM part GROUP BY p_size % 3",
)
def kmeans_separated(t: Tables) -> DataFrame:
    points = t.part.select((F.col("p_size") % 3 * 1000 + F.col("p_size") / 100.0).alias("v"))
    return t.spark.createDataFrame([(round(c, 6),) for c in ml.kmeans_1d(points, "v", 3)], "centre double")


def _urgent(t: Tables) -> DataFrame:
    return t.orders.select(
        "o_orderkey",
        "o_orderpriority",
        F.lit("same").alias("constant"),
        F.when(F.col("o_orderpriority") < "3", "YES").otherwise("NO").alias("outcome"),
    )


@query(
    "importance_decided",
    """SELECT * FROM (VALUES ('o_orderpriority', 1.0::double), ('constant', 0.0::double)) v(feature, importance)
    WHERE (SELECT count(DISTINCT o_orderpriority < '3') FROM orders) = 2""",
)
def importance_decided(t: Tables) -> DataFrame:
    fitted = ml.fit(_urgent(t), "outcome", ["o_orderpriority", "constant"], "rforest", ntree=10, depth=5)
    return t.spark.createDataFrame(ml.importance(fitted), "feature string, importance double")


@query(
    "forward_decided",
    """SELECT 1::int AS step, 'o_orderpriority' AS "column", avg((p = outcome)::int)::double AS accuracy, true AS kept
    FROM (SELECT CASE WHEN o_orderpriority < '3' THEN 'YES' ELSE 'NO' END AS outcome,
                 CASE WHEN o_orderpriority < '3' THEN 'YES' ELSE 'NO' END AS p FROM orders)""",
)
def forward_decided(t: Tables) -> DataFrame:
    train, test = op.split(_urgent(t), "o_orderkey", [0.8, 0.2], seed=10)
    return ml.forward_select(train, test, "outcome", ["constant"], ["o_orderpriority"], name="rpart")


@query(
    "fill_bad_decided",
    """SELECT l_orderkey, l_linenumber, l_returnflag, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END::int AS code
    FROM lineitem""",
)
def fill_bad_decided(t: Tables) -> DataFrame:
    code = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 2).otherwise(3)
    rows = t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_returnflag", F.when(F.col("l_linenumber") > 5, 99).otherwise(code).alias("code")
    )
    return ml.fill_by_model(rows, "code", ["l_returnflag"], "rpart", bad=F.col("code") > 20)


@query(
    "fill_forest_decided",
    "SELECT p_partkey, p_brand, 'g' || right(p_brand, 1) AS line FROM part",
)
def fill_forest_decided(t: Tables) -> DataFrame:
    line = F.concat(F.lit("g"), F.right("p_brand", F.lit(1)))
    rows = t.part.select("p_partkey", "p_brand", F.when(F.col("p_partkey") % 7 != 0, line).alias("line"))
    return ml.fill_by_model(rows, "line", ["p_brand"], "rforest", ntree=10)
