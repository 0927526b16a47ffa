"""Kernel machines, forests on counts, out-of-bag votes, permutation importance and averaged nets, with SQL.

Labels follow from one column with wide margins, so what a sound learner answers is known; the draws, votes and
permutations around it follow from digests and are counted again in SQL.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from .. import models as ml
from .. import operators as op
from .catalog import Tables, query
from .decided_queries import _SPLIT, _urgent

#: The grid of the reference's search: width 0.1 to 0.5 by 0.05, cost 2 to the power of 0.1, 1.1, 2.1.
GAMMAS = [round(0.1 + 0.05 * i, 2) for i in range(9)]
COSTS = [2**0.1, 2**1.1, 2**2.1]


def _rings(t: Tables) -> DataFrame:
    """Orders on two rings around one centre, the dear ones on the outer: no line parts them."""
    dear = F.col("o_totalprice") > 200_000
    angle = F.radians((F.col("o_custkey") % 360).cast("double"))
    radius = F.when(dear, 3.0).otherwise(1.0)
    return t.orders.select(
        "o_orderkey",
        (radius * F.cos(angle)).alias("x"),
        (radius * F.sin(angle)).alias("y"),
        F.when(dear, "YES").otherwise("NO").alias("outcome"),
    )


@query("svc_rings", _SPLIT)
def svc_rings(t: Tables) -> DataFrame:
    train, test = op.split(_rings(t), "o_orderkey", [0.8, 0.2], seed=300)
    fitted = ml.fit(train, "outcome", ["x", "y"], "svm", kernel="radial", gamma=0.5, cost=1.072, compressed=True)
    return ml.binary_metrics(fitted.predict(test), "predicted", "outcome")


_PARAMS = ", ".join(f"('cost={c}, gamma={g}, kernel=radial')" for g in GAMMAS for c in COSTS)


@query(
    "tune_rings",
    f"""
    SELECT 'svm' AS model, params, 1.0::double AS accuracy, 1.0::double AS ppv, 1.0::double AS npv, 1.0::double AS sensitivity, 1.0::double AS specificity
    FROM (VALUES {_PARAMS}) v(params) WHERE (SELECT count(DISTINCT o_totalprice > 200000) FROM orders) = 2
    """,
)
def tune_rings(t: Tables) -> DataFrame:
    grid = {"kernel": ["radial"], "gamma": GAMMAS, "cost": COSTS}
    return ml.tune(_rings(t), "outcome", ["x", "y"], "svm", grid, id_col="o_orderkey", compressed=True, parallelism=4)


@query(
    "fill_radial_decided",
    "SELECT p_partkey, p_brand, p_type, 'g' || right(p_brand, 1) AS line FROM part",
)
def fill_radial_decided(t: Tables) -> DataFrame:
    line = F.concat(F.lit("g"), F.right("p_brand", F.lit(1)))
    rows = t.part.select("p_partkey", "p_brand", "p_type", F.when(F.col("p_partkey") % 7 != 0, line).alias("line"))
    return ml.fill_by_model(rows, "line", ["p_brand"], "svm", kernel="radial", gamma=0.5, cost=10.0, max_iter=50)


_SCREENED = {
    "constant": "'same'",
    "first": "o_orderpriority < '2'",
    "o_orderpriority": "o_orderpriority",
}


@query(
    "screen_decided",
    f"""
    WITH r AS (SELECT *, CASE WHEN o_orderpriority < '3' THEN 'YES' ELSE 'NO' END AS outcome,
                      row_number() OVER (ORDER BY md5('10|' || o_orderkey)) <= floor(count(*) OVER () * 0.2) AS held FROM orders),
         l AS ({" UNION ALL ".join(f"SELECT '{c}' AS col, ({e})::varchar AS v, outcome, held FROM r" for c, e in _SCREENED.items())}),
         m AS (SELECT col, v, mode(outcome) AS p FROM l WHERE NOT held GROUP BY 1, 2),
         a AS (SELECT col, avg((p = outcome)::int) AS accuracy FROM l JOIN m USING (col, v) WHERE held GROUP BY 1),
         prior AS (SELECT avg((outcome = 'YES')::int) AS prior FROM r WHERE NOT held)
    SELECT col AS "column", 'rforest' AS model, round(accuracy, 8) AS accuracy, round(prior, 8) AS prior, accuracy >= prior AS kept FROM a CROSS JOIN prior
    """,
)
def screen_decided(t: Tables) -> DataFrame:
    rows = _urgent(t).withColumn("first", (F.col("o_orderpriority") < "2").cast("string"))
    train, test = op.split(rows, "o_orderkey", [0.8, 0.2], seed=10)
    out = ml.screen_columns(train, test, "outcome", list(_SCREENED), ["rforest"], params={"rforest": {"ntree": 5}})
    return out.withColumns({c: F.round(c, 8) for c in ("accuracy", "prior")})


TREES = 10


def _forest(t: Tables, features: list[str], **params):
    rows = _urgent(t)
    return rows, ml.fit(rows, "outcome", features, "rforest", 1, id_col="o_orderkey", ntree=TREES, depth=5, **params)


#: Rows that tree ``t`` of a forest of seed 1 is grown without.
_UNSEEN = f"('0x' || substr(md5('1-' || t || '|' || o_orderkey), 1, 12))::bigint / 281474976710656.0 < {math.exp(-1)!r}::double"
_OUTCOME = "CASE WHEN o_orderpriority < '3' THEN 'YES' ELSE 'NO' END"


@query(
    "oob_votes",
    f"""
    WITH v AS (SELECT o_orderkey, {_OUTCOME} AS outcome, count(*) FILTER ({_UNSEEN}) AS n FROM orders, range({TREES}) r(t) GROUP BY ALL)
    SELECT o_orderkey, outcome, (CASE outcome WHEN 'NO' THEN n ELSE 0 END)::int AS no_votes, (CASE outcome WHEN 'YES' THEN n ELSE 0 END)::int AS yes_votes,
           CASE WHEN n > 0 THEN outcome END AS predicted FROM v
    """,
)
def oob_votes(t: Tables) -> DataFrame:
    rows, fitted = _forest(t, ["o_orderpriority", "constant"], mtry=2)
    votes = ml.oob_votes(fitted, rows, "outcome", "o_orderkey")
    each = [F.get("votes", F.lit(k)).alias(f"{level.lower()}_votes") for k, level in enumerate(fitted.levels)]
    return votes.select("o_orderkey", "outcome", *each, "predicted")


@query(
    "importance_permuted",
    f"""
    WITH r AS (SELECT o_orderkey, {_OUTCOME} AS outcome, row_number() OVER (ORDER BY md5('1a|' || o_orderkey)) AS here,
                      row_number() OVER (ORDER BY md5('1b|' || o_orderkey)) AS there FROM orders),
         d AS (SELECT a.o_orderkey, a.outcome <> b.outcome AS wrong FROM r a JOIN r b ON a.here = b.there),
         drops AS (SELECT t, count(*) FILTER (wrong) / count(*) AS loss FROM d, range({TREES}) g(t) WHERE {_UNSEEN} GROUP BY 1)
    SELECT 'o_orderpriority' AS feature, round(avg(loss), 8) AS decrease, round(avg(loss) / (stddev_samp(loss) / sqrt({TREES})), 6) AS z FROM drops
    UNION ALL SELECT 'constant', 0.0::double, NULL
    """,
)
def importance_permuted(t: Tables) -> DataFrame:
    rows, fitted = _forest(t, ["o_orderpriority", "constant"], mtry=2)
    found = ml.permuted_importance(fitted, rows, "outcome", "o_orderkey")
    return found.withColumns({"decrease": F.round("decrease", 8), "z": F.round("z", 6)})


_NOISY = "CASE WHEN (o_orderpriority < '3') <> (o_orderkey % 5 = 0) THEN 'YES' ELSE 'NO' END"


@query(
    "mtry_search",
    f"""
    WITH n AS (SELECT o_orderkey, o_orderpriority, {_NOISY} AS outcome FROM orders),
         m AS (SELECT o_orderpriority, mode(outcome) AS p FROM n GROUP BY 1),
         e AS (SELECT round(avg((p <> outcome)::int), 8) AS error FROM n JOIN m USING (o_orderpriority)
               WHERE EXISTS (SELECT 1 FROM range({TREES}) r(t) WHERE {_UNSEEN}))
    SELECT step, mtry, error, step = 1 AS best FROM e, (VALUES (1::int, 1::int), (2::int, 2::int)) v(step, mtry)
    """,
)
def mtry_search(t: Tables) -> DataFrame:
    """Three columns that say the same: the error is that of the noise, whatever a split may choose from."""
    flipped = (F.col("o_orderpriority") < "3") != (F.col("o_orderkey") % 5 == 0)
    same = {f"same{i}": F.col("o_orderpriority") for i in range(2)}
    rows = t.orders.select("o_orderkey", "o_orderpriority", F.when(flipped, "YES").otherwise("NO").alias("outcome")).withColumns(same)
    found = ml.tune_mtry(rows, "outcome", ["o_orderpriority", *same], "o_orderkey", start=1, ntree=TREES, depth=6)
    return found.withColumn("error", F.round("error", 8))


@query("nets_separable", _SPLIT)
def nets_separable(t: Tables) -> DataFrame:
    """Seventy nets of three units with decay, as the reference settles on."""
    dear = F.col("o_totalprice") > 200_000
    rows = t.orders.select(
        "o_orderkey",
        F.when(dear, "dear").when(F.col("o_totalprice") > 100_000, "middle").otherwise("cheap").alias("price"),
        F.when(dear, "YES").otherwise("NO").alias("outcome"),
    )
    train, test = op.split(rows, "o_orderkey", [0.8, 0.2], seed=300)
    fitted = ml.fit(train, "outcome", ["price"], "nnet", repeats=70, size=3, decay=0.1, compressed=True)
    return ml.binary_metrics(fitted.predict(test), "predicted", "outcome")
