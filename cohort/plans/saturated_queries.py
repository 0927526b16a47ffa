"""Model queries with an exact SQL counterpart.

With one categorical feature a tree, an unbagged forest and a logistic regression all end at the
majority class of each category, which SQL can compute; so splits, fits, fills, metrics and loops
are checked value by value here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import models as ml
from .. import operators as op
from .catalog import Tables, holed, query
from .model_queries import kept_rows, outcome_rows

_OUTCOME = """
    o AS (
        SELECT l_orderkey || '-' || l_partkey AS id, flag AS l_returnflag, p_type,
               CASE WHEN p_size < 10 THEN 'A' WHEN p_size < 20 THEN 'B' WHEN p_size < 30 THEN 'C' WHEN p_size < 40 THEN 'D' ELSE 'E' END AS size_group,
               CASE WHEN quantity + p_size + CASE WHEN flag = 'R' THEN 15 ELSE 0 END > 55 THEN 'YES' ELSE 'NO' END AS outcome
        FROM (SELECT l_orderkey, l_partkey, min(l_returnflag) AS flag, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1, 2)
        JOIN part ON l_partkey = p_partkey)
"""
_MAJORITY = "CASE WHEN count(*) FILTER (outcome = 'YES') > count(*) FILTER (outcome = 'NO') THEN 'YES' ELSE 'NO' END"
_CELLS = """count(*) FILTER (p = 'NO' AND outcome = 'NO') AS tp, count(*) FILTER (p = 'YES' AND outcome = 'NO') AS fn,
    count(*) FILTER (p = 'NO' AND outcome = 'YES') AS fp, count(*) FILTER (p = 'YES' AND outcome = 'YES') AS tn"""
_RATIOS = """round((tp + tn) / (tp + fn + fp + tn), 8) AS accuracy, round(tp / nullif(tp + fp, 0), 8) AS ppv, round(tn / nullif(tn + fn, 0), 8) AS npv,
    round(tp / nullif(tp + fn, 0), 8) AS sensitivity, round(tn / nullif(tn + fp, 0), 8) AS specificity"""


def _ranked(seed: str, rows: str = "o") -> str:
    return f"SELECT *, row_number() OVER (ORDER BY md5('{seed}|' || id)) AS rn, count(*) OVER () AS n FROM {rows}"


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 8) for c in df.columns if df.schema[c].dataType.typeName() == "double"})


_COLUMNS = ["l_returnflag", "size_group", "p_type"]
_LONG = " UNION ALL ".join(f"""SELECT '{c}' AS "column", {c} AS v, outcome, rn <= floor(n * 0.2) AS held FROM r""" for c in _COLUMNS)


@query(
    "screen_saturated",
    f"""
    WITH {_OUTCOME}, r AS ({_ranked("10")}), l AS ({_LONG}),
         m AS (SELECT "column", v, {_MAJORITY} AS p FROM l WHERE NOT held GROUP BY 1, 2),
         a AS (SELECT "column", avg((p = outcome)::int) AS accuracy FROM l JOIN m USING ("column", v) WHERE held GROUP BY 1),
         prior AS (SELECT avg((outcome = 'YES')::int) AS prior FROM r WHERE rn > floor(n * 0.2))
    SELECT "column", model, round(accuracy, 8) AS accuracy, round(prior, 8) AS prior, accuracy >= prior AS kept
    FROM a CROSS JOIN prior CROSS JOIN (VALUES ('glm'), ('rforest'), ('rpart')) x(model)
    """,
)
def screen_saturated(t: Tables) -> DataFrame:
    train, test = op.split(kept_rows(t), "id", [0.8, 0.2], seed=10)
    models = ["glm", "rforest", "rpart"]
    return _rounded(ml.screen_columns(train, test, "outcome", _COLUMNS, models, params={"rforest": {"ntree": 3, "bootstrap": False}}))


def _grid_part(share: float, seed: int) -> str:
    part = "o" if share == 1 else f"(SELECT id, size_group, outcome FROM ({_ranked(str(seed))}) WHERE rn <= floor(n * {share}))"
    return f"SELECT {share}::double AS share, {seed} AS seed, * FROM ({_ranked(f'{seed}t', f'(SELECT id, size_group, outcome FROM {part})')})"


_SHARES, _SEEDS = [0.2, 0.5, 1.0], [10, 300, 5000, 700]
_GRID = " UNION ALL ".join(_grid_part(share, seed) for share in _SHARES for seed in _SEEDS)


@query(
    "grid_saturated",
    f"""
    WITH {_OUTCOME}, g AS ({_GRID}),
         m AS (SELECT share, seed, size_group, {_MAJORITY} AS p FROM g WHERE rn > floor(n * 0.2) GROUP BY ALL),
         c AS (SELECT share, seed, {_CELLS} FROM g JOIN m USING (share, seed, size_group) WHERE rn <= floor(n * 0.2) GROUP BY 1, 2)
    SELECT share, seed::int AS seed, 'rpart' AS model, {_RATIOS} FROM c
    """,
)
def grid_saturated(t: Tables) -> DataFrame:
    rows = outcome_rows(t)
    return _rounded(ml.run_grid(rows, "id", "outcome", ["size_group"], _SHARES, _SEEDS, ["rpart"]))


@query(
    "folds_saturated",
    f"""
    WITH {_OUTCOME}, f AS (SELECT *, ('0x' || substr(md5('1|' || id), 1, 12))::bigint % 5 AS fold FROM o),
         m AS (SELECT k, size_group, {_MAJORITY} AS p FROM f JOIN range(5) r(k) ON fold <> k GROUP BY 1, 2),
         c AS (SELECT fold, {_CELLS} FROM f JOIN m ON fold = k AND f.size_group = m.size_group GROUP BY 1)
    SELECT 'rpart' AS model, fold::int AS fold, {_RATIOS} FROM c
    """,
)
def folds_saturated(t: Tables) -> DataFrame:
    return _rounded(ml.cross_validate(outcome_rows(t), "id", "outcome", ["size_group"], "rpart", k=5))


@query(
    "tune_saturated",
    f"""
    WITH {_OUTCOME}, r AS ({_ranked("10")}),
         m AS (SELECT size_group, {_MAJORITY} AS p FROM r WHERE rn > floor(n * 0.4) GROUP BY 1),
         c AS (SELECT {_CELLS} FROM r JOIN m USING (size_group) WHERE rn <= floor(floor(n * 0.4) / 2))
    SELECT 'rpart' AS model, params, {_RATIOS} FROM c CROSS JOIN (VALUES ('depth=4'), ('depth=6')) x(params)
    """,
)
def tune_saturated(t: Tables) -> DataFrame:
    train, cv, _ = op.split(kept_rows(t), "id", [0.6, 0.2, 0.2], seed=10)
    return _rounded(ml.tune(train, "outcome", ["size_group"], "rpart", {"depth": [4, 6]}, cv=cv))


@query(
    "analyze_saturated",
    f"""
    WITH {_OUTCOME}, r AS ({_ranked("300")}),
         m AS (SELECT size_group, {_MAJORITY} AS p FROM r WHERE rn > floor(n * 0.2) GROUP BY 1)
    SELECT 'glm' AS model, round(avg((p = outcome)::int) * 100, 2) AS accuracy FROM r JOIN m USING (size_group) WHERE rn <= floor(n * 0.2)
    """,
)
def analyze_saturated(t: Tables) -> DataFrame:
    train, test = op.split(kept_rows(t), "id", [0.8, 0.2], seed=300)
    accuracy = ml.analyze(train, test, "outcome", ["size_group"], "glm", compressed=True)
    return t.spark.createDataFrame([("glm", accuracy)], "model string, accuracy double")


@query(
    "model_fill_saturated",
    """
    WITH h AS (SELECT l_orderkey, l_partkey, l_returnflag,
                      CASE WHEN l_orderkey % 7 <> 0 THEN CASE WHEN l_returnflag = 'R' AND l_quantity > 20 THEN 'F' ELSE l_linestatus END END AS status
               FROM lineitem),
         m AS (SELECT l_returnflag, mode(status) AS p FROM h WHERE status IS NOT NULL GROUP BY 1)
    SELECT l_orderkey, l_partkey, l_returnflag, coalesce(status, p) AS status FROM h JOIN m USING (l_returnflag)
    """,
)
def model_fill_saturated(t: Tables) -> DataFrame:
    returned = (F.col("l_returnflag") == "R") & (F.col("l_quantity") > 20)
    lines = t.lineitem.withColumn("status", F.when(returned, "F").otherwise(F.col("l_linestatus")))
    rows = lines.select("l_orderkey", "l_partkey", "l_returnflag", holed("status", "l_orderkey").alias("status"))
    return ml.fill_by_model(rows, "status", ["l_returnflag"], "rpart")
