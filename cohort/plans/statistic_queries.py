"""Imputation, statistics, sampling, profiling and CSV on the test tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from .. import functions as fn
from .. import models as ml
from .. import operators as op
from .. import sources as src
from ..operators.sample import poisson_steps
from ..sizing import literal_rows, shared_folder
from .catalog import Tables, holed, query


@query(
    "fill_const",
    """
    SELECT doc_id, coalesce(quality, -1) AS quality, coalesce(toxic, 0) AS toxic FROM documents LEFT JOIN labels USING (doc_id)
    """,
)
def fill_const(t: Tables) -> DataFrame:
    return op.fill_const(t.labelled.select("doc_id", "quality", "toxic"), {"quality": -1, "toxic": 0})


@query(
    "fill_coalesce",
    """
    SELECT doc_id, coalesce(quality, toxic, n_chars % 2)::bigint AS quality,
           CASE WHEN doc_id % 7 <> 0 THEN lang ELSE source END AS origin
    FROM documents LEFT JOIN labels USING (doc_id)
    """,
)
def fill_coalesce(t: Tables) -> DataFrame:
    rows = t.labelled.withColumns({"parity": F.col("n_chars") % 2, "quality": F.col("quality").cast("long")})
    filled = op.coalesce_from(rows, "quality", "toxic", "parity")
    return filled.select("doc_id", "quality", fn.first_present(holed("lang", "doc_id"), "source").alias("origin"))


@query(
    "fill_blank",
    """
    SELECT doc_id::varchar AS doc_id, lang, coalesce(quality::varchar, '') AS quality, coalesce(toxic::varchar, '') AS toxic
    FROM documents LEFT JOIN labels USING (doc_id)
    """,
)
def fill_blank(t: Tables) -> DataFrame:
    return op.fill_blank(t.labelled.select("doc_id", "lang", "quality", "toxic"))


@query(
    "fill_median",
    """
    WITH h AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS price FROM orders)
    SELECT o_orderkey, round(coalesce(price, (SELECT quantile_cont(price, 0.5) FROM h)), 4) AS price FROM h
    """,
)
def fill_median(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", holed("o_totalprice", "o_orderkey").alias("price"))
    return op.fill_median(rows, "price").withColumn("price", F.round("price", 4))


@query(
    "fill_mode_label",
    """
    WITH h AS (SELECT p_partkey, CASE WHEN p_partkey % 7 <> 0 THEN p_brand END AS brand FROM part)
    SELECT p_partkey, coalesce(brand, (SELECT brand FROM h WHERE brand IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, brand LIMIT 1)) AS brand
    FROM h
    """,
)
def fill_mode_label(t: Tables) -> DataFrame:
    return op.fill_mode(t.part.select("p_partkey", holed("p_brand", "p_partkey").alias("brand")), "brand")


@query(
    "fill_mode_first",
    """
    WITH h AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN o_custkey END AS subject FROM orders)
    SELECT o_orderkey, coalesce(subject, (SELECT subject FROM h WHERE subject IS NOT NULL GROUP BY 1
        ORDER BY count(*) DESC, min(o_orderkey) LIMIT 1)) AS subject
    FROM h
    """,
)
def fill_mode_first(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", holed("o_custkey", "o_orderkey").alias("subject"))
    return op.fill_mode(rows, "subject", tie="order", order_by="o_orderkey")


@query(
    "fill_harmonic",
    """
    WITH h AS (SELECT l_orderkey, l_partkey, l_returnflag, l_linestatus,
                      CASE WHEN l_orderkey % 7 <> 0 THEN l_extendedprice END AS price FROM lineitem),
         s AS (SELECT l_returnflag, l_linestatus, count(price) / sum(1 / price) AS stat FROM h GROUP BY 1, 2)
    SELECT l_orderkey, l_partkey, l_returnflag, l_linestatus, round(coalesce(price, stat), 3) AS price
    FROM h LEFT JOIN s USING (l_returnflag, l_linestatus)
    """,
)
def fill_harmonic(t: Tables) -> DataFrame:
    price = holed("l_extendedprice", "l_orderkey").alias("price")
    rows = t.lineitem.select("l_orderkey", "l_partkey", "l_returnflag", "l_linestatus", price)
    filled = op.fill_group_stat(rows, "price", ["l_returnflag", "l_linestatus"], "harmonic")
    return filled.withColumn("price", F.round("price", 3))


@query(
    "summary",
    """
    WITH h AS (SELECT CASE WHEN l_orderkey % 7 <> 0 THEN l_extendedprice END AS x, l_quantity AS y FROM lineitem)
    SELECT 'price' AS "column", count(x)::bigint AS n, count(*) FILTER (x IS NULL)::bigint AS n_missing, min(x) AS min,
           round(quantile_cont(x, 0.25), 4) AS q1, round(quantile_cont(x, 0.5), 4) AS median, round(avg(x), 4) AS mean,
           round(quantile_cont(x, 0.75), 4) AS q3, max(x) AS max FROM h
    UNION ALL
    SELECT 'quantity', count(y)::bigint, count(*) FILTER (y IS NULL)::bigint, min(y), round(quantile_cont(y, 0.25), 4),
           round(quantile_cont(y, 0.5), 4), round(avg(y), 4), round(quantile_cont(y, 0.75), 4), max(y) FROM h
    """,
)
def summary(t: Tables) -> DataFrame:
    rows = t.lineitem.select(
        holed("l_extendedprice", "l_orderkey").alias("price"), F.col("l_quantity").alias("quantity")
    )
    out = op.summary(rows, ["price", "quantity"])
    return out.withColumns({c: F.round(c, 4) for c in ("q1", "median", "mean", "q3")})


@query(
    "entropy",
    """
    WITH f AS (SELECT quality, count(*) AS n FROM labels GROUP BY 1), p AS (SELECT n / sum(n) OVER () AS p FROM f)
    SELECT round(abs(sum(p * log2(p)) / count(*)), 8) AS entropy FROM p
    """,
)
def entropy(t: Tables) -> DataFrame:
    return op.entropy(t.labels, "quality").withColumn("entropy", F.round("entropy", 8))


@query(
    "entropy_shannon",
    """
    WITH f AS (SELECT lang, count(*) AS n FROM documents GROUP BY 1), p AS (SELECT n / sum(n) OVER () AS p FROM f)
    SELECT round(-sum(p * log2(p)), 8) AS entropy FROM p
    """,
)
def entropy_shannon(t: Tables) -> DataFrame:
    out = op.entropy(t.documents, "lang", normalize_by_classes=False)
    return out.withColumn("entropy", F.round("entropy", 8))


@query("prior", "SELECT round(avg(CASE WHEN quality = 1 THEN 100.0::double ELSE 0 END), 8) AS prior FROM labels")
def prior(t: Tables) -> DataFrame:
    return op.prior(t.labels, "quality", 1).withColumn("prior", F.round("prior", 8))


_REPORT_SQL = """
    SELECT '{c}' AS "column", round(avg(({x} IS NULL)::int), 8) AS missing_ratio, count(DISTINCT {x})::bigint AS n_distinct,
           min({x})::varchar AS min, max({x})::varchar AS max, {d} AS declared FROM (SELECT *, CASE WHEN event_id % 7 <> 0 THEN event_type END AS kind FROM events)
"""


@query(
    "profile",
    " UNION ALL ".join(
        _REPORT_SQL.format(c=c, x=c, d=d)
        for c, d in [("event_id", "'Nominal'"), ("user_id", "'Nominal'"), ("kind", "'Categorical'"), ("props", "NULL")]
    ),
)
def profile(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", "user_id", holed("event_type", "event_id").alias("kind"), "props")
    described = [("event_id", "Nominal"), ("user_id", "Nominal"), ("kind", "Categorical")]
    dictionary = literal_rows(t.spark, described, "attribute string, measurement string")
    return op.profile(rows, dictionary).withColumn("missing_ratio", F.round("missing_ratio", 8))


@query(
    "csv_roundtrip",
    """
    SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderstatus END AS status,
           'say "' || o_orderpriority || '", then go' AS note, strftime(o_orderdate, '%Y-%m-%d') AS day, o_totalprice
    FROM orders
    """,
)
def csv_roundtrip(t: Tables) -> DataFrame:
    rows = t.orders.select(
        "o_orderkey",
        holed("o_orderstatus", "o_orderkey").alias("status"),
        F.concat(F.lit('say "'), "o_orderpriority", F.lit('", then go')).alias("note"),
        F.to_date("o_orderdate").alias("day"),
        "o_totalprice",
    )
    path = f"{shared_folder(t.spark)}/csv-{uuid.uuid4().hex}"
    src.write_csv(rows, path)
    back = src.read_csv(t.spark, path, "o_orderkey long, status string, note string, day date, o_totalprice double")
    return back.withColumn("day", F.col("day").cast("string"))


@query(
    "metrics_log",
    """
    SELECT 'one' AS run, count(*)::bigint AS n FROM orders UNION ALL SELECT 'two', count(*)::bigint FROM customer
    """,
)
def metrics_log(t: Tables) -> DataFrame:
    path = f"{shared_folder(t.spark)}/metrics-{uuid.uuid4().hex}"
    src.append_metrics(op.row_count(t.orders).select(F.lit("one").alias("run"), "n"), path)
    src.append_metrics(op.row_count(t.customer).select(F.lit("two").alias("run"), "n"), path, stamp=False)
    return t.spark.read.parquet(path).select("run", "n")


@query(
    "metrics_repeated",
    """
    SELECT 'one' AS run, count(*)::bigint AS n FROM orders UNION ALL SELECT 'two', count(*)::bigint FROM customer
    """,
)
def metrics_repeated(t: Tables) -> DataFrame:
    """Run ``one`` fails after its first results and is repeated; the log keeps one copy of each run."""
    path = f"{shared_folder(t.spark)}/runs-{uuid.uuid4().hex}"
    src.log_metrics(op.row_count(t.lineitem).select("n"), path, "one")
    src.log_metrics(op.row_count(t.customer).select("n"), path, "two", stamp=False)
    src.log_metrics(op.row_count(t.orders).select("n"), path, "one")
    return t.spark.read.parquet(path).select("run", "n")


@query(
    "encode",
    """
    SELECT p_partkey, (dense_rank() OVER (ORDER BY p_type) - 1)::double AS p_type_code FROM part
    """,
)
def encode(t: Tables) -> DataFrame:
    coded, _ = src.encode(t.part.select("p_partkey", "p_type"), ["p_type"])
    return coded.select("p_partkey", "p_type_code")


@query(
    "sample_exact",
    """
    SELECT o_orderkey FROM orders
    QUALIFY row_number() OVER (ORDER BY md5('300|' || o_orderkey)) <= floor((SELECT count(*) FROM orders) * 0.2)
    """,
)
def sample_exact(t: Tables) -> DataFrame:
    return op.sample_exact(t.orders.select("o_orderkey"), "o_orderkey", 0.2, seed=300)


@query(
    "sample_stratified",
    """
    SELECT o_orderkey, o_orderpriority FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5('10|' || o_orderkey))
            <= floor(count(*) OVER (PARTITION BY o_orderpriority) * 0.3)
    """,
)
def sample_stratified(t: Tables) -> DataFrame:
    orders = t.orders.select("o_orderkey", "o_orderpriority")
    return op.sample_stratified(orders, "o_orderkey", ["o_orderpriority"], 0.3, seed=10)


_SPLIT_SQL = """
    WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY md5('{seed}|' || o_orderkey)) AS rn, count(*) OVER () AS n FROM orders)
    SELECT o_orderkey, {case} AS part FROM r
"""


@query(
    "split_2way",
    _SPLIT_SQL.format(seed=700, case="CASE WHEN rn <= floor(n * 0.2) THEN 'test' ELSE 'train' END"),
)
def split_2way(t: Tables) -> DataFrame:
    return op.split_label(t.orders.select("o_orderkey"), "o_orderkey", [0.8, 0.2], seed=700)


@query(
    "split_3way",
    _SPLIT_SQL.format(
        seed=5000,
        case="CASE WHEN rn <= floor(floor(n * 0.4) / 2) THEN 'cv' WHEN rn <= floor(n * 0.4) THEN 'test' ELSE 'train' END",
    ),
)
def split_3way(t: Tables) -> DataFrame:
    return op.split_label(t.orders.select("o_orderkey"), "o_orderkey", [0.6, 0.2, 0.2], seed=5000)


_DRAW = "('0x' || substr(md5('9|' || o_orderkey), 1, 12))::bigint"


@query(
    "bootstrap",
    f"""
    WITH steps AS (SELECT k, sum(exp(-1) / factorial(k::int)) OVER (ORDER BY k) AS upto FROM range({len(poisson_steps())}) r(k)),
         d AS (SELECT o_orderkey, {_DRAW}::double / pow(16, 12) AS u FROM orders),
         c AS (SELECT o_orderkey, (SELECT count(*) FROM steps WHERE upto <= u) AS copies FROM d)
    SELECT o_orderkey FROM (SELECT o_orderkey, unnest(range(copies)) FROM c)
    """,
)
def bootstrap(t: Tables) -> DataFrame:
    return op.bootstrap(t.orders.select("o_orderkey"), "o_orderkey", seed=9)


@query("fold_id", f"SELECT o_orderkey, ({_DRAW} % 5)::int AS fold FROM orders")
def fold_id(t: Tables) -> DataFrame:
    return op.fold_id(t.orders.select("o_orderkey"), "o_orderkey", 5, seed=9)


@query(
    "confusion_metrics",
    """
    WITH p AS (SELECT quality = 0 AS t, n_chars < 1000 AS p FROM documents JOIN labels USING (doc_id)),
         c AS (SELECT count(*) FILTER (p AND t)::bigint AS tp, count(*) FILTER (NOT p AND t)::bigint AS fn,
                      count(*) FILTER (p AND NOT t)::bigint AS fp, count(*) FILTER (NOT p AND NOT t)::bigint AS tn FROM p)
    SELECT tp, fn, fp, tn, round((tp + tn) / (tp + fn + fp + tn), 8) AS accuracy, round(tp / (tp + fp), 8) AS ppv,
           round(tn / (tn + fn), 8) AS npv, round(tp / (tp + fn), 8) AS sensitivity, round(tn / (tn + fp), 8) AS specificity
    FROM c
    """,
)
def confusion_metrics(t: Tables) -> DataFrame:
    rows = t.documents.join(t.labels, "doc_id").select(
        fn.label(F.col("quality").cast("string"), ["1"]).alias("truth"),
        F.when(F.col("n_chars") < 1000, "NO").otherwise("YES").alias("guess"),
    )
    out = ml.binary_metrics(rows, "guess", "truth", positive="NO")
    rounded = {c: F.round(c, 8) for c in ("accuracy", "ppv", "npv", "sensitivity", "specificity")}
    return out.withColumns(rounded)


@query(
    "confusion_table",
    """
    SELECT CASE WHEN n_chars < 1000 THEN 'NO' ELSE 'YES' END AS guess, quality AS truth, count(*)::bigint AS n
    FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2
    """,
)
def confusion_table(t: Tables) -> DataFrame:
    guess = F.when(F.col("n_chars") < 1000, "NO").otherwise("YES").alias("guess")
    rows = t.documents.join(t.labels, "doc_id").select(guess, F.col("quality").alias("truth"))
    return ml.confusion(rows, "guess", "truth")


_CHI_SQL = """
    (WITH d AS (SELECT {c} AS v, quality AS q FROM documents JOIN labels USING (doc_id)),
          o AS (SELECT v, q, vn * qn / n AS e, coalesce(k, 0) AS k
                FROM (SELECT v, count(*) AS vn FROM d GROUP BY 1) CROSS JOIN (SELECT q, count(*) AS qn FROM d GROUP BY 1)
                CROSS JOIN (SELECT count(*) AS n FROM d) LEFT JOIN (SELECT v, q, count(*) AS k FROM d GROUP BY 1, 2) USING (v, q))
     SELECT '{c}' AS "column", sum((k - e) * (k - e) / e) AS x,
            ((count(DISTINCT v) - 1) * (count(DISTINCT q) - 1))::bigint AS degrees FROM o)
"""


# The tail of the density by Simpson's rule.
_CHI_TAIL = """
    SELECT "column", round(x, 6) AS statistic, degrees, (
        SELECT round(sum(w * pow(x + i * 0.01, degrees / 2.0 - 1) * exp(-(x + i * 0.01) / 2)) * 0.01 / 3
               / (pow(2, degrees / 2.0) * gamma(degrees / 2.0)), 6)
        FROM (SELECT i, CASE WHEN i IN (0, 40000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END AS w FROM range(40001) r(i))) AS p_value
    FROM ({found})
"""


@query("chi2_table", _CHI_TAIL.format(found=" UNION ALL ".join(_CHI_SQL.format(c=c) for c in ("lang", "source"))))
def chi2_table(t: Tables) -> DataFrame:
    rows = t.documents.join(t.labels, "doc_id").select("quality", "lang", "source")
    out = ml.chi2_screen(rows, "quality", ["lang", "source"])
    return out.select("column", F.round("statistic", 6).alias("statistic"), "degrees", F.round("p_value", 6).alias("p_value"))
