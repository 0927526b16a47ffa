"""Joins, picks, aggregates, set operations and checks on the test tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window, functions as F

from .. import functions as fn
from .. import operators as op
from .. import sources as src
from ..sizing import shared_folder
from .catalog import Tables, holed, query

BUCKETS = 8

FLAGSHIP_SQL = """
    WITH ranked AS (
        SELECT o_custkey, o_orderdate::date AS day, o_orderstatus,
               row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn
        FROM orders),
    last AS (SELECT * FROM ranked WHERE rn = 1),
    prev AS (SELECT l.o_custkey, max(o.o_orderdate::date) AS prev_day
             FROM last l JOIN orders o ON o.o_custkey = l.o_custkey AND o.o_orderdate::date < l.day GROUP BY 1),
    subjects AS (
        SELECT c_mktsegment AS segment, datediff('day', prev_day, day) AS d,
               CASE WHEN o_orderstatus = 'F' THEN 1.0::double ELSE 0.0::double END AS done
        FROM customer LEFT JOIN last ON c_custkey = last.o_custkey LEFT JOIN prev ON c_custkey = prev.o_custkey
        WHERE c_mktsegment IN ('BUILDING', 'MACHINERY'))
    SELECT segment,
           CASE WHEN d IS NULL THEN 'NOT PRESENT' WHEN d < 1 THEN 'NONE' WHEN d <= 1 THEN NULL WHEN d <= 3 THEN '3D'
                WHEN d <= 7 THEN '1W' WHEN d <= 14 THEN '2W' WHEN d <= 30 THEN '1M' WHEN d <= 60 THEN '2M'
                WHEN d <= 180 THEN '6M' ELSE '1Y' END AS delay,
           count(*)::bigint AS subjects, round(avg(done), 6) AS completed_share
    FROM subjects GROUP BY 1, 2
"""


@query("cohort_outcome", FLAGSHIP_SQL)
def cohort_outcome(t: Tables) -> DataFrame:
    """Share of completed subjects per segment and delay since the previous order.

    Orders are reduced to one per customer and day before anything is keyed by customer alone.
    """
    cohort = t.customer.filter(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).select(
        F.col("c_custkey").alias("subject"), F.col("c_mktsegment").alias("segment")
    )
    orders = t.orders.select(
        F.col("o_custkey").alias("subject"), F.to_date("o_orderdate").alias("day"), "o_orderkey", "o_orderstatus"
    )
    days = op.pick_one(op.restrict_to(orders, cohort, "subject"), ["subject", "day"], ["-o_orderkey"])
    earlier = F.lag("day").over(Window.partitionBy("subject").orderBy("day"))
    last = op.latest(days.withColumn("delay", fn.day_gap("day", earlier)), "subject", "day")
    outcome = last.select(
        "subject", "delay", fn.label("o_orderstatus", ["F"]).alias("complete")
    )
    subjects = op.assemble(cohort, [outcome], "subject")
    return subjects.groupBy("segment", fn.discretize_delay("delay").alias("delay")).agg(
        F.count(F.lit(1)).alias("subjects"),
        F.round(F.avg(F.when(F.col("complete") == "YES", 1.0).otherwise(0.0)), 6).alias("completed_share"),
    )


@query(
    "inner_join",
    """
    SELECT l_orderkey, l_linenumber, l_partkey, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    """,
)
def inner_join(t: Tables) -> DataFrame:
    finished = t.orders.select("o_orderkey", "o_custkey")
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey")
    return op.inner(lines, finished, {"l_orderkey": "o_orderkey"})


@query(
    "star_assembly",
    """
    WITH o AS (SELECT o_custkey, count(*)::bigint AS orders, max(o_totalprice) AS dearest FROM orders GROUP BY 1),
         b AS (SELECT o_custkey, count(*)::bigint AS urgent FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1)
    SELECT c_custkey, c_name, orders, dearest, urgent, n_name
    FROM customer LEFT JOIN o ON c_custkey = o.o_custkey LEFT JOIN b ON c_custkey = b.o_custkey
    LEFT JOIN nation ON c_nationkey = n_nationkey
    """,
)
def star_assembly(t: Tables) -> DataFrame:
    orders = t.orders.withColumnRenamed("o_custkey", "c_custkey")
    per_subject = orders.groupBy("c_custkey").agg(
        F.count(F.lit(1)).alias("orders"), F.max("o_totalprice").alias("dearest")
    )
    urgent = orders.filter(F.col("o_orderpriority") == "1-URGENT").groupBy("c_custkey")
    base = t.customer.select("c_custkey", "c_name", "c_nationkey")
    wide = op.assemble(base, [per_subject, urgent.agg(F.count(F.lit(1)).alias("urgent"))], "c_custkey")
    dim = op.pick_one(t.nation.select("n_nationkey", "n_name"), "n_nationkey", ["n_name"])
    return op.lookup(wide, dim, {"c_nationkey": "n_nationkey"}).drop("c_nationkey")


@query(
    "staged_star",
    """
    WITH o AS (SELECT o_custkey, count(*)::bigint AS orders, max(o_totalprice) AS dearest FROM orders GROUP BY 1),
         b AS (SELECT o_custkey, count(*)::bigint AS urgent FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1)
    SELECT c_custkey, c_name, orders, dearest, urgent, n_name
    FROM customer LEFT JOIN o ON c_custkey = o.o_custkey LEFT JOIN b ON c_custkey = b.o_custkey
    LEFT JOIN nation ON c_nationkey = n_nationkey
    """,
)
def staged_star(t: Tables) -> DataFrame:
    """The same from tables staged by subject: the assembly itself moves no rows."""
    tag = f"{shared_folder(t.spark)}/star-{uuid.uuid4().hex}"

    def staged(df: DataFrame, name: str) -> DataFrame:
        return src.stage_bucketed(df, f"{name}_{tag[-32:]}", "c_custkey", BUCKETS, f"{tag}/{name}")

    base = staged(t.customer.select("c_custkey", "c_name", "c_nationkey"), "subjects")
    orders = staged(t.orders.withColumnRenamed("o_custkey", "c_custkey"), "records")
    per_subject = orders.groupBy("c_custkey").agg(F.count(F.lit(1)).alias("orders"), F.max("o_totalprice").alias("dearest"))
    urgent = orders.filter(F.col("o_orderpriority") == "1-URGENT").groupBy("c_custkey")
    wide = op.assemble(base, [per_subject, urgent.agg(F.count(F.lit(1)).alias("urgent"))], "c_custkey")
    return op.lookup(wide, F.broadcast(t.nation.select("n_nationkey", "n_name")), {"c_nationkey": "n_nationkey"}).drop("c_nationkey")


@query(
    "semi_cohort",
    """
    SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)
    """,
)
def semi_cohort(t: Tables) -> DataFrame:
    cohort = t.customer.filter(F.col("c_acctbal") > 5000)
    return op.restrict_to(t.orders.select("o_orderkey", "o_custkey"), cohort, {"o_custkey": "c_custkey"})


@query(
    "anti_rest",
    """
    SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')
    """,
)
def anti_rest(t: Tables) -> DataFrame:
    returned = t.lineitem.filter(F.col("l_returnflag") == "R").select(F.col("l_orderkey").alias("o_orderkey"))
    return op.exclude(t.orders.select("o_orderkey"), returned, "o_orderkey")


@query(
    "result_before_ref",
    """
    SELECT o_custkey, l_orderkey, l_linenumber, l_partkey
    FROM lineitem JOIN orders o ON l_orderkey = o_orderkey
    WHERE EXISTS (SELECT 1 FROM orders r WHERE r.o_custkey = o.o_custkey AND l_shipdate < r.o_orderdate)
    """,
)
def result_before_ref(t: Tables) -> DataFrame:
    subjects = t.orders.select("o_orderkey", "o_custkey")
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")
    results = op.inner(lines, subjects, {"l_orderkey": "o_orderkey"})
    return op.before(results, t.orders, "o_custkey", "l_shipdate", "o_orderdate").drop("l_shipdate")


@query(
    "group_totals",
    """
    SELECT l_orderkey, count(l_linenumber)::bigint AS count_l_linenumber, sum(l_quantity) AS sum_l_quantity,
           sum(l_linenumber)::bigint AS sum_l_linenumber
    FROM lineitem GROUP BY 1
    """,
)
def group_totals(t: Tables) -> DataFrame:
    return op.group_totals(t.lineitem, ["l_orderkey"], ["l_linenumber"], ["l_quantity", "l_linenumber"])


@query(
    "dup_keys",
    "SELECT l_orderkey, l_linenumber, count(*)::bigint AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
)
def dup_keys(t: Tables) -> DataFrame:
    return op.duplicated_keys(t.lineitem, "l_orderkey", "l_linenumber")


@query(
    "pick_one",
    """
    SELECT event_id, user_id, event_type, value FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY value, event_id) = 1
    """,
)
def pick_one(t: Tables) -> DataFrame:
    events = t.events.select("event_id", "user_id", "event_type", "value")
    return op.pick_one(events, ["user_id", "event_type"], ["value", "event_id"])


@query(
    "pick_one_mixed",
    """
    SELECT o_custkey, o_orderkey, o_orderpriority, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderdate DESC, o_orderkey) = 1
    """,
)
def pick_one_mixed(t: Tables) -> DataFrame:
    orders = t.orders.select("o_custkey", "o_orderkey", "o_orderpriority", "o_orderdate")
    first = op.pick_one(orders, "o_custkey", ["o_orderpriority", "-o_orderdate", "o_orderkey"])
    return first.select("o_custkey", "o_orderkey", "o_orderpriority", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


@query(
    "dedup_prefer",
    """
    WITH d AS (SELECT event_id, user_id, ts::date::varchar AS day,
                      CASE WHEN event_id % 2 = 0 THEN upper(event_type) ELSE event_type END AS event_type FROM events)
    SELECT * FROM d QUALIFY NOT (lower(event_type) = 'view' AND count(*) OVER (PARTITION BY user_id, day) > 1)
    """,
)
def dedup_prefer(t: Tables) -> DataFrame:
    mixed = F.when(F.col("event_id") % 2 == 0, F.upper("event_type")).otherwise(F.col("event_type"))
    events = t.events.select("event_id", "user_id", F.to_date("ts").cast("string").alias("day"), mixed.alias("event_type"))
    return op.dedup_prefer(events, ["user_id", "day"], "event_type", "view", case_insensitive=True)


@query(
    "dedup_keep_one",
    """
    WITH d AS (SELECT o_orderkey, o_custkey, o_orderpriority, o_orderstatus FROM orders),
         k AS (SELECT *, bool_and(o_orderstatus = 'P') OVER (PARTITION BY o_custkey, o_orderpriority) AS all_bad,
                      row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey DESC) AS rn FROM d)
    SELECT o_orderkey, o_custkey, o_orderpriority, o_orderstatus FROM k WHERE o_orderstatus <> 'P' OR (all_bad AND rn = 1)
    """,
)
def dedup_keep_one(t: Tables) -> DataFrame:
    orders = t.orders.select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus")
    keys = ["o_custkey", "o_orderpriority"]
    return op.dedup_prefer(orders, keys, "o_orderstatus", "P", keep_if_all_bad=True, order_by=["-o_orderkey"])


@query(
    "latest_ties",
    """
    SELECT o_orderkey, o_custkey FROM orders
    QUALIFY rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC) = 1
    """,
)
def latest_ties(t: Tables) -> DataFrame:
    orders = t.orders.select("o_orderkey", "o_custkey", "o_orderdate")
    return op.latest(orders, "o_custkey", "o_orderdate", ties=True).select("o_orderkey", "o_custkey")


@query(
    "latest_one",
    """
    SELECT o_orderkey, o_custkey, o_orderstatus FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1
    """,
)
def latest_one(t: Tables) -> DataFrame:
    orders = t.orders.select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus")
    return op.latest(orders, "o_custkey", ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query(
    "max_id",
    "SELECT * FROM (SELECT event_id, user_id, event_type FROM events) e WHERE event_id = (SELECT max(event_id) FROM events WHERE user_id = e.user_id)",
)
def max_id(t: Tables) -> DataFrame:
    return op.latest(t.events.select("event_id", "user_id", "event_type"), "user_id", "event_id", ties=True)


@query(
    "delete_keys",
    """
    SELECT o_orderkey, o_custkey FROM orders
    WHERE NOT (o_orderkey = 1 AND o_custkey = 769) AND NOT (o_orderkey = 2 AND o_custkey = -1)
      AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity = 50)
    """,
)
def delete_keys(t: Tables) -> DataFrame:
    known = [{"o_orderkey": 1, "o_custkey": 769}, {"o_orderkey": 2, "o_custkey": -1}]
    orders = op.delete_keys(t.orders.select("o_orderkey", "o_custkey"), known)
    full = t.lineitem.filter(F.col("l_quantity") == 50).select(F.col("l_orderkey").alias("o_orderkey"))
    return op.delete_keys(orders, full, on=["o_orderkey"])


@query(
    "drop_values",
    """
    SELECT * FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority END AS priority FROM orders)
    WHERE priority IS NULL OR priority NOT IN ('5-LOW', '4-NOT SPECIFIED')
    """,
)
def drop_values(t: Tables) -> DataFrame:
    orders = t.orders.select("o_orderkey", holed("o_orderpriority", "o_orderkey").alias("priority"))
    return op.drop_values(orders, "priority", ["5-LOW", "4-NOT SPECIFIED"])


@query("complete_cases", "SELECT doc_id, quality, toxic FROM documents JOIN labels USING (doc_id)")
def complete_cases(t: Tables) -> DataFrame:
    return op.complete_cases(t.labelled.select("doc_id", "quality", "toxic"))


@query("freq", "SELECT CASE WHEN event_id % 7 <> 0 THEN event_type END AS kind, count(*)::bigint AS n FROM events GROUP BY 1")
def freq(t: Tables) -> DataFrame:
    return op.freq(t.events.select(holed("event_type", "event_id").alias("kind")), "kind")


@query("distinct_values", "SELECT DISTINCT p_brand, p_type FROM part")
def distinct_values(t: Tables) -> DataFrame:
    return op.distinct_values(t.part, "p_brand", "p_type")


@query("row_count", "SELECT count(*)::bigint AS n FROM lineitem")
def row_count(t: Tables) -> DataFrame:
    return op.row_count(t.lineitem)


@query(
    "missing_ratio",
    """
    SELECT 'quality' AS "column", round(avg((quality IS NULL)::int), 8) AS missing_ratio FROM documents LEFT JOIN labels USING (doc_id)
    UNION ALL
    SELECT 'lang', round(avg((lang IS NULL)::int), 8) FROM documents
    """,
)
def missing_ratio(t: Tables) -> DataFrame:
    ratios = op.missing_ratio(t.labelled.select("quality", "lang"))
    return ratios.withColumn("missing_ratio", F.round("missing_ratio", 8))


@query(
    "argmax_value",
    """
    WITH f AS (SELECT p_type, count(*)::bigint AS n FROM part GROUP BY 1)
    SELECT * FROM f ORDER BY n DESC, p_type LIMIT 1
    """,
)
def argmax_value(t: Tables) -> DataFrame:
    return op.argmax(op.freq(t.part, "p_type"), "n", ["p_type"])


@query("sort_values", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderdate, o_orderkey")
def sort_values(t: Tables) -> DataFrame:
    return t.orders.orderBy("o_orderdate", "o_orderkey").select("o_orderkey", "o_custkey")


@query(
    "append_rows",
    """
    SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'
    UNION ALL SELECT o_orderkey, o_orderstatus FROM orders WHERE o_totalprice > 100000
    """,
)
def append_rows(t: Tables) -> DataFrame:
    orders = t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice")
    a = orders.filter(F.col("o_orderstatus") == "F").drop("o_totalprice")
    b = orders.filter(F.col("o_totalprice") > 100000).drop("o_totalprice")
    return op.append_rows(a, b)


@query(
    "unique_check",
    """
    SELECT 'orders' AS "table", count(*)::bigint AS repeated FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1)
    UNION ALL SELECT 'customer', count(*)::bigint FROM (SELECT c_custkey FROM customer GROUP BY 1 HAVING count(*) > 1)
    UNION ALL SELECT 'lineitem', count(*)::bigint FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1)
    """,
)
def unique_check(t: Tables) -> DataFrame:
    keys = {"orders": ["o_orderkey"], "customer": ["c_custkey"], "lineitem": ["l_orderkey", "l_linenumber"]}
    counts = [
        op.duplicated_keys(getattr(t, name), *key).agg(F.count(F.lit(1)).alias("repeated")).withColumn("table", F.lit(name))
        for name, key in keys.items()
    ]
    return op.append_rows(*counts)
