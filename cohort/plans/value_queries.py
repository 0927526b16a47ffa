"""Projection, recoding, repair, derivation and discretization on the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .. import functions as fn
from .. import operators as op
from .catalog import Tables, holed, query

_DAY = "strftime({}::date, '%Y-%m-%d')"


@query(
    "project_filter",
    """
    SELECT l_orderkey AS order_id, l_linenumber AS line_no, l_quantity AS quantity, l_returnflag AS flag
    FROM lineitem
    WHERE l_quantity >= 10 AND l_quantity < 30 AND l_returnflag IN ('A', 'R') AND l_linestatus <> 'O'
    """,
)
def project_filter(t: Tables) -> DataFrame:
    lines = op.project(
        t.lineitem,
        {
            "l_orderkey": "order_id",
            "l_linenumber": "line_no",
            "l_quantity": "quantity",
            "l_returnflag": "flag",
            "l_linestatus": "status",
        },
    )
    kept = lines.filter((F.col("quantity") >= 10) & (F.col("quantity") < 30) & F.col("flag").isin("A", "R"))
    return kept.filter(F.col("status") != "O").drop("status")


@query(
    "union_sources",
    """
    SELECT c_nationkey AS nation, floor(c_acctbal / 1000)::bigint AS thousands FROM customer
    UNION
    SELECT s_nationkey, floor(s_acctbal / 1000)::bigint FROM supplier
    """,
)
def union_sources(t: Tables) -> DataFrame:
    a = op.align(t.customer, {"nation": "c_nationkey", "thousands": F.floor(F.col("c_acctbal") / 1000)})
    b = op.align(t.supplier, {"nation": "s_nationkey", "thousands": F.floor(F.col("s_acctbal") / 1000)})
    return op.union_distinct(a, b)


@query(
    "recode_map",
    """
    SELECT o_orderkey,
           CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'HIGH'
                WHEN o_orderpriority = '3-MEDIUM' THEN 'MEDIUM'
                ELSE o_orderpriority END AS priority,
           CASE WHEN o_orderstatus IN ('F', 'P') THEN 'CLOSED' ELSE o_orderstatus END AS status,
           CASE WHEN o_orderpriority = '5-LOW' THEN 'LAST' ELSE o_orderpriority END AS folded
    FROM orders
    """,
)
def recode_map(t: Tables) -> DataFrame:
    synonyms = {"1-URGENT": "HIGH", "2-HIGH": "HIGH", "3-MEDIUM": "MEDIUM"}
    return t.orders.select(
        "o_orderkey",
        fn.recode("o_orderpriority", synonyms).alias("priority"),
        fn.group_into("o_orderstatus", ["F", "P"], "CLOSED").alias("status"),
        fn.recode("o_orderpriority", {" 5-low ": "LAST"}, case_insensitive=True).alias("folded"),
    )


@query(
    "recode_like",
    """
    SELECT p_partkey,
           CASE WHEN p_name LIKE '%ring%' THEN 'RING' WHEN p_name LIKE '%red%' THEN 'RED'
                WHEN p_name LIKE 'small%' THEN 'SMALL' ELSE p_name END AS kind,
           p_name LIKE '%gear%' AS is_gear
    FROM part
    """,
)
def recode_like(t: Tables) -> DataFrame:
    rules = [("%ring%", "RING"), ("%red%", "RED"), ("small%", "SMALL")]
    return t.part.select(
        "p_partkey", fn.recode_like("p_name", rules).alias("kind"), F.col("p_name").contains("gear").alias("is_gear")
    )


@query(
    "recode_table",
    """
    SELECT n.r_name AS region, count(*)::bigint AS n
    FROM customer c JOIN (SELECT * FROM nation JOIN region ON n_regionkey = r_regionkey) n ON c_nationkey = n_nationkey
    GROUP BY ALL
    """,
)
def recode_table(t: Tables) -> DataFrame:
    places = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    table = places.select(F.col("n_nationkey").cast("string").alias("code"), "r_name")
    coded = t.customer.select(F.col("c_nationkey").cast("string").alias("region"))
    return op.freq(op.recode_by_table(coded, "region", table, "code", "r_name"), "region")


@query(
    "null_if_rescale",
    """
    WITH a AS (SELECT l_orderkey, CASE WHEN l_quantity >= 48 THEN NULL ELSE l_quantity END AS q FROM lineitem),
         b AS (SELECT l_orderkey, CASE WHEN q < 4 THEN q * 30.48 ELSE q END AS q FROM a)
    SELECT l_orderkey, round(CASE WHEN q = 10 THEN NULL ELSE q END, 4) AS q FROM b
    """,
)
def null_if_rescale(t: Tables) -> DataFrame:
    q = F.col("q")
    out = t.lineitem.select("l_orderkey", F.col("l_quantity").alias("q"))
    out = out.withColumn("q", fn.null_if("q", q >= 48))
    out = out.withColumn("q", fn.rescale_if("q", q < 4, 30.48))
    return out.withColumn("q", F.round(fn.null_if("q", q == 10), 4))


@query(
    "clamp_year",
    """
    SELECT o_orderkey, greatest(year(o_orderdate), 1997)::int AS year_from_1997,
           least(year(o_orderdate), 1999)::int AS year_to_1999, strftime(o_orderdate, '%m-%d') AS month_day
    FROM orders
    """,
)
def clamp_year(t: Tables) -> DataFrame:
    return t.orders.select(
        "o_orderkey",
        fn.clamp(F.year("o_orderdate"), low=1997).alias("year_from_1997"),
        fn.clamp(F.year("o_orderdate"), high=1999).alias("year_to_1999"),
        fn.month_day("o_orderdate").alias("month_day"),
    )


@query(
    "strip_upper",
    """
    SELECT p_partkey, regexp_replace(p_name, '\\s|[.]', '', 'g') AS squeezed, upper(p_name) AS upper_name FROM part
    """,
)
def strip_upper(t: Tables) -> DataFrame:
    return t.part.select(
        "p_partkey", fn.strip_chars("p_name").alias("squeezed"), fn.normalize_case("p_name").alias("upper_name")
    )


@query(
    "collapse_rare",
    """
    WITH f AS (SELECT p_brand, count(*) AS n FROM part GROUP BY 1)
    SELECT CASE WHEN f.n < (SELECT avg(n) FROM f) THEN 'other' ELSE p_brand END AS brand, count(*)::bigint AS n
    FROM part JOIN f USING (p_brand) GROUP BY 1
    """,
)
def collapse_rare(t: Tables) -> DataFrame:
    # The threshold follows the table: brands below the average count are rare.
    average = op.freq(t.part, "p_brand").agg(F.avg("n")).scalar()
    brands = op.collapse_rare(t.part.select(F.col("p_brand").alias("brand")), "brand", average)
    return op.freq(brands, "brand")


@query(
    "rules_consistency",
    """
    WITH a AS (SELECT l_orderkey, l_quantity, l_linenumber, l_returnflag AS flag, l_linestatus AS status FROM lineitem),
         b AS (SELECT *, CASE WHEN flag = 'R' AND status = 'O' THEN 'F' ELSE status END AS status2 FROM a),
         c AS (SELECT *, CASE WHEN status2 = 'O' THEN NULL ELSE flag END AS flag2 FROM b)
    SELECT l_orderkey, status2 AS status, flag2 AS flag,
           CASE WHEN status <> status2 THEN 'YES' ELSE 'NO' END AS status_changed,
           CASE WHEN flag <> flag2 THEN 'YES' ELSE 'NO' END AS flag_changed,
           CASE WHEN l_quantity > 45 THEN l_linenumber * 1.0::double ELSE l_quantity END AS quantity
    FROM c
    """,
)
def rules_consistency(t: Tables) -> DataFrame:
    lines = t.lineitem.withColumns({"flag": F.col("l_returnflag"), "status": F.col("l_linestatus")})
    ruled = op.apply_rules(
        lines,
        [
            ((F.col("flag") == "R") & (F.col("status") == "O"), "status", "F"),
            (F.col("status") == "O", "flag", None),
        ],
    )
    return ruled.select(
        "l_orderkey",
        "status",
        "flag",
        fn.changed_flag("l_linestatus", "status").alias("status_changed"),
        fn.changed_flag("l_returnflag", "flag").alias("flag_changed"),
        fn.repair_if("l_quantity", F.col("l_quantity") > 45, F.col("l_linenumber") * F.lit(1.0)).alias("quantity"),
    )


@query(
    "lenient_parse",
    """
    SELECT event_id, try_cast(regexp_extract(substr(props, 7), '^\\s*(\\d+)', 1) AS int) AS k,
           try_cast(props AS double) AS not_a_number,
           try_cast(event_id::varchar || '.5' AS double) AS number,
           strftime(try_cast('2023-' || lpad((event_id % 14)::varchar, 2, '0') || '-' || lpad((user_id % 33)::varchar, 2, '0')
               AS date), '%Y-%m-%d') AS day
    FROM events
    """,
)
def lenient_parse(t: Tables) -> DataFrame:
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    day = F.concat(F.lit("2023-"), two(F.col("event_id") % 14), F.lit("-"), two(F.col("user_id") % 33))
    return t.events.select(
        "event_id",
        fn.lenient_int(F.substr("props", F.lit(7))).alias("k"),
        fn.lenient_number("props").alias("not_a_number"),
        fn.lenient_number(F.concat(F.col("event_id").cast("string"), F.lit(".5"))).alias("number"),
        fn.parse_date(day).cast("string").alias("day"),
    )


@query(
    "synth_date",
    f"""
    SELECT o_orderkey, {_DAY.format("try_cast((year(o_orderdate) - o_custkey % 40)::varchar || strftime(o_orderdate, '-%m-%d') AS date)")} AS born,
           (year(o_orderdate) - year(DATE '1990-05-06'))::int AS years
    FROM orders
    """,
)
def synth_date(t: Tables) -> DataFrame:
    d = F.col("o_orderdate")
    born = fn.synth_date(F.year(d) - F.col("o_custkey") % 40, F.month(d), F.dayofmonth(d))
    return t.orders.select(
        "o_orderkey",
        born.cast("string").alias("born"),
        fn.year_gap(d, F.lit("1990-05-06").cast("date")).alias("years"),
    )


@query(
    "fill_when",
    """
    SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderstatus
        WHEN o_custkey % 11 = 0 THEN NULL WHEN o_totalprice <= 200000 THEN 'SMALL' ELSE 'LARGE' END AS status
    FROM orders
    """,
)
def fill_when(t: Tables) -> DataFrame:
    basis = holed("o_totalprice", "o_custkey", 11) <= 200000
    return t.orders.select(
        "o_orderkey", fn.fill_when(holed("o_orderstatus", "o_orderkey"), basis, "SMALL", "LARGE").alias("status")
    )


@query(
    "bin_edges",
    """
    SELECT p_partkey, CASE WHEN p_size < 5 THEN 'infant' WHEN p_size < 13 THEN 'child' WHEN p_size < 20 THEN 'teen'
        WHEN p_size < 26 THEN 'young' WHEN p_size < 40 THEN 'adult' ELSE 'old' END AS size_group
    FROM part
    """,
)
def bin_edges(t: Tables) -> DataFrame:
    names = ["infant", "child", "teen", "young", "adult", "old"]
    return t.part.select("p_partkey", fn.bucketize("p_size", [5, 13, 20, 26, 40], names).alias("size_group"))


@query(
    "bin_gaps",
    """
    SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 2500.5 THEN 'low'
        WHEN c_acctbal < 6000 THEN 'middle' WHEN c_acctbal < 7000 THEN NULL ELSE 'high' END AS balance_group
    FROM customer
    """,
)
def bin_gaps(t: Tables) -> DataFrame:
    names = ["debt", "low", "middle", "high"]
    binned = fn.bucketize("c_acctbal", [0, 2500.5, 6000], names, gaps=[(6000, 7000)])
    return t.customer.select("c_custkey", binned.alias("balance_group"))


@query(
    "delay_bins",
    """
    WITH g AS (
        SELECT datediff('day', lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), o_orderdate) AS d
        FROM orders)
    SELECT CASE WHEN d IS NULL THEN 'NOT PRESENT' WHEN d < 1 THEN 'NONE' WHEN d <= 1 THEN NULL WHEN d <= 3 THEN '3D'
        WHEN d <= 7 THEN '1W' WHEN d <= 14 THEN '2W' WHEN d <= 30 THEN '1M' WHEN d <= 60 THEN '2M'
        WHEN d <= 180 THEN '6M' ELSE '1Y' END AS delay, count(*)::bigint AS n
    FROM g GROUP BY 1
    """,
)
def delay_bins(t: Tables) -> DataFrame:
    # Orders are first reduced to one row per customer and day, so the window below never sees more
    # rows of one customer than there are days; further orders of a day are delays of zero.
    days = t.orders.groupBy("o_custkey", F.to_date("o_orderdate").alias("day")).agg(F.count(F.lit(1)).alias("orders"))
    earlier = F.lag("day").over(Window.partitionBy("o_custkey").orderBy("day"))
    gaps = days.select(fn.day_gap("day", earlier).alias("d"), "orders")
    weighted = gaps.select(
        F.inline(F.array(F.struct(F.col("d"), F.lit(1).cast("long").alias("w")), F.struct(F.lit(0).alias("d"), (F.col("orders") - 1).alias("w"))))
    ).filter(F.col("w") > 0)
    return weighted.groupBy(fn.discretize_delay("d").alias("delay")).agg(F.sum("w").alias("n"))


@query(
    "flags",
    """
    SELECT doc_id, CASE WHEN quality IS NULL THEN 'NO' ELSE 'YES' END AS labelled,
           CASE WHEN coalesce(lang, 'en') = 'en' THEN 'NO' ELSE 'YES' END AS foreign_text,
           quality IS NOT NULL AS has_label,
           CASE WHEN source IN ('src1', 'src2', 'src3') THEN 'YES' ELSE 'NO' END AS trusted
    FROM documents LEFT JOIN labels USING (doc_id)
    """,
)
def flags(t: Tables) -> DataFrame:
    return t.labelled.select(
        "doc_id",
        fn.presence_flag("quality").alias("labelled"),
        fn.positive_flag("lang", "EN", case_insensitive=True).alias("foreign_text"),
        fn.has_value("quality").alias("has_label"),
        fn.label("source", ["src1", "src2", "src3"]).alias("trusted"),
    )


@query(
    "score",
    """
    WITH s AS (
        SELECT (CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) + (CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END)
             + (CASE WHEN l_quantity < 10 THEN 1 WHEN l_quantity < 30 THEN 2 ELSE 3 END)
             + (CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END) AS score
        FROM lineitem)
    SELECT score::int AS score, count(*)::bigint AS n FROM s GROUP BY 1
    """,
)
def score(t: Tables) -> DataFrame:
    q = F.col("l_quantity")
    rules = [
        (F.col("l_returnflag") == "R", 1),
        (F.col("l_linestatus") == "O", 1),
        (q < 10, 1),
        ((q >= 10) & (q < 30), 2),
        (q >= 30, 3),
        (F.col("l_discount") > 0.05, 1),
    ]
    return op.freq(t.lineitem.select(fn.score(rules).alias("score")), "score")


@query(
    "abs_round",
    """
    SELECT l_orderkey, l_partkey, round_even(l_quantity / 2, 0) AS half, abs(l_quantity - l_linenumber) AS gap FROM lineitem
    """,
)
def abs_round(t: Tables) -> DataFrame:
    return t.lineitem.select(
        "l_orderkey",
        "l_partkey",
        F.bround(F.col("l_quantity") / 2, 0).alias("half"),
        fn.abs_difference("l_quantity", "l_linenumber").alias("gap"),
    )


@query(
    "concat_null",
    """
    SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderstatus END || ' ' || o_orderpriority AS notes FROM orders
    """,
)
def concat_null(t: Tables) -> DataFrame:
    return t.orders.select(
        "o_orderkey", fn.joined_text(holed("o_orderstatus", "o_orderkey"), "o_orderpriority").alias("notes")
    )


@query(
    "minmax",
    """
    SELECT c_custkey,
           round((c_acctbal - min(c_acctbal) OVER ()) / (max(c_acctbal) OVER () - min(c_acctbal) OVER ()), 8) AS c_acctbal
    FROM customer
    """,
)
def minmax(t: Tables) -> DataFrame:
    scaled = op.minmax(t.customer.select("c_custkey", "c_acctbal"), "c_acctbal")
    return scaled.withColumn("c_acctbal", F.round("c_acctbal", 8))


@query(
    "surrogate_ids",
    """
    SELECT c_name, row_number() OVER (ORDER BY md5('pepper' || c_name), c_name)::bigint AS "ID"
    FROM (SELECT DISTINCT c_name FROM customer)
    """,
)
def surrogate_ids(t: Tables) -> DataFrame:
    return op.surrogate_ids(t.customer, "c_name", salt="pepper")


@query(
    "replace_ids",
    """
    WITH ids AS (SELECT user_id, row_number() OVER (ORDER BY md5(user_id::varchar), user_id)::bigint AS id
                 FROM (SELECT DISTINCT user_id FROM events))
    SELECT event_id, ids.id AS user_id FROM events JOIN ids USING (user_id)
    """,
)
def replace_ids(t: Tables) -> DataFrame:
    events = t.events.select("event_id", "user_id")
    return op.replace_ids(events, "user_id", op.surrogate_ids(events, "user_id"))


@query(
    "deidentify",
    """
    SELECT o_orderkey, md5('s' || o_custkey::varchar) AS o_custkey,
           CASE WHEN o_orderkey % 7 <> 0 THEN sha256('s' || o_orderstatus) END AS status
    FROM orders
    """,
)
def deidentify(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", "o_custkey", holed("o_orderstatus", "o_orderkey").alias("status"))
    return op.deidentify(op.deidentify(rows, "o_custkey", algo="md5", salt="s"), "status", salt="s")
