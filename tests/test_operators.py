import random

import pytest
from conftest import bag
from pyspark.sql import functions as F

from cohort import operators as op


def test_union_distinct_keeps_different_attributes(frame):
    a = frame([("g1", "MBBS"), ("g2", "FCPS")], "name string, degree string")
    b = frame([("g1", "MBBS"), ("g1", "FCPS")], "name string, degree string")
    assert bag(op.union_distinct(a, b)) == [("g1", "FCPS"), ("g1", "MBBS"), ("g2", "FCPS")]
    assert op.append_rows(a, b).count() == 4


def test_align_matches_sources_by_meaning(frame):
    a = frame([("p", "l1")], "PatientID string, SputumTestID string")
    b = frame([("l2", "q")], "SputumLabID string, PatientID string")
    union = op.union_distinct(a, op.align(b, {"PatientID": "PatientID", "SputumTestID": "SputumLabID"}))
    assert bag(union) == [("p", "l1"), ("q", "l2")]


def test_delete_keys_by_list_and_table(frame):
    df = frame([("a", 1), ("a", 2), (None, 1)], "k string, e int")
    assert bag(op.delete_keys(df, [{"k": "a", "e": 1}])) == [("a", 2), (None, 1)]
    assert bag(op.delete_keys(df, df.filter("k = 'a'"), on=["k"])) == [(None, 1)]


def test_drop_values_keeps_null(frame):
    df = frame([("",), ("ERROR",), ("OK",), (None,)], "r string")
    assert bag(op.drop_values(df, "r", ["", "ERROR"])) == [("OK",), (None,)]


def test_rules_see_the_ones_before(frame):
    df = frame([("NO", "YES"), (None, "YES"), ("YES", None)], "productive string, blood string")
    p, b = F.col("productive"), F.col("blood")
    out = op.apply_rules(df, [((p != "YES") & (b == "YES"), "productive", "YES"), (p != "YES", "blood", None)])
    assert bag(out) == [("YES", "YES"), ("YES", None), (None, "YES")]


@pytest.mark.parametrize("n, want", [(19, "other"), (20, "v"), (21, "v")])
def test_rare_values_collapse_below_the_count(frame, n, want):
    df = frame([("v",)] * n + [("big",)] * 30 + [(None,)], "x string")
    assert dict(op.freq(op.collapse_rare(df, "x", 20), "x").collect()) == {want: n, "big": 30, None: 1}


def test_collapse_rare_without_broadcast(frame, monkeypatch):
    monkeypatch.setattr("cohort.operators.shape.small_or_plain", lambda d: d)
    df = frame([(f"v{i % 40}",) for i in range(900)] + [("rare",)], "x string")
    got = op.freq(op.collapse_rare(df, "x", 20), "x")
    assert got.count() == 41 and got.filter("x = 'other'").first()["n"] == 1


ROWS = [("a", "NEGATIVE"), ("a", "3+"), ("b", "NEGATIVE"), ("b", "NEGATIVE"), ("c", "NEGATIVE"), ("d", "1+"), ("d", "2+")]


def test_dedup_prefer_as_coded_and_as_meant(frame):
    df = frame(ROWS, "k string, r string")
    assert bag(op.dedup_prefer(df, "k", "r", "NEGATIVE")) == [("a", "3+"), ("c", "NEGATIVE"), ("d", "1+"), ("d", "2+")]
    meant = bag(op.dedup_prefer(df, "k", "r", "NEGATIVE", keep_if_all_bad=True))
    assert meant == [("a", "3+"), ("b", "NEGATIVE"), ("c", "NEGATIVE"), ("d", "1+"), ("d", "2+")]


def test_dedup_prefer_keeps_null_results(frame):
    df = frame([("a", None), ("a", "NEGATIVE"), (None, "NEGATIVE")], "k string, r string")
    assert bag(op.dedup_prefer(df, "k", "r", "NEGATIVE")) == [("a", None), (None, "NEGATIVE")]


def test_latest_ties_and_single(frame):
    df = frame([("a", 1, 1), ("a", 2, 2), ("a", 2, 3), ("b", 1, 4), ("c", None, 5)], "k string, d int, e int")
    assert bag(op.latest(df, "k", "d", ties=True)) == [("a", 2, 2), ("a", 2, 3), ("b", 1, 4)]
    assert bag(op.latest(df, "k", ["d", "e"])) == [("a", 2, 3), ("b", 1, 4), ("c", None, 5)]
    with pytest.raises(ValueError):
        op.latest(df, "k", ["d", "e"], ties=True)


@pytest.mark.parametrize(
    "order", [["s"], ["-s"], ["s", "-n"], ["-s", "n"], ["n", "-s"], ["d", "-n"], ["-n", "d", "t"], ["-s", "t", "f"]]
)
def test_pick_one_agrees_with_sorting(frame, order):
    rng = random.Random(5)
    names = ["", "a", "ab", "abc", "b", "B", "é", None]
    rows = [
        (rng.randrange(6), rng.choice(names), rng.choice([None, -3, 0, 9]), rng.choice([None, 1.5, -2.5]), i)
        for i in range(300)
    ]
    df = frame(rows, "k int, s string, n int, f double, i int").withColumns(
        {"d": F.date_add(F.lit("2020-01-01").cast("date"), F.col("n")), "t": F.timestamp_seconds(F.col("i") % 7)}
    )
    order = [*order, "i"]
    got = {r["k"]: r["i"] for r in op.pick_one(df, "k", order).collect()}
    rows = df.collect()

    def place(row):
        key = []
        for o in order:
            v = row[o.lstrip("-")]
            v = v.encode() if isinstance(v, str) else v
            key.append((o.startswith("-"), v))
        return key

    def before(a, b):
        for (desc, x), (_, y) in zip(place(a), place(b)):
            if x != y:
                if x is None or y is None:
                    return (x is None) != desc
                return (x > y) if desc else (x < y)
        return False

    for k in got:
        best = None
        for r in rows:
            if r["k"] == k and (best is None or before(r, best)):
                best = r
        assert got[k] == best["i"]


def test_before_needs_a_later_reference_and_does_not_fan_out(frame):
    x = frame([("a", 1), ("a", 5), ("b", 3), ("c", 1), (None, 1)], "k string, d int")
    ref = frame([("a", 5), ("a", 2), ("b", 3), (None, 9)], "p string, e int")
    assert bag(op.before(x, ref, {"k": "p"}, "d", "e")) == [("a", 1)]


def test_joins(frame):
    df = frame([("a", 1), ("b", 2), (None, 3)], "k string, v int")
    cohort = frame([("a",), ("a",), (None,)], "id string")
    assert bag(op.restrict_to(df, cohort, {"k": "id"})) == [("a", 1)]
    assert bag(op.exclude(df, cohort.withColumnRenamed("id", "k"), "k")) == [("b", 2), (None, 3)]
    dim = frame([("a", "x"), ("a", "y")], "id string, t string")
    with pytest.raises(op.DuplicateKeyError):
        op.lookup(df, dim, {"k": "id"}, check=True)
    assert op.lookup(df, op.pick_one(dim, "id", ["t"]), {"k": "id"}, check=True).count() == 3
    assert op.assemble(df, [dim.groupBy(F.col("id").alias("k")).count()], "k").count() == 3


def test_modes_differ_in_ties(frame):
    df = frame([(1, "z"), (2, "b"), (3, "z"), (4, "b"), (5, None)], "i int, x string")
    assert op.fill_mode(df, "x").filter("i = 5").first()["x"] == "b"
    assert op.fill_mode(df, "x", tie="order", order_by="i").filter("i = 5").first()["x"] == "z"
    with pytest.raises(ValueError):
        op.fill_mode(df, "x", tie="order")


def test_group_fill_leaves_unknown_groups(frame):
    df = frame([("a", "M", 2.0), ("a", "M", 6.0), ("a", "M", None), (None, "M", None), ("b", "F", None)], "g string, s string, w double")
    got = bag(op.fill_group_stat(df, "w", ["g", "s"]))
    assert ("a", "M", 3.0) in got and (None, "M", None) in got and ("b", "F", None) in got and len(got) == 5


def test_median_fill(frame):
    df = frame([(1.0,), (2.0,), (10.0,), (20.0,), (None,)], "x double")
    assert sorted(r[0] for r in op.fill_median(df, "x").collect()) == [1.0, 2.0, 6.0, 10.0, 20.0]
    empty = frame([(None,)], "x double")
    assert op.fill_median(empty, "x").first()[0] is None
    assert op.fill_median(df, "x", exact=False).filter("x is null").count() == 0


def test_minmax(frame):
    df = frame([(1.0, 3.0), (5.0, 3.0), (None, 3.0)], "x double, c double")
    out = bag(op.minmax(df, ["x", "c"]))
    assert out == [(0.0, None), (1.0, None), (None, None)]


def test_surrogate_ids_are_dense_stable_and_one_to_one(frame):
    df = frame([(f"p{i % 500}",) for i in range(900)] + [(None,)], "k string")
    ids = dict(op.surrogate_ids(df, "k", prefix=1).collect())
    assert sorted(ids.values()) == list(range(1, 501)) and len(ids) == 500
    assert ids == dict(op.surrogate_ids(df.repartition(7), "k", prefix=2).collect())
    assert ids != dict(op.surrogate_ids(df, "k", salt="x").collect())


def test_deidentify(frame):
    df = frame([("a",), ("a",), (None,)], "x string")
    for algo, size in [("sha256", 64), ("md5", 32), ("crc32", 8)]:
        got = [r[0] for r in op.deidentify(df, "x", algo, salt="s").collect()]
        assert got[0] == got[1] and len(got[0]) == size and got[2] is None
    assert [r[0] for r in op.deidentify(df, "x", "crc32").collect()][0] == "e8b7be43"
    with pytest.raises(ValueError):
        op.deidentify(df, "x", "rot13")


def test_entropy_and_prior(frame):
    df = frame([("Y",)] * 3 + [("N",)] + [(None,)], "x string")
    shannon = op.entropy(df, "x", normalize_by_classes=False).first()[0]
    assert shannon == pytest.approx(0.8112781244591328)
    assert op.entropy(df, "x").first()[0] == pytest.approx(shannon / 2)
    assert op.prior(df, "x", "Y").first()[0] == pytest.approx(60.0)


def test_assert_unique(frame):
    df = frame([("a", 1), ("a", 2)], "k string, v int")
    assert op.assert_unique(df, "k", "v") is df
    with pytest.raises(op.DuplicateKeyError):
        op.assert_unique(df, "k")


@pytest.mark.parametrize("fetch", [1, 5, 10_000])
def test_exact_quantiles(frame, fetch):
    rng = random.Random(3)
    rows = [(rng.gauss(0, 5), float(rng.choice([1, 1, 1, 2, 7]))) for _ in range(401)] + [(None, None)]
    df = frame(rows, "x double, y double")
    got = op.exact_quantiles(df, ["x", "y"], [0.0, 0.25, 0.5, 0.9, 1.0], fetch=fetch)
    for i, c in enumerate("xy"):
        values = sorted(r[i] for r in rows if r[i] is not None)
        for p, q in zip([0.0, 0.25, 0.5, 0.9, 1.0], got[c]):
            place = p * (len(values) - 1)
            low = int(place)
            high = min(low + 1, len(values) - 1)
            assert q == pytest.approx(values[low] + (values[high] - values[low]) * (place - low))
    assert op.exact_quantiles(df.limit(0), "x", [0.5]) == {"x": [None]}


def test_hot_key_survives_every_pick(spark):
    """One key with a third of the rows and one with a third of copies."""
    df = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id") % 1000).alias("k"),
        F.when(F.col("id") % 3 == 1, 7).otherwise(F.col("id")).alias("v"),
    )
    want = df.groupBy("k").agg(F.max("v").alias("v"))
    assert bag(op.latest(df, "k", "v")) == bag(want)
    assert bag(op.latest(df, "k", "v", ties=True).distinct()) == bag(want)
    assert op.union_distinct(df, df).count() == df.distinct().count()
