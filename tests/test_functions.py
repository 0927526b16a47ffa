from datetime import date

import pytest
from pyspark.sql import functions as F

from cohort import functions as fn
from cohort.plans import clean, wide
from cohort.plans.wide import repaired_measure

X = F.col("x")


def test_recode_groups_synonyms_and_keeps_the_rest(values):
    mapping = {"CATEGORY 1": "CAT I", "CATEGORY 2": "CAT II"}
    xs = ["CATEGORY 1", "CATEGORY 2", "CAT I", "category 1", None]
    assert values(fn.recode("x", mapping), xs, "string") == ["CAT I", "CAT II", "CAT I", "category 1", None]
    assert values(fn.recode("x", mapping, case_insensitive=True), [" category 1 "], "string") == ["CAT I"]
    assert values(fn.recode("x", {}), xs, "string") == xs


def test_recode_is_idempotent_for_the_tables_in_use(values):
    for table in (clean.CASTES, clean.SITES, clean.DIAGNOSES, wide.OUTCOMES, wide.REGIMENS):
        once = fn.recode("x", table)
        twice = fn.recode(once, table)
        xs = [*table, *table.values()]
        assert values(once, xs, "string") == values(twice, xs, "string")


def test_recode_like_takes_the_first_match(values):
    xs = ["RIF RESISTANT INDETERMINATE", "RIF RESISTANT", "SENSITIVE", "", None, "resistant"]
    want = ["INDETERMINATE", "RESISTANT", "SENSITIVE", "", None, "resistant"]
    assert values(fn.recode_like("x", wide.RESISTANCE), xs, "string") == want
    assert values(fn.recode_like("x", wide.RESISTANCE, case_insensitive=True), ["resistant"], "string") == ["RESISTANT"]


def test_recode_like_rejects_results_a_later_rule_would_change():
    with pytest.raises(ValueError):
        fn.recode_like("x", [("%A%", "AB"), ("%B%", "C")])


def test_unknown_predicates_change_nothing(values):
    assert values(fn.null_if("x", X > 5), [None, 5.0, 6.0], "double") == [None, 5.0, None]
    assert values(fn.repair_if("x", X > 90, F.lit(1.0)), [None, 90.0, 91.0], "double") == [None, 90.0, 1.0]
    assert values(fn.clamp("x", low=2011), [None, 2010, 2011, 2012], "int") == [None, 2011, 2011, 2012]
    assert values(fn.clamp("x", high=3), [None, 2, 3, 4], "int") == [None, 2, 3, 3]


def test_height_and_weight_repair(values):
    height = repaired_measure("x", lambda x: x < wide.FEET_BELOW, wide.CM_PER_FOOT)
    got = values(height, [None, 0.0, 5.5, 39.9, 40.0, 443.0, 444.0], "double")
    assert got == pytest.approx([None, None, 167.64, 1216.152, 40.0, 443.0, None])
    weight = repaired_measure("x", lambda x: x > wide.POUNDS_ABOVE, wide.KG_PER_POUND)
    got = values(weight, [None, 0.0, 60.0, 140.0, 140.1, 443.0, 444.0], "double")
    assert got == pytest.approx([None, None, 60.0, 140.0, 63.53535, 200.9005, None])


def test_strip_case_and_text(values):
    assert values(fn.strip_chars("x"), ["GIL GIT.", "a\tb", None], "string") == ["GILGIT", "ab", None]
    assert values(fn.normalize_case("x"), ["New", None], "string") == ["NEW", None]
    assert values(fn.joined_text("x", F.lit("b")), ["a", None], "string") == ["a b", None]


def test_lenient_parsing(values):
    assert values(fn.lenient_int("x"), ["34 yrs", " 7", "n/a", "", None], "string") == [34, 7, None, None, None]
    assert values(fn.lenient_number("x"), ["1.5", "x", None], "string") == [1.5, None, None]
    days = ["2013-04-09", "2013/04/09", "2013-02-29", "soon", None]
    assert values(fn.parse_date("x"), days, "string") == [date(2013, 4, 9), date(2013, 4, 9), None, None, None]


def test_leap_day_has_no_birthday_in_a_common_year(values):
    born = fn.synth_date(X, F.lit(2), F.lit(29))
    assert values(born, [2012, 2013, None], "int") == [date(2012, 2, 29), None, None]


@pytest.mark.parametrize(
    "x, want",
    [(None, "NOT PRESENT"), (-1, "NONE"), (0, "NONE"), (1, None), (2, "3D"), (3, "3D"), (4, "1W"), (7, "1W"), (8, "2W"),
     (14, "2W"), (15, "1M"), (30, "1M"), (31, "2M"), (60, "2M"), (61, "6M"), (180, "6M"), (181, "1Y")],
)
def test_delay_bins(values, x, want):
    assert values(fn.discretize_delay("x"), [x], "int") == [want]


def test_delay_gap_can_be_closed(values):
    assert values(fn.discretize_delay("x", gap_to="3D"), [1], "int") == ["3D"]


def test_age_bins(values):
    ages = [4, 5, 12, 13, 19, 20, 25, 26, 29, 30, 39, 40, 49, 50, 66, 67, None]
    want = "infant child child teen teen young young adult1 adult1 adult2 adult2 old1 old1 old2 old2 ancient".split()
    assert values(fn.bucketize("x", clean.AGE_EDGES, clean.AGE_GROUPS), ages, "int") == [*want, None]


def test_weight_bins_have_a_gap(values):
    weights = [34.0, 35.0, 46.04, 54.05, 63.78, 81.59, 81.6, 91.5, 91.6]
    want = ["verylow", "low", "below_avg", "average", "above_avg", "above_avg", None, None, "high"]
    bins = fn.bucketize("x", clean.WEIGHT_EDGES, clean.WEIGHT_GROUPS, clean.WEIGHT_GAPS)
    assert values(bins, weights, "double") == want


def test_bucketize_checks_its_arguments():
    with pytest.raises(ValueError):
        fn.bucketize("x", [1, 2], ["a", "b"])
    with pytest.raises(ValueError):
        fn.bucketize("x", [2, 1], ["a", "b", "c"])


def test_flags(frame):
    df = frame([("a", "a"), ("a", "b"), (None, "b"), ("a", None)], "a string, b string")
    got = df.select(fn.changed_flag("a", "b"), fn.presence_flag("a"), fn.positive_flag("b", "b"), fn.label("a", ["a"]))
    assert [tuple(r) for r in got.collect()] == [
        ("NO", "YES", "YES", "YES"),
        ("YES", "YES", "NO", "YES"),
        ("NO", "NO", "NO", "NO"),
        ("NO", "YES", "NO", "YES"),
    ]


def test_fill_when(values):
    phase = fn.fill_when(F.lit(None).cast("string"), X <= 60, "INTENSIVE", "CONTINUATION")
    assert values(phase, [60, 61, None], "int") == ["INTENSIVE", "CONTINUATION", None]


def test_half_to_even_and_harmonic_mean(values, frame):
    assert values(F.bround("x", 0), [2.5, 3.5, -2.5], "double") == [2.0, 4.0, -2.0]
    df = frame([(2.0,), (6.0,), (0.0,), (None,)], "x double")
    assert df.select(fn.harmonic_mean("x")).first()[0] == pytest.approx(3.0)
    assert frame([(None,)], "x double").select(fn.harmonic_mean("x")).first()[0] is None


def test_row_functions_work_on_a_stream(spark):
    source = spark.readStream.schema("o_orderkey long, o_orderpriority string, o_totalprice double").parquet(
        "/root/testdata/sf0.001", pathGlobFilter="orders.parquet"
    )
    out = source.select(
        fn.recode("o_orderpriority", {"5-LOW": "LOW"}).alias("p"),
        fn.bucketize("o_totalprice", [1e5, 2e5], ["S", "M", "L"]).alias("b"),
    )
    q = out.writeStream.format("memory").queryName("rows_out").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("rows_out").count() == spark.read.parquet("/root/testdata/sf0.001/orders.parquet").count()
