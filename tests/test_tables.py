"""The integration and cleaning stages on small hand-made tables."""

from datetime import date

import pytest
from conftest import bag
from pyspark.sql import functions as F

from cohort import functions as fn
from cohort import operators as op
from cohort import sources as src
from cohort.plans import clean, wide
from cohort.plans.catalog import Tables
from cohort.plans.source_tables import two_sources

HEAD = "EncounterID int, PID1 string, PID2 string, DateEncounterStart date, DateEncounterEnd date, EnteredDate date, ENTERED_DATE string"


def day(n):
    return date(2013, 1, n)


@pytest.fixture
def encounter(frame):
    """Encounter rows from ``(id, subject, day, extra...)``."""

    def build(rows, extra):
        full = [(i, p, "w", None, None, d and day(d), None, *rest) for i, p, d, *rest in rows]
        return frame(full, f"{HEAD}, {extra}")

    return build


SMEAR1 = "PatientID string, SputumTestID string, Month int, DateSubmitted date, DateTested date, SmearResult string"
SMEAR2 = (
    "PatientID string, SputumLabID string, Month int, SmearOrderDate date, DateSmearTested date, SmearResult string, "
    "DateGeneXpertTested date, Details string, GeneXpertResult string, GeneXpertResistance string"
)


def test_smears_prefer_positive_and_pick_the_first(frame):
    a = frame(
        [
            ("p", "1", 0, day(1), day(2), "NEGATIVE"),
            ("p", "2", 0, day(3), day(4), "1-9 AFB"),
            ("q", "3", 0, day(1), day(2), "NEGATIVE"),
            ("r", "4", 0, day(1), day(2), "NEGATIVE"),
            ("r", "5", 0, day(1), day(3), "NEGATIVE"),
            ("s", "6", 2, day(1), day(2), "3+"),
            ("t", "7", 0, day(5), day(6), "2+"),
        ],
        SMEAR1,
    )
    b = frame([("t", "8", 0, day(1), day(2), "1+", None, None, None, None)], SMEAR2)
    got = wide.smears({"sputumresults": a}, {"sputumresults": b}).select("PatientID", "SmearResult")
    assert bag(got) == [("p", "1-9AFB"), ("q", "NEGATIVE"), ("t", "1+")]


def test_gene_tests_drop_invalid_and_fold_patterns(frame):
    one = "PatientID string, LaboratoryID string, DateTested date, Remarks string, GeneXpertResult string, DrugResistance string"
    rows = [
        ("p", "1", day(1), None, "MTB POSITIVE", "RIF RESISTANT"),
        ("p", "2", day(1), None, "MTB NEGATIVE", None),
        ("q", "3", day(1), None, "ERROR", "X"),
        ("r", "4", day(1), None, None, "rif sensitive"),
        ("s", "5", None, None, "MTB POSITIVE", None),
    ]
    a = {"genexpertresults": frame(rows, one)}
    b = {"sputumresults": frame([("t", "6", 0, None, None, None, day(2), "d", "", None)], SMEAR2)}
    got = wide.gene_tests(a, b).select("PatientID", "GeneXpertResult", "DrugResistance")
    assert bag(got) == [("p", "POSITIVE", "RESISTANT"), ("r", None, "SENSITIVE")]


def test_xrays_must_precede_the_baseline(frame, encounter):
    one = "PatientID string, XRayDate date, DateReported date, XRayResults string, Remarks string"
    rows = [
        ("p", day(3), day(4), "NORMAL", "late"),
        ("p", day(2), day(4), "NORMAL", "early"),
        ("p", day(1), day(4), "IMAGE UNCLEAR", "bad"),
        ("q", day(5), day(5), "NORMAL", "same day"),
        ("r", day(1), day(2), "NORMAL", "no baseline"),
        ("s", day(4), day(4), "NORMAL", "two baselines"),
    ]
    a = {
        "xrayresults": frame(rows, one),
        "enc_baseline": encounter([(1, "p", 9, None), (2, "q", 5, None), (3, "s", 3, None)], "X string"),
    }
    b = {
        "xrayresults": frame([], one.replace("XRayResults", "XRayResult")),
        "enc_baseline": encounter([(4, "s", 8, None)], "X string"),
    }
    got = wide.xrays(a, b).select("PatientID", "Remarks")
    assert bag(got) == [("p", "early"), ("s", "two baselines")]


def test_outcome_takes_the_latest_and_names_it(encounter):
    rows = [
        (1, "p", 1, "CURED", None),
        (2, "p", 5, "TX FAILURE", None),
        (3, "p", 5, "Transfer out", "x"),
        (1, "q", 1, "DEAFAULT", None),
        (1, "r", 1, "MDR SUSPECT", None),
        (1, "s", None, "treamtent completed", None),
    ]
    a = {"enc_end_fol": encounter(rows, "REASON string, OTHER_REASON string")}
    got = wide.treatment_outcome(a, a).select("PatientID", "TreatmentOutcome")
    want = [("p", "TRANSFERRED"), ("q", "MOVED"), ("r", "MDR PATIENT"), ("s", "TREATMENT COMPLETED")]
    assert bag(got) == want


def test_refusal_and_drug_totals(encounter, frame):
    a = {"enc_refusal": encounter([(1, "p", 1, "A", "B"), (4, "p", 1, "C", "D")], "REASON string, WHAT_REFUSED string")}
    assert [r["REASON"] for r in wide.refusals(a, a).collect()] == ["C"]
    columns = "PatientID string, {} int, DateDispensed date, PillsDelivered int, PillsQuotaDelivered int, StreptomycinDelivered int, StreptomycinQuotaDelivered int, Remarks string"
    rows = [("p", 1, None, 10, 12, None, 1, None), ("p", None, None, 5, 6, 2, 1, None)]
    one = {"drughistory": frame(rows, columns.format("DispensationNo"))}
    two = {"drughistory": frame(rows[:1], columns.format("DispensalNo"))}
    assert bag(wide.drug_history(one, two)) == [("p", 1, 15, 18, 2, 2)]


def test_known_bad_record_is_removed_and_ages_are_read(encounter):
    symptoms = ", ".join(f"{c} string" for c in ["AGE", *wide.SYMPTOMS])
    rows = [(1, "p", 1, "34 yrs", *[None] * 9), (2, "p", 1, "n/a", None, None, "< 2 weeks", *[None] * 6)]
    a = {"enc_suspect_id": encounter(rows, symptoms)}
    with pytest.raises(op.DuplicateKeyError):
        op.assert_unique(wide.screening(a, a), "PatientID")
    got = wide.screening(a, a, known_bad=[{"PatientID": "p", "EncounterID": 1}]).first()
    assert got["ScreeningAge"] is None and got["CoughDuration"] == "LESS THAN 2 WEEKS"


def test_symptoms_agree_with_each_other(frame):
    names = ["Fever", "Cough", "CoughDuration", "ProductiveCough", "BloodInCough", "NightSweats", "WeightLoss", "TBHistory", "TBInFamily"]
    schema = ", ".join(f"{c} string" for c in names)
    yes, no = "YES", "NO"
    rows = [
        (yes, yes, "MORE THAN 3 WEEKS", yes, yes, yes, yes, yes, yes),
        (no, no, yes, yes, yes, no, no, no, no),
        (None,) * 9,
        (yes, yes, "2 TO 3 WEEKS", no, yes, "REFUSED", no, no, no),
        (yes, "REFUSED", None, None, None, no, no, no, no),
        (yes, yes, "LESS THAN 2 WEEKS", no, None, no, no, no, no),
    ]
    got = [tuple(r) for r in clean.symptoms(frame(rows, schema)).collect()]
    unknown = "DON'T KNOW"
    assert got == [
        (yes, yes, "MORE THAN 3 WEEKS", yes, yes, yes, yes, yes, yes, 11),
        (no, no, no, no, no, no, no, no, no, 0),
        (yes, yes, unknown, yes, no, yes, yes, unknown, unknown, 5),
        (yes, yes, "2 TO 3 WEEKS", yes, yes, "REFUSE", no, no, no, 6),
        (yes, "REFUSED", unknown, unknown, no, no, no, no, no, 1),
        (yes, yes, "LESS THAN 2 WEEKS", no, no, no, no, no, no, 3),
    ]


def test_score_of_nothing_known_is_zero(frame):
    df = frame([(None, None)], "a string, b string")
    assert df.select(fn.score([(F.col("a") == "YES", 1), (F.col("b") == "YES", 3)])).first()[0] == 0


def test_layouts():
    assert len(wide.WIDE_COLUMNS) == len(set(wide.WIDE_COLUMNS)) == 84
    assert len(clean.CLEAN_COLUMNS) == len(set(clean.CLEAN_COLUMNS)) == 51
    assert len(clean.DELAYS) == 12


def test_csv_keeps_quotes_and_nulls_but_not_empty_text(frame, spark, tmp_path):
    rows = [(1, 'a "q", b', day(1)), (2, None, None), (3, "", day(2)), (4, "back\\slash", day(3)), (5, "two\nlines", day(4))]
    df = frame(rows, "i int, s string, d date")
    path = str(tmp_path / "out")
    src.write_csv(op.fill_blank(df).coalesce(1), path)
    first = next((tmp_path / "out").glob("*.csv")).read_text().splitlines()[:3]
    assert first == ['"i","s","d"', '"1","a ""q"", b","2013-01-01"', '"2","",""']
    back = bag(src.read_csv(spark, path, "i int, s string, d date", multiline=True))
    assert back == [(i, s or None, d) for i, s, d in rows]


def test_dictionary_stage_metrics_and_encoding(frame, spark, tmp_path):
    (tmp_path / "dict.csv").write_text("Attribute,Description,Data type,Category\nx,\"a, b\",Nominal,-\n")
    dictionary = src.read_dictionary(spark, str(tmp_path / "dict.csv"))
    df = frame([("b", 1.0), (None, 2.0), ("a", None)], "x string, y double")
    report = {r["column"]: r for r in op.profile(df, dictionary).collect()}
    assert report["x"]["declared"] == "Nominal" and report["y"]["declared"] is None
    assert report["x"]["n_distinct"] == 2 and report["x"]["min"] == "a"
    assert op.profile(df, exact_distinct=False).count() == 2
    assert src.stage(df, "staged", persist=True).count() == spark.table("staged").count()
    coded, levels = src.encode(df, ["x"])
    assert [r["x_code"] for r in coded.orderBy(F.col("y").asc_nulls_last()).collect()] == [1.0, 2.0, 0.0]
    assert bag(levels) == [("x", "a", 0), ("x", "b", 1)]
    src.append_metrics(df, str(tmp_path / "log"))
    src.append_metrics(df, str(tmp_path / "log"), stamp=False)
    assert spark.read.parquet(str(tmp_path / "log")).filter("logged_at is null").count() == 3


def test_cleaning_the_exported_csv_equals_cleaning_the_typed_table(spark, tmp_path):
    """The whole way: two sources, wide table, CSV of text, clean table."""
    typed = wide.wide_table(*two_sources(Tables(spark, "/root/testdata/sf0.001")), check=True)
    wide.export_wide(typed, str(tmp_path / "wide"))
    text = src.read_csv(spark, str(tmp_path / "wide"), ", ".join(f"{c} string" for c in wide.WIDE_COLUMNS))
    a, b = (clean.clean_table(df, salt="s", ntree=3).drop("PatientID") for df in (text, typed))
    assert a.count() > 0 and a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    complete = set(clean.CLEAN_COLUMNS) - {"Gender", "AgeGroup", "Weight", "ScreeningYear", "PatientID"}
    gaps = {r["column"] for r in op.missing_ratio(a).filter("missing_ratio > 0").collect()}
    assert not gaps & complete
