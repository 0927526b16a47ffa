"""From the tables of two operational systems to one wide, typed row per subject.

Each source is a mapping from table name to DataFrame. Stages are lazy; the wide table writes the cohort,
which several stages need, and each stage's reduced rows before it joins them. In every stage records are reduced per subject
by aggregates that combine before the shuffle, and only then joined, so a subject or a source with a
large share of the records does not land in one task. Records are made distinct only where copies
would count. All joins are on the subject key and share one partitioning, except the practitioner
dimension, which comes last.

Stages take an optional ``cohort``; the wide table leaves it out, since its joins restrict already.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from .. import functions as fn
from .. import operators as op
from ..sizing import checkpoint, small_or_plain
from ..sources import write_csv

Source = Mapping[str, DataFrame]

# --- Fixed values: table layouts, spellings and limits the results depend on. ---------------------

HEADER = ["EncounterID", "PID1", "PID2", "DateEncounterStart", "DateEncounterEnd", "EnteredDate", "ENTERED_DATE"]

PATIENT = [
    "PatientID", "CHWID", "GPID", "Weight", "Height", "BloodGroup", "DateRegistered", "TreatmentCenter",
    "HasTreatmentSupporter", "DiseaseConfirmed", "DiseaseCategory", "DiseaseSite", "Severity", "Regimen",
    "DoseCombination", "OtherDoseDescription", "TreatmentPhase", "PatientStatus", "PatientType",
    "DiseaseHistory", "TreatedPreviously", "CompletedPreviousTreatment",
]

# Names and the role in the system are left behind here.
PERSON = ["PID", "Gender", "DOB", "MaritalStatus", "Domicile", "Religion", "Caste"]

SYMPTOMS = {
    "FEVER": "Fever",
    "COUGH": "Cough",
    "COUGH_DURATION": "CoughDuration",
    "PRODUCTIVE_COUGH": "ProductiveCough",
    "HAEMOPTYSIS": "BloodInCough",
    "NIGHT_SWEATS": "NightSweats",
    "WEIGHT_LOSS": "WeightLoss",
    "TB_HISTORY": "TBHistory",
    "TB_FAMILY_HISTORY": "TBInFamily",
}

DIAGNOSIS = {
    "PID1": "PatientID",
    "PID2": "DiagnosedBy",
    "EnteredDate": "DiagnosisDate",
    "ANTIBIOTIC_TRIAL": "DiagnosisAntibiotic",
    "CLINICAL_SYMP_TB": "TBSymptomsDiagnosed",
    "CONTACT_HISTORY": "TBContactDiagnosed",
    "DIAGNOSIS": "Diagnosis",
    "LARGE_LYMPH_NODES": "LargeLymphDiagnosed",
    "LYMPH_NODE_BIOPSY": "LymphBiopsyDiagnosed",
    "MANTOUX": "MantouxDiagnosed",
    "PAST_HISTORY": "PastTBDiagnosed",
    "XRAY_SUGGESTIVE": "XRaySuggestiveDiagnosed",
    "OTHER_THAN_TB_DETAIL": "OtherTBDiagnosis",
}

CATEGORIES = {"CATEGORY 1": "CAT I", "CATEGORY 2": "CAT II"}
REGIMENS = {"RHEZ": "RHZE"}
BASELINE_REGIMENS = {"RHEZ": "RHZE", "EH": "HE"}
COUGH_DURATIONS = {
    "< 2 WEEKS": "LESS THAN 2 WEEKS",
    "2-3 WEEKS": "2 TO 3 WEEKS",
    "> 3 WEEKS": "MORE THAN 3 WEEKS",
}
SMEARS = {"1-9 AFB": "1-9AFB"}
INVALID_GENE_TESTS = ["", "ERROR", "INVALID"]
GENE_RESULTS = [("%POSITIVE%", "POSITIVE"), ("%NEGATIVE%", "NEGATIVE")]
RESISTANCE = [("%INDETERMINATE%", "INDETERMINATE"), ("%RESISTANT%", "RESISTANT"), ("%SENSITIVE%", "SENSITIVE")]
INVALID_XRAYS = ["IMAGE UNCLEAR"]
OUTCOMES = {
    "TX FAILURE": "TREATMENT FAILURE",
    "FAILURE": "TREATMENT FAILURE",
    "TX COMPLETED": "TREATMENT COMPLETED",
    "TREAMTENT COMPLETED": "TREATMENT COMPLETED",
    "DEAFAULT": "MOVED",
    "DEFAULTED": "MOVED",
    "DEFAULT/MOVED OUT OF AREA": "MOVED",
}
OUTCOME_PATTERNS = [("%TRANSFER%", "TRANSFERRED"), ("%MDR%", "MDR PATIENT"), ("%RESISTANT%", "MDR PATIENT")]

NO_MEASURE = 444  # heights and weights from here on are placeholders
FEET_BELOW, CM_PER_FOOT = 40, 30.48
POUNDS_ABOVE, KG_PER_POUND = 140, 0.4535
BASELINE_WEIGHT_LIMIT = 200

#: The column of each record table that names the subject.
SUBJECT = {
    **dict.fromkeys(["enc_suspect_id", "enc_baseline", "enc_cdf", "enc_end_fol"], "PID1"),
    **dict.fromkeys(["sputumresults", "genexpertresults", "xrayresults"], "PatientID"),
}

WIDE_COLUMNS = [
    "PatientID", "GP", "GPQualification", "GPSpeciality", "Screener", "DOB", "BirthYear", "ScreeningAge",
    "Gender", "MaritalStatus", "Religion", "Caste", "Weight", "Height", "ScreeningDate", "ScreeningYear",
    "DateRegistered", "RegistrationYear", "HasTreatmentSupporter", "DiseaseConfirmed", "DiseaseCategory",
    "DiseaseSite", "LastRegimen", "DoseCombination", "OtherDoseDescription", "TreatmentPhase",
    "PatientStatus", "PatientType", "TreatedPreviously", "CompletedPreviousTreatment", "Fever", "Cough",
    "CoughDuration", "ProductiveCough", "BloodInCough", "NightSweats", "WeightLoss", "TBHistory",
    "TBInFamily", "SmearTested", "DateSputumSubmitted", "DateSputumTested", "SputumResultDelay",
    "SmearResult", "SmearPositive", "XRayDone", "XRayDate", "DateXRayReported", "XRayResultDelay",
    "XRayResults", "XRayRemarks", "XRayIndicative", "GeneXpertTested", "DateGXPTested", "GXPDelay",
    "GeneXpertResult", "DrugResistance", "GXRemarks", "GXPPositive", "DiagnosedBy", "DiagnosisDate",
    "DiagnosisAntibiotic", "TBSymptomsDiagnosed", "TBContactDiagnosed", "Diagnosis", "LargeLymphDiagnosed",
    "LymphBiopsyDiagnosed", "MantouxDiagnosed", "PastTBDiagnosed", "XRaySuggestiveDiagnosed",
    "OtherTBDiagnosis", "DiagnosisNotes", "BaselineCHWID", "BaselineDate", "BaselineWeight",
    "BaselinePatientCategory", "BaselinePatientType", "BaselineRegimen", "FDCTablets", "Streptomycin",
    "TreatmentEndDate", "TreatmentDuration", "TreatmentOutcome", "TreatmentOutcomeDetails",
]

# --------------------------------------------------------------------------------------------------


def _layout(columns: list[str], **differing) -> dict:
    return {c: differing.get(c, c) for c in columns}


def _both(
    first: DataFrame, second: DataFrame, columns: list[str], in_first=None, in_second=None, distinct: bool = True
) -> DataFrame:
    """Rows of a table kept by both sources, in the common layout."""
    union = op.union_distinct if distinct else op.append_rows
    return union(
        op.align(first, _layout(columns, **(in_first or {}))),
        op.align(second, _layout(columns, **(in_second or {}))),
    )


def _restricted(df: DataFrame, cohort: DataFrame | None, key: str = "PatientID") -> DataFrame:
    return df if cohort is None else op.restrict_to(df, cohort, {key: "PatientID"})


def practitioners(a: Source, b: Source) -> DataFrame:
    """Practitioner dimension, one row per name."""
    columns = ["GPName", "Qualification", "Speciality"]
    union = _both(
        a["gp"],
        b["gp"],
        columns,
        {"GPName": "GPID", "Qualification": "Qualification1", "Speciality": "Speciality1"},
        {"GPName": "GPID", "Speciality": "Specialization"},
    )
    return op.pick_one(union, "GPName", ["Qualification", "Speciality"])


def users(a: Source, b: Source) -> DataFrame:
    """System users of both sources with a dense id."""
    union = _both(a["users"], b["users"], ["UserName", "Role"])
    keyed = union.withColumn("__key", F.to_json(F.struct("UserName", "Role")))
    return keyed.join(op.surrogate_ids(keyed, "__key", "UserID"), "__key").select("UserID", "UserName", "Role")


def repaired_measure(c: str, wrong_unit, factor: float):
    """Placeholder to null, then the wrong unit, then zero to null, in this order."""
    x = F.col(c)
    x = fn.null_if(x, x >= NO_MEASURE)
    x = fn.rescale_if(x, wrong_unit(x), factor)
    return fn.null_if(x, x == 0)


def patients(a: Source, b: Source) -> DataFrame:
    """The cohort: confirmed subjects of a known type, with their personal data but no names."""
    supported = {"HasTreatmentSupporter": fn.has_value("TreatmentSupporter")}
    second = {**supported, "OtherDoseDescription": "Streptomycin"}
    subject = _both(a["patient"], b["patient"], PATIENT, supported, second)
    confirmed = F.col("DiseaseConfirmed").cast("boolean")
    subject = subject.filter(confirmed & F.col("PatientType").isNotNull())
    person = _both(a["person"], b["person"], PERSON).withColumnRenamed("PID", "PatientID")
    merged = op.inner(subject.drop("BloodGroup"), person, "PatientID")
    return merged.withColumns(
        {
            "DiseaseCategory": fn.recode("DiseaseCategory", CATEGORIES, case_insensitive=True),
            "Regimen": fn.recode("Regimen", REGIMENS, case_insensitive=True),
            "Height": repaired_measure("Height", lambda x: x < FEET_BELOW, CM_PER_FOOT),
            "Weight": repaired_measure("Weight", lambda x: x > POUNDS_ABOVE, KG_PER_POUND),
        }
    )


def screening(
    a: Source, b: Source, cohort: DataFrame | None = None, known_bad: list[Mapping] = ()
) -> DataFrame:
    """First encounter. ``known_bad`` lists records to delete, ``{"PatientID": ..., "EncounterID": ...}``."""
    union = _both(a["enc_suspect_id"], b["enc_suspect_id"], [*HEADER, "AGE", *SYMPTOMS])
    union = union.withColumn("COUGH_DURATION", fn.recode("COUGH_DURATION", COUGH_DURATIONS, case_insensitive=True))
    names = {"EncounterID": "EncounterID", "PID1": "PatientID", "PID2": "ScreenerID", "EnteredDate": "ScreeningDate"}
    out = op.project(union.withColumn("AGE", fn.lenient_int("AGE")), {**names, "AGE": "ScreeningAge", **SYMPTOMS})
    return _restricted(op.delete_keys(out, known_bad), cohort)


def smears(a: Source, b: Source) -> DataFrame:
    """Baseline smear per subject; a negative one gives way to any other."""
    columns = ["PatientID", "SputumTestID", "Month", "DateSubmitted", "DateTested", "SmearResult"]
    second = {"SputumTestID": "SputumLabID", "DateSubmitted": "SmearOrderDate", "DateTested": "DateSmearTested"}
    union = _both(a["sputumresults"], b["sputumresults"], columns, None, second)
    union = union.filter((F.col("Month") == 0) & F.col("SmearResult").isNotNull())
    union = union.withColumn("SmearResult", fn.recode("SmearResult", SMEARS, case_insensitive=True))
    kept = op.dedup_prefer(union, "PatientID", "SmearResult", "NEGATIVE", case_insensitive=True)
    return op.pick_one(kept, "PatientID", ["DateTested", "SputumTestID"])


def gene_tests(a: Source, b: Source) -> DataFrame:
    """Valid gene test per subject; the second source keeps them with the smears."""
    columns = ["PatientID", "LaboratoryID", "DateTested", "Remarks", "GeneXpertResult", "DrugResistance"]
    first = a["genexpertresults"].filter(F.col("DateTested").isNotNull())
    second = b["sputumresults"].filter((F.col("Month") == 0) & F.col("DateGeneXpertTested").isNotNull())
    renamed = {
        "LaboratoryID": "SputumLabID",
        "DateTested": "DateGeneXpertTested",
        "Remarks": "Details",
        "DrugResistance": "GeneXpertResistance",
    }
    union = op.drop_values(_both(first, second, columns, None, renamed), "GeneXpertResult", INVALID_GENE_TESTS, True)
    union = union.withColumns(
        {
            "GeneXpertResult": fn.recode_like("GeneXpertResult", GENE_RESULTS, case_insensitive=True),
            "DrugResistance": fn.recode_like("DrugResistance", RESISTANCE, case_insensitive=True),
        }
    )
    kept = op.dedup_prefer(union, "PatientID", "GeneXpertResult", "NEGATIVE", case_insensitive=True)
    return op.pick_one(kept, "PatientID", ["DateTested", "LaboratoryID"])


def xrays(a: Source, b: Source) -> DataFrame:
    """Readable X-ray taken before the baseline encounter, one per subject."""
    columns = ["PatientID", "XRayDate", "DateReported", "XRayResults", "Remarks"]
    renamed = {"XRayResults": "XRayResult"}
    union = _both(a["xrayresults"], b["xrayresults"], columns, None, renamed, distinct=False)
    baseline = _both(a["enc_baseline"], b["enc_baseline"], ["PID1", "EnteredDate"], distinct=False)
    union = op.drop_values(union.filter(F.col("XRayResults").isNotNull()), "XRayResults", INVALID_XRAYS, True)
    # Per subject the earliest X-ray is the one to pick, and if any lies before the reference it does.
    first = op.pick_one(union.filter(F.col("XRayDate").isNotNull()), "PatientID", ["XRayDate", "DateReported"])
    return op.before(first, baseline, {"PatientID": "PID1"}, "XRayDate", "EnteredDate")


def baseline_encounters(a: Source, b: Source) -> DataFrame:
    columns = [*HEADER, "FDC_TABLETS", "PATIENT_CATEGORY", "PATIENT_TYPE", "STREPTOMYCIN", "REGIMEN", "WEIGHT"]
    return _both(a["enc_baseline"], b["enc_baseline"], columns, {"STREPTOMYCIN": "STREPOMYCIN"})


def baseline_results(a: Source, b: Source) -> list[DataFrame]:
    """Smear, X-ray and gene test, each one row per subject, to be set side by side."""
    smear = smears(a, b).select(
        "PatientID",
        F.col("DateSubmitted").alias("DateSputumSubmitted"),
        F.col("DateTested").alias("DateSputumTested"),
        fn.day_gap("DateTested", "DateSubmitted").alias("SputumResultDelay"),
        "SmearResult",
    )
    xray = xrays(a, b).select(
        "PatientID",
        "XRayDate",
        F.col("DateReported").alias("DateXRayReported"),
        fn.day_gap("DateReported", "XRayDate").alias("XRayResultDelay"),
        "XRayResults",
        F.col("Remarks").alias("XRayRemarks"),
    )
    gene = gene_tests(a, b).select(
        "PatientID",
        F.col("DateTested").alias("DateGXPTested"),
        "GeneXpertResult",
        "DrugResistance",
        F.col("Remarks").alias("GXRemarks"),
    )
    return [smear, xray, gene]


def diagnosis(a: Source, b: Source, cohort: DataFrame | None = None) -> DataFrame:
    """Latest clinical diagnosis per subject."""
    notes = fn.joined_text("OTHER_DIAGNOSTIC_DETAIL", "NOTES")
    columns = [*DIAGNOSIS, "OTHER_DIAGNOSTIC_DETAIL", "NOTES"]
    union = _both(a["enc_cdf"], b["enc_cdf"], columns, distinct=False).withColumn("DiagnosisNotes", notes)
    renamed = op.project(union, {**DIAGNOSIS, "DiagnosisNotes": "DiagnosisNotes"})
    dated = renamed.filter(F.col("DiagnosisDate").isNotNull())
    return _restricted(op.latest(dated, "PatientID", "DiagnosisDate"), cohort)


def baseline_treatment(a: Source, b: Source, cohort: DataFrame | None = None) -> DataFrame:
    cleaned = baseline_encounters(a, b).select(
        F.col("PID1").alias("PatientID"),
        F.col("PID2").alias("BaselineCHWID"),
        F.col("EnteredDate").alias("BaselineDate"),
        fn.null_if("WEIGHT", F.col("WEIGHT") > BASELINE_WEIGHT_LIMIT).alias("BaselineWeight"),
        fn.recode("PATIENT_CATEGORY", CATEGORIES, case_insensitive=True).alias("BaselinePatientCategory"),
        F.col("PATIENT_TYPE").alias("BaselinePatientType"),
        fn.recode("REGIMEN", BASELINE_REGIMENS, case_insensitive=True).alias("BaselineRegimen"),
        F.col("FDC_TABLETS").alias("FDCTablets"),
        F.col("STREPTOMYCIN").alias("Streptomycin"),
    )
    return _restricted(cleaned, cohort)


def drug_history(a: Source, b: Source) -> DataFrame:
    """Dispensed quantities per subject."""
    amounts = ["PillsDelivered", "PillsQuotaDelivered", "StreptomycinDelivered", "StreptomycinQuotaDelivered"]
    columns = ["PatientID", "DispensationNo", "DateDispensed", *amounts, "Remarks"]
    union = _both(a["drughistory"], b["drughistory"], columns, None, {"DispensationNo": "DispensalNo"})
    totals = op.group_totals(union, ["PatientID"], ["DispensationNo"], amounts)
    names = ["TotalPills", "TotalPillsQuota", "TotalStreptomycin", "TotalStreptomycinQuota"]
    return op.project(
        totals,
        {
            "PatientID": "PatientID",
            "count_DispensationNo": "TotalDispensals",
            **{f"sum_{c}": n for c, n in zip(amounts, names)},
        },
    )


def follow_ups(a: Source, b: Source, cohort: DataFrame | None = None) -> DataFrame:
    columns = [*HEADER, "MONTH", "FDC_TABLETS", "STREPTOMYCIN", "REGIMEN", "WEIGHT", "TREATMENT_PHASE"]
    spelled = {"STREPTOMYCIN": "STREPOMYCIN"}
    first = {**spelled, "FDC_TABLETS": fn.first_present("FDC_TABLETS", "FDC_TABLET")}
    union = _both(a["enc_follow_up"], b["enc_follow_up"], columns, first, spelled)
    return _restricted(union, cohort, "PID1")


def refusals(a: Source, b: Source, cohort: DataFrame | None = None) -> DataFrame:
    """Last refusal encounter per subject."""
    union = _both(a["enc_refusal"], b["enc_refusal"], [*HEADER, "REASON", "WHAT_REFUSED"])
    return _restricted(op.latest(union, "PID1", "EncounterID", ties=True), cohort, "PID1")


def treatment_outcome(a: Source, b: Source, cohort: DataFrame | None = None) -> DataFrame:
    """How treatment ended: the latest end-of-follow-up encounter."""
    union = _both(a["enc_end_fol"], b["enc_end_fol"], [*HEADER, "REASON", "OTHER_REASON"], distinct=False)
    last = op.latest(union, "PID1", ["EnteredDate", "EncounterID"])
    reason = fn.recode("REASON", OUTCOMES, case_insensitive=True)
    out = last.select(
        F.col("PID1").alias("PatientID"),
        F.col("EnteredDate").alias("TreatmentEndDate"),
        fn.recode_like(reason, OUTCOME_PATTERNS, case_insensitive=True).alias("TreatmentOutcome"),
        F.col("OTHER_REASON").alias("TreatmentOutcomeDetails"),
    )
    return _restricted(out, cohort)


def wide_table(
    a: Source, b: Source, known_bad: list[Mapping] = (), salt: str = "", check: bool = True
) -> DataFrame:
    """The 84-column table, one row per subject; with ``check`` the run fails where a stage repeats a subject.

    The check is part of the plan, so every stage is computed once; repeated subjects of the cohort itself, which
    is written first, raise at once. All records are restricted to the cohort as they are read, before anything
    is aggregated.
    """
    guard = (lambda df: op.unique_rows(df, "PatientID")) if check else (lambda df: df)
    with op.naming_duplicates():
        cohort = checkpoint(guard(patients(a, b)))
    keys = small_or_plain(cohort.select("PatientID").distinct())
    a, b = (
        {
            name: df.join(keys.withColumnRenamed("PatientID", SUBJECT[name]), SUBJECT[name], "left_semi") if name in SUBJECT else df
            for name, df in s.items()
        }
        for s in (a, b)
    )
    stages = [
        screening(a, b, known_bad=known_bad),
        *baseline_results(a, b),
        diagnosis(a, b),
        baseline_treatment(a, b),
        treatment_outcome(a, b),
    ]
    # Fused into one task, the sorts and aggregates of all stages would hold memory at the same time.
    screened, *rest = [guard(checkpoint(stage)) for stage in stages]
    joined = op.assemble(op.inner(cohort, screened.drop("EncounterID"), "PatientID"), rest, "PatientID")
    joined = op.replace_ids(joined, "PatientID", op.surrogate_ids(cohort, "PatientID", salt=salt))
    dim = practitioners(a, b).withColumnsRenamed({"Qualification": "GPQualification", "Speciality": "GPSpeciality"})
    full = op.lookup(joined, dim, {"GPID": "GPName"}).withColumnsRenamed(
        {"GPID": "GP", "ScreenerID": "Screener", "Regimen": "LastRegimen"}
    )
    derived = {
        "BirthYear": F.year("DOB"),
        "ScreeningYear": F.year("ScreeningDate"),
        "RegistrationYear": F.year("DateRegistered"),
        "SmearTested": fn.presence_flag("SmearResult"),
        "SmearPositive": fn.positive_flag("SmearResult", "NEGATIVE", True),
        "XRayDone": fn.presence_flag("XRayResults"),
        "XRayIndicative": fn.positive_flag("XRayResults", "NORMAL", True),
        "GeneXpertTested": fn.presence_flag("GeneXpertResult"),
        "GXPPositive": fn.positive_flag("GeneXpertResult", "NEGATIVE", True),
        "GXPDelay": fn.day_gap("DateSputumTested", "DateGXPTested"),
        "TreatmentDuration": fn.day_gap("TreatmentEndDate", "BaselineDate"),
    }
    return full.withColumns(derived).select(*WIDE_COLUMNS)


def export_wide(wide: DataFrame, path: str) -> None:
    """Sort by registration, turn everything to text with blanks for nulls, and write CSV."""
    write_csv(op.fill_blank(wide.orderBy("DateRegistered")), path)
