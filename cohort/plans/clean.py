"""From the wide table to the clean table: typed, filled, binned, scored and de-identified.

The steps follow the data: rules that only look at one row are column expressions and fuse into one
pass; a statistic or a model is a barrier. The table is checkpointed twice, on entry and before the
models, so the statistics do not redo the integration and the five fits do not redo the statistics.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import functions as fn
from .. import models as ml
from .. import operators as op
from ..sizing import checkpoint

# --- Fixed values: spellings, edges, fills and columns the results depend on. ---------------------

DATES = [
    "DOB", "ScreeningDate", "DateRegistered", "DateSputumSubmitted", "DateSputumTested", "DateXRayReported",
    "XRayDate", "DateGXPTested", "TreatmentEndDate", "BaselineDate", "DiagnosisDate",
]
NUMBERS = ["ScreeningAge", "Weight", "Height", "BaselineWeight", "RegistrationYear", "ScreeningYear",
           "TreatmentDuration", "XRayResultDelay"]

UNKNOWN, ABSENT = "DON'T KNOW", "NOT PRESENT"
MIN_PATIENTS = 20
MAX_AGE = 90
AGE_EDGES = [5, 13, 20, 26, 30, 40, 50, 67]
AGE_GROUPS = ["infant", "child", "teen", "young", "adult1", "adult2", "old1", "old2", "ancient"]
WEIGHT_EDGES = [34.69, 46.04, 54.05, 63.78, 81.6]
WEIGHT_GROUPS = ["verylow", "low", "below_avg", "average", "above_avg", "high"]
WEIGHT_GAPS = [(81.6, 91.6)]
MAX_HEIGHT = 200
HEIGHT_EDGES = [60.25, 143.14, 154.83, 167.78]
HEIGHT_GROUPS = ["short", "below_avg", "average", "above_avg", "high"]
YEAR_OFF = 365
FIRST_YEAR = 2011
INTENSIVE_DAYS = 60
MAX_WEIGHT_CHANGE = 20

RELIGIONS = {"MUSLIM": "ISLAM"}
CASTES = {
    "ABAASI": "ABBASI",
    "AFGANI": "AFGHANI",
    "BALTI": "BALDI",
    "GILGATI": "GILGITI",
    "GILGETI": "GILGITI",
    "GILGIT": "GILGITI",
    "GILGITTI": "GILGITI",
    "GILGTI": "GILGITI",
    "GILGTY": "GILGITI",
    "GILLGITE": "GILGITI",
    "": "GILGITI",
    "HAZARA": "HAZARAWAL",
    "HAZARYWAAL": "HAZARAWAL",
    "HINDE": "HINDU",
    "HINDO": "HINDU",
    "KACCHI": "MEMON",
    "KATHIAWARI": "MEMON",
    "HINKO": "HINDKO",
    "KASHAMEERI": "KASHAMIRI",
    "KOHISTANE": "KOHISTANI",
    "KURESHI": "QURESHI",
    "QURAISHI": "QURESHI",
    "MARVARI": "MARWARI",
    "MARWAARI": "MARWARI",
    "MARWADRI": "MARWARI",
    "PHATAN": "PAKHTUN",
    "RAJPOT": "RAJPOOT",
    "RAJPUT": "RAJPOOT",
    "SERAIQE": "SARAIKI",
}
OTHER_CASTES = [
    "ABBASI", "BHERMI", "BURMI", "CHINA", "CHITRAL", "KHOKAR", "MAEO", "MAHROHRI", "MALAK", "MEWATI",
    "RANGARI", "SHINA", "OTHER",
]
SITES = dict.fromkeys(["EP-TB", "EP -TB", "EP TB", "EXTRA PULMONARY"], "EXTRAPULMONARY")
DIAGNOSES = {**SITES, "EPTB": "EXTRAPULMONARY"}
OTHER_DIAGNOSES = {
    "NO T.B": "NOT TB",
    "NO TB": "NOT TB",
    "TB BONE": "EXTRAPULMONARY",
    "TB SPINE": "EXTRAPULMONARY",
    "PLURAL TB": "EXTRAPULMONARY",
    "CXR SUGGUSTIVE TB": "PULMONARY TB",
    "SUGGESTIVE OF TB": "PULMONARY TB",
    "SMEAR NEGATIVE": "PULMONARY TB",
}
OPEN_STATUSES = ["SUSPECT", "GP_CONF", "VERIFIED", "PATIENT", "SUSPENDED"]
XRAYS = {
    "OTHER ABNORMALITY (NON-TB)": "OTHER ABNORMALITY",
    "OTHER ABNORMALITY ": "OTHER ABNORMALITY",
    "POSSIBILITY OF TB": "SUGGESTIVE OF TB",
    "SUSPICIOUS OF TB": "SUGGESTIVE OF TB",
}
OUTCOMES = {"NOT TB": "OTHER", "CLOSED": "OTHER"}
COMPLETE = ["CURED", "TRANSFERRED", "TREATMENT COMPLETED", "TREATMENT FAILURE", ""]

DELAYS = [
    "SputumResultDelay", "GXPToBaselineDelay", "SmearToBaselineDelay", "XRayResultDelay", "XRayToBaselineDelay",
    "RegistrationDelay", "ScreeningToSmearDelay", "ScreeningToXRayDelay", "ScreeningToGXPDelay",
    "ScreeningToDiagnosisDelay", "ScreeningToBaselineDelay", "DiagnosisToBaselineDelay",
]
FILLS = {
    "XRayResults": UNKNOWN,
    "GeneXpertResult": UNKNOWN,
    "DrugResistance": UNKNOWN,
    "DiagnosisAntibiotic": UNKNOWN,
    "TBSymptomsDiagnosed": UNKNOWN,
    "TBContactDiagnosed": UNKNOWN,
    "Diagnosis": UNKNOWN,
    "LargeLymphDiagnosed": UNKNOWN,
    "LymphBiopsyDiagnosed": UNKNOWN,
    "MantouxDiagnosed": UNKNOWN,
    "PastTBDiagnosed": UNKNOWN,
    "XRaySuggestiveDiagnosed": UNKNOWN,
    "BaselineWeightGroup": UNKNOWN,
    "BaselinePatientCategory": "CAT I",
    "BaselinePatientType": "NEW",
    "BaselineRegimen": "RHZE",
    "DiseaseCategory": "CAT I",
    "DoseCombination": "3",
    "TreatmentOutcome": ABSENT,
    **{c: ABSENT for c in DELAYS},
}

CLEAN_COLUMNS = [
    "PatientID", "TreatmentComplete", "Gender", "AgeGroup", "Weight", "HeightGroup", "MaritalStatus",
    "ScreeningYear", "RegistrationYear", "TBHistory", "TBInFamily", "RegistrationDelay", "SputumResultDelay",
    "SmearResult", "ScreeningToSmearDelay", "XRayDone", "XRayResultDelay", "XRayResults", "XRayIndicative",
    "ScreeningToXRayDelay", "GeneXpertTested", "GeneXpertResult", "DrugResistance", "GXPPositive",
    "ScreeningToGXPDelay", "ScreeningToDiagnosisDelay", "DiagnosedBy", "DiagnosisAntibiotic",
    "TBSymptomsDiagnosed", "TBContactDiagnosed", "Diagnosis", "LargeLymphDiagnosed", "LymphBiopsyDiagnosed",
    "MantouxDiagnosed", "PastTBDiagnosed", "XRaySuggestiveDiagnosed", "ScreeningToBaselineDelay",
    "SmearToBaselineDelay", "XRayToBaselineDelay", "GXPToBaselineDelay", "DiagnosisToBaselineDelay",
    "BaselineWeightGroup", "BaselinePatientCategory", "BaselinePatientType", "BaselineRegimen",
    "BaselineDoseCombination", "BaselineStreptomycin", "ScreeningToBaselineWeightDifference",
    "DiseaseCategory", "DiseaseSite", "DoseCombination",
]

# --------------------------------------------------------------------------------------------------


def typed(df: DataFrame) -> DataFrame:
    """Parse dates and numbers that come as text; typed columns pass unchanged in value."""
    return df.withColumns(
        {
            **{c: fn.parse_date(c) for c in DATES},
            **{c: fn.lenient_number(c) for c in NUMBERS},
            "DoseCombination": F.col("DoseCombination").cast("string"),
            "OtherDoseDescription": F.col("OtherDoseDescription").cast("string"),
        }
    )


def people(df: DataFrame) -> DataFrame:
    """Practitioners, ages, dates of birth, religion and caste."""
    df = op.fill_median(df, "RegistrationYear")
    df = op.fill_mode(df, "GP", tie="order", order_by=F.struct("DateRegistered", "PatientID"))
    df = op.collapse_rare(op.fill_const(df, {"DiagnosedBy": UNKNOWN}), "DiagnosedBy", MIN_PATIENTS)
    df = op.coalesce_from(df.withColumn("__age", fn.year_gap("DateRegistered", "DOB")), "ScreeningAge", "__age")
    df = op.coalesce_from(df.drop("__age"), "ScreeningDate", "DateRegistered")
    seen = F.col("ScreeningDate")
    born = fn.synth_date(F.year(seen) - F.col("ScreeningAge"), F.month(seen), F.dayofmonth(seen))
    df = df.withColumn("DOB", fn.first_present("DOB", born)).withColumn("BirthYear", F.year("DOB"))
    by_year = F.col("RegistrationYear") - F.col("BirthYear")
    df = df.withColumn("ScreeningAge", fn.repair_if("ScreeningAge", F.col("ScreeningAge") > MAX_AGE, by_year))
    caste = fn.group_into(fn.recode(fn.strip_chars("Caste"), CASTES), OTHER_CASTES, "OTHERS")
    df = df.withColumns(
        {
            "AgeGroup": fn.bucketize("ScreeningAge", AGE_EDGES, AGE_GROUPS),
            "Religion": fn.first_present(fn.recode("Religion", RELIGIONS), F.lit("ISLAM")),
            "Caste": caste,
        }
    )
    return op.fill_mode(df, "Caste")


def measures(df: DataFrame) -> DataFrame:
    """Weight and height, and their groups; the height group is completed by a model later."""
    df = op.fill_group_stat(df, "Weight", ["AgeGroup", "Gender"], "harmonic")
    df = df.withColumn("Weight", F.bround("Weight", 0))
    df = df.withColumn("WeightGroup", fn.bucketize("Weight", WEIGHT_EDGES, WEIGHT_GROUPS, WEIGHT_GAPS))
    df = op.fill_mode(df, "WeightGroup")
    at_baseline = fn.bucketize("BaselineWeight", WEIGHT_EDGES, WEIGHT_GROUPS, WEIGHT_GAPS)
    height = F.bround(fn.null_if("Height", F.col("Height") > MAX_HEIGHT), 0)
    df = df.withColumns({"BaselineWeightGroup": fn.first_present(at_baseline, "WeightGroup"), "Height": height})
    return df.withColumn("HeightGroup", fn.bucketize("Height", HEIGHT_EDGES, HEIGHT_GROUPS))


def treatment(df: DataFrame) -> DataFrame:
    """Registration, category, site, regimen, doses, phase and status."""
    df = df.withColumns(
        {
            "MaritalStatus": fn.first_present("MaritalStatus", F.lit("MARRIED")),
            "DateRegistered": fn.first_present("DateRegistered", "ScreeningDate"),
            "ScreeningYear": fn.clamp("ScreeningYear", low=float(FIRST_YEAR)),
            "DiseaseCategory": fn.first_present("DiseaseCategory", "BaselinePatientCategory"),
            "DiseaseSite": fn.recode(fn.first_present("DiseaseSite", "Diagnosis"), SITES),
            "BaselineRegimen": fn.recode("BaselineRegimen", {"HE": "EH"}),
            "DoseCombination": fn.null_if("DoseCombination", fn.lenient_number("DoseCombination") == 99),
            "OtherDoseDescription": fn.null_if("OtherDoseDescription", fn.lenient_number("OtherDoseDescription") == 0),
            "PatientStatus": fn.group_into("PatientStatus", OPEN_STATUSES, "OPEN"),
            "PatientType": fn.normalize_case("PatientType"),
        }
    )
    wait = fn.day_gap("DateRegistered", "ScreeningDate")
    phase = fn.recode("TreatmentPhase", {"CONTINUOUS": "CONTINUATION"})
    short = F.col("TreatmentDuration") <= INTENSIVE_DAYS
    return df.withColumns(
        {
            "RegistrationDelay": fn.null_if(wait, (wait < 0) | (wait == YEAR_OFF)),
            "DiseaseSite": fn.null_if("DiseaseSite", F.col("DiseaseSite") == "OTHER THAN TB"),
            "RegimenChanged": fn.changed_flag("BaselineRegimen", "LastRegimen"),
            "TreatmentPhase": fn.fill_when(phase, short, "INTENSIVE", "CONTINUATION"),
        }
    ).drop("TreatedPreviously", "CompletedPreviousTreatment")


def symptoms(df: DataFrame) -> DataFrame:
    """Make the symptom answers agree with each other, complete them, and score severity."""
    cough, productive, blood = F.col("Cough"), F.col("ProductiveCough"), F.col("BloodInCough")
    df = op.apply_rules(
        df,
        [
            ((productive != "YES") & (blood == "YES"), "ProductiveCough", "YES"),
            (productive != "YES", "BloodInCough", None),
        ],
    )
    refused = {"REFUSED": "REFUSE"}
    df = df.withColumns({c: fn.recode(c, refused) for c in ("NightSweats", "WeightLoss", "TBHistory", "TBInFamily")})
    answered = {"Fever": "YES", "Cough": "YES", "CoughDuration": UNKNOWN, "NightSweats": "YES", "WeightLoss": "YES"}
    df = op.fill_const(df, {**answered, "TBHistory": UNKNOWN, "TBInFamily": UNKNOWN})
    df = op.apply_rules(
        df,
        [
            (cough == "NO", "CoughDuration", "NO"),
            (productive.isNull() & (cough == "YES"), "ProductiveCough", "YES"),
            (productive.isNull() & (cough != "NO"), "ProductiveCough", UNKNOWN),
            (cough == "NO", "ProductiveCough", "NO"),
            ((cough == "NO") | blood.isNull(), "BloodInCough", "NO"),
        ],
    )
    lasting = F.col("CoughDuration")
    yes = ["Cough", "ProductiveCough", "BloodInCough", "Fever", "NightSweats", "WeightLoss", "TBHistory", "TBInFamily"]
    weights = [("LESS THAN 2 WEEKS", 1), ("2 TO 3 WEEKS", 2), ("MORE THAN 3 WEEKS", 3)]
    points = [(F.col(c) == "YES", 1) for c in yes] + [(lasting == v, w) for v, w in weights]
    return df.withColumn("SeverityScore", fn.score(points))


def tests_and_delays(df: DataFrame) -> DataFrame:
    """Test results, diagnosis, delays between the steps of care, and the outcome."""
    gaps = {
        "ScreeningToSmearDelay": ("DateSputumTested", "ScreeningDate"),
        "SputumResultDelay": ("DateSputumTested", "DateSputumSubmitted"),
        "ScreeningToXRayDelay": ("XRayDate", "ScreeningDate"),
        "ScreeningToGXPDelay": ("DateGXPTested", "ScreeningDate"),
        "ScreeningToDiagnosisDelay": ("DiagnosisDate", "ScreeningDate"),
        "ScreeningToBaselineDelay": ("BaselineDate", "ScreeningDate"),
        "SmearToBaselineDelay": ("BaselineDate", "DateSputumTested"),
        "XRayToBaselineDelay": ("BaselineDate", "DateXRayReported"),
        "GXPToBaselineDelay": ("BaselineDate", "DateGXPTested"),
        "DiagnosisToBaselineDelay": ("BaselineDate", "DiagnosisDate"),
    }
    past = (F.col("PastTBDiagnosed") == "YES") & (F.col("TBHistory") == "NO")
    named = fn.recode("Diagnosis", DIAGNOSES)
    outcome = fn.recode("TreatmentOutcome", OUTCOMES)
    df = df.withColumns(
        {
            **{name: fn.day_gap(later, earlier) for name, (later, earlier) in gaps.items()},
            "XRayResults": fn.recode(fn.normalize_case("XRayResults"), XRAYS),
            "DiagnosisDone": fn.presence_flag("Diagnosis"),
            "Diagnosis": fn.null_if(named, named == "OTHER THAN TB"),
            "TBHistory": fn.repair_if("TBHistory", past, F.lit("YES")),
            "OtherTBDiagnosis": fn.recode("OtherTBDiagnosis", OTHER_DIAGNOSES),
            "ScreeningToBaselineWeightDifference": fn.abs_difference("BaselineWeight", "Weight"),
            "BaselinePatientType": fn.normalize_case("BaselinePatientType"),
            "TreatmentOutcome": outcome,
            "TreatmentComplete": fn.label(outcome, COMPLETE),
        }
    )
    df = df.withColumns({c: fn.discretize_delay(c) for c in DELAYS}).withColumnsRenamed(
        {"FDCTablets": "BaselineDoseCombination", "Streptomycin": "BaselineStreptomycin"}
    )
    df = df.drop("GXPDelay", "GXRemarks")
    untested = F.col("SmearTested") == "NO"
    df = op.apply_rules(df, [(untested, "SmearResult", ABSENT), (untested, "ScreeningToSmearDelay", ABSENT)])
    return op.fill_const(df, FILLS)


def model_fills(df: DataFrame, height_model: str = "svm", **height_params) -> DataFrame:
    """Height group, baseline doses, weight change and disease site predicted where missing.

    The height group is told by radial machines unless another model is named.
    """
    height_params = ({"kernel": "radial"} if height_model == "svm" else {}) | height_params
    df = ml.fill_by_model(df, "HeightGroup", ["AgeGroup", "Gender", "WeightGroup"], height_model, **height_params)
    base = ["BaselineRegimen", "AgeGroup", "BaselinePatientCategory", "BaselinePatientType", "BaselineWeightGroup"]
    df = ml.fill_by_model(df, "BaselineDoseCombination", base)
    df = ml.fill_by_model(df, "BaselineStreptomycin", ["BaselineDoseCombination", *base])
    # Whole kilograms up to the plausible limit are the classes, so their number is bounded.
    change = "ScreeningToBaselineWeightDifference"
    plausible = fn.null_if(change, F.col(change) > MAX_WEIGHT_CHANGE)
    df = df.withColumn(change, F.bround(plausible, 0))
    df = ml.fill_by_model(df, change, ["AgeGroup", "Gender", "HeightGroup", "WeightGroup"])
    care = ["BaselineDoseCombination", "BaselineRegimen", "BaselinePatientCategory", "SmearResult", "XRayResults"]
    return ml.fill_by_model(df, "DiseaseSite", care)


def clean_table(wide: DataFrame, salt: str, algo: str = "sha256", **height_params) -> DataFrame:
    """The 51-column table without subjects who died."""
    rows = tests_and_delays(symptoms(treatment(measures(people(checkpoint(typed(wide)))))))
    filled = model_fills(checkpoint(rows), **height_params)
    hidden = op.deidentify(filled, ["GP", "Screener", "DiagnosedBy", "BaselineCHWID"], algo, salt)
    scaled = op.minmax(hidden, ["Weight", "ScreeningToBaselineWeightDifference"])
    year = F.col("ScreeningYear").cast("int").cast("string")
    years = scaled.withColumns({"ScreeningYear": year, "RegistrationYear": F.col("RegistrationYear").cast("int")})
    return years.filter(F.col("TreatmentOutcome") != "DIED").select(*CLEAN_COLUMNS)
