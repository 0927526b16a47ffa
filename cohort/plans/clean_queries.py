"""The cleaning stage before its model fills, with an exact SQL counterpart on the derived wide table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.bins import DELAY_BINS, DELAY_LONGEST, DELAY_MISSING, DELAY_NONE
from ..sizing import checkpoint
from . import clean
from .catalog import Tables, query
from .wide_queries import _PATIENT, _STAGES, _WIDE_SELECT, _with, wide_table


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _recode(expression: str, mapping: dict[str, str]) -> str:
    cases = " ".join(f"WHEN {_text(k)} THEN {_text(v)}" for k, v in mapping.items())
    return f"CASE {expression} {cases} ELSE {expression} END"


def _bins(c: str, edges: list, labels: list[str], gaps: list[tuple] = ()) -> str:
    gap = "".join(f" WHEN {c} >= {a} AND {c} < {b} THEN NULL" for a, b in gaps)
    steps = "".join(f" WHEN {c} < {e} THEN '{n}'" for e, n in zip(edges, labels))
    return f"CASE WHEN {c} IS NULL THEN NULL{gap}{steps} ELSE '{labels[-1]}' END"


def _delay(c: str) -> str:
    steps = "".join(f" WHEN {c} <= {end} THEN '{name}'" for end, name in DELAY_BINS)
    return f"CASE WHEN {c} IS NULL THEN '{DELAY_MISSING}' WHEN {c} < 1 THEN '{DELAY_NONE}' WHEN {c} <= 1 THEN NULL{steps} ELSE '{DELAY_LONGEST}' END"


def _replace(name: str, source: str, changes: dict[str, str], more: str = "") -> str:
    """A step of named changes, all seen on the step before."""
    inside = ", ".join(f"{e} AS {c}" for c, e in changes.items())
    return f"{name} AS (SELECT * REPLACE ({inside}){more} FROM {source})"


def _mode(c: str, source: str) -> str:
    return f"coalesce({c}, (SELECT {c} FROM {source} WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1))"


_GAPS = {
    "SputumResultDelay": ("DateSputumTested", "DateSputumSubmitted"),
    "ScreeningToSmearDelay": ("DateSputumTested", "ScreeningDate"),
    "ScreeningToXRayDelay": ("XRayDate", "ScreeningDate"),
    "ScreeningToGXPDelay": ("DateGXPTested", "ScreeningDate"),
    "ScreeningToDiagnosisDelay": ("DiagnosisDate", "ScreeningDate"),
    "ScreeningToBaselineDelay": ("BaselineDate", "ScreeningDate"),
    "SmearToBaselineDelay": ("BaselineDate", "DateSputumTested"),
    "XRayToBaselineDelay": ("BaselineDate", "DateXRayReported"),
    "GXPToBaselineDelay": ("BaselineDate", "DateGXPTested"),
    "DiagnosisToBaselineDelay": ("BaselineDate", "DiagnosisDate"),
}
_NEW_GAPS = [c for c in _GAPS if c != "SputumResultDelay"]
_CASTE = _recode(r"regexp_replace(Caste, '\s|[.]', '', 'g')", clean.CASTES)
_OTHERS = ", ".join(map(_text, clean.OTHER_CASTES))
_HARMONIC = "count(nullif(Weight, 0)) OVER p / nullif(sum(1e0 / nullif(Weight, 0)) OVER p, 0)"
_UNSURE = _text(clean.UNKNOWN)
_YES = ["Cough", "ProductiveCough", "BloodInCough", "Fever", "NightSweats", "WeightLoss", "TBHistory", "TBInFamily"]
_POINTS = " + ".join(
    [f"CASE WHEN {c} = 'YES' THEN 1 ELSE 0 END" for c in _YES]
    + ["CASE CoughDuration WHEN 'LESS THAN 2 WEEKS' THEN 1 WHEN '2 TO 3 WEEKS' THEN 2 WHEN 'MORE THAN 3 WEEKS' THEN 3 ELSE 0 END"]
)
_FILLED = {c: v for c, v in clean.FILLS.items() if c != "DoseCombination"}

COLUMNS = [
    "PatientID", "GP", "DiagnosedBy", "ScreeningAge", "AgeGroup", "BirthYear", "Religion", "Caste", "Weight", "WeightGroup",
    "BaselineWeightGroup", "Height", "HeightGroup", "MaritalStatus", "ScreeningYear", "RegistrationYear", "DiseaseCategory",
    "DiseaseSite", "BaselineRegimen", "DoseCombination", "OtherDoseDescription", "PatientStatus", "PatientType",
    "RegimenChanged", "TreatmentPhase", "Fever", "CoughDuration", "ProductiveCough", "BloodInCough", "Cough", "NightSweats",
    "WeightLoss", "TBHistory", "TBInFamily", "SeverityScore", "XRayResults", "DiagnosisDone", "Diagnosis", "OtherTBDiagnosis",
    "ScreeningToBaselineWeightDifference", "BaselinePatientType", "BaselinePatientCategory", "TreatmentOutcome",
    "TreatmentComplete", "SmearResult", "GeneXpertResult", "DrugResistance", "DiagnosisAntibiotic", "TBSymptomsDiagnosed",
    "PastTBDiagnosed", "BaselineDoseCombination", "BaselineStreptomycin", *clean.DELAYS,
]

_STEPS = [
    f"w AS ({_WIDE_SELECT})",
    _replace(
        "c1",
        "w",
        {
            **{c: f"{c}::date" for c in clean.DATES},
            "RegistrationYear": "coalesce(RegistrationYear::double, (SELECT quantile_cont(RegistrationYear::double, 0.5) FROM w))",
            "ScreeningYear": "ScreeningYear::double",
            "ScreeningAge": "ScreeningAge::double",
            "DiagnosedBy": f"coalesce(DiagnosedBy, {_UNSURE})",
        },
    ),
    _replace(
        "c2",
        "c1",
        {
            "DiagnosedBy": f"CASE WHEN count(*) OVER (PARTITION BY DiagnosedBy) < {clean.MIN_PATIENTS} THEN 'other' ELSE DiagnosedBy END",
            "ScreeningAge": "coalesce(ScreeningAge, year(DateRegistered) - year(DOB))",
            "ScreeningDate": "coalesce(ScreeningDate, DateRegistered)",
        },
    ),
    _replace("c3", "c2", {"DOB": "coalesce(DOB, try_cast((year(ScreeningDate) - ScreeningAge)::int || strftime(ScreeningDate, '-%m-%d') AS date))"}),
    _replace("c4", "c3", {"BirthYear": "year(DOB)::int"}),
    _replace(
        "c5",
        "c4",
        {
            "ScreeningAge": f"CASE WHEN ScreeningAge > {clean.MAX_AGE} THEN RegistrationYear - BirthYear ELSE ScreeningAge END",
            "Religion": f"coalesce({_recode('Religion', clean.RELIGIONS)}, 'ISLAM')",
            "Caste": f"CASE WHEN {_CASTE} IN ({_OTHERS}) THEN 'OTHERS' ELSE {_CASTE} END",
        },
    ),
    _replace("c6", "c5", {"Caste": _mode("Caste", "c5")}, f", {_bins('ScreeningAge', clean.AGE_EDGES, clean.AGE_GROUPS)} AS AgeGroup"),
    f"""c7 AS (SELECT * REPLACE (round_even(CASE WHEN AgeGroup IS NULL OR Gender IS NULL THEN Weight ELSE coalesce(Weight, {_HARMONIC}) END, 0) AS Weight)
        FROM c6 WINDOW p AS (PARTITION BY AgeGroup, Gender))""",
    f"c8 AS (SELECT *, {_bins('Weight', clean.WEIGHT_EDGES, clean.WEIGHT_GROUPS, clean.WEIGHT_GAPS)} AS WeightGroup FROM c7)",
    _replace(
        "c9",
        "c8",
        {"WeightGroup": _mode("WeightGroup", "c8"), "Height": f"round_even(CASE WHEN Height > {clean.MAX_HEIGHT} THEN NULL ELSE Height END, 0)"},
    ),
    f"""c10 AS (SELECT *, coalesce({_bins('BaselineWeight', clean.WEIGHT_EDGES, clean.WEIGHT_GROUPS, clean.WEIGHT_GAPS)}, WeightGroup) AS BaselineWeightGroup,
        {_bins('Height', clean.HEIGHT_EDGES, clean.HEIGHT_GROUPS)} AS HeightGroup FROM c9)""",
    _replace(
        "t1",
        "c10",
        {
            "MaritalStatus": "coalesce(MaritalStatus, 'MARRIED')",
            "DateRegistered": "coalesce(DateRegistered, ScreeningDate)",
            "ScreeningYear": f"CASE WHEN ScreeningYear IS NOT NULL THEN greatest(ScreeningYear, {clean.FIRST_YEAR}) END",
            "DiseaseCategory": "coalesce(DiseaseCategory, BaselinePatientCategory)",
            "DiseaseSite": _recode("coalesce(DiseaseSite, Diagnosis)", clean.SITES),
            "BaselineRegimen": _recode("BaselineRegimen", {"HE": "EH"}),
            "DoseCombination": "CASE WHEN try_cast(DoseCombination AS double) = 99 THEN NULL ELSE DoseCombination END",
            "OtherDoseDescription": "CASE WHEN try_cast(OtherDoseDescription AS double) = 0 THEN NULL ELSE OtherDoseDescription END",
            "PatientStatus": _recode("PatientStatus", dict.fromkeys(clean.OPEN_STATUSES, "OPEN")),
            "PatientType": "upper(PatientType)",
        },
    ),
    "t2 AS (SELECT *, datediff('day', ScreeningDate, DateRegistered) AS wait FROM t1)",
    _replace(
        "t3",
        "t2",
        {
            "DiseaseSite": "nullif(DiseaseSite, 'OTHER THAN TB')",
            "TreatmentPhase": f"""coalesce({_recode('TreatmentPhase', {'CONTINUOUS': 'CONTINUATION'})},
                CASE WHEN TreatmentDuration <= {clean.INTENSIVE_DAYS} THEN 'INTENSIVE' WHEN TreatmentDuration > {clean.INTENSIVE_DAYS} THEN 'CONTINUATION' END)""",
        },
        f""", CASE WHEN wait < 0 OR wait = {clean.YEAR_OFF} THEN NULL ELSE wait END AS RegistrationDelay,
            CASE WHEN BaselineRegimen <> LastRegimen THEN 'YES' ELSE 'NO' END AS RegimenChanged""",
    ),
    _replace("s1", "t3", {"ProductiveCough": "CASE WHEN ProductiveCough <> 'YES' AND BloodInCough = 'YES' THEN 'YES' ELSE ProductiveCough END"}),
    _replace(
        "s2",
        "s1",
        {
            "BloodInCough": "CASE WHEN ProductiveCough <> 'YES' THEN NULL ELSE BloodInCough END",
            "Fever": "coalesce(Fever, 'YES')",
            "Cough": "coalesce(Cough, 'YES')",
            "CoughDuration": f"coalesce(CoughDuration, {_UNSURE})",
            **{c: f"coalesce({_recode(c, {'REFUSED': 'REFUSE'})}, 'YES')" for c in ("NightSweats", "WeightLoss")},
            **{c: f"coalesce({_recode(c, {'REFUSED': 'REFUSE'})}, {_UNSURE})" for c in ("TBHistory", "TBInFamily")},
        },
    ),
    _replace(
        "s3",
        "s2",
        {
            "CoughDuration": "CASE WHEN Cough = 'NO' THEN 'NO' ELSE CoughDuration END",
            "ProductiveCough": f"""CASE WHEN Cough = 'NO' THEN 'NO' WHEN ProductiveCough IS NULL AND Cough = 'YES' THEN 'YES'
                WHEN ProductiveCough IS NULL THEN {_UNSURE} ELSE ProductiveCough END""",
            "BloodInCough": "CASE WHEN Cough = 'NO' OR BloodInCough IS NULL THEN 'NO' ELSE BloodInCough END",
        },
    ),
    f"s4 AS (SELECT *, {_POINTS} AS SeverityScore FROM s3)",
    _replace(
        "d1",
        "s4",
        {
            "SputumResultDelay": "datediff('day', DateSputumSubmitted, DateSputumTested)",
            "XRayResults": _recode("upper(XRayResults)", clean.XRAYS),
            "Diagnosis": f"nullif({_recode('Diagnosis', clean.DIAGNOSES)}, 'OTHER THAN TB')",
            "TBHistory": "CASE WHEN PastTBDiagnosed = 'YES' AND TBHistory = 'NO' THEN 'YES' ELSE TBHistory END",
            "OtherTBDiagnosis": _recode("OtherTBDiagnosis", clean.OTHER_DIAGNOSES),
            "BaselinePatientType": "upper(BaselinePatientType)",
            "TreatmentOutcome": _recode("TreatmentOutcome", clean.OUTCOMES),
        },
        ", "
        + ", ".join(f"datediff('day', {_GAPS[c][1]}, {_GAPS[c][0]}) AS {c}" for c in _NEW_GAPS)
        + f""", CASE WHEN Diagnosis IS NULL THEN 'NO' ELSE 'YES' END AS DiagnosisDone, abs(BaselineWeight - Weight) AS ScreeningToBaselineWeightDifference,
            CASE WHEN {_recode('TreatmentOutcome', clean.OUTCOMES)} IN ({", ".join(map(_text, clean.COMPLETE))}) THEN 'YES' ELSE 'NO' END AS TreatmentComplete,
            FDCTablets AS BaselineDoseCombination, Streptomycin AS BaselineStreptomycin""",
    ),
    _replace("d2", "d1", {c: _delay(c) for c in clean.DELAYS}),
    _replace(
        "d3",
        "d2",
        {
            "SmearResult": f"CASE WHEN SmearTested = 'NO' THEN '{clean.ABSENT}' ELSE SmearResult END",
            "ScreeningToSmearDelay": f"CASE WHEN SmearTested = 'NO' THEN '{clean.ABSENT}' ELSE ScreeningToSmearDelay END",
        },
    ),
    _replace("d4", "d3", {**{c: f"coalesce({c}, {_text(v)})" for c, v in _FILLED.items()}, "DoseCombination": "coalesce(DoseCombination, '3')"}),
]


@query("clean_rules", _with(_PATIENT, _STAGES, *_STEPS) + f"SELECT {', '.join(COLUMNS)} FROM d4")
def clean_rules(t: Tables) -> DataFrame:
    rows = clean.measures(clean.people(checkpoint(clean.typed(wide_table(t)))))
    return clean.tests_and_delays(clean.symptoms(clean.treatment(rows))).select(*COLUMNS)
