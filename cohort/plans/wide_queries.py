"""The integration stages on source tables derived from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from . import clean, wide
from .catalog import Tables, query
from .source_tables import statements, two_sources

_CTES = ",\n".join(f"s{i}_{name} AS ({sql})" for i in (1, 2) for name, sql in statements(i).items())


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join([_CTES, *ctes])


_PATIENT = """
    subject AS (
        SELECT PatientID, GPID, Weight, Height, DateRegistered, TreatmentSupporter IS NOT NULL AS HasTreatmentSupporter, DiseaseConfirmed,
               DiseaseCategory, DiseaseSite, Regimen, DoseCombination, OtherDoseDescription, TreatmentPhase, PatientStatus, PatientType,
               TreatedPreviously, CompletedPreviousTreatment FROM s1_patient
        UNION
        SELECT PatientID, GPID, Weight, Height, DateRegistered, TreatmentSupporter IS NOT NULL, DiseaseConfirmed,
               DiseaseCategory, DiseaseSite, Regimen, DoseCombination, Streptomycin, TreatmentPhase, PatientStatus, PatientType,
               TreatedPreviously, CompletedPreviousTreatment FROM s2_patient),
    person AS (SELECT PID, Gender, DOB, MaritalStatus, Religion, Caste FROM s1_person
               UNION SELECT PID, Gender, DOB, MaritalStatus, Religion, Caste FROM s2_person),
    p0 AS (SELECT * FROM subject JOIN person ON PID = PatientID WHERE DiseaseConfirmed AND PatientType IS NOT NULL),
    p1 AS (SELECT * REPLACE (
               CASE DiseaseCategory WHEN 'CATEGORY 1' THEN 'CAT I' WHEN 'CATEGORY 2' THEN 'CAT II' ELSE DiseaseCategory END AS DiseaseCategory,
               CASE Regimen WHEN 'RHEZ' THEN 'RHZE' ELSE Regimen END AS Regimen,
               CASE WHEN Height >= 444 THEN NULL WHEN Height < 40 THEN Height * 30.48e0 ELSE Height END AS Height,
               CASE WHEN Weight >= 444 THEN NULL WHEN Weight > 140 THEN Weight * 0.4535e0 ELSE Weight END AS Weight) FROM p0),
    cohort AS (SELECT * REPLACE (nullif(Height, 0) AS Height, nullif(Weight, 0) AS Weight) FROM p1)
"""

_HEADER = "EncounterID, PID1, PID2, DateEncounterStart, DateEncounterEnd, EnteredDate, ENTERED_DATE"
_KEEP = "PatientID IN (SELECT PatientID FROM cohort)"


def _union(table: str, first: str, second: str | None = None) -> str:
    return f"SELECT {first} FROM s1_{table} UNION SELECT {second or first} FROM s2_{table}"


_STAGES = f"""
    screen0 AS ({_union("enc_suspect_id", f"{_HEADER}, AGE, FEVER, COUGH, COUGH_DURATION, PRODUCTIVE_COUGH, HAEMOPTYSIS, NIGHT_SWEATS, WEIGHT_LOSS, TB_HISTORY, TB_FAMILY_HISTORY")}),
    screening AS (SELECT PID1 AS PatientID, PID2 AS Screener, EnteredDate AS ScreeningDate,
        try_cast(regexp_extract(AGE, '^\\s*(\\d+)', 1) AS int) AS ScreeningAge, FEVER AS Fever, COUGH AS Cough,
        CASE COUGH_DURATION WHEN '< 2 WEEKS' THEN 'LESS THAN 2 WEEKS' WHEN '2-3 WEEKS' THEN '2 TO 3 WEEKS' WHEN '> 3 WEEKS' THEN 'MORE THAN 3 WEEKS' END AS CoughDuration,
        PRODUCTIVE_COUGH AS ProductiveCough, HAEMOPTYSIS AS BloodInCough, NIGHT_SWEATS AS NightSweats, WEIGHT_LOSS AS WeightLoss,
        TB_HISTORY AS TBHistory, TB_FAMILY_HISTORY AS TBInFamily FROM screen0),
    smear0 AS ({_union("sputumresults", "PatientID, SputumTestID, Month, DateSubmitted, DateTested, SmearResult", "PatientID, SputumLabID, Month, SmearOrderDate, DateSmearTested, SmearResult")}),
    smear1 AS (SELECT * REPLACE (CASE SmearResult WHEN '1-9 AFB' THEN '1-9AFB' ELSE SmearResult END AS SmearResult),
        count(*) OVER (PARTITION BY PatientID) AS k FROM smear0 WHERE Month = 0 AND SmearResult IS NOT NULL),
    smear AS (SELECT * FROM smear1 WHERE NOT (k > 1 AND SmearResult = 'NEGATIVE')
        QUALIFY row_number() OVER (PARTITION BY PatientID ORDER BY DateTested, SputumTestID, DateSubmitted, SmearResult) = 1),
    gene0 AS (SELECT PatientID, LaboratoryID, DateTested, Remarks, GeneXpertResult, DrugResistance FROM s1_genexpertresults WHERE DateTested IS NOT NULL
        UNION SELECT PatientID, SputumLabID, DateGeneXpertTested, Details, GeneXpertResult, GeneXpertResistance FROM s2_sputumresults
        WHERE Month = 0 AND DateGeneXpertTested IS NOT NULL),
    gene1 AS (SELECT * REPLACE (
        CASE WHEN GeneXpertResult ILIKE '%POSITIVE%' THEN 'POSITIVE' WHEN GeneXpertResult ILIKE '%NEGATIVE%' THEN 'NEGATIVE' ELSE GeneXpertResult END AS GeneXpertResult,
        CASE WHEN DrugResistance LIKE '%INDETERMINATE%' THEN 'INDETERMINATE' WHEN DrugResistance LIKE '%RESISTANT%' THEN 'RESISTANT' WHEN DrugResistance LIKE '%SENSITIVE%' THEN 'SENSITIVE' ELSE DrugResistance END AS DrugResistance),
        count(*) OVER (PARTITION BY PatientID) AS k FROM gene0 WHERE GeneXpertResult IS NULL OR GeneXpertResult NOT IN ('', 'ERROR', 'INVALID')),
    gene AS (SELECT * FROM gene1 WHERE NOT (k > 1 AND coalesce(GeneXpertResult, '') = 'NEGATIVE')
        QUALIFY row_number() OVER (PARTITION BY PatientID ORDER BY DateTested, LaboratoryID, Remarks, GeneXpertResult NULLS FIRST, DrugResistance NULLS FIRST) = 1),
    base0 AS ({_union("enc_baseline", f"{_HEADER}, FDC_TABLETS, PATIENT_CATEGORY, PATIENT_TYPE, STREPOMYCIN AS STREPTOMYCIN, REGIMEN, WEIGHT", f"{_HEADER}, FDC_TABLETS, PATIENT_CATEGORY, PATIENT_TYPE, STREPTOMYCIN, REGIMEN, WEIGHT")}),
    xray0 AS ({_union("xrayresults", "PatientID, XRayDate, DateReported, XRayResults, Remarks", "PatientID, XRayDate, DateReported, XRayResult, Remarks")}),
    xray AS (SELECT x.* FROM xray0 x WHERE XRayResults IS NOT NULL AND XRayResults <> 'IMAGE UNCLEAR'
        AND EXISTS (SELECT 1 FROM base0 WHERE PID1 = x.PatientID AND x.XRayDate < EnteredDate)
        QUALIFY row_number() OVER (PARTITION BY PatientID ORDER BY XRayDate, DateReported, XRayResults, Remarks) = 1),
    cdf0 AS ({_union("enc_cdf", "PID1, PID2, EnteredDate, ANTIBIOTIC_TRIAL, CLINICAL_SYMP_TB, CONTACT_HISTORY, DIAGNOSIS, LARGE_LYMPH_NODES, LYMPH_NODE_BIOPSY, MANTOUX, PAST_HISTORY, XRAY_SUGGESTIVE, OTHER_THAN_TB_DETAIL, OTHER_DIAGNOSTIC_DETAIL || ' ' || NOTES AS DiagnosisNotes")}),
    diagnosed AS (SELECT PID1 AS PatientID, PID2 AS DiagnosedBy, EnteredDate AS DiagnosisDate, ANTIBIOTIC_TRIAL AS DiagnosisAntibiotic,
        CLINICAL_SYMP_TB AS TBSymptomsDiagnosed, CONTACT_HISTORY AS TBContactDiagnosed, DIAGNOSIS AS Diagnosis, LARGE_LYMPH_NODES AS LargeLymphDiagnosed,
        LYMPH_NODE_BIOPSY AS LymphBiopsyDiagnosed, MANTOUX AS MantouxDiagnosed, PAST_HISTORY AS PastTBDiagnosed, XRAY_SUGGESTIVE AS XRaySuggestiveDiagnosed,
        OTHER_THAN_TB_DETAIL AS OtherTBDiagnosis, DiagnosisNotes FROM cdf0
        QUALIFY row_number() OVER (PARTITION BY PID1 ORDER BY EnteredDate DESC, PID2 DESC, CLINICAL_SYMP_TB DESC NULLS LAST, DIAGNOSIS DESC NULLS LAST,
            PAST_HISTORY DESC, OTHER_THAN_TB_DETAIL DESC NULLS LAST, DiagnosisNotes DESC NULLS LAST) = 1),
    treated AS (SELECT PID1 AS PatientID, PID2 AS BaselineCHWID, EnteredDate AS BaselineDate, CASE WHEN WEIGHT <= 200 THEN WEIGHT END AS BaselineWeight,
        CASE PATIENT_CATEGORY WHEN 'CATEGORY 2' THEN 'CAT II' ELSE PATIENT_CATEGORY END AS BaselinePatientCategory, PATIENT_TYPE AS BaselinePatientType,
        CASE REGIMEN WHEN 'RHEZ' THEN 'RHZE' WHEN 'EH' THEN 'HE' END AS BaselineRegimen, FDC_TABLETS AS FDCTablets, STREPTOMYCIN AS Streptomycin FROM base0),
    end0 AS ({_union("enc_end_fol", f"{_HEADER}, REASON, OTHER_REASON")}),
    ended AS (SELECT PID1 AS PatientID, EnteredDate AS TreatmentEndDate,
        CASE REASON WHEN 'TX FAILURE' THEN 'TREATMENT FAILURE' WHEN 'TREAMTENT COMPLETED' THEN 'TREATMENT COMPLETED' WHEN 'TRANSFER OUT' THEN 'TRANSFERRED'
            WHEN 'DEFAULTED' THEN 'MOVED' WHEN 'MDR SUSPECT' THEN 'MDR PATIENT' ELSE REASON END AS TreatmentOutcome, OTHER_REASON AS TreatmentOutcomeDetails
        FROM end0 QUALIFY row_number() OVER (PARTITION BY PID1 ORDER BY EnteredDate DESC, EncounterID DESC) = 1),
    dim AS (SELECT * FROM ({_union("gp", "GPID AS GPName, Qualification1 AS Qualification, Speciality1 AS Speciality", "GPID, Qualification, Specialization")})
        QUALIFY row_number() OVER (PARTITION BY GPName ORDER BY Qualification, Speciality NULLS FIRST) = 1),
    ids AS (SELECT PatientID, row_number() OVER (ORDER BY md5(PatientID))::bigint AS ID FROM cohort)
"""

_WIDE_SELECT = """
    SELECT ids.ID AS PatientID, c.GPID AS GP, Qualification AS GPQualification, Speciality AS GPSpeciality, Screener, DOB::varchar AS DOB,
        year(DOB)::int AS BirthYear, ScreeningAge, Gender, MaritalStatus, Religion, Caste, round(Weight, 6) AS Weight, round(Height, 6) AS Height,
        ScreeningDate::varchar AS ScreeningDate, year(ScreeningDate)::int AS ScreeningYear, DateRegistered::varchar AS DateRegistered,
        year(DateRegistered)::int AS RegistrationYear, HasTreatmentSupporter, DiseaseConfirmed, DiseaseCategory, DiseaseSite, Regimen AS LastRegimen,
        DoseCombination, OtherDoseDescription, TreatmentPhase, PatientStatus, PatientType, TreatedPreviously, CompletedPreviousTreatment,
        Fever, Cough, CoughDuration, ProductiveCough, BloodInCough, NightSweats, WeightLoss, TBHistory, TBInFamily,
        CASE WHEN SmearResult IS NULL THEN 'NO' ELSE 'YES' END AS SmearTested, s.DateSubmitted::varchar AS DateSputumSubmitted,
        s.DateTested::varchar AS DateSputumTested, datediff('day', s.DateSubmitted, s.DateTested)::int AS SputumResultDelay, SmearResult,
        CASE WHEN coalesce(SmearResult, 'NEGATIVE') = 'NEGATIVE' THEN 'NO' ELSE 'YES' END AS SmearPositive,
        CASE WHEN XRayResults IS NULL THEN 'NO' ELSE 'YES' END AS XRayDone, XRayDate::varchar AS XRayDate, DateReported::varchar AS DateXRayReported,
        datediff('day', XRayDate, DateReported)::int AS XRayResultDelay, XRayResults, x.Remarks AS XRayRemarks,
        CASE WHEN coalesce(XRayResults, 'NORMAL') = 'NORMAL' THEN 'NO' ELSE 'YES' END AS XRayIndicative,
        CASE WHEN GeneXpertResult IS NULL THEN 'NO' ELSE 'YES' END AS GeneXpertTested, g.DateTested::varchar AS DateGXPTested,
        datediff('day', g.DateTested, s.DateTested)::int AS GXPDelay, GeneXpertResult, DrugResistance, g.Remarks AS GXRemarks,
        CASE WHEN coalesce(GeneXpertResult, 'NEGATIVE') = 'NEGATIVE' THEN 'NO' ELSE 'YES' END AS GXPPositive,
        DiagnosedBy, DiagnosisDate::varchar AS DiagnosisDate, DiagnosisAntibiotic, TBSymptomsDiagnosed, TBContactDiagnosed, Diagnosis, LargeLymphDiagnosed,
        LymphBiopsyDiagnosed, MantouxDiagnosed, PastTBDiagnosed, XRaySuggestiveDiagnosed, OtherTBDiagnosis, DiagnosisNotes,
        BaselineCHWID, BaselineDate::varchar AS BaselineDate, BaselineWeight, BaselinePatientCategory, BaselinePatientType, BaselineRegimen, FDCTablets,
        Streptomycin, TreatmentEndDate::varchar AS TreatmentEndDate, datediff('day', BaselineDate, TreatmentEndDate)::int AS TreatmentDuration,
        TreatmentOutcome, TreatmentOutcomeDetails
    FROM cohort c JOIN ids USING (PatientID) JOIN screening USING (PatientID) LEFT JOIN smear s USING (PatientID) LEFT JOIN xray x USING (PatientID)
    LEFT JOIN gene g USING (PatientID) LEFT JOIN diagnosed USING (PatientID) LEFT JOIN treated USING (PatientID) LEFT JOIN ended USING (PatientID)
    LEFT JOIN dim ON c.GPID = GPName
"""


def _shown(df: DataFrame) -> DataFrame:
    """Dates as text, so both engines show them alike."""
    dates = [f.name for f in df.schema if isinstance(f.dataType, T.DateType)]
    return df.withColumns({c: F.col(c).cast("string") for c in dates}) if dates else df


@query("wide_table", _with(_PATIENT, _STAGES) + _WIDE_SELECT)
def wide_table(t: Tables) -> DataFrame:
    out = _shown(wide.wide_table(*two_sources(t)))
    return out.withColumns({c: F.round(c, 6) for c in ("Weight", "Height")})


@query(
    "drug_history",
    _with(
        f"""h AS ({_union("drughistory", "PatientID, DispensationNo, DateDispensed, PillsDelivered, PillsQuotaDelivered, StreptomycinDelivered, StreptomycinQuotaDelivered, Remarks",
        "PatientID, DispensalNo, DateDispensed, PillsDelivered, PillsQuotaDelivered, StreptomycinDelivered, StreptomycinQuotaDelivered, Remarks")})
        SELECT PatientID, count(DispensationNo)::bigint AS TotalDispensals, sum(PillsDelivered)::bigint AS TotalPills,
            sum(PillsQuotaDelivered)::bigint AS TotalPillsQuota, sum(StreptomycinDelivered)::bigint AS TotalStreptomycin,
            sum(StreptomycinQuotaDelivered)::bigint AS TotalStreptomycinQuota FROM h GROUP BY 1"""
    ),
)
def drug_history(t: Tables) -> DataFrame:
    return wide.drug_history(*two_sources(t))



@query(
    "follow_ups",
    _with(
        _PATIENT,
        f"""f AS ({_union("enc_follow_up", "EncounterID, PID1, MONTH, coalesce(FDC_TABLETS, FDC_TABLET) AS FDC_TABLETS, WEIGHT", "EncounterID, PID1, MONTH, FDC_TABLETS, WEIGHT")})
        SELECT * FROM f WHERE PID1 IN (SELECT PatientID FROM cohort)""",
    ),
)
def follow_ups(t: Tables) -> DataFrame:
    a, b = two_sources(t)
    out = wide.follow_ups(a, b, wide.patients(a, b))
    return out.select("EncounterID", "PID1", "MONTH", "FDC_TABLETS", "WEIGHT")


@query(
    "refusals",
    _with(
        _PATIENT,
        f"""r AS ({_union("enc_refusal", "EncounterID, PID1, EnteredDate::varchar AS EnteredDate, REASON")})
        SELECT * FROM r WHERE PID1 IN (SELECT PatientID FROM cohort) QUALIFY EncounterID = max(EncounterID) OVER (PARTITION BY PID1)""",
    ),
)
def refusals(t: Tables) -> DataFrame:
    a, b = two_sources(t)
    out = wide.refusals(a, b, wide.patients(a, b)).select("EncounterID", "PID1", "EnteredDate", "REASON")
    return _shown(out)


@query("system_users", _with(f'u AS ({_union("users", "UserName, Role")}) SELECT UserName, Role FROM u'))
def system_users(t: Tables) -> DataFrame:
    return wide.users(*two_sources(t)).select("UserName", "Role")


@query("clean_table")
def clean_table(t: Tables) -> DataFrame:
    return clean.clean_table(wide.wide_table(*two_sources(t)), salt="s", ntree=10)
