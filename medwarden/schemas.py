"""Table and record schemas, one constant per layer table."""

from __future__ import annotations

from pyspark.sql import types as T


_STRING, _STRINGS = T.StringType(), T.ArrayType(T.StringType())
_TYPES: dict[str, T.DataType] = {
    "string": _STRING,
    "strings": _STRINGS,
    "int": T.IntegerType(),
    "bigint": T.LongType(),
    "double": T.DoubleType(),
    "boolean": T.BooleanType(),
    "date": T.DateType(),
    "timestamp": T.TimestampType(),
    "timestamp_ntz": T.TimestampNTZType(),
}


def _struct(**fields: str | T.DataType) -> T.StructType:
    return T.StructType(
        [T.StructField(n, _TYPES[t] if isinstance(t, str) else t) for n, t in fields.items()]
    )


AE_REPORTS = _struct(
    case_id="string",
    patient_id="string",
    patient_age="int",
    patient_sex="string",
    patient_dob="date",
    patient_weight="double",
    drug_name="string",
    drug_dose="string",
    drug_route="string",
    drug_start_date="date",
    indication="string",
    ae_term="string",
    ae_severity="string",
    ae_seriousness="string",
    ae_outcome="string",
    ae_onset_date="date",
    reporter_type="string",
    report_date="date",
    country="string",
    manufacturer="string",
    created_at="timestamp_ntz",
)
AE_REPORTS_REQUIRED = ["case_id", "patient_id", "drug_name", "ae_term", "report_date"]

AE_NARRATIVES = _struct(
    case_id="string",
    narrative_text="string",
    narrative_type="string",
    generated_at="timestamp_ntz",
)
AE_NARRATIVES_REQUIRED = ["case_id", "narrative_text"]

FUNCTION_EVENTS = _struct(
    timestamp="timestamp_ntz",
    function_name="string",
    model_used="string",
    input_file="string",
    latency_ms="bigint",
    token_count="bigint",
    status="string",
    error_message="string",
)

# What Spark's binaryFile source gives.
BINARY_FILE = _struct(
    path="string", modificationTime="timestamp", length="bigint", content=T.BinaryType()
)

CLASSIFICATION = _struct(labels="strings")

NARRATIVE_EXTRACT = _struct(
    response=_struct(
        primary_drug="string",
        adverse_event="string",
        severity_assessment="string",
        patient_outcome="string",
        onset_days="string",
        causality="string",
        dechallenge_result="string",
        concomitant_drugs="string",
    )
)

CALL_INTELLIGENCE = _struct(
    caller_emotional_state="string",
    caller_urgency_level="string",
    ae_acoustic_signals="strings",
    agent_compliance_score="double",
    agent_tone_professional="boolean",
    call_duration_category="string",
    call_type_inferred="string",
    escalation_recommended="boolean",
    escalation_reason="string",
)

ADVERSE_EVENT = _struct(
    ae_description_verbatim="string",
    meddra_preferred_term="string",
    meddra_soc_class="string",
    seriousness_criteria="strings",
    outcome="string",
    causality_who_umc="string",
)
AE_EXTRACTION = _struct(
    ae_detected="boolean",
    icsr_completeness="string",
    adverse_events=T.ArrayType(ADVERSE_EVENT),
    suspect_drug=_struct(
        drug_name="string", drug_dose="string", drug_route="string", indication="string"
    ),
    patient=_struct(age="string", sex="string", identifier="string"),
    product_quality_complaint="boolean",
    off_label_use_mentioned="boolean",
    reporting_deadline="string",
    narrative_summary="string",
)

# The labels and enumerations of the records above.
TOXICITY_LABELS = [
    "Hepatotoxicity",
    "Cardiotoxicity",
    "Nephrotoxicity",
    "Dermatologic",
    "Neurologic",
    "Gastrointestinal",
    "Hematologic",
    "Immunologic",
    "Musculoskeletal",
    "Respiratory",
]
EMOTIONAL_STATES = ["calm", "concerned", "distressed", "confused", "angry"]
URGENCY_LEVELS = ["routine", "elevated", "urgent", "emergency"]
DURATION_CATEGORIES = ["brief_under_2min", "standard_2_to_8min", "extended_over_8min"]
CALL_TYPES = [
    "adverse_event_report",
    "product_quality_complaint",
    "off_label_inquiry",
    "standard_drug_info",
    "unknown",
]
COMPLETENESS_LEVELS = ["complete", "minimum_criteria_met", "incomplete", "no_ae"]
SERIOUSNESS_CRITERIA = [
    "death",
    "life_threatening",
    "hospitalization",
    "disability",
    "congenital_anomaly",
    "medically_significant",
    "none",
]
EVENT_OUTCOMES = ["recovered", "recovering", "not_recovered", "fatal", "sequelae", "unknown"]
CAUSALITY_LEVELS = ["certain", "probable", "possible", "unlikely", "conditional", "unassessable"]
DEADLINE_CLASSES = ["15_day_expedited", "90_day_periodic", "no_report_required"]
