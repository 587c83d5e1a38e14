"""Star schema: dimensions and facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PATIENT_COLUMNS = [
    "patient_id", "patient_age", "patient_sex", "patient_dob", "patient_weight", "country",
]
DRUG_COLUMNS = ["drug_name", "drug_dose", "drug_route", "indication", "manufacturer"]


def dim_patient(events: DataFrame) -> DataFrame:
    return events.select(*PATIENT_COLUMNS).distinct()


def dim_drug(events: DataFrame) -> DataFrame:
    return events.select(*DRUG_COLUMNS).distinct()


def fact_adverse_event(classified: DataFrame) -> DataFrame:
    """One row per report with its first label, a constant score and the days to onset."""
    return classified.select(
        "case_id",
        "patient_id",
        "drug_name",
        "drug_dose",
        "drug_route",
        "drug_start_date",
        "ae_term",
        F.get(F.col("ae_classification.labels"), F.lit(0)).alias("ae_soc_class"),
        F.lit(1.0).alias("ae_classification_score"),
        "ae_severity",
        "ae_seriousness",
        "ae_outcome",
        "ae_onset_date",
        F.datediff("ae_onset_date", "drug_start_date").alias("onset_days"),
        "reporter_type",
        "report_date",
        "country",
        "manufacturer",
    )


def fact_narrative(enriched: DataFrame) -> DataFrame:
    """Extracted fields side by side; onset days become a whole number or NULL."""
    field = "extracted.response."
    days = F.col(field + "onset_days").try_cast("decimal(38,0)").try_cast("bigint")
    return enriched.select(
        "case_id",
        "narrative_text",
        "narrative_type",
        F.col(field + "primary_drug").alias("extracted_drug"),
        F.col(field + "adverse_event").alias("extracted_ae"),
        F.col(field + "severity_assessment").alias("extracted_severity"),
        F.col(field + "patient_outcome").alias("extracted_outcome"),
        days.alias("extracted_onset_days"),
        F.col(field + "causality").alias("extracted_causality"),
        F.col(field + "dechallenge_result").alias("dechallenge_result"),
        F.col(field + "concomitant_drugs").alias("concomitant_drugs"),
        "narrative_sentiment",
        "generated_at",
    )


def fact_ae_calls(extractions: DataFrame, source: str = "CALL_CENTER") -> DataFrame:
    """One row per event of a detected call. A call with no events gives no row."""
    record = "ae_extraction_json."
    found = extractions.filter(
        F.col("ae_extraction_json").isNotNull() & F.col(record + "ae_detected")
    )
    # posexplode_outer: for explode the optimizer adds a filter that would build the events again.
    events = found.select(
        "file_name",
        "ae_extraction_json",
        "extracted_at",
        F.posexplode_outer(record + "adverse_events").alias("at", "event"),
    )
    return events.filter(F.col("at").isNotNull()).select(
        F.col("file_name").alias("source_call_id"),
        F.lit(source).alias("data_source"),
        F.col(record + "suspect_drug.drug_name").alias("drug_name"),
        F.col(record + "suspect_drug.drug_dose").alias("drug_dose"),
        F.col(record + "suspect_drug.drug_route").alias("drug_route"),
        F.col("event.meddra_preferred_term").alias("ae_preferred_term"),
        F.col("event.meddra_soc_class").alias("ae_soc_class"),
        F.array_join("event.seriousness_criteria", ", ", "").alias("ae_seriousness"),
        F.col("event.outcome").alias("ae_outcome"),
        F.col("event.causality_who_umc").alias("causality"),
        F.col(record + "patient.age").alias("patient_age"),
        F.col(record + "patient.sex").alias("patient_sex"),
        F.col(record + "reporting_deadline").alias("reporting_deadline"),
        F.col(record + "narrative_summary").alias("case_narrative"),
        F.col("extracted_at").alias("report_date"),
    )


def fact_agent_compliance(analyses: DataFrame) -> DataFrame:
    """One row per call that has an analysis."""
    record = "audio_intelligence_json."
    return analyses.filter(F.col("audio_intelligence_json").isNotNull()).select(
        F.col("file_name").alias("call_id"),
        F.col(record + "agent_compliance_score").cast("double").alias("compliance_score"),
        F.col(record + "agent_tone_professional").alias("tone_professional"),
        F.col(record + "caller_emotional_state").alias("caller_state"),
        F.col(record + "caller_urgency_level").alias("urgency_level"),
        F.col(record + "call_type_inferred").alias("call_type"),
        F.col(record + "escalation_recommended").alias("escalation_needed"),
        F.col(record + "escalation_reason").alias("escalation_reason"),
        "analyzed_at",
    )
