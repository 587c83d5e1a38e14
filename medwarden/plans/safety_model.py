"""The metric model of the adverse-event star."""

from __future__ import annotations

from medwarden.plans.metrics import Dimension, Measure, MetricModel, Relationship

FACT, PATIENT, DRUG = "fact_adverse_event", "dim_patient", "dim_drug"

_FACT_DIMENSIONS = [
    "case_id", "drug_name", "drug_dose", "drug_route", "ae_term", "ae_soc_class", "ae_severity",
    "ae_seriousness", "ae_outcome", "reporter_type", "country", "manufacturer", "report_date",
    "ae_onset_date", "drug_start_date",
]
_PATIENT_DIMENSIONS = ["patient_id", "patient_age", "patient_sex", "country"]
_DRUG_DIMENSIONS = ["drug_name", "drug_dose", "drug_route", "indication", "manufacturer"]

_FATAL = "count_if(ae_outcome = 'Fatal')"

_FACT_MEASURES = {
    "total_cases": "count(distinct case_id)",
    "total_patients": "count(distinct patient_id)",
    "fatal_cases": _FATAL,
    "severe_cases": "count_if(lower(ae_severity) = 'severe')",
    "serious_cases": "count_if(ae_seriousness <> 'Non-serious')",
    "fatal_rate": f"cast({_FATAL} as double) * 100 / nullif(cast(count(*) as double), 0)",
    "avg_onset_days": "avg(onset_days)",
    "median_onset_days": "median(onset_days)",
}
_PATIENT_MEASURES = {
    "avg_patient_age": "avg(patient_age)",
    "patient_count": "count(distinct patient_id)",
}

SAFETY_MODEL = MetricModel(
    fact=FACT,
    dimensions=(
        *[Dimension(c, FACT, c) for c in _FACT_DIMENSIONS],
        *[Dimension(c, PATIENT, c) for c in _PATIENT_DIMENSIONS],
        *[Dimension(c, DRUG, c) for c in _DRUG_DIMENSIONS],
        Dimension("report_month", FACT, "trunc(report_date, 'MM')"),
    ),
    measures=(
        *[Measure(n, FACT, e) for n, e in _FACT_MEASURES.items()],
        *[Measure(n, PATIENT, e) for n, e in _PATIENT_MEASURES.items()],
    ),
    relationships=(
        Relationship("patient_events", FACT, PATIENT, (("patient_id", "patient_id"),)),
        Relationship(
            "drug_events",
            FACT,
            DRUG,
            tuple((c, c) for c in ("drug_name", "drug_dose", "drug_route")),
        ),
    ),
)
