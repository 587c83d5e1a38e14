"""The aggregates behind the two dashboards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medwarden.functions.numbers import count_where
from medwarden.operators import gold
from medwarden.operators.gold import is_fatal, is_severe
from medwarden.operators.triage import EXPEDITED_CLASS


def _count(name: str) -> Column:
    return F.count(F.lit(1)).alias(name)


def _by_count(rows: DataFrame, column: str, count: str) -> DataFrame:
    return (
        rows.groupBy(column)
        .agg(_count(count))
        .orderBy(F.desc(count), F.col(column).asc_nulls_last())
    )


# --- reports ------------------------------------------------------------------------------


def safety_headline(fact: DataFrame) -> DataFrame:
    """Distinct cases, severe and fatal reports, drugs and the whole severe percentage: one scan.

    Reports are first reduced to one row per case and drug, so both distinct counts work on that
    smaller set without multiplying the rows.
    """
    per_case = fact.groupBy("case_id", "drug_name").agg(
        count_where(is_severe()).alias("severe"), count_where(is_fatal()).alias("fatal")
    )
    totals = per_case.agg(
        F.count_distinct("case_id").alias("total_cases"),
        F.coalesce(F.sum("severe"), F.lit(0)).alias("severe_cases"),
        F.coalesce(F.sum("fatal"), F.lit(0)).alias("fatal_cases"),
        F.count_distinct("drug_name").alias("unique_drugs"),
    )
    return totals.withColumn(
        "severe_pct", F.expr("severe_cases * 100 div greatest(total_cases, 1)")
    )


def top_drugs_by_reports(fact: DataFrame, n: int = 10) -> DataFrame:
    return _by_count(fact, "drug_name", "case_count").limit(n)


def cases_by_soc(fact: DataFrame) -> DataFrame:
    return _by_count(fact.filter(F.col("ae_soc_class").isNotNull()), "ae_soc_class", "case_count")


def drug_severity(fact: DataFrame, top: int = 10) -> DataFrame:
    """Reports per drug and severity for the drugs with most reports.

    The top drugs come from the drug-severity counts, so the fact table is read once.
    """
    counts = fact.groupBy("drug_name", "ae_severity").agg(_count("cnt"))
    leaders = (
        counts.groupBy("drug_name")
        .agg(F.sum("cnt").alias("total"))
        .orderBy(F.desc("total"), "drug_name")
        .limit(top)
    )
    # ``top`` rows. Null-safe, so that both sides keep the same shuffle of the counts.
    leaders = leaders.select(F.col("drug_name").alias("_leader"))
    same = F.col("drug_name").eqNullSafe(F.col("_leader"))
    return counts.join(F.broadcast(leaders), same, "left_semi")


def drug_severity_matrix(
    fact: DataFrame, levels: Sequence[str] = ("Mild", "Moderate", "Severe"), top: int = 10
) -> DataFrame:
    """``drug_severity`` as one row per drug, one column per level, and ``other``.

    Levels are compared without regard to case, as the severe measure does. ``other`` counts any
    other severity and none at all, so a row sums to the drug's reports.
    """
    severity = F.lower(F.col("ae_severity"))
    known = F.coalesce(severity.isin([level.lower() for level in levels]), F.lit(False))

    def total(when: Column, name: str) -> Column:
        return F.coalesce(F.sum(F.when(when, F.col("cnt"))), F.lit(0)).cast("long").alias(name)

    return (
        drug_severity(fact, top)
        .groupBy("drug_name")
        .agg(*[total(severity == level.lower(), level) for level in levels], total(~known, "other"))
    )


def monthly_trend(fact: DataFrame) -> DataFrame:
    return gold.monthly_severe_trend(fact).select("month", "total_cases", "severe_cases")


def outcome_distribution(fact: DataFrame) -> DataFrame:
    return _by_count(fact, "ae_outcome", "cnt")


def fatal_percent_by_drug(fact: DataFrame) -> DataFrame:
    return gold.fatal_rate_by_drug(fact, digits=1).select(
        "drug_name",
        F.col("total_cases").alias("total"),
        F.col("fatal_cases").alias("fatal"),
        F.col("fatal_rate_pct").alias("fatal_pct"),
    )


def onset_by_soc(fact: DataFrame) -> DataFrame:
    return gold.onset_by(fact, "ae_soc_class")


def severe_by_country(fact: DataFrame) -> DataFrame:
    return _by_count(fact.filter(is_severe()), "country", "severe_cases")


def monthly_volume(fact: DataFrame) -> DataFrame:
    return (
        fact.groupBy(F.trunc("report_date", "MM").alias("month"))
        .agg(_count("cases"))
        .orderBy(F.col("month").asc_nulls_last())
    )


# --- calls --------------------------------------------------------------------------------


def calls_headline(compliance: DataFrame, calls: DataFrame, queue: DataFrame) -> DataFrame:
    """Calls, events, expedited cases in the queue and the mean score, as one row."""
    events = calls.agg(F.count(F.lit(1))).scalar()
    expedited = (
        queue.filter(F.col("reporting_deadline") == EXPEDITED_CLASS)
        .agg(F.count(F.lit(1)))
        .scalar()
    )
    totals = compliance.agg(
        _count("total_calls"), F.round(F.avg("compliance_score"), 1).alias("avg_compliance")
    )
    return totals.select(
        "total_calls",
        events.alias("ae_cases"),
        expedited.alias("pending_15_day"),
        "avg_compliance",
    )


def score_bucket(score: Column) -> Column:
    """Bucket label; a missing score falls into the last one."""
    return (
        F.when(score <= 50, "0-50")
        .when(score <= 70, "51-70")
        .when(score <= 90, "71-90")
        .otherwise("91-100")
    )


def score_buckets(compliance: DataFrame) -> DataFrame:
    bucket = score_bucket(F.col("compliance_score")).alias("score_bucket")
    return compliance.groupBy(bucket).agg(_count("call_count")).orderBy("score_bucket")


def flagged_calls(compliance: DataFrame, below: float = 70) -> DataFrame:
    return (
        compliance.filter(F.col("compliance_score") < below)
        .select(
            "call_id",
            "compliance_score",
            "tone_professional",
            "caller_state",
            "urgency_level",
            "call_type",
            "analyzed_at",
        )
        .orderBy("compliance_score", "call_id")
    )


def escalations(compliance: DataFrame) -> DataFrame:
    return (
        compliance.filter(F.col("escalation_needed"))
        .select(
            "call_id", "compliance_score", "urgency_level", "escalation_reason", "analyzed_at"
        )
        .orderBy(F.desc_nulls_last("analyzed_at"), "call_id")
    )
