"""Joined views and the fixed analyst questions over the fact table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medwarden.functions.numbers import count_where, is_value, percent

PATIENT_KEY = ["patient_id"]
DRUG_KEY = ["drug_name", "drug_dose", "drug_route"]


def one_row_per_key(dim: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """The smallest row per key (NULL first). Combines map-side, so no key is ever sorted whole."""
    first = F.min(F.struct(*columns)).alias("_first")
    return dim.groupBy(*key).agg(first).select(*key, *[f"_first.{c}" for c in columns])


def analytics_view(
    fact: DataFrame, patients: DataFrame, drugs: DataFrame
) -> DataFrame:
    """Fact with patient age, sex and drug indication.

    A dimension row per matching key is kept, so facts multiply where a key has several rows. The
    fact is read once; where a key holds many facts, adaptive execution splits its partition.
    """
    patient = patients.select(*PATIENT_KEY, "patient_age", "patient_sex")
    drug = drugs.select(*DRUG_KEY, "indication")
    rows = fact.join(patient, PATIENT_KEY, "left").join(drug, DRUG_KEY, "left")
    return rows.select(*fact.columns, "patient_age", "patient_sex", "indication")


def analytics_view_dedup(
    fact: DataFrame, patients: DataFrame, drugs: DataFrame
) -> DataFrame:
    """The same with one dimension row per key: exactly one row per fact."""
    return analytics_view(
        fact,
        one_row_per_key(patients, PATIENT_KEY, ["patient_age", "patient_sex"]),
        one_row_per_key(drugs, DRUG_KEY, ["indication", "manufacturer"]),
    )


def cases_by_drug(view: DataFrame) -> DataFrame:
    return view.groupBy("drug_name").agg(F.count(F.lit(1)).alias("cases"))


def cases_by_drug_from_star(
    fact: DataFrame, patients: DataFrame, drugs: DataFrame
) -> DataFrame:
    """``cases_by_drug`` of the view without building the view.

    A fact row appears (patient rows x drug rows) times, so counts per key are multiplied instead
    of joining the rows themselves.
    """
    per_patient = patients.groupBy(*PATIENT_KEY).agg(F.count(F.lit(1)).alias("n_patient"))
    per_drug = drugs.groupBy(*DRUG_KEY).agg(F.count(F.lit(1)).alias("n_drug"))
    facts = fact.groupBy(*PATIENT_KEY, *DRUG_KEY).agg(F.count(F.lit(1)).alias("n"))
    weighted = (
        facts.join(per_patient, PATIENT_KEY, "left")
        .groupBy(*DRUG_KEY)
        .agg(F.sum(F.col("n") * F.coalesce("n_patient", F.lit(1))).alias("n"))
    )
    return (
        weighted.join(per_drug, DRUG_KEY, "left")
        .groupBy("drug_name")
        .agg(F.sum(F.col("n") * F.coalesce("n_drug", F.lit(1))).alias("cases"))
    )


FATAL = "Fatal"
SEVERE = "severe"


def is_fatal() -> Column:
    return is_value(F.col("ae_outcome"), FATAL)


def is_severe() -> Column:
    return is_value(F.col("ae_severity"), SEVERE, ignore_case=True)


def top_drugs(fact: DataFrame, n: int = 5) -> DataFrame:
    """Drugs with the most distinct cases."""
    return (
        fact.groupBy("drug_name")
        .agg(F.count_distinct("case_id").alias("total_cases"))
        .orderBy(F.desc("total_cases"), "drug_name")
        .limit(n)
    )


def monthly_severe_trend(fact: DataFrame) -> DataFrame:
    return (
        fact.groupBy(F.trunc("report_date", "MM").alias("month"))
        .agg(count_where(is_severe()).alias("severe_cases"), F.count(F.lit(1)).alias("total_cases"))
        .orderBy(F.col("month").asc_nulls_last())
    )


def fatal_rate_by_drug(fact: DataFrame, min_cases: int = 5, digits: int = 2) -> DataFrame:
    counts = fact.groupBy("drug_name").agg(
        F.count(F.lit(1)).alias("total_cases"), count_where(is_fatal()).alias("fatal_cases")
    )
    return (
        counts.filter(F.col("total_cases") >= min_cases)
        .withColumn(
            "fatal_rate_pct", percent(F.col("fatal_cases"), F.col("total_cases"), digits)
        )
        .orderBy(F.desc("fatal_rate_pct"), "drug_name")
    )


def share_of_total(df: DataFrame, column: str, count: str, pct: str, digits: int = 1) -> DataFrame:
    """Rows per value and their percentage of all rows.

    The total is a scalar subquery over the grouped rows, so no task sees all of them.
    """
    groups = df.groupBy(column).agg(F.count(F.lit(1)).alias(count))
    total = groups.agg(F.sum(count)).scalar()
    return groups.withColumn(pct, percent(F.col(count), total, digits)).orderBy(
        F.desc(count), F.col(column).asc_nulls_last()
    )


def soc_distribution(fact: DataFrame) -> DataFrame:
    return share_of_total(fact, "ae_soc_class", "case_count", "pct")


def onset_by(fact: DataFrame, column: str) -> DataFrame:
    """Mean and median days to onset. The median keeps one counter per distinct day value."""
    return (
        fact.filter(F.col("onset_days").isNotNull())
        .groupBy(column)
        .agg(
            F.round(F.avg("onset_days"), 1).alias("avg_onset_days"),
            F.round(F.median("onset_days"), 1).alias("median_onset_days"),
            F.count(F.lit(1)).alias("cases"),
        )
        .orderBy(F.desc("avg_onset_days"), F.col(column).asc_nulls_last())
    )


def onset_by_drug(fact: DataFrame) -> DataFrame:
    return onset_by(fact, "drug_name")
