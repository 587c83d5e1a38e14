"""Deadline-driven work queue of adverse events from calls."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Days allowed per deadline class, and the days that make a case urgent.
EXPEDITED_CLASS, EXPEDITED_DAYS = "15_day_expedited", 15
PERIODIC_CLASS, PERIODIC_DAYS = "90_day_periodic", 90
URGENT_WITHIN_DAYS = 3
URGENT, ACTION_REQUIRED, STANDARD = "URGENT", "ACTION_REQUIRED", "STANDARD"


def triage_queue(
    calls: DataFrame,
    compliance: DataFrame,
    as_of: dt.date | None = None,
    clock_start: str = "report_date",
) -> DataFrame:
    """Events with submission deadline, priority and the compliance facts of their call.

    ``as_of`` stands for today (default: the current date). Overdue cases stay urgent. The
    deadline runs from ``clock_start``; calls without an analysis keep NULL compliance columns.
    """
    today = F.current_date() if as_of is None else F.lit(as_of)
    start = F.col(clock_start).cast("date")
    kind = F.col("reporting_deadline")
    deadline = F.when(kind == EXPEDITED_CLASS, F.date_add(start, EXPEDITED_DAYS)).when(
        kind == PERIODIC_CLASS, F.date_add(start, PERIODIC_DAYS)
    )
    close = F.date_add(start, EXPEDITED_DAYS) <= F.date_add(today, URGENT_WITHIN_DAYS)
    priority = (
        F.when((kind == EXPEDITED_CLASS) & close, URGENT)
        .when(kind == EXPEDITED_CLASS, ACTION_REQUIRED)
        .otherwise(STANDARD)
    )
    scores = compliance.select(
        F.col("call_id").alias("source_call_id"),
        "compliance_score",
        "caller_state",
        "urgency_level",
    )
    return calls.join(scores, "source_call_id", "left").select(
        "source_call_id",
        "drug_name",
        "ae_preferred_term",
        "ae_soc_class",
        "ae_seriousness",
        "ae_outcome",
        "reporting_deadline",
        "case_narrative",
        "patient_age",
        "patient_sex",
        "compliance_score",
        "caller_state",
        "urgency_level",
        deadline.alias("submission_deadline"),
        priority.alias("priority_flag"),
        "report_date",
    )


def priority_rank() -> Column:
    return F.when(F.col("priority_flag") == URGENT, 1).when(
        F.col("priority_flag") == ACTION_REQUIRED, 2
    ).otherwise(3)


def triage_sorted(queue: DataFrame) -> DataFrame:
    """Most pressing first; cases without a deadline last within their rank."""
    return queue.orderBy(
        priority_rank(),
        F.col("submission_deadline").asc_nulls_last(),
        F.col("source_call_id"),
        F.col("ae_preferred_term"),
    )


def urgent_count(queue: DataFrame) -> DataFrame:
    return queue.filter(F.col("priority_flag") == URGENT).agg(
        F.count(F.lit(1)).alias("urgent_cases")
    )
