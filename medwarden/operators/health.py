"""Hourly health of model calls and error alerts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medwarden.functions.numbers import count_where, ratio


def health_measures() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("total_calls"),
        count_where(F.col("status") == "error").alias("error_count"),
        F.round(F.avg("latency_ms"), 0).alias("avg_latency_ms"),
        F.sum("token_count").alias("total_tokens"),
    ]


def function_health(events: DataFrame) -> DataFrame:
    """Calls, errors, mean latency and tokens by hour, function and model; newest first."""
    hour = F.date_trunc("hour", F.col("timestamp")).cast("timestamp_ntz").alias("hour")
    return (
        events.groupBy(hour, "function_name", "model_used")
        .agg(*health_measures())
        .orderBy(F.desc_nulls_last("hour"), "function_name", "model_used")
    )


def _alerts(rows: DataFrame, min_rate: float) -> DataFrame:
    rate = ratio(F.col("error_count"), F.col("total_calls"))
    return rows.filter(rate > min_rate).select(
        "model_used",
        "error_count",
        "total_calls",
        F.round(rate * 100, 1).alias("error_rate_pct"),
    )


def error_alerts(
    health: DataFrame, as_of: dt.datetime | None = None, min_rate: float = 0.10
) -> DataFrame:
    """Health rows of the last hour over the error rate.

    Hours are bucket starts, so this is normally the current bucket only; a model appears once per
    function. A past ``as_of`` also hides what came later.
    """
    now = F.current_timestamp().cast("timestamp_ntz") if as_of is None else F.lit(as_of)
    now = now.cast("timestamp_ntz")
    recent = (F.col("hour") >= now - F.expr("INTERVAL 1 HOUR")) & (F.col("hour") <= now)
    return _alerts(health.filter(recent), min_rate)


def rolling_error_alerts(
    events: DataFrame, as_of: dt.datetime | None = None, min_rate: float = 0.10
) -> DataFrame:
    """The same over the events of the last 60 minutes instead of an hour bucket."""
    now = F.current_timestamp() if as_of is None else F.lit(as_of)
    now = now.cast("timestamp_ntz")
    time = F.col("timestamp")
    recent = events.filter((time >= now - F.expr("INTERVAL 1 HOUR")) & (time <= now))
    rows = recent.groupBy("function_name", "model_used").agg(*health_measures())
    return _alerts(rows, min_rate)
