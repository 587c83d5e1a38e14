"""Data-quality metrics and verification reports."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medwarden.functions.numbers import count_where
from medwarden.functions.text import preview as preview_text
from medwarden.operators.gold import share_of_total

NULL_COUNT, ROW_COUNT, FRESHNESS = "NULL_COUNT", "ROW_COUNT", "FRESHNESS"


def _metric(kind: str, column: str | None, as_of: dt.datetime | None) -> Column:
    if kind == ROW_COUNT:
        return F.count(F.lit(1))
    if column is None:
        raise ValueError(f"{kind} needs a column")
    if kind == NULL_COUNT:
        return count_where(F.col(column).isNull())
    if kind == FRESHNESS:
        now = F.current_timestamp() if as_of is None else F.lit(as_of).cast("timestamp")
        newest = F.max(F.col(column).cast("timestamp"))
        return F.unix_seconds(now) - F.unix_seconds(newest)
    raise ValueError(f"unknown metric {kind!r}")


def dq_null_count(df: DataFrame, column: str) -> DataFrame:
    return df.agg(_metric(NULL_COUNT, column, None).alias("null_count"))


def dq_row_count(df: DataFrame) -> DataFrame:
    return df.agg(_metric(ROW_COUNT, None, None).alias("row_count"))


def dq_freshness(df: DataFrame, column: str, as_of: dt.datetime | None = None) -> DataFrame:
    """Seconds from the newest value of a date or time column to ``as_of``."""
    return df.agg(_metric(FRESHNESS, column, as_of).alias("freshness_seconds"))


def dq_report(
    df: DataFrame,
    specs: Sequence[tuple[str, str | None]],
    as_of: dt.datetime | None = None,
) -> DataFrame:
    """All metrics (kind, column) of a table as rows, from one pass."""
    totals = df.agg(
        *[_metric(kind, col, as_of).cast("bigint").alias(f"v{i}")
          for i, (kind, col) in enumerate(specs)]
    )
    rows = [
        F.struct(
            F.lit(kind).alias("metric"),
            F.lit(col or "").alias("column_name"),
            F.col(f"v{i}").alias("value"),
        )
        for i, (kind, col) in enumerate(specs)
    ]
    return totals.select(F.inline(F.array(*rows)))


def _union(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    return _union(
        [
            df.agg(F.count(F.lit(1)).alias("row_count")).select(
                F.lit(name).alias("table_name"), "row_count"
            )
            for name, df in tables.items()
        ]
    )


def completeness(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Total rows, and per entry {label: column} how many have and lack a value."""
    counts = df.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count(F.col(c)).alias(f"has_{label}") for label, c in columns.items()],
    )
    missing = [
        (F.col("total") - F.col(f"has_{label}")).alias(f"missing_{label}") for label in columns
    ]
    return counts.select("*", *missing)


def null_outputs(tables: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """Rows per table whose model output is NULL, that is, whose call failed."""
    return _union(
        [
            df.agg(count_where(F.col(column).isNull()).alias("null_count")).select(
                F.lit(name).alias("table_name"), "null_count"
            )
            for name, (df, column) in tables.items()
        ]
    )


def distribution(df: DataFrame, column: str, digits: int = 1) -> DataFrame:
    """Rows per value with their percentage of all rows."""
    return share_of_total(df, column, "cnt", "pct", digits)


def detection_summary(extractions: Mapping[str, DataFrame]) -> DataFrame:
    """Per source: records, records with an event, expedited records. No records give NULL sums."""
    record = "ae_extraction_json."

    def ones(condition: Column) -> Column:
        return F.sum(F.when(condition, 1).otherwise(0))

    return _union(
        [
            df.agg(
                F.count(F.lit(1)).alias("total"),
                ones(F.col(record + "ae_detected")).alias("ae_detected_count"),
                ones(F.col(record + "reporting_deadline") == "15_day_expedited").alias(
                    "expedited_reports"
                ),
            ).select(F.lit(source).alias("source"), "*")
            for source, df in extractions.items()
        ]
    )


def preview(
    df: DataFrame,
    fields: Mapping[str, str],
    text: Mapping[str, tuple[str, int]] | None = None,
    order_by: Sequence[str] = (),
    limit: int | None = None,
) -> DataFrame:
    """Picked fields {name: path} and cut texts {name: (path, length)} of a nested table."""
    picked = [F.col(path).alias(name) for name, path in fields.items()]
    cut = [preview_text(F.col(p), n).alias(name) for name, (p, n) in (text or {}).items()]
    rows = df.select(*picked, *cut)
    if limit is None:
        return rows
    order = list(order_by) or rows.columns
    return rows.orderBy(*[F.col(c).asc_nulls_last() for c in order]).limit(limit)
