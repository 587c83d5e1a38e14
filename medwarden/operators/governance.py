"""Role-based masking, sensitive-column detection and column tags.

Masks are applied last, to the frame a role gets to see: masking a key first would break joins.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Roles and tags.
OFFICER = "DRUG_SAFETY_OFFICER"
ENGINEER = "DATA_ENGINEER"
ANALYST = "PV_ANALYST"
REDACTED = "***REDACTED***"
TAGS: dict[str, list[str]] = {
    "HIPAA_CATEGORY": ["PHI", "PII", "SENSITIVE", "PUBLIC"],
    "DATA_CLASSIFICATION": ["CONFIDENTIAL", "INTERNAL", "PUBLIC"],
}
# Column -> its tags, one pair or several.
PATIENT_TAGS = {
    "patient_dob": ("HIPAA_CATEGORY", "PHI"),
    "patient_id": ("HIPAA_CATEGORY", "PII"),
    "patient_weight": ("HIPAA_CATEGORY", "PHI"),
    "patient_age": ("HIPAA_CATEGORY", "SENSITIVE"),
}
FACT_TAGS = {"case_id": [("DATA_CLASSIFICATION", "CONFIDENTIAL")]}

Mask = Callable[[Column, T.DataType, str], Column]


def _hash_or_redact(value: Column, kind: T.DataType, role: str) -> Column:
    if role == OFFICER:
        return value
    if role == ENGINEER:
        return F.sha2(value.cast("string"), 256)
    return F.lit(REDACTED)


def _year_only(value: Column, kind: T.DataType, role: str) -> Column:
    return value if role == OFFICER else F.make_date(F.year(value), F.lit(1), F.lit(1))


def _hide(value: Column, kind: T.DataType, role: str) -> Column:
    return value if role == OFFICER else F.lit(None).cast(kind)


PATIENT_POLICIES: dict[str, Mask] = {
    "patient_id": _hash_or_redact,
    "patient_dob": _year_only,
    "patient_weight": _hide,
}


def apply_policies(
    df: DataFrame, role: str, policies: Mapping[str, Mask] = PATIENT_POLICIES
) -> DataFrame:
    """The frame as ``role`` may see it. Policies of absent columns are skipped."""
    types = {f.name.lower(): f.dataType for f in df.schema.fields}
    masked = {
        name: mask(F.col(name), types[name.lower()], role)
        for name, mask in policies.items()
        if name.lower() in types
    }
    return df.withColumns(masked) if masked else df


def mask_patient_id(df: DataFrame, role: str, column: str = "patient_id") -> DataFrame:
    return apply_policies(df, role, {column: _hash_or_redact})


def mask_dob(df: DataFrame, role: str, column: str = "patient_dob") -> DataFrame:
    return apply_policies(df, role, {column: _year_only})


def mask_null(df: DataFrame, role: str, column: str = "patient_weight") -> DataFrame:
    return apply_policies(df, role, {column: _hide})


# --- detection ----------------------------------------------------------------------------

# category -> (pattern of the content, part of the column name, tag value)
SENSITIVE_PATTERNS: dict[str, tuple[str | None, str, str]] = {
    "identifier": (r"^[A-Z]{2,4}-[A-Za-z0-9]+$", "id", "PII"),
    "date_of_birth": (r"^19[0-9]{2}-[0-9]{2}-[0-9]{2}$", "dob", "PHI"),
    "email": (r"[A-Za-z0-9.]+@[A-Za-z0-9.]+", "email", "PII"),
    "phone": (r"[0-9]{3}-[0-9]{4}", "phone", "PII"),
    "weight": (None, "weight", "PHI"),
    "age": (None, "age", "SENSITIVE"),
    "sex": (r"^(Male|Female)$", "sex", "SENSITIVE"),
}


def classify_columns(
    df: DataFrame,
    patterns: Mapping[str, tuple[str | None, str, str]] = SENSITIVE_PATTERNS,
    min_rate: float = 0.8,
) -> DataFrame:
    """Columns that look sensitive by content or by name, with the tag to propose.

    A pattern of None leaves the content alone. A name fits by one of its parts between
    underscores, so ``language`` is no ``age``.

    One aggregate counts all matches; the result has a row per column and category that fits.
    """
    aggregates: list[Column] = []
    entries: list[Column] = []
    for i, name in enumerate(df.columns):
        text = F.col(f"`{name}`").cast("string")
        aggregates.append(F.count(text).alias(f"n{i}"))
        for j, (category, (pattern, part, tag)) in enumerate(patterns.items()):
            hit = F.lit(False) if pattern is None else text.rlike(pattern)
            aggregates.append(F.count(F.when(hit, 1)).alias(f"m{i}_{j}"))
            rate = F.coalesce(
                F.col(f"m{i}_{j}").cast("double")
                / F.nullif(F.col(f"n{i}").cast("double"), F.lit(0.0)),
                F.lit(0.0),
            )
            entries.append(
                F.struct(
                    F.lit(name).alias("column_name"),
                    F.lit(category).alias("category"),
                    F.round(rate, 4).alias("hit_rate"),
                    F.lit(part in name.lower().split("_")).alias("name_match"),
                    F.lit(tag).alias("proposed_tag"),
                )
            )
    found = df.agg(*aggregates).select(F.inline(F.array(*entries)))
    return found.filter((F.col("hit_rate") >= min_rate) | F.col("name_match"))


# --- tags ---------------------------------------------------------------------------------


def tag_column(df: DataFrame, column: str, tag: str, value: str) -> DataFrame:
    """Put a tag into the column's metadata; only the tag's allowed values are accepted."""
    if value not in TAGS.get(tag, []):
        raise ValueError(f"{value!r} is not an allowed value of tag {tag!r}")
    field = next(f for f in df.schema.fields if f.name.lower() == column.lower())
    tags = {**field.metadata.get("tags", {}), tag: value}
    return df.withMetadata(field.name, {**field.metadata, "tags": tags})


def tag_columns(
    df: DataFrame, tags: Mapping[str, tuple[str, str] | Sequence[tuple[str, str]]] = PATIENT_TAGS
) -> DataFrame:
    """Put one tag, or several, on each named column."""
    for column, pairs in tags.items():
        for tag, value in [pairs] if isinstance(pairs, tuple) else pairs:
            df = tag_column(df, column, tag, value)
    return df


def tag_detected(
    df: DataFrame,
    patterns: Mapping[str, tuple[str | None, str, str]] = SENSITIVE_PATTERNS,
    min_rate: float = 0.8,
    tag: str = "HIPAA_CATEGORY",
) -> DataFrame:
    """The frame with the proposed tags of ``classify_columns`` applied.

    Runs the detection; its result has at most one row per column and category. Where a column
    fits several categories, the tag value that is allowed first (the strictest) wins.
    """
    found = classify_columns(df, patterns, min_rate).select("column_name", "proposed_tag")
    proposals: dict[str, list[str]] = {}
    for row in found.collect():
        proposals.setdefault(row.column_name, []).append(row.proposed_tag)
    for column, values in proposals.items():
        df = tag_column(df, column, tag, min(values, key=TAGS[tag].index))
    return df


def tag_references(df: DataFrame) -> DataFrame:
    """The tags of a frame as rows: column_name, tag_name, tag_value."""
    rows: Sequence[tuple[str, str, str]] = [
        (f.name, tag, value)
        for f in df.schema.fields
        for tag, value in f.metadata.get("tags", {}).items()
    ]
    return df.sparkSession.createDataFrame(
        rows, "column_name string, tag_name string, tag_value string"
    )
