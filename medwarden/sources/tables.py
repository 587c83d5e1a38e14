"""Typed tables, JSON ingest and table sinks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from medwarden import schemas


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project onto a schema: cast each field, and add absent ones as typed NULLs."""
    present = {c.lower() for c in df.columns}
    return df.select(
        *[
            (F.col(f.name) if f.name.lower() in present else F.lit(None))
            .cast(f.dataType)
            .alias(f.name)
            for f in schema.fields
        ]
    )


def _any_null(columns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns])


def missing_required(df: DataFrame, required: list[str]) -> DataFrame:
    """Rows a NOT NULL declaration would refuse, with the names of the empty columns."""
    names = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in required]))
    return df.filter(_any_null(required)).withColumn("missing_columns", names)


def _keep_required(df: DataFrame, required: list[str]) -> DataFrame:
    # IsNotNull per column reaches the parquet scan.
    for column in required:
        df = df.filter(F.col(column).isNotNull())
    return df


def as_ae_reports(df: DataFrame) -> DataFrame:
    """Any frame with report columns as the typed report table."""
    rows = _keep_required(conform(df, schemas.AE_REPORTS), schemas.AE_REPORTS_REQUIRED)
    now = F.current_timestamp().cast("timestamp_ntz")
    return rows.withColumn("created_at", F.coalesce("created_at", now))


def load_ae_reports(spark: SparkSession, path: str) -> DataFrame:
    return as_ae_reports(spark.read.parquet(path))


def as_narratives(df: DataFrame) -> DataFrame:
    """Narratives with the defaults for type and time filled in."""
    rows = _keep_required(conform(df, schemas.AE_NARRATIVES), schemas.AE_NARRATIVES_REQUIRED)
    now = F.current_timestamp().cast("timestamp_ntz")
    return rows.withColumns(
        {
            "narrative_type": F.coalesce("narrative_type", F.lit("INITIAL")),
            "generated_at": F.coalesce("generated_at", now),
        }
    )


def load_narratives(spark: SparkSession, path: str) -> DataFrame:
    return as_narratives(spark.read.parquet(path))


def as_function_events(df: DataFrame) -> DataFrame:
    """The model-call log; a missing time is filled with the current one."""
    rows = conform(df, schemas.FUNCTION_EVENTS)
    now = F.current_timestamp().cast("timestamp_ntz")
    return rows.withColumn("timestamp", F.coalesce("timestamp", now))


def load_function_events(spark: SparkSession, path: str) -> DataFrame:
    return as_function_events(spark.read.parquet(path))


# --- JSON batches -------------------------------------------------------------------------

_PAYLOAD_FIELDS = [f for f in schemas.AE_REPORTS.fields if f.name != "created_at"]
_PAYLOAD_TYPE = "array<struct<" + ", ".join(f"{f.name}: string" for f in _PAYLOAD_FIELDS) + ">>"


def _parsed(payload: Column) -> Column:
    """The payload as an array of all-string records; NULL unless it is a valid JSON array."""
    whole = F.trim(payload)
    is_array = whole.startswith("[") & whole.endswith("]")
    return F.when(is_array, F.from_json(payload, _PAYLOAD_TYPE))


def _misfits(record: Column) -> Column:
    """Names of the fields whose text does not fit the column's type."""
    typed = [f for f in _PAYLOAD_FIELDS if not isinstance(f.dataType, T.StringType)]
    value = {f.name: record[f.name] for f in typed}
    return F.array_compact(
        F.array(
            *[
                F.when(value[f.name].isNotNull() & value[f.name].try_cast(f.dataType).isNull(), F.lit(f.name))
                for f in typed
            ]
        )
    )


def ingest_json_batches(df: DataFrame, payload_col: str, strict: bool = False) -> DataFrame:
    """One typed report row per record of each payload. Payloads that do not parse give none.

    A record with a value that does not fit its column is left out and found by
    ``rejected_batches``; with ``strict`` it fails the job, as a cast does.
    """
    # explode_outer: for explode the optimizer adds a filter that would parse each payload again.
    records = df.select(F.explode_outer(_parsed(F.col(payload_col))).alias("r"))
    records = records.filter(F.col("r").isNotNull())
    if not strict:
        records = records.filter(F.size(_misfits(F.col("r"))) == 0)
    return records.select(
        *[F.col(f"r.{f.name}").cast(f.dataType).alias(f.name) for f in _PAYLOAD_FIELDS]
    )


def rejected_batches(df: DataFrame, payload_col: str) -> DataFrame:
    """The payloads that ``ingest_json_batches`` skips, with the reason.

    A payload appears once for each of its records that has values that do not fit.
    """
    payload = F.col(payload_col)
    reason = (
        F.when(payload.isNull(), "missing")
        .when(F.try_parse_json(payload).isNull(), "invalid json")
        .otherwise("not an array of records")
    )
    whole = df.filter(_parsed(payload).isNull()).withColumn("reason", reason)
    records = df.withColumn("_r", F.explode_outer(_parsed(payload)))
    records = records.withColumn("_bad", _misfits(F.col("_r"))).filter(F.size("_bad") > 0)
    why = F.concat(F.lit("does not fit: "), F.array_join("_bad", ", "))
    return whole.unionByName(records.withColumn("reason", why).drop("_r", "_bad"))


# --- sinks --------------------------------------------------------------------------------


def _is_path(target: str) -> bool:
    return "/" in target


def write_table(
    df: DataFrame,
    target: str,
    mode: str = "overwrite",
    partition_by: list[str] | None = None,
) -> None:
    """Table from query. ``target`` is a catalog name, or a path if it has a slash."""
    writer = df.write.mode(mode).format("parquet")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if _is_path(target):
        writer.save(target)
    else:
        writer.saveAsTable(target)


def append_table(df: DataFrame, target: str, partition_by: list[str] | None = None) -> int:
    """Append and return the rows added, counted while writing (no second pass)."""
    seen = Observation()
    write_table(
        df.observe(seen, F.count(F.lit(1)).alias("rows")), target, "append", partition_by
    )
    return seen.get["rows"]


def read_table(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.parquet(target) if _is_path(target) else spark.table(target)
