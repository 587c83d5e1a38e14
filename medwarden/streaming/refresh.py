"""Tables that keep themselves fresh, as Structured Streaming jobs.

Every job has its own checkpoint under the cluster's shared folder. Sinks written per batch are
keyed by the batch id and overwrite on a retry, so a batch that runs twice counts once.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from medwarden.functions.numbers import count_where
from medwarden.operators.health import health_measures
from medwarden.schemas import BINARY_FILE
from medwarden.session import checkpoint_root
from medwarden.sources.files import as_catalog

# Freshness targets.
REPORTS_LAG = "60 minutes"
CALLS_LAG = "30 minutes"
SEARCH_LAG = "1 hour"


def start_stream(
    writer: DataStreamWriter,
    spark: SparkSession,
    name: str,
    lag: str | None,
    checkpoint: str | None,
) -> StreamingQuery:
    """``lag`` None runs what is there and stops; else the job wakes up once per ``lag``."""
    location = f"{checkpoint_root(spark, checkpoint)}/{name}"
    writer = writer.option("checkpointLocation", location)
    timed = writer.trigger(availableNow=True) if lag is None else writer.trigger(
        processingTime=lag
    )
    return timed.start()


def table_stream(
    spark: SparkSession, path: str, schema: T.StructType, max_files: int | None = None
) -> DataFrame:
    """New files of a parquet table as a stream."""
    reader = spark.readStream.schema(schema).format("parquet")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def catalog_stream(
    spark: SparkSession, path: str, glob: str = "*", max_files: int = 10
) -> DataFrame:
    """Catalog rows of newly arrived recordings, at most ``max_files`` per batch.

    The file bytes are not selected, so they are not read.
    """
    listing = (
        spark.readStream.format("binaryFile")
        .schema(BINARY_FILE)
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", max_files)
        .load(path)
    )
    return as_catalog(listing)


def refresh_stream(
    source: DataFrame,
    transform: Callable[[DataFrame], DataFrame],
    sink: str,
    name: str,
    lag: str | None = REPORTS_LAG,
    checkpoint: str | None = None,
) -> StreamingQuery:
    """Keep ``sink`` equal to ``transform`` of all rows of a stream, for row-wise transforms.

    The file sink commits each batch in its log, so output is exactly once.
    """
    writer = (
        transform(source).writeStream.format("parquet").option("path", sink).outputMode("append")
    )
    return start_stream(writer, source.sparkSession, name, lag, checkpoint)


def refresh_joined_stream(
    source: DataFrame,
    transform: Callable[[DataFrame], DataFrame],
    sink: str,
    name: str,
    lag: str | None = SEARCH_LAG,
    checkpoint: str | None = None,
) -> StreamingQuery:
    """Like ``refresh_stream`` for transforms that read other tables or aggregate a batch.

    Each batch is a plain DataFrame for ``transform``; its result is one partition of the sink.
    Rows already written do not change when the other tables do: rebuild the table for that
    (``medwarden.plans.layers``).
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}")

    return start_stream(
        source.writeStream.foreachBatch(write), source.sparkSession, name, lag, checkpoint
    )


def refresh_distinct_stream(
    source: DataFrame,
    columns: Sequence[str],
    sink: str,
    name: str,
    lag: str | None = REPORTS_LAG,
    checkpoint: str | None = None,
) -> StreamingQuery:
    """Keep ``sink`` equal to the distinct ``columns`` of a stream (a dimension).

    A batch is made distinct with map-side combining, so copies of one row never meet in one task
    unreduced, and is then compared with the sink. No state is kept between batches. A retried
    batch leaves its own earlier partition out of the comparison and overwrites it.
    """
    spark = source.sparkSession
    stored = T.StructType(
        [*source.select(*columns).schema.fields, T.StructField("batch_id", T.LongType())]
    )

    def write(batch: DataFrame, batch_id: int) -> None:
        fresh = batch.select(*columns).distinct()
        if batch_id > 0:
            known = (
                spark.read.schema(stored)
                .parquet(sink)
                .filter(F.col("batch_id") < batch_id)
                .drop("batch_id")
                .withColumnsRenamed({c: f"_{c}" for c in columns})
            )
            same = reduce(
                lambda a, b: a & b,
                [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in columns],
            )
            fresh = fresh.join(known, same, "left_anti")
        fresh.write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}")

    return start_stream(source.writeStream.foreachBatch(write), spark, name, lag, checkpoint)


def function_health_stream(
    events: DataFrame, watermark: str = "10 minutes", hours: int = 1
) -> DataFrame:
    """Hourly health of a stream of call events; later events than the watermark are left out.

    In append mode an hour is emitted when the watermark passes its end, in update and complete
    mode at once.
    """
    timed = events.withColumn("_time", F.col("timestamp").cast("timestamp"))
    return (
        timed.withWatermark("_time", watermark)
        .groupBy(F.window("_time", f"{hours} hour"), "function_name", "model_used")
        .agg(*health_measures())
        .select(
            F.col("window.start").cast("timestamp_ntz").alias("hour"),
            "function_name",
            "model_used",
            "total_calls",
            "error_count",
            "avg_latency_ms",
            "total_tokens",
        )
    )


_HEALTH_KEYS = ["hour", "function_name", "model_used"]
_HEALTH_PARTS = (
    "hour timestamp_ntz, function_name string, model_used string, total_calls bigint, error_count bigint, "
    "latency bigint, timed bigint, total_tokens bigint, late_calls bigint, batch_id bigint"
)


def refresh_health(
    events: DataFrame,
    sink: str,
    name: str,
    lag: str | None = REPORTS_LAG,
    checkpoint: str | None = None,
) -> StreamingQuery:
    """Keep the hourly health of a stream of call events, however late they come.

    A batch writes what it adds to each hour as one ``batch_id`` partition, so a late event corrects
    its hour and a retried batch counts once. Calls of an hour before the last one that earlier
    batches had are counted as late, too. Read the result with ``current_health``.
    """
    spark = events.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        known = None
        if batch_id > 0:
            earlier = spark.read.schema(_HEALTH_PARTS).parquet(sink).filter(F.col("batch_id") < batch_id)
            known = earlier.agg(F.max("hour")).first()[0]
        hour = F.date_trunc("hour", F.col("timestamp")).cast("timestamp_ntz")
        late = F.lit(False) if known is None else F.col("hour") < F.lit(known).cast("timestamp_ntz")
        parts = (
            batch.withColumn("hour", hour)
            .groupBy(*_HEALTH_KEYS)
            .agg(
                F.count(F.lit(1)).alias("total_calls"),
                count_where(F.col("status") == "error").alias("error_count"),
                F.sum(F.col("latency_ms").cast("long")).alias("latency"),
                F.count("latency_ms").alias("timed"),
                F.sum(F.col("token_count").cast("long")).alias("total_tokens"),
            )
            .withColumn("late_calls", F.when(late, F.col("total_calls")).otherwise(F.lit(0).cast("long")))
        )
        parts.write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}")

    return start_stream(events.writeStream.foreachBatch(write), spark, name, lag, checkpoint)


def current_health(spark: SparkSession, sink: str) -> DataFrame:
    """What ``function_health`` gives for all events so far, and ``late_calls``."""
    parts = spark.read.schema(_HEALTH_PARTS).parquet(sink)
    summed = parts.groupBy(*_HEALTH_KEYS).agg(
        *[F.sum(c).alias(c) for c in ("total_calls", "error_count", "latency", "timed", "total_tokens", "late_calls")]
    )
    mean = F.round(F.col("latency").cast("double") / F.nullif(F.col("timed"), F.lit(0)), 0)
    return summed.select(
        *_HEALTH_KEYS, "total_calls", "error_count", mean.alias("avg_latency_ms"), "total_tokens", "late_calls"
    ).orderBy(F.desc_nulls_last("hour"), "function_name", "model_used")
