"""Catalogs of recording files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

def base_name(column: str) -> Column:
    return F.split_part(F.col(column), F.lit("/"), F.lit(-1))


def as_catalog(listing: DataFrame) -> DataFrame:
    return listing.select(
        F.col("path").alias("file_path"),
        base_name("path").alias("file_name"),
        F.col("length").alias("file_size_bytes"),
        F.col("modificationTime").alias("received_at"),
    )


def file_catalog(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Path, base name, size and arrival time of each file (``*.mp3``, ``*.mp4``, ...).

    ``content`` is not selected, so the scan skips reading the files themselves.
    """
    reader = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", "true")
    )
    return as_catalog(reader.load(path))


def not_yet_in(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in ``done``. NULL keys on either side match nothing.

    ``done`` is made distinct first, which combines map-side: a key with very many rows there
    reaches the join once.
    """
    return rows.join(done.select(key).distinct(), key, "left_anti")


def catalog_increment(listing: DataFrame, catalog: DataFrame, limit: int = 10) -> DataFrame:
    """New files only, oldest first, at most ``limit`` (the batch size of one run)."""
    fresh = not_yet_in(listing, catalog, "file_path")
    return (
        fresh.orderBy(F.col("received_at").asc_nulls_last(), F.col("file_path").asc_nulls_last())
        .limit(limit)
        .withColumn("file_name", base_name("file_path"))
    )
