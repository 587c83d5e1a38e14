"""Helpers shared by the text operators."""

from __future__ import annotations

import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Hashable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Between words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = "\\x20\\x09-\\x0D"

# Bits of a bitmap of hashes, however many hashes there are, in buckets of Spark's bitmap functions.
BITMAP_BITS, _BUCKET = 1 << 27, 32768


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only a local session (tests), where driver and executors are one process, may go without.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is not set")
        root = kept_in_worker("shared folder", lambda: tempfile.mkdtemp(prefix="medwarden-"))
    return root.rstrip("/")


def stage(df: DataFrame, name: str, **options: int | str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors.

    ``options`` are those of the writer.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_of(docs: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """Only the columns an operator needs, so that no other column can clash with its own."""
    return docs.select(
        F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), *[F.col(c) for c in more]
    )


def kept_in_worker(key: Hashable, make: Callable[[], object]) -> object:
    """What ``make`` gave in this Python process for ``key``, made at the first call.

    Python workers serve one task after the other, but a task brings its functions' own globals
    along. So this lives in a module of the process; it holds caches whose size is bounded.
    """
    name = "medwarden_kept_in_worker"
    kept = sys.modules.setdefault(name, types.ModuleType(name)).__dict__.setdefault("kept", {})
    if key not in kept:
        kept[key] = make()
    return kept[key]


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))


def words_of(text: Column) -> Column:
    """Words between white space; empty for NULL or blank text."""
    clean = trimmed(text)
    return F.when(F.length(clean) > 0, F.split(clean, f"[{SPACE}]+")).otherwise(
        F.array().cast("array<string>")
    )


def bitmap(keys: DataFrame) -> np.ndarray:
    """``BITMAP_BITS`` bits with those of the hashes ``key`` set: what the driver gets is bounded."""
    bit = F.pmod("key", F.lit(BITMAP_BITS))
    rows = (
        keys.select(bit.alias("bit"))
        .groupBy(F.floor(F.col("bit") / _BUCKET).alias("bucket"))
        .agg(F.bitmap_construct_agg((F.col("bit") % _BUCKET).cast("long")).alias("bits"))
        .collect()
    )
    bits = np.zeros((BITMAP_BITS // _BUCKET, _BUCKET // 8), np.uint8)
    for r in rows:
        bits[r.bucket] = np.frombuffer(r["bits"], np.uint8)
    return bits.ravel()


def bits_set(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the 64-bit hashes are set in ``bits``: all that were put in, and few others."""
    at = keys.view(np.int64) & (BITMAP_BITS - 1)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
