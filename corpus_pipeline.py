"""From raw documents to encoded training text, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; its result is
written as Parquet in the shared folder and read again for the next. Stages that decide about rows
match them by id and a hash of their columns, so repeated ids are told apart. Which rows a stage
keeps does not depend on how they are dealt over partitions. Other columns than those of documents
may be called anything; they stay with their rows until the last stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medwarden.llm.bpe import bpe_round_trip
from medwarden.llm.common import stage, table
from medwarden.llm.decontaminate import decontaminate
from medwarden.llm.line_dedup import line_dedup
from medwarden.llm.quality_rules import quality_rules
from medwarden.llm.simhash import near_duplicates

TOKENIZER = "word_bpe_49k.json"
KEY = "_row"


def _free(docs: DataFrame, name: str) -> str:
    """``name``, made longer until no column has it."""
    while name in docs.columns:
        name += "_"
    return name


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a key of id and content, and the name of that column, which is new."""
    key = _free(docs, KEY)
    return docs.withColumn(key, F.struct("doc_id", F.xxhash64("text", "lang", "source"))), key


def _matching(keyed: DataFrame, keys: DataFrame, key: str, how: str) -> DataFrame:
    """Rows of ``keyed`` whose key is (left_semi) or is not (left_anti) among ``keys``."""
    other = _free(keyed, "_other")
    return keyed.join(keys.select(F.col(key).alias(other)), F.col(key) == F.col(other), how)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    keyed, key = _keyed(docs)
    kept = quality_rules(keyed, id_col=key).filter("kept")
    return _matching(keyed, kept, key, "left_semi").select(docs.columns)


def drop_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines whose template recurs; ``n_chars`` follows the text."""
    return line_dedup(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of the smallest id, once."""
    keyed, key = _keyed(docs)
    first = near_duplicates(keyed, id_col=key).filter(F.col(key) == F.col("component_id"))
    return _matching(keyed, first, key, "left_semi").dropDuplicates([key]).select(docs.columns)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    keyed, key = _keyed(docs)
    found = decontaminate(keyed, table(spark, sf_dir, "benchmark"), id_col=key)
    return _matching(keyed, stage(found.select(key).distinct(), "leaks"), key, "left_anti").select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and hashes of ids and decoded text of every document."""
    return bpe_round_trip(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality_rules", drop_low_quality),
    ("line_dedup", drop_recurring_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("bpe", encode),
]

# Near duplicates, latent retrieval and BPE are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that all stages keep, encoded."""
    docs = table(spark, sf_dir, "documents")
    for name, apply in STAGES:
        docs = stage(apply(spark, docs, sf_dir), name)
    return docs
