"""Jobs that rebuild what a batch touches: the call chain, and the search corpus from both sides.

Keyed state gives all rows so far of the keys in a batch (``medwarden.streaming.state``), so a batch
costs what it touches, however long the history is. What is made of them is written as the batch's
``batch_id`` partition of the results; rows that come late, in whatever order, count as if they had
come at once. The rows of a key's latest batch are the valid ones (``current``). A batch that runs
again finds the state as it was before and overwrites its own partitions.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from medwarden.operators import calls, search, search_index, silver
from medwarden.streaming.refresh import CALLS_LAG, SEARCH_LAG, start_stream
from medwarden.streaming.state import state_settings, touched_rows

# Result tables of the call chain and the column that names the recording.
CALL_TABLES = {
    "transcriptions": "file_name",
    "intelligence": "file_name",
    "ae_extractions": "file_name",
    "fact_ae_calls": "source_call_id",
    "fact_agent_compliance": "call_id",
}


def _keep(df: DataFrame, root: str, table: str, batch_id: int) -> DataFrame:
    path = f"{root}/{table}/batch_id={batch_id}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _history(spark: SparkSession, root: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{table}").withColumn(
        "batch_id", F.col("batch_id").cast("long")
    )


def _staged(batch: DataFrame, root: str) -> DataFrame:
    """The rows of a batch, written once: each further use of a batch would run its stream again.

    The folder holds one batch, and the next one replaces it.
    """
    path = f"{root}/batch"
    batch.write.mode("overwrite").parquet(path)
    return batch.sparkSession.read.schema(batch.schema).parquet(path)


def current(spark: SparkSession, root: str, table: str, key: str, by: str, by_key: str) -> DataFrame:
    """Rows of ``table`` from the latest batch of their key, as table ``by`` has it.

    ``by`` has a row for each key of a batch.
    """
    latest = (
        _history(spark, root, by)
        .groupBy(F.col(by_key).alias("_key"))
        .agg(F.max("batch_id").alias("_latest"))
    )
    rows = _history(spark, root, table)
    return rows.join(
        latest,
        F.col(key).eqNullSafe(F.col("_key")) & (F.col("batch_id") == F.col("_latest")),
        "left_semi",
    ).drop("batch_id")


def current_calls(spark: SparkSession, root: str, table: str) -> DataFrame:
    """The valid rows of one of ``CALL_TABLES``."""
    return current(spark, root, table, CALL_TABLES[table], "transcriptions", "file_name")


def refresh_calls(
    turns: DataFrame,
    term_lexicon: DataFrame,
    drug_lexicon: DataFrame,
    root: str,
    name: str,
    source: str = "CALL_CENTER",
    call_rules: calls.CallRules | None = None,
    extraction_rules: calls.ExtractionRules | None = None,
    lag: str | None = CALLS_LAG,
    checkpoint: str | None = None,
    keep_ms: int | None = None,
) -> StreamingQuery:
    """Keep five tables under ``root`` up to date with a stream of speaker turns.

    The turns of a recording may arrive in any number of batches: all recordings of the file names
    in a batch are rebuilt from all their turns. Read the tables with ``current_calls``. Turns are
    kept for ever, or for ``keep_ms`` after a recording's last one; what comes later still changes
    nothing and is kept in table ``late_turns``, for a rebuild from the source.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        both = _staged(batch, root)
        rows = both.filter(~F.col("late")).drop("late")
        if keep_ms is not None:
            _keep(both.filter("late").drop("late"), root, "late_turns", batch_id)

        def save(df: DataFrame, table: str) -> DataFrame:
            return _keep(df, root, table, batch_id)

        save(calls.assemble_transcripts(rows), "transcriptions")
        analyses = save(calls.call_intelligence(rows, call_rules), "intelligence")
        records = save(
            calls.extract_adverse_events(rows, term_lexicon, drug_lexicon, extraction_rules),
            "ae_extractions",
        )
        save(silver.fact_agent_compliance(analyses), "fact_agent_compliance")
        save(silver.fact_ae_calls(records, source), "fact_ae_calls")

    writer = touched_rows(turns, "file_name", keep_ms).writeStream.foreachBatch(write)
    with state_settings(turns.sparkSession, keep_ms is not None):
        return start_stream(writer, turns.sparkSession, name, lag, checkpoint)


_FACT_COLUMNS = ["drug_name", "ae_soc_class", "ae_term", "report_date"]


def refresh_search_corpus(
    narratives: DataFrame,
    fact: DataFrame,
    root: str,
    name: str,
    lag: str | None = SEARCH_LAG,
    checkpoint: str | None = None,
    compact_every: int = 0,
) -> StreamingQuery:
    """Keep the search corpus and its index up to date with streams of narratives and report facts.

    A report that comes after its narrative fills in the attributes. A batch writes the rows of its
    cases as a segment of the index, which replaces their older rows; every ``compact_every`` batches
    the segments become one. Read the corpus with ``current_corpus`` and search it with
    ``search_current``.
    """
    texts = narratives.select("case_id", "narrative_text").withColumn("is_text", F.lit(True))
    facts = fact.select("case_id", *_FACT_COLUMNS).withColumn("is_text", F.lit(False))
    both = texts.unionByName(facts, allowMissingColumns=True)
    spark = narratives.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = _staged(batch, root)
        corpus = search.search_corpus(
            rows.filter("is_text").select("case_id", "narrative_text"),
            rows.filter("NOT is_text").select("case_id", *_FACT_COLUMNS),
        )
        corpus = _keep(corpus, root, "corpus", batch_id)
        # Odd numbers are for compactions.
        search_index.write_segment(corpus, _index(root), 2 * batch_id, cols=["drug_name", "ae_soc_class"])
        if compact_every and batch_id % compact_every == compact_every - 1:
            search_index.compact(spark, _index(root))

    writer = touched_rows(both, "case_id").writeStream.foreachBatch(write)
    with state_settings(spark):
        return start_stream(writer, spark, name, lag, checkpoint)


def _index(root: str) -> str:
    return f"{root}/index"


def current_corpus(spark: SparkSession, root: str) -> DataFrame:
    """The valid rows of the search corpus."""
    return current(spark, root, "corpus", "case_id", "corpus", "case_id")


def search_current(
    spark: SparkSession,
    root: str,
    queries: DataFrame,
    k: int = 5,
    filters: Mapping[str, str] | None = None,
    cols: Sequence[str] = (),
) -> DataFrame:
    """What ``search_batch`` finds in ``current_corpus``, from the index."""
    return search_index.search_index(spark, _index(root), queries, k, filters, cols)
