"""Batch builds of the bronze, silver and gold tables.

Each table is written before the next step reads it, so no step recomputes an earlier one and a
lost executor costs only the running write. Facts are partitioned by month for pruning.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medwarden.operators import calls, enrichment, gold, search, signals, silver
from medwarden.sources.tables import read_table, write_table


@dataclass(frozen=True)
class Layers:
    """Where tables live: ``<root>/<layer>/<table>``, or catalog names with ``catalog``."""

    root: str
    catalog: bool = False

    def target(self, layer: str, name: str) -> str:
        return f"{self.root}.{layer}_{name}" if self.catalog else f"{self.root}/{layer}/{name}"

    def save(
        self, df: DataFrame, layer: str, name: str, partition_by: list[str] | None = None
    ) -> DataFrame:
        target = self.target(layer, name)
        write_table(df, target, "overwrite", partition_by)
        return read_table(df.sparkSession, target)

    def load(self, spark: SparkSession, layer: str, name: str) -> DataFrame:
        return read_table(spark, self.target(layer, name))


def _save_by_month(layers: Layers, df: DataFrame, name: str, date: str) -> DataFrame:
    dated = df.withColumn("report_month", F.trunc(F.col(date).cast("date"), "MM"))
    # Brings the rows of a month together before writing, so that files are few; adaptive
    # execution splits a month that is too large for one task.
    dated = dated.hint("rebalance", "report_month")
    return layers.save(dated, "silver", name, ["report_month"]).drop("report_month")


def build_reports(
    layers: Layers,
    reports: DataFrame,
    narratives: DataFrame,
    label_lexicon=enrichment.TOXICITY_WORDS,
    field_patterns=enrichment.FIELD_PATTERNS,
    tone_lexicon=enrichment.TONE_WORDS,
) -> dict[str, DataFrame]:
    """Reports and narratives to classified events, the star, and the signal tables."""
    events = layers.save(
        enrichment.classify_events(reports, label_lexicon), "bronze", "classified_events"
    )
    enriched = layers.save(
        enrichment.enrich_narratives(narratives, field_patterns, tone_lexicon),
        "bronze",
        "enriched_narratives",
    )
    fact = _save_by_month(
        layers, silver.fact_adverse_event(events), "fact_adverse_event", "report_date"
    )
    out = {
        "fact_adverse_event": fact,
        "dim_patient": layers.save(silver.dim_patient(events), "silver", "dim_patient"),
        "dim_drug": layers.save(silver.dim_drug(events), "silver", "dim_drug"),
        "fact_narrative": layers.save(
            silver.fact_narrative(enriched), "silver", "fact_narrative"
        ),
    }
    out["signal_prr"] = layers.save(signals.signal_prr(fact), "gold", "signal_prr")
    out["search_corpus"] = layers.save(
        search.search_corpus(out["fact_narrative"], fact), "gold", "search_corpus"
    )
    out["analytics_view"] = gold.analytics_view(fact, out["dim_patient"], out["dim_drug"])
    return out


def build_calls(
    layers: Layers,
    turns: DataFrame,
    term_lexicon: DataFrame,
    drug_lexicon: DataFrame,
    call_rules: calls.CallRules | None = None,
    extraction_rules: calls.ExtractionRules | None = None,
    source: str = "CALL_CENTER",
) -> dict[str, DataFrame]:
    """Speaker turns to transcripts, analyses, extractions and the two call facts."""
    name = source.lower()
    layers.save(calls.assemble_transcripts(turns), "bronze", f"{name}_transcriptions")
    intelligence = layers.save(
        calls.call_intelligence(turns, call_rules), "bronze", f"{name}_intelligence"
    )
    extractions = layers.save(
        calls.extract_adverse_events(turns, term_lexicon, drug_lexicon, extraction_rules),
        "bronze",
        f"{name}_ae_extractions",
    )
    return {
        "fact_ae_calls": layers.save(
            silver.fact_ae_calls(extractions, source), "silver", f"{name}_fact_ae"
        ),
        "fact_agent_compliance": layers.save(
            silver.fact_agent_compliance(intelligence), "silver", f"{name}_fact_compliance"
        ),
    }
