"""One Spark query per operator, over the driver's tables."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks import fixture_rules as rules
from medwarden import schemas
from medwarden.functions.text import shorten
from medwarden.operators import (
    calls,
    dashboards,
    enrichment,
    gold,
    governance,
    health,
    quality,
    search,
    search_index,
    signals,
    silver,
    triage,
    vector_index,
)
from medwarden.plans.model_file import load_model, run_verified
from medwarden.plans.safety_model import DRUG, FACT, PATIENT, SAFETY_MODEL
from medwarden.session import checkpoint_root
from medwarden.sources import files, fixtures, tables

Query = Callable[[SparkSession, str], DataFrame]

# fact column -> report columns it is made from, where the names differ
_FACT_SOURCES = {
    "ae_soc_class": ["ae_term"],
    "onset_days": ["ae_onset_date", "drug_start_date"],
    "ae_classification_score": [],
}
_REPORT_TYPES = {f.name: f.dataType for f in schemas.AE_REPORTS.fields}
FACT_COLUMNS = [
    "case_id", "patient_id", "drug_name", "drug_dose", "drug_route", "drug_start_date",
    "ae_term", "ae_soc_class", "ae_classification_score", "ae_severity", "ae_seriousness",
    "ae_outcome", "ae_onset_date", "onset_days", "reporter_type", "report_date", "country",
    "manufacturer",
]


def fact(spark: SparkSession, d: str, *needed: str) -> DataFrame:
    """The fact with the needed columns, joining only the driver tables those come from."""
    wanted = list(needed) or FACT_COLUMNS
    sources = list(dict.fromkeys(s for c in wanted for s in _FACT_SOURCES.get(c, [c])))
    reports = fixtures.ae_reports(spark, d, sources or ["case_id"])
    absent = [c for c in fixtures.FACT_INPUT if c not in reports.columns]
    reports = reports.select(
        "*", *[F.lit(None).cast(_REPORT_TYPES[c]).alias(c) for c in absent]
    )
    classified = enrichment.classify_events(reports, fixtures.FIXTURE_LABELS)
    return silver.fact_adverse_event(classified).select(*wanted)


def reports(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return fixtures.ae_reports(spark, d, list(columns) or None)


def patients(spark: SparkSession, d: str) -> DataFrame:
    return silver.dim_patient(reports(spark, d, *silver.PATIENT_COLUMNS))


def drugs(spark: SparkSession, d: str) -> DataFrame:
    return silver.dim_drug(reports(spark, d, *silver.DRUG_COLUMNS))


def narratives(spark: SparkSession, d: str) -> DataFrame:
    return tables.as_narratives(fixtures.ae_narratives(spark, d))


def rendered(spark: SparkSession, d: str) -> DataFrame:
    """Narratives rendered from the reports, which have fields to extract."""
    text = enrichment.render_narrative(reports(spark, d))
    return text.select(
        "case_id",
        "narrative_text",
        F.lit("INITIAL").alias("narrative_type"),
        F.col("created_at").alias("generated_at"),
        "report_date",
    )


def fact_narrative(spark: SparkSession, d: str) -> DataFrame:
    enriched = enrichment.enrich_narratives(
        rendered(spark, d).drop("report_date"), lexicon=rules.TONE
    )
    return silver.fact_narrative(enriched)


def call_facts(spark: SparkSession, d: str) -> DataFrame:
    return silver.fact_ae_calls(fixtures.call_extractions(spark, d))


def compliance(spark: SparkSession, d: str) -> DataFrame:
    return silver.fact_agent_compliance(fixtures.call_intelligence_records(spark, d))


def queue(spark: SparkSession, d: str) -> DataFrame:
    return triage.triage_queue(call_facts(spark, d), compliance(spark, d), rules.TRIAGE_DAY)


def events(spark: SparkSession, d: str) -> DataFrame:
    return tables.as_function_events(fixtures.function_events(spark, d))


def model_frames(spark: SparkSession, d: str, *needed: str) -> dict[str, DataFrame]:
    return {FACT: fact(spark, d, *needed), PATIENT: patients(spark, d), DRUG: drugs(spark, d)}


def lexicons(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    return (
        spark.createDataFrame(
            rules.TERM_PHRASES, "phrase string, preferred_term string, soc_class string"
        ),
        spark.createDataFrame(rules.DRUG_PHRASES, "phrase string, drug_name string"),
    )


# --- sources ------------------------------------------------------------------------------


def _known_files(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    listing = fixtures.file_listing(spark, d).drop("page_id")
    return listing, listing.filter(F.col("file_path").contains("/en/"))


def load_ae_reports(spark, d):
    return tables.as_ae_reports(reports(spark, d))


def ingest_json_batches(spark, d):
    return tables.ingest_json_batches(fixtures.json_batches(spark, d), "payload")


def rejected_batches(spark, d):
    bad = tables.rejected_batches(fixtures.json_batches(spark, d), "payload")
    return bad.select("case_id", "reason")


def catalog_increment(spark, d):
    listing, known = _known_files(spark, d)
    return files.catalog_increment(listing, known).select(
        "file_path", "file_name", "file_size_bytes", "received_at"
    )


# --- bronze -------------------------------------------------------------------------------


def classify_terms(spark, d):
    terms = fixtures.table(spark, d, "part").select(F.col("p_name").alias("ae_term"))
    scored = enrichment.classify_terms(terms.distinct(), "ae_term", fixtures.FIXTURE_LABELS)
    return scored.select(
        "ae_term", F.array_join("ae_classification.labels", ",").alias("labels")
    )


def class_distribution(spark, d):
    rows = reports(spark, d, "ae_term")
    return enrichment.class_distribution(
        enrichment.classify_events(rows, fixtures.FIXTURE_LABELS)
    )


def classify_events(spark, d):
    rows = enrichment.classify_events(reports(spark, d), fixtures.FIXTURE_LABELS)
    first = F.get(F.col("ae_classification.labels"), F.lit(0))
    return rows.withColumn("label", first).drop("ae_classification")


def extract_fields(spark, d):
    rows = enrichment.extract_fields(rendered(spark, d))
    return rows.select("case_id", "report_date", "extracted.response.*")


def sentiment(spark, d):
    rows = enrichment.sentiment(narratives(spark, d), lexicon=rules.TONE)
    return rows.select("case_id", F.round("narrative_sentiment", 6).alias("narrative_sentiment"))


def enrich_narratives(spark, d):
    rows = enrichment.enrich_narratives(rendered(spark, d), lexicon=rules.TONE)
    return rows.select(
        "case_id",
        "narrative_type",
        "generated_at",
        F.col("extracted.response.primary_drug").alias("drug"),
        F.col("extracted.response.adverse_event").alias("ae"),
        F.round("narrative_sentiment", 6).alias("narrative_sentiment"),
    )


def _transcript_rows(transcripts: DataFrame) -> DataFrame:
    result = "transcription_result."
    element = transcripts.schema["transcription_result"].dataType["segments"].dataType.elementType
    segment = lambda s: F.concat_ws("|", *[s[name].cast("string") for name in element.names])
    return transcripts.select(
        "file_path",
        "file_name",
        "received_at",
        F.col(result + "text").alias("text"),
        F.size(result + "segments").alias("n_segments"),
        F.array_join(F.transform(result + "segments", segment), "\n").alias("segments"),
    )


def assemble_transcripts(spark, d):
    return _transcript_rows(calls.assemble_transcripts(fixtures.call_turns(spark, d)))


def assemble_video_transcripts(spark, d):
    turns = fixtures.call_turns(spark, d, videos=True)
    return _transcript_rows(calls.assemble_transcripts(turns, speaker=None))


def transcribe_increment(spark, d):
    turns = fixtures.call_turns(spark, d)
    catalog = turns.select("file_path", "received_at").distinct()
    # Calls with a system turn count as transcribed already.
    done = turns.filter("speaker_label = 'system'").select("file_path").distinct()
    return _transcript_rows(calls.transcribe_increment(catalog, done, turns))


def _intelligence_rows(turns: DataFrame) -> DataFrame:
    rows = calls.call_intelligence(turns, rules.CALL_RULES)
    return rows.select(
        "file_name",
        F.col("audio_intelligence_json.*"),
    ).withColumn("ae_acoustic_signals", F.size("ae_acoustic_signals"))


def call_intelligence(spark, d):
    return _intelligence_rows(fixtures.call_turns(spark, d))


def video_intelligence(spark, d):
    turns = fixtures.call_turns(spark, d, videos=True)
    return _intelligence_rows(turns.withColumn("speaker_label", F.lit(None).cast("string")))


def _extraction_rows(spark: SparkSession, turns: DataFrame) -> DataFrame:
    terms, drug_names = lexicons(spark)
    rows = calls.extract_adverse_events(turns, terms, drug_names, rules.EXTRACTION_RULES)
    record = "ae_extraction_json."
    event = F.get(F.col(record + "adverse_events"), F.lit(0))
    names = F.transform(record + "adverse_events", lambda e: e["meddra_preferred_term"])
    return rows.select(
        "file_name",
        F.col(record + "ae_detected").alias("ae_detected"),
        F.col(record + "icsr_completeness").alias("icsr_completeness"),
        F.array_join(names, ",").alias("terms"),
        F.array_join(F.transform(record + "adverse_events", lambda e: e["ae_description_verbatim"]), "|").alias("verbatims"),
        F.array_join(F.transform(record + "adverse_events", lambda e: e["meddra_soc_class"]), ",").alias("classes"),
        event["ae_description_verbatim"].alias("first_verbatim"),
        event["meddra_soc_class"].alias("first_class"),
        F.array_join(event["seriousness_criteria"], ",").alias("seriousness"),
        event["outcome"].alias("outcome"),
        event["causality_who_umc"].alias("causality"),
        F.col(record + "suspect_drug.drug_name").alias("drug_name"),
        F.col(record + "suspect_drug.drug_dose").alias("drug_dose"),
        F.col(record + "suspect_drug.drug_route").alias("drug_route"),
        F.col(record + "patient.age").alias("age"),
        F.col(record + "patient.sex").alias("sex"),
        F.col(record + "patient.identifier").alias("identifier"),
        F.col(record + "product_quality_complaint").alias("product_quality_complaint"),
        F.col(record + "off_label_use_mentioned").alias("off_label_use_mentioned"),
        F.col(record + "reporting_deadline").alias("reporting_deadline"),
        F.col(record + "narrative_summary").alias("narrative_summary"),
    )


def extract_adverse_events(spark, d):
    return _extraction_rows(spark, fixtures.call_turns(spark, d))


def extract_adverse_events_video(spark, d):
    return _extraction_rows(spark, fixtures.call_turns(spark, d, videos=True))


def icsr_completeness(spark, d):
    record = F.col("ae_extraction_json")
    level = calls.icsr_completeness(
        record["adverse_events"], record["suspect_drug"], record["patient"]
    )
    rows = fixtures.call_extractions(spark, d).filter(record.isNotNull())
    return rows.groupBy("file_name", level.alias("icsr_completeness")).agg(
        F.count(F.lit(1)).alias("records")
    )


def reporting_deadline(spark, d):
    record = F.col("ae_extraction_json")
    found = record["adverse_events"]
    first = F.get(found, F.lit(0))["seriousness_criteria"]
    kind = calls.reporting_deadline(first, F.size(found) > 0)
    rows = fixtures.call_extractions(spark, d).filter(record.isNotNull())
    return rows.groupBy("file_name", kind.alias("reporting_deadline")).agg(
        F.count(F.lit(1)).alias("records")
    )


def _violations(rows: DataFrame, spec: calls.RecordSpec) -> DataFrame:
    found = calls.validate_records(rows, spec)
    return found.select("file_name", F.array_join("violations", ";").alias("violations")).filter(
        "violations <> ''"
    )


def validate_records(spark, d):
    return _violations(fixtures.call_intelligence_records(spark, d), calls.INTELLIGENCE_SPEC)


def validate_extractions(spark, d):
    return _violations(fixtures.call_extractions(spark, d), calls.EXTRACTION_SPEC)


def apply_model(spark, d):
    def letters(rows: pd.DataFrame) -> list[int]:
        return [sum(ch == "e" for ch in text) for text in rows["text"]]

    turns = fixtures.call_turns(spark, d).select("file_name", "turn", "text")
    applied = enrichment.apply_model(turns, letters, ["text"], T.LongType())
    return applied.select("file_name", "turn", "response", "status", "error_message")


def render_narrative(spark, d):
    return rendered(spark, d).select("case_id", "report_date", "narrative_text")


def pending_narratives(spark, d):
    cases = reports(spark, d, "case_id")
    return enrichment.pending_narratives(reports(spark, d), fixtures.ae_narratives(spark, d), cases=cases)


# --- gold ---------------------------------------------------------------------------------


def _view_summary(view: DataFrame) -> DataFrame:
    return view.groupBy("drug_name", "patient_sex", "indication").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("onset_days").alias("onset_total"),
        F.sum("patient_age").alias("age_total"),
    )


_VIEW_FACT = ["case_id", "patient_id", "drug_name", "drug_dose", "drug_route", "onset_days",
              "ae_term", "report_date"]


def analytics_view(spark, d):
    view = gold.analytics_view(
        fact(spark, d, *_VIEW_FACT), patients(spark, d), drugs(spark, d)
    )
    return _view_summary(view)


def analytics_view_dedup(spark, d):
    view = gold.analytics_view_dedup(
        fact(spark, d, *_VIEW_FACT), patients(spark, d), drugs(spark, d)
    )
    return _view_summary(view)


def cases_by_drug(spark, d):
    keys = ["patient_id", "drug_name", "drug_dose", "drug_route"]
    return gold.cases_by_drug_from_star(
        fact(spark, d, *keys), patients(spark, d), drugs(spark, d)
    )


def _measure_query(measure: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        frames = model_frames(
            spark, d, "case_id", "patient_id", "drug_name", "ae_outcome", "ae_severity",
            "ae_seriousness", "onset_days",
        )
        rows = SAFETY_MODEL.query(frames, [measure], ["drug_name"])
        return rows.withColumn(measure, F.round(measure, 6)) if _is_ratio(measure) else rows

    return run


def _is_ratio(measure: str) -> bool:
    return measure in ("fatal_rate", "avg_onset_days", "median_onset_days", "avg_patient_age")


def metric_query(spark, d):
    """Measures of two tables, dimensions of all three, filters and order."""
    frames = model_frames(
        spark, d, "case_id", "patient_id", "drug_name", "drug_dose", "drug_route", "ae_outcome"
    )
    rows = SAFETY_MODEL.query(
        frames,
        ["total_cases", "fatal_cases", "patient_count", "avg_patient_age"],
        ["patient_sex", "indication"],
        filters=[("drug_route", lambda c: c != "SMALL")],
        order_by=["-total_cases"],
    )
    return rows.withColumn("avg_patient_age", F.round("avg_patient_age", 6))


def metric_query_total(spark, d):
    frames = model_frames(spark, d, "case_id", "patient_id", "ae_seriousness")
    rows = SAFETY_MODEL.query(frames, ["total_cases", "serious_cases", "avg_patient_age"])
    return rows.withColumn("avg_patient_age", F.round("avg_patient_age", 6))


def metric_query_top(spark, d):
    frames = model_frames(spark, d, "case_id", "report_date", "ae_severity", "country")
    return SAFETY_MODEL.query(
        frames,
        ["severe_cases", "total_cases"],
        ["report_month"],
        filters=[("country", lambda c: c.isin("NATION_1", "NATION_2", "NATION_3"))],
        order_by=["-severe_cases"],
        limit=12,
    )


def _file_model():
    return load_model(os.path.join(os.path.dirname(__file__), "safety_model.yaml"))


def verified(name: str, *columns: str) -> Query:
    """A verified query of the model file, with the columns of the fact that it reads."""
    return lambda spark, d: run_verified(_file_model(), {FACT: fact(spark, d, *columns)}, name)


def metric_query_of_file(spark, d):
    """``metric_query`` with a rate, by the model that the file holds."""
    frames = model_frames(
        spark, d, "case_id", "patient_id", "drug_name", "drug_dose", "drug_route", "ae_outcome"
    )
    rows = _file_model().query(
        frames,
        ["total_cases", "fatal_cases", "fatal_rate", "patient_count", "avg_patient_age"],
        ["patient_sex", "indication"],
        filters=[("drug_route", lambda c: c != "SMALL")],
        order_by=["-total_cases"],
    )
    return rows.withColumns({c: F.round(c, 6) for c in ("fatal_rate", "avg_patient_age")})


def check_relationship(spark, d):
    frames = {PATIENT: patients(spark, d), DRUG: drugs(spark, d)}
    return SAFETY_MODEL.check_relationship(frames, "drug_events").unionByName(
        SAFETY_MODEL.check_relationship(frames, "patient_events")
    )


def flag_baseline(spark, d):
    rates = signals.relative_rates(fact(spark, d, "drug_name", "ae_soc_class"))
    return signals.flag_baseline(rates, 1.1)


def unified_sources(spark, d):
    pairs = fact(spark, d, "drug_name", "ae_soc_class")
    return signals.unified_sources(signals.unified_signal_counts(pairs, call_facts(spark, d)))


def unified_prr_mapped(spark, d):
    mapping = spark.createDataFrame(
        [("bolt", "fastener"), ("rod", "fastener")], "source_class string, unified_class string"
    )
    pairs = fact(spark, d, "drug_name", "ae_soc_class")
    return signals.unified_prr(pairs, call_facts(spark, d), soc_map=mapping, threshold=1.05)


# --- search -------------------------------------------------------------------------------


def _corpus(spark: SparkSession, d: str) -> DataFrame:
    return search.search_corpus(
        narratives(spark, d),
        fact(spark, d, "case_id", "drug_name", "ae_soc_class", "ae_term", "report_date"),
        reports(spark, d, "case_id"),
    )


def search_corpus(spark, d):
    return _corpus(spark, d).groupBy("case_id", "drug_name", "ae_soc_class").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.length("narrative_text")).alias("text_length")
    )


def keyword_search(spark, d, limit=20):
    return search.keyword_search(
        narratives(spark, d), rules.KEYWORDS, cols=["case_id"], limit=limit
    )


def keyword_search_filtered(spark, d):
    return search.keyword_search(
        _corpus(spark, d),
        rules.KEYWORDS,
        filters={"ae_soc_class": "gear"},
        cols=["case_id", "drug_name"],
        limit=20,
        tie_break=["case_id", "drug_name"],
    )


def _query_vector(spark: SparkSession, d: str):
    vectors = fixtures.table(spark, d, "embeddings")
    return vectors.filter("vec_id = 0").select("embedding").scalar()


def vector_search(spark, d, k=20):
    return search.vector_search(
        fixtures.narrative_vectors(spark, d), _query_vector(spark, d), k=k
    )


def hybrid_search(spark, d):
    hits = keyword_search(spark, d, limit=200), vector_search(spark, d, k=200)
    return search.hybrid_search(*hits, k=20, depth=200)


def search_batch(spark, d):
    asked = spark.createDataFrame(rules.QUERIES, "query_id int, query string")
    return search.search_batch(narratives(spark, d), asked, k=10)


def search_batch_filtered(spark, d):
    asked = spark.createDataFrame(rules.QUERIES, "query_id int, query string")
    gear = {"ae_soc_class": "gear"}
    return search.search_batch(_corpus(spark, d), asked, k=10, filters=gear, cols=["drug_name"])


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share; a temporary one where no shared one is named."""
    return f"{checkpoint_root(spark, tempfile.gettempdir())}/{name}-{uuid.uuid4().hex}"


def search_index_batch(spark, d):
    root = _folder(spark, "search-index")
    search_index.write_segment(narratives(spark, d), root)
    asked = spark.createDataFrame(rules.QUERIES, "query_id int, query string")
    return search_index.search_index(spark, root, asked, k=10)


def search_index_fresh(spark, d):
    """An index whose rows of a third of the cases were outdated and have been replaced."""
    root, corpus = _folder(spark, "search-index"), _corpus(spark, d)
    late = F.pmod(F.xxhash64("case_id"), F.lit(3)) == 0
    outdated = corpus.withColumns(
        {
            "drug_name": F.when(~late, F.col("drug_name")),
            "narrative_text": F.when(late, F.concat(F.lit("the token "), "narrative_text")).otherwise(
                F.col("narrative_text")
            ),
        }
    )
    cols = ["drug_name", "ae_soc_class"]
    search_index.write_segment(outdated, root, 0, cols=cols)
    search_index.write_segment(corpus.filter(late), root, 1, cols=cols)
    asked = spark.createDataFrame(rules.QUERIES, "query_id int, query string")
    gear = {"ae_soc_class": "gear"}
    return search_index.search_index(spark, root, asked, k=10, filters=gear, cols=["drug_name"])


def _vector_index(spark, d):
    """The root of a new index of all vectors, and the queries: every vector whose id 20 divides."""
    root = _folder(spark, "vector-index")
    vector_index.build_vector_index(fixtures.narrative_vectors(spark, d), root)
    asked = fixtures.table(spark, d, "embeddings").filter("vec_id % 20 = 0")
    return root, asked.select(F.col("vec_id").alias("query_id"), "embedding")


def vector_index_exact(spark, d):
    root, asked = _vector_index(spark, d)
    return vector_index.search_vector_index(spark, root, asked, k=10)


def vector_index_recall(spark, d):
    """Whether probing finds at least 0.9 of what the exact search finds."""
    root, asked = _vector_index(spark, d)
    exact = vector_index.search_vector_index(spark, root, asked, k=10)
    probed = vector_index.search_vector_index(spark, root, asked, k=10, probes=rules.PROBES)
    keys = ["query_id", "case_id"]
    both = exact.select(*keys).join(probed.select(*keys, F.lit(1).alias("hit")), keys, "left")
    return both.agg(
        F.countDistinct("query_id").alias("queries"),
        F.count(F.lit(1)).alias("neighbours"),
        (10 * F.count("hit") >= 9 * F.count(F.lit(1))).alias("reached"),
    )


def search_narratives(spark, d):
    return search.search_narratives(fact_narrative(spark, d), rules.SUBSTRING, 20).withColumn(
        "narrative_sentiment", F.round("narrative_sentiment", 6)
    )


def narrative_overview(spark, d):
    return search.narrative_overview(fact_narrative(spark, d)).withColumn(
        "sentiment_score", F.round("sentiment_score", 6)
    )


def _hits(spark: SparkSession, d: str) -> DataFrame:
    transcripts = calls.assemble_transcripts(fixtures.call_turns(spark, d))
    return search.search_transcripts(transcripts, rules.TRANSCRIPT_SUBSTRING, 20)


def search_transcripts(spark, d):
    return _hits(spark, d).drop("transcript_preview")


def linked_events(spark, d):
    return search.linked_events(_hits(spark, d).select("file_name"), call_facts(spark, d))


def transcript_preview(spark, d):
    text = fixtures.table(spark, d, "documents")
    return text.select("doc_id", shorten(F.col("text")).alias("preview"))


# --- governance and quality ---------------------------------------------------------------


def _masked(role: str) -> Query:
    return lambda spark, d: governance.apply_policies(patients(spark, d), role)


def mask_patient_id(spark, d):
    return governance.mask_patient_id(patients(spark, d), governance.ENGINEER)


def mask_dob(spark, d):
    return governance.mask_dob(patients(spark, d), governance.ANALYST)


def mask_null(spark, d):
    return governance.mask_null(patients(spark, d), governance.ENGINEER)


def classify_columns(spark, d):
    rows = patients(spark, d).withColumns(
        {"language": F.lit("en"), "note": F.when(F.col("patient_age") % 10 == 0, "")}
    )
    return governance.classify_columns(rows)


_DQ = [
    (quality.NULL_COUNT, "ae_term"),
    (quality.NULL_COUNT, "ae_onset_date"),
    (quality.ROW_COUNT, None),
    (quality.FRESHNESS, "report_date"),
]


def dq_report(spark, d):
    rows = fact(spark, d, "ae_term", "ae_onset_date", "report_date")
    return quality.dq_report(rows, _DQ, rules.QUALITY_TIME)


def row_counts(spark, d):
    return quality.row_counts(
        {
            "DIM_PATIENT": patients(spark, d),
            "DIM_DRUG": drugs(spark, d),
            "FACT_ADVERSE_EVENT": fact(spark, d, "case_id"),
            "FACT_AE_CALLS": call_facts(spark, d),
            "FACT_AGENT_COMPLIANCE": compliance(spark, d),
        }
    )


def completeness(spark, d):
    rows = fact_narrative(spark, d)
    return quality.completeness(
        rows, {"extraction": "extracted_drug", "sentiment": "narrative_sentiment"}
    )


def null_outputs(spark, d):
    return quality.null_outputs(
        {
            "CALL_AE_EXTRACTIONS": (fixtures.call_extractions(spark, d), "ae_extraction_json"),
            "CALL_AUDIO_INTELLIGENCE": (
                fixtures.call_intelligence_records(spark, d),
                "audio_intelligence_json",
            ),
        }
    )


def detection_summary(spark, d):
    terms, drug_names = lexicons(spark)
    videos = calls.extract_adverse_events(
        fixtures.call_turns(spark, d, videos=True), terms, drug_names, rules.EXTRACTION_RULES
    )
    return quality.detection_summary(
        {"CALL_CENTER": fixtures.call_extractions(spark, d), "HCP_VIDEO": videos}
    )


def preview(spark, d):
    record = "ae_extraction_json."
    return quality.preview(
        fixtures.call_extractions(spark, d),
        {
            "file_name": "file_name",
            "ae_detected": record + "ae_detected",
            "icsr_status": record + "icsr_completeness",
            "drug_name": record + "suspect_drug.drug_name",
            "deadline": record + "reporting_deadline",
        },
        {"narrative_preview": (record + "narrative_summary", 150)},
    )


def preview_texts(spark, d):
    return quality.preview(
        narratives(spark, d),
        {"case_id": "case_id"},
        {"preview": ("narrative_text", 200)},
        order_by=["case_id"],
        limit=5,
    )


def _of_fact(operator: Callable[[DataFrame], DataFrame], *columns: str) -> Query:
    return lambda spark, d: operator(fact(spark, d, *columns))


def _of_calls(operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, d: operator(compliance(spark, d))


def _unified(operator) -> Query:
    return lambda spark, d: operator(
        fact(spark, d, "drug_name", "ae_soc_class"), call_facts(spark, d)
    )


QUERIES: dict[str, Query] = {
    # sources
    "load_ae_reports": load_ae_reports,
    "load_narratives": narratives,
    "ingest_json_batches": ingest_json_batches,
    "rejected_batches": rejected_batches,
    "catalog_increment": catalog_increment,
    "load_function_events": events,
    # bronze
    "classify_terms": classify_terms,
    "class_distribution": class_distribution,
    "extract_fields": extract_fields,
    "sentiment": sentiment,
    "enrich_narratives": enrich_narratives,
    "classify_events": classify_events,
    "assemble_transcripts": assemble_transcripts,
    "assemble_video_transcripts": assemble_video_transcripts,
    "transcribe_increment": transcribe_increment,
    "call_intelligence": call_intelligence,
    "video_intelligence": video_intelligence,
    "extract_adverse_events": extract_adverse_events,
    "extract_adverse_events_video": extract_adverse_events_video,
    "icsr_completeness": icsr_completeness,
    "reporting_deadline": reporting_deadline,
    "validate_records": validate_records,
    "validate_extractions": validate_extractions,
    "apply_model": apply_model,
    "render_narrative": render_narrative,
    "pending_narratives": pending_narratives,
    # silver
    "dim_patient": patients,
    "dim_drug": drugs,
    "fact_adverse_event": _of_fact(lambda f: f),
    "fact_narrative": lambda s, d: fact_narrative(s, d).withColumn(
        "narrative_sentiment", F.round("narrative_sentiment", 6)
    ),
    "fact_ae_calls": call_facts,
    "fact_agent_compliance": compliance,
    # gold
    "analytics_view": analytics_view,
    "analytics_view_dedup": analytics_view_dedup,
    "cases_by_drug": cases_by_drug,
    "metric_query": metric_query,
    "metric_query_total": metric_query_total,
    "metric_query_top": metric_query_top,
    "metric_query_of_file": metric_query_of_file,
    "verified_top_drugs": verified("top_drugs", "drug_name", "case_id"),
    "verified_monthly_severe_trend": verified("monthly_severe_trend", "report_date", "ae_severity"),
    "verified_fatal_rate_by_drug": verified("fatal_rate_by_drug", "drug_name", "ae_outcome"),
    "verified_soc_distribution": verified("soc_distribution", "ae_soc_class"),
    "verified_onset_by_drug": verified("onset_by_drug", "drug_name", "onset_days"),
    **{f"metric_{m.name}": _measure_query(m.name) for m in SAFETY_MODEL.measures},
    "check_relationship": check_relationship,
    "top_drugs": _of_fact(gold.top_drugs, "drug_name", "case_id"),
    "monthly_severe_trend": _of_fact(gold.monthly_severe_trend, "report_date", "ae_severity"),
    "fatal_rate_by_drug": _of_fact(gold.fatal_rate_by_drug, "drug_name", "ae_outcome"),
    "soc_distribution": _of_fact(gold.soc_distribution, "ae_soc_class"),
    "onset_by_drug": _of_fact(gold.onset_by_drug, "drug_name", "onset_days"),
    "signal_relative_rate": _of_fact(
        signals.signal_relative_rate, "drug_name", "ae_soc_class"
    ),
    "signal_prr": _of_fact(signals.signal_prr, "drug_name", "ae_soc_class"),
    "signal_prr_terms": _of_fact(
        lambda f: signals.signal_prr(f, event="ae_term", threshold=1.2, inclusive=False),
        "drug_name",
        "ae_term",
    ),
    "flag_baseline": flag_baseline,
    "unified_signal_counts": _unified(signals.unified_signal_counts),
    "unified_prr": _unified(signals.unified_prr),
    "unified_prr_mapped": unified_prr_mapped,
    "unified_sources": unified_sources,
    "triage_queue": queue,
    "triage_sorted": lambda s, d: triage.triage_sorted(queue(s, d)),
    # search
    "search_corpus": search_corpus,
    "keyword_search": keyword_search,
    "keyword_search_filtered": keyword_search_filtered,
    "vector_search": vector_search,
    "vector_index_exact": vector_index_exact,
    "vector_index_recall": vector_index_recall,
    "hybrid_search": hybrid_search,
    "search_batch": search_batch,
    "search_batch_filtered": search_batch_filtered,
    "search_index": search_index_batch,
    "search_index_fresh": search_index_fresh,
    "search_narratives": search_narratives,
    "narrative_overview": narrative_overview,
    "search_transcripts": search_transcripts,
    "linked_events": linked_events,
    "transcript_preview": transcript_preview,
    # dashboards
    "safety_headline": _of_fact(
        dashboards.safety_headline, "case_id", "drug_name", "ae_severity", "ae_outcome"
    ),
    "top_drugs_by_reports": _of_fact(dashboards.top_drugs_by_reports, "drug_name"),
    "cases_by_soc": _of_fact(dashboards.cases_by_soc, "ae_soc_class"),
    "drug_severity": _of_fact(dashboards.drug_severity, "drug_name", "ae_severity"),
    "drug_severity_matrix": _of_fact(
        lambda f: dashboards.drug_severity_matrix(f, ["Mild", "Moderate", "Unseen"]),
        "drug_name",
        "ae_severity",
    ),
    "monthly_trend": _of_fact(dashboards.monthly_trend, "report_date", "ae_severity"),
    "outcome_distribution": _of_fact(dashboards.outcome_distribution, "ae_outcome"),
    "fatal_percent_by_drug": _of_fact(
        dashboards.fatal_percent_by_drug, "drug_name", "ae_outcome"
    ),
    "onset_by_soc": _of_fact(dashboards.onset_by_soc, "ae_soc_class", "onset_days"),
    "severe_by_country": _of_fact(dashboards.severe_by_country, "country", "ae_severity"),
    "monthly_volume": _of_fact(dashboards.monthly_volume, "report_date"),
    "quick_top_drugs": _of_fact(gold.top_drugs, "drug_name", "case_id"),
    "calls_headline": lambda s, d: dashboards.calls_headline(
        compliance(s, d), call_facts(s, d), queue(s, d)
    ),
    "score_buckets": _of_calls(dashboards.score_buckets),
    "flagged_calls": _of_calls(dashboards.flagged_calls),
    "escalations": _of_calls(dashboards.escalations),
    "urgent_count": lambda s, d: triage.urgent_count(queue(s, d)),
    # governance and quality
    "mask_patient_id": mask_patient_id,
    "mask_dob": mask_dob,
    "mask_null": mask_null,
    "apply_policies_officer": _masked(governance.OFFICER),
    "apply_policies_engineer": _masked(governance.ENGINEER),
    "apply_policies_analyst": _masked(governance.ANALYST),
    "classify_columns": classify_columns,
    "dq_null_count": _of_fact(
        lambda f: quality.dq_null_count(f, "ae_onset_date"), "ae_onset_date"
    ),
    "dq_row_count": _of_fact(quality.dq_row_count, "case_id"),
    "dq_freshness": _of_fact(
        lambda f: quality.dq_freshness(f, "report_date", rules.QUALITY_TIME), "report_date"
    ),
    "dq_report": dq_report,
    "row_counts": row_counts,
    "completeness": completeness,
    "null_outputs": null_outputs,
    "distribution": lambda s, d: quality.distribution(reports(s, d, "country"), "country"),
    "detection_summary": detection_summary,
    "preview": preview,
    "preview_texts": preview_texts,
    # health
    "function_health": lambda s, d: health.function_health(events(s, d)),
    "error_alerts": lambda s, d: health.error_alerts(
        health.function_health(events(s, d)), rules.HEALTH_TIME
    ),
    "rolling_error_alerts": lambda s, d: health.rolling_error_alerts(
        events(s, d), rules.HEALTH_TIME
    ),
}
