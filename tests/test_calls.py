import datetime as dt

import pytest
from pyspark.sql import functions as F

from medwarden import schemas
from medwarden.operators import calls, silver

TURNS = [
    ("c1", 1, "caller", "I took Zolina 5 mg oral and got a bad rash, I am scared, 54 years old"),
    ("c1", 0, "agent", "Hello, my name is Ann, what symptoms did you experience?"),
    ("c1", 2, "agent", "Thank you. She was admitted to hospital?"),
    ("c2", 0, "agent", "Whatever, call again"),
    ("c2", 1, "caller", "what is the dose"),
]


@pytest.fixture
def turns(spark):
    df = spark.createDataFrame(TURNS, "id string, turn int, speaker_label string, text string")
    return df.select(
        F.concat(F.lit("in/"), "id").alias("file_path"),
        F.col("id").alias("file_name"),
        F.lit(dt.datetime(2024, 1, 1)).alias("received_at"),
        "turn",
        "speaker_label",
        "text",
    )


@pytest.fixture
def lexicons(spark):
    terms = spark.createDataFrame(
        [("rash", "Rash", "Skin"), ("bad rash", "Rash severe", "Skin")],
        "phrase string, preferred_term string, soc_class string",
    )
    drugs = spark.createDataFrame([("zolina", "Zolina")], "phrase string, drug_name string")
    return terms, drugs


def test_transcript_order_and_round_trip(turns, rows):
    done = calls.assemble_transcripts(turns)
    one = done.filter("file_name = 'c1'").first().transcription_result
    assert one.text.startswith("agent: Hello") and one.text.count("\n") == 2
    assert [s.turn for s in one.segments] == [0, 1, 2]
    back = calls.explode_segments(done)
    assert rows(back, "file_name", "turn", "text") == rows(turns, "file_name", "turn", "text")
    plain = calls.assemble_transcripts(turns, speaker=None)
    assert "agent:" not in plain.first().transcription_result.text
    assert set(rows(calls.explode_segments(plain), "speaker_label")) == {(None,)}


def test_intelligence_rules(turns):
    got = {r.file_name: r.audio_intelligence_json for r in calls.call_intelligence(turns).collect()}
    one, two = got["c1"], got["c2"]
    assert one.caller_emotional_state == "distressed" and one.caller_urgency_level == "urgent"
    assert one.call_type_inferred == "adverse_event_report" and one.escalation_recommended
    assert one.agent_compliance_score == 100.0 and one.agent_tone_professional
    assert one.ae_acoustic_signals == []
    assert two.call_type_inferred == "standard_drug_info" and not two.agent_tone_professional
    assert two.escalation_reason == "agent tone"
    assert one.call_duration_category == "brief_under_2min"


def test_extraction_record(turns, lexicons):
    got = calls.extract_adverse_events(turns, *lexicons)
    record = {r.file_name: r.ae_extraction_json for r in got.collect()}
    one = record["c1"]
    assert one.ae_detected and one.icsr_completeness == "complete"
    assert [a.meddra_preferred_term for a in one.adverse_events] == ["Rash", "Rash severe"]
    assert one.adverse_events[0].ae_description_verbatim == TURNS[0][3]
    assert one.adverse_events[0].seriousness_criteria == ["hospitalization"]
    assert one.reporting_deadline == "15_day_expedited"
    assert (one.suspect_drug.drug_name, one.suspect_drug.drug_dose) == ("Zolina", "5 mg")
    assert one.suspect_drug.drug_route == "oral" and one.patient.age == "54"
    two = record["c2"]
    assert not two.ae_detected and two.adverse_events == []
    assert (two.icsr_completeness, two.reporting_deadline) == ("no_ae", "no_report_required")
    assert got.select("ae_extraction_json").schema[0].dataType.fieldNames() == (
        schemas.AE_EXTRACTION.fieldNames()
    )


def test_phrases_of_any_length_and_doses(spark):
    said = ["Acute myocardial, INFARCTION after 0.5 mg of insulin-glargine.", "Then 12,5 mcg; 3 gx"]
    turns = spark.createDataFrame(
        [("c", "in/c", i, "user", t, None) for i, t in enumerate(said)],
        "file_name string, file_path string, turn int, role string, text string, received_at timestamp",
    )
    terms = spark.createDataFrame(
        [("acute myocardial infarction", "AMI", "Cardiac"), ("myocardial infarction after 0 5 mg", "X", "Y")],
        "phrase string, preferred_term string, soc_class string",
    )
    drugs = spark.createDataFrame([("Insulin Glargine", "Glargine")], "phrase string, drug_name string")
    one = calls.extract_adverse_events(turns, terms, drugs, key=["file_name"]).first().ae_extraction_json
    assert [e.meddra_preferred_term for e in one.adverse_events] == ["AMI", "X"]
    assert one.adverse_events[0].ae_description_verbatim == said[0]
    assert (one.suspect_drug.drug_name, one.suspect_drug.drug_dose) == ("Glargine", "0.5 mg")
    late = calls.extract_adverse_events(turns.filter("turn = 1"), terms, drugs, key=["file_name"])
    assert late.first().ae_extraction_json.suspect_drug.drug_dose == "12,5 mcg"


def test_produced_records_are_valid(turns, lexicons):
    checked = calls.validate_records(calls.call_intelligence(turns), calls.INTELLIGENCE_SPEC)
    assert {tuple(r.violations) for r in checked.collect()} == {()}
    records = calls.extract_adverse_events(turns, *lexicons)
    checked = calls.validate_records(records, calls.EXTRACTION_SPEC)
    assert {tuple(r.violations) for r in checked.collect()} == {()}


def test_violations_are_named(spark):
    bad = {"ae_detected": None, "icsr_completeness": "maybe", "suspect_drug": {},
           "adverse_events": [{"seriousness_criteria": ["odd"], "outcome": None,
                               "meddra_preferred_term": "x", "ae_description_verbatim": "y"}],
           "reporting_deadline": "15_day_expedited"}
    schema = schemas._struct(file_name="string", ae_extraction_json=schemas.AE_EXTRACTION)
    df = spark.createDataFrame([("f", bad), ("g", None)], schema)
    got = {r.file_name: r.violations for r in
           calls.validate_records(df, calls.EXTRACTION_SPEC).collect()}
    assert got["g"] == ["no record"]
    assert set(got["f"]) == {
        "missing ae_detected",
        "missing adverse_events[].outcome",
        "not allowed icsr_completeness",
        "not allowed adverse_events[].seriousness_criteria[]",
    }


def test_model_records(turns):
    def model(frame):
        return [{"ae_detected": "rash" in t} for t in frame["text"]]

    got = calls.extract_adverse_events(turns, model=model)
    assert {r.file_name: r.ae_extraction_json.ae_detected for r in got.collect()} == {
        "c1": True, "c2": False,
    }


def test_transcribe_increment(turns, spark, rows):
    catalog = turns.select("file_path", "received_at").distinct()
    done = spark.createDataFrame([("in/c1",)], "file_path string")
    assert rows(calls.transcribe_increment(catalog, done, turns), "file_name") == [("c2",)]


def extraction(detected, events):
    if detected is None:
        return None
    return {"ae_detected": detected, "adverse_events": events, "suspect_drug": {"drug_name": "D"},
            "reporting_deadline": "90_day_periodic"}


def test_fact_ae_calls_guards(spark, rows):
    event = {"meddra_preferred_term": "T", "seriousness_criteria": ["death", None, "none"]}
    data = [
        ("null", extraction(None, None)),
        ("not detected", extraction(False, [event])),
        ("no events", extraction(True, [])),
        ("null events", extraction(True, None)),
        ("unknown", extraction("x", [event]) | {"ae_detected": None}),
        ("two", extraction(True, [event, event])),
    ]
    schema = schemas._struct(
        file_name="string", ae_extraction_json=schemas.AE_EXTRACTION
    )
    df = spark.createDataFrame(data, schema).withColumn("extracted_at", F.current_timestamp())
    got = silver.fact_ae_calls(df, "HCP_VIDEO")
    assert rows(got, "source_call_id", "data_source", "ae_seriousness") == [
        ("two", "HCP_VIDEO", "death, , none")
    ] * 2
    assert len(got.columns) == 15


def test_fact_agent_compliance_keeps_null_scores(spark, rows):
    schema = schemas._struct(
        file_name="string", audio_intelligence_json=schemas.CALL_INTELLIGENCE
    )
    df = spark.createDataFrame(
        [("a", {"agent_compliance_score": None}), ("b", None)], schema
    ).withColumn("analyzed_at", F.current_timestamp())
    assert rows(silver.fact_agent_compliance(df), "call_id", "compliance_score") == [("a", None)]


def test_fact_narrative_number_parsing(spark, rows):
    schema = schemas._struct(
        case_id="string", narrative_text="string", narrative_type="string",
        extracted=schemas.NARRATIVE_EXTRACT, narrative_sentiment="double",
        generated_at="timestamp_ntz",
    )
    data = [(v, "t", "INITIAL", {"response": {"onset_days": v}}, 0.0, None)
            for v in ("12", "12.6", "n/a")]
    got = silver.fact_narrative(spark.createDataFrame(data, schema))
    assert rows(got, "case_id", "extracted_onset_days") == [
        ("12", 12), ("12.6", 13), ("n/a", None),
    ]


def test_a_record_is_made_once_for_all_rules(spark):
    """The record's expression stands once in the plan, not once for each rule and again in a filter."""
    record = F.expr(
        "named_struct('ae_detected', id > 1, 'icsr_completeness', concat('only', 'once', id), 'adverse_events', "
        "array(named_struct('ae_description_verbatim', 'a', 'meddra_preferred_term', 'b', 'seriousness_criteria', "
        "array('none'), 'outcome', 'fatal', 'causality_who_umc', 'certain')), 'suspect_drug', "
        "named_struct('drug_name', 'd'), 'reporting_deadline', 'no_report_required')"
    )
    rows = spark.range(3).select("id", F.when(F.col("id") < 2, record).alias("ae_extraction_json"))
    found = calls.validate_records(rows, calls.EXTRACTION_SPEC).filter(F.size("violations") > 0)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("onlyonce") + plan.count("concat(only") == 1
    assert found.columns == ["id", "ae_extraction_json", "violations"]
    assert {r.id: r.violations for r in found.collect()} == {
        0: ["not allowed icsr_completeness"], 1: ["not allowed icsr_completeness"], 2: ["no record"]
    }
