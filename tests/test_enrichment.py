import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from medwarden.operators import enrichment as e


def labels(spark, terms, lexicon=e.TOXICITY_WORDS):
    df = spark.createDataFrame([(t,) for t in terms], "ae_term string")
    return [
        r.ae_classification.labels
        for r in e.classify_terms(df, "ae_term", lexicon).collect()
    ]


def test_labels_by_hits_then_lexicon_order(spark):
    lexicon = {"A": ["x", "y"], "B": ["y", "z"], "C": ["q"]}
    assert labels(spark, ["y", "y z", "q y", "none", ""], lexicon) == [
        ["A", "B"], ["B", "A"], ["A", "B", "C"], [], [],
    ]


def test_default_labels(spark):
    assert labels(spark, ["Drug-induced liver injury", "QT prolongation"]) == [
        ["Hepatotoxicity"], ["Cardiotoxicity"],
    ]


def test_model_sees_each_term_once(spark, tmp_path):
    log = str(tmp_path / "calls")

    def model(frame):
        with open(log, "a") as out:
            out.write("".join(t + "\n" for t in frame["ae_term"]))
        return [{"labels": [t.upper()]} for t in frame["ae_term"]]

    df = spark.createDataFrame([("a",)] * 50 + [("b",)], "ae_term string").coalesce(1)
    got = e.classify_events(df, model=model)
    counts = {r.label: r["count"] for r in got.groupBy(
        F.col("ae_classification.labels")[0].alias("label")).count().collect()}
    assert counts == {"A": 50, "B": 1}
    assert sorted(open(log).read().split()) == ["a", "b"]


def test_failing_rows_are_reported_not_lost(spark):
    def model(frame):
        if "bad" in set(frame["text"]):
            raise ValueError("no luck")
        return [len(t) for t in frame["text"]]

    df = spark.createDataFrame([("ab",), ("bad",), ("abc",)], "text string").coalesce(1)
    got = e.apply_model(df, model, ["text"], T.LongType())
    assert {(r.text, r.response, r.status, r.error_message) for r in got.collect()} == {
        ("ab", 2, "ok", None), ("abc", 3, "ok", None), ("bad", None, "error", "no luck"),
    }
    log = e.model_events(got, "LENGTH", "stub", "text")
    assert log.filter("status = 'error'").count() == 1


def test_sentiment_bounds(spark):
    df = spark.createDataFrame(
        [("Fatal, died.",), ("recovered and stable",), ("nothing here",), (None,)], "t string"
    )
    got = [r.narrative_sentiment for r in e.sentiment(df, "t").collect()]
    assert got == [-1.0, 0.75, 0.0, None]


def test_render_and_extract_round_trip(spark):
    df = spark.createDataFrame(
        [("Female", 40, None, "DrugX", "5mg", "oral", "asthma", "Skin rash", "Severe", "Death",
          "Fatal", "2024-01-01", "2024-01-11"),
         ("Female", 40, 60.5, "DrugX", "5mg", "oral", None, "Skin rash", "Severe", "Death",
          "Fatal", "2024-01-01", "2024-01-11")],
        "patient_sex string, patient_age int, patient_weight double, drug_name string, "
        "drug_dose string, drug_route string, indication string, ae_term string, "
        "ae_severity string, ae_seriousness string, ae_outcome string, drug_start_date string, "
        "ae_onset_date string",
    )
    df = df.withColumns({c: F.to_date(c) for c in ("drug_start_date", "ae_onset_date")})
    full, broken = e.extract_fields(e.render_narrative(df)).collect()
    assert "weight unknown kg" in full.narrative_text
    got = full.extracted.response
    assert (got.primary_drug, got.adverse_event, got.onset_days) == ("DrugX", "Skin rash", "10")
    assert (got.severity_assessment, got.patient_outcome) == ("Severe", "Fatal")
    assert got.causality is None and got.concomitant_drugs is None
    assert broken.narrative_text is None and broken.extracted is None


def test_list_field_keeps_all_matches(spark):
    df = spark.createDataFrame(
        [("taken together with A1 and together with B2",)], "narrative_text string"
    )
    assert e.extract_fields(df).first().extracted.response.concomitant_drugs == "A1, B2"


def test_no_python_and_no_shuffle_in_default_enrichment(spark):
    df = spark.createDataFrame([("c", "text", None, None)],
                               "case_id string, narrative_text string, narrative_type string, "
                               "generated_at timestamp_ntz")  # fmt: skip
    plan = e.enrich_narratives(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


@pytest.mark.parametrize("limit", [1, 3])
def test_pending_narratives(spark, limit):
    reports = spark.createDataFrame(
        [(f"c{i}", "d", "t", "2024-01-01") for i in range(5)],
        "case_id string, drug_name string, ae_term string, report_date string",
    )
    done = spark.createDataFrame([("c0",), ("c2",)], "case_id string")
    got = [r.case_id for r in e.pending_narratives(reports, done, limit).collect()]
    assert got == ["c1", "c3", "c4"][:limit]


def test_pending_narratives_sort_only_the_cases_of_a_batch(spark):
    """Reports beyond the batch's last case are not sorted; ties, repeats and NULL cases stay right."""
    schema = "case_id string, drug_name string, ae_term string, report_date string"
    rows = [(c, d, "t", "2024-01-01") for c in ("c1", "c2", "c2", "c3", None) for d in ("b", "a", None)]
    reports = spark.createDataFrame(rows, schema)
    done = spark.createDataFrame([("c1",), (None,)], "case_id string")
    pending = [("c2", "a"), ("c2", "a"), ("c2", "b"), ("c2", "b"), ("c2", None), ("c2", None)]
    pending += [(c, d) for c in ("c3", None) for d in ("a", "b", None)]
    for limit in (1, 5, 8, 10, 20):
        for cases in (None, reports.select("case_id")):
            found = e.pending_narratives(reports, done, limit, cases=cases)
            assert [(r.case_id, r.drug_name) for r in found.collect()] == pending[:limit]
    assert "scalar-subquery" in found._jdf.queryExecution().optimizedPlan().toString()


def test_fields_reach_to_their_delimiter(spark):
    text = (
        "Patient received insulin glargine 0.5 mg (oral) for pain and developed Crohn's disease "
        "[type 2] (severity: Severe, seriousness: x) after 3 days. The outcome was not recovered."
    )
    row = e.extract_fields(spark.createDataFrame([(text,)], "narrative_text string")).first()
    found = row.extracted.response
    assert (found.primary_drug, found.adverse_event) == ("insulin glargine", "Crohn's disease [type 2]")
    assert (found.severity_assessment, found.patient_outcome) == ("Severe", "not recovered")
