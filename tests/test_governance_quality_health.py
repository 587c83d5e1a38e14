import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from medwarden.operators import governance as g
from medwarden.operators import health, quality


@pytest.fixture
def patients(spark):
    return spark.createDataFrame(
        [("PAT-1", 40, "Female", dt.date(1970, 5, 6), 70.5), (None, None, None, None, None)],
        "patient_id string, patient_age int, patient_sex string, patient_dob date, "
        "patient_weight double",
    )


def test_masks_by_role(patients, rows):
    assert rows(g.apply_policies(patients, g.OFFICER)) == rows(patients)
    digest = hashlib.sha256(b"PAT-1").hexdigest()
    assert rows(g.apply_policies(patients, g.ENGINEER)) == [
        (digest, 40, "Female", dt.date(1970, 1, 1), None), (None,) * 5,
    ]
    analyst = g.apply_policies(patients, "ANYONE_ELSE")
    assert {r.patient_id for r in analyst.collect()} == {g.REDACTED}
    assert analyst.schema["patient_weight"].dataType.typeName() == "double"
    assert g.apply_policies(patients.select("patient_age"), g.ANALYST).columns == ["patient_age"]


def test_tags(patients, rows):
    tagged = g.tag_columns(patients)
    assert rows(g.tag_references(tagged)) == [
        ("patient_age", "HIPAA_CATEGORY", "SENSITIVE"),
        ("patient_dob", "HIPAA_CATEGORY", "PHI"),
        ("patient_id", "HIPAA_CATEGORY", "PII"),
        ("patient_weight", "HIPAA_CATEGORY", "PHI"),
    ]
    assert tagged.filter("patient_age > 1").select("patient_id").schema[0].metadata["tags"]
    fact = g.tag_columns(patients.withColumnRenamed("patient_sex", "case_id"), g.FACT_TAGS)
    both = g.tag_columns(fact, {"case_id": [("HIPAA_CATEGORY", "PII")]})
    assert rows(g.tag_references(both)) == [
        ("case_id", "DATA_CLASSIFICATION", "CONFIDENTIAL"), ("case_id", "HIPAA_CATEGORY", "PII"),
    ]
    with pytest.raises(ValueError, match="not an allowed value"):
        g.tag_column(patients, "patient_id", "HIPAA_CATEGORY", "SECRET")


def test_detected_columns_get_the_strictest_tag(spark, rows):
    df = spark.createDataFrame(
        [("AB-1", dt.date(1960, 1, 2), 5)], "patient_id string, patient_dob date, n int"
    )
    assert rows(g.tag_references(g.tag_detected(df))) == [
        ("patient_dob", "HIPAA_CATEGORY", "PHI"), ("patient_id", "HIPAA_CATEGORY", "PII"),
    ]


def test_detection_by_content_and_name(spark, rows):
    df = spark.createDataFrame(
        [("AB-1", "a@b.org", "x", "", "en"), ("CD-2", "c@d.org", "y", "", "de")],
        "code string, info string, dob string, empty string, language string",
    )
    got = rows(g.classify_columns(df), "column_name", "category", "hit_rate", "name_match")
    assert got == [
        ("code", "identifier", 1.0, False),
        ("dob", "date_of_birth", 0.0, True),
        ("info", "email", 1.0, False),
    ]


def test_metrics_and_reports(spark, rows):
    df = spark.createDataFrame(
        [("a", dt.date(2024, 1, 1)), (None, dt.date(2024, 1, 2)), (None, None)],
        "k string, d date",
    )
    now = dt.datetime(2024, 1, 3)
    got = quality.dq_report(
        df, [("NULL_COUNT", "k"), ("ROW_COUNT", None), ("FRESHNESS", "d")], now
    )
    assert rows(got) == [("FRESHNESS", "d", 86400), ("NULL_COUNT", "k", 2), ("ROW_COUNT", "", 3)]
    assert quality.dq_null_count(df, "k").first()[0] == 2
    assert quality.dq_freshness(df.limit(0), "d", now).first()[0] is None
    assert rows(quality.distribution(df, "k")) == [("a", 1, 33.3), (None, 2, 66.7)]
    assert rows(quality.row_counts({"x": df, "y": df.limit(0)})) == [("x", 3), ("y", 0)]
    got = quality.completeness(df, {"k": "k"}).first()
    assert got.asDict() == {"total": 3, "has_k": 1, "missing_k": 2}
    assert rows(quality.null_outputs({"t": (df, "k")})) == [("t", 2)]
    cut = quality.preview(df, {}, {"k": ("k", 1)}, order_by=["k"], limit=1)
    assert rows(cut) == [("a",)]


def test_detection_summary_of_an_empty_source(spark, rows):
    df = spark.createDataFrame(
        [((True, "15_day_expedited"),), ((None, None),), (None,)],
        "ae_extraction_json struct<ae_detected: boolean, reporting_deadline: string>",
    )
    got = quality.detection_summary({"CALL_CENTER": df, "HCP_VIDEO": df.limit(0)})
    assert rows(got) == [("CALL_CENTER", 3, 1, 1), ("HCP_VIDEO", 0, None, None)]


def log(spark, entries):
    return spark.createDataFrame(
        entries,
        "timestamp timestamp_ntz, function_name string, model_used string, latency_ms bigint, "
        "token_count bigint, status string",
    )


def test_health_and_alerts(spark, rows):
    day = lambda h, m=0: dt.datetime(2024, 1, 1, h, m)
    events = log(
        spark,
        [(day(9, 5), "f", "m", 10, 1, "error")]
        + [(day(10, i), "f", "m", i, 2, "error" if i == 0 else "ok") for i in range(10)]
        + [(day(10, i), "g", "m", 5, None, "error" if i < 2 else "ok") for i in range(10)]
        + [(day(12), "f", "m", None, None, "error")],
    )
    hourly = health.function_health(events)
    assert rows(hourly, "hour", "function_name", "total_calls", "error_count", "total_tokens") == [
        (day(9), "f", 1, 1, 1), (day(10), "f", 10, 1, 20), (day(10), "g", 10, 2, None),
        (day(12), "f", 1, 1, None),
    ]
    # Exactly 10 % is no alert; the 9 o'clock bucket started more than an hour ago.
    assert rows(health.error_alerts(hourly, day(10, 30))) == [("m", 2, 10, 20.0)]
    rolling = health.rolling_error_alerts(events, day(10, 0))
    assert rows(rolling) == [("m", 1, 1, 100.0), ("m", 2, 2, 100.0)]


def test_health_plan_combines_before_the_shuffle(spark):
    plan = health.function_health(log(spark, []))._jdf.queryExecution().sparkPlan().toString()
    assert "partial_count" in plan
    assert F is not None
