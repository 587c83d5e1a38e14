import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from medwarden.sources import files, fixtures, tables


def record(case, **extra):
    base = {"case_id": case, "patient_id": "P", "drug_name": "D", "ae_term": "t",
            "report_date": "2024-01-05"}
    return base | extra


def test_conform_casts_and_adds_missing_columns(spark):
    df = spark.createDataFrame(
        [("c1", "p", "41", "d", "t", dt.date(2024, 1, 1))],
        "CASE_ID string, patient_id string, patient_age string, drug_name string, "
        "ae_term string, report_date date",
    )
    row = tables.as_ae_reports(df).first()
    assert (row.case_id, row.patient_age, row.country) == ("c1", 41, None)
    assert row.created_at is not None
    assert len(row) == 21


def test_missing_required_names_the_columns(spark, rows):
    df = spark.createDataFrame([("a", None), ("b", "x"), (None, None)], "k string, v string")
    found = rows(tables.missing_required(df, ["k", "v"]).select("k", "missing_columns"))
    assert found == [("a", ["v"]), (None, ["k", "v"])]


def test_narrative_defaults(spark):
    df = spark.createDataFrame([("c", "text")], "case_id string, narrative_text string")
    row = tables.as_narratives(df).first()
    assert row.narrative_type == "INITIAL" and row.generated_at is not None


def test_json_batches_and_rejects(spark, rows):
    good = json.dumps([record("c1", patient_age=5), record("c2", patient_weight="70.5")])
    payloads = [
        ("good", good),
        ("empty", "[]"),
        ("cut", good[: len(good) // 2]),
        ("trailing", good + " and more"),
        ("object", json.dumps(record("c3"))),
        ("scalars", "[1, 2]"),
        ("null", None),
    ]
    df = spark.createDataFrame(payloads, "name string, payload string")
    found = rows(tables.ingest_json_batches(df, "payload"), "case_id", "patient_age",
                 "patient_weight", "report_date")
    day = dt.date(2024, 1, 5)
    assert found == [("c1", 5, None, day), ("c2", None, 70.5, day)]
    reasons = dict(rows(tables.rejected_batches(df, "payload"), "name", "reason"))
    assert reasons["cut"] == "invalid json" and reasons["null"] == "missing"
    assert reasons["object"] == reasons["scalars"] == "not an array of records"
    assert set(reasons) == {"cut", "trailing", "object", "scalars", "null"}


def test_bad_value_fails_like_a_cast(spark):
    df = spark.createDataFrame([(json.dumps([record("c", patient_age="old")]),)], "p string")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        tables.ingest_json_batches(df, "p", strict=True).collect()


def test_bad_values_are_rejected_and_the_rest_goes_on(spark, rows):
    both = json.dumps([record("c1", patient_age="old", report_date="soon"), record("c2", patient_age=3)])
    df = spark.createDataFrame([("x", both)], "name string, payload string")
    assert rows(tables.ingest_json_batches(df, "payload"), "case_id", "patient_age") == [("c2", 3)]
    bad = tables.rejected_batches(df, "payload").collect()
    assert [(r.name, r.reason) for r in bad] == [("x", "does not fit: patient_age, report_date")]


def test_sinks_overwrite_append_and_count(spark, tmp_path):
    target = str(tmp_path / "t")
    tables.write_table(spark.range(5), target)
    assert tables.append_table(spark.range(7), target) == 7
    assert tables.read_table(spark, target).count() == 12
    tables.write_table(spark.range(3), target)
    assert tables.read_table(spark, target).count() == 3


def test_file_catalog_by_kind(spark, tmp_path, rows):
    for name, size in (("a.mp3", 3), ("b.mp3", 5), ("v.mp4", 7)):
        (tmp_path / name).write_bytes(b"x" * size)
    catalog = files.file_catalog(spark, str(tmp_path), "*.mp3")
    assert rows(catalog, "file_name", "file_size_bytes") == [("a.mp3", 3), ("b.mp3", 5)]
    assert "content" not in catalog.columns
    videos = files.file_catalog(spark, str(tmp_path), "*.mp4")
    assert rows(videos, "file_name") == [("v.mp4",)]


def test_catalog_increment_is_oldest_first_and_survives_null_keys(spark):
    listing = spark.createDataFrame(
        [(f"d/f{i:02d}", 1, dt.datetime(2024, 1, 1 + i % 3)) for i in range(20)],
        "file_path string, file_size_bytes bigint, received_at timestamp",
    )
    done = spark.createDataFrame([("d/f00",), (None,)], "file_path string")
    got = [r.file_name for r in files.catalog_increment(listing, done).collect()]
    assert got == ["f03", "f06", "f09", "f12", "f15", "f18", "f01", "f04", "f07", "f10"]


def test_filters_reach_the_scan(spark, tmp_path):
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    path = str(tmp_path / "r")
    rows = spark.createDataFrame([record("c")]).withColumn(
        "report_date", F.to_date("report_date")
    )
    rows.write.parquet(path)
    df = tables.load_ae_reports(spark, path).filter("drug_name = 'D'").select("case_id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(drug_name,D)" in plan and "manufacturer" not in plan


def test_reports_are_joined_once_a_chain(spark):
    sf_dir = "/root/testdata/sf0.001"
    reports = fixtures.ae_reports(spark, sf_dir)

    def joins_of_reports(plan):
        below = [plan.children().apply(i) for i in range(plan.children().size())]
        own = plan.nodeName() == "Join" and "l_orderkey" in plan.collectLeaves().toString()
        return own + sum(map(joins_of_reports, below))

    assert joins_of_reports(reports._jdf.queryExecution().optimizedPlan()) == 3
    assert reports.count() == fixtures.table(spark, sf_dir, "lineitem").count()
