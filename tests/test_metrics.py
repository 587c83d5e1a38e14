import pytest
from pyspark.sql import functions as F

from medwarden.plans.metrics import MetricModel
from medwarden.plans.safety_model import DRUG, FACT, PATIENT, SAFETY_MODEL


@pytest.fixture
def frames(spark):
    fact = spark.createDataFrame(
        [("c1", "p1", "d1", "5", "oral", "Fatal"), ("c1", "p1", "d1", "5", "oral", "Unknown"),
         ("c2", "p1", "d2", "5", "oral", "Unknown"), ("c3", "p2", "d1", "5", "oral", None),
         ("c4", "p9", "d3", "5", "oral", None)],
        "case_id string, patient_id string, drug_name string, drug_dose string, "
        "drug_route string, ae_outcome string",
    )
    patients = spark.createDataFrame(
        [("p1", 30, "F", "US"), ("p2", 50, "M", "UK"), ("p3", 90, "M", "UK")],
        "patient_id string, patient_age int, patient_sex string, country string",
    )
    drugs = spark.createDataFrame(
        [("d1", "5", "oral", "b", "m"), ("d1", "5", "oral", "a", "m"), ("d2", "5", "oral", "a", "m")],
        "drug_name string, drug_dose string, drug_route string, indication string, "
        "manufacturer string",
    )
    return {FACT: fact, PATIENT: patients, DRUG: drugs}


def test_joining_a_dimension_never_multiplies(frames, rows):
    got = SAFETY_MODEL.query(frames, ["total_cases", "fatal_cases", "fatal_rate"], ["indication"])
    assert rows(got) == [("a", 3, 1, 25.0), (None, 1, 0, 0.0)]


def test_patient_measures_count_patients_not_reports(frames, rows):
    got = SAFETY_MODEL.query(frames, ["avg_patient_age", "patient_count"], ["drug_name"])
    assert rows(got) == [("d1", 40.0, 2), ("d2", 30.0, 1)]
    own = SAFETY_MODEL.query(frames, ["patient_count"], ["patient_sex"])
    assert rows(own) == [("F", 1), ("M", 2)]


def test_filters_outside_the_groups(frames, rows):
    got = SAFETY_MODEL.query(
        frames, ["total_cases", "patient_count"], ["patient_sex"],
        filters=[("drug_name", lambda c: c.isin("d1", "d2"))],
    )
    assert rows(got) == [("F", 2, 1), ("M", 1, 1)]


def test_measures_of_two_tables_without_groups(frames):
    got = SAFETY_MODEL.query(frames, ["total_cases", "avg_patient_age"]).first()
    assert got.total_cases == 4 and got.avg_patient_age == pytest.approx(170 / 3)


def test_order_limit_and_unknown_names(frames):
    got = SAFETY_MODEL.query(
        frames, ["total_cases"], ["drug_name"], order_by=["-total_cases"], limit=2
    )
    assert [r.drug_name for r in got.collect()] == ["d1", "d2"]
    with pytest.raises(KeyError):
        SAFETY_MODEL.query(frames, ["nope"])


def test_relationship_check(frames, rows):
    assert rows(SAFETY_MODEL.check_relationship(frames, "drug_events")) == [("drug_events", 1, 2)]
    assert rows(SAFETY_MODEL.check_relationship(frames, "patient_events")) == [
        ("patient_events", 0, 0)
    ]


def test_model_from_configuration(frames, rows):
    model = MetricModel.from_mapping(
        {
            "tables": [
                {
                    "name": FACT,
                    "dimensions": [{"name": "drug", "expr": "upper(drug_name)"}],
                    "measures": [{"name": "cases", "expr": "COUNT(DISTINCT CASE_ID)"}],
                },
                {"name": PATIENT, "dimensions": [{"name": "sex", "expr": "patient_sex"}]},
            ],
            "relationships": [
                {
                    "name": "r",
                    "left_table": FACT,
                    "right_table": PATIENT,
                    "on": [{"left_column": "patient_id", "right_column": "patient_id"}],
                }
            ],
        }
    )
    got = model.query(frames, ["cases"], ["drug", "sex"])
    assert rows(got) == [("D1", "F", 1), ("D1", "M", 1), ("D2", "F", 1), ("D3", None, 1)]


def test_grouping_by_an_expression(spark, rows):
    fact = spark.createDataFrame(
        [("c1", "2024-01-05"), ("c2", "2024-01-09"), ("c3", "2024-02-01")],
        "case_id string, report_date string",
    ).withColumn("report_date", F.to_date("report_date"))
    got = SAFETY_MODEL.query({FACT: fact}, ["total_cases"], ["report_month"])
    assert [r[1] for r in rows(got)] == [2, 1]
