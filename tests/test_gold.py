import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from medwarden.operators import dashboards, gold, signals, silver, triage
from medwarden.operators.skew import hot_keys, salted_join


def skewed(spark, n=2000, seed=7):
    rng = random.Random(seed)
    data = [
        (i, None if i % 50 == 0 else "hot" if i % 3 == 0 else f"k{rng.randrange(40)}", i % 7)
        for i in range(n)
    ]
    return spark.createDataFrame(data, "id int, k string, v int")


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("hot_side", ["left", "right"])
def test_salted_join_gives_the_rows_of_a_plain_join(spark, rows, how, hot_side):
    big = skewed(spark)
    other = spark.createDataFrame(
        [("hot", 1), ("hot", 2), ("k1", 3), ("k2", 4), ("unmatched", 5), (None, 6), (None, 7)],
        "k string, w int",
    )
    left, right = (big, other) if hot_side == "left" else (other, big)
    assert rows(hot_keys(big, ["k"])) != []
    got = salted_join(left, right, ["k"], how, hot_side)
    want = left.join(right, "k", how).select(*got.columns)
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))


def test_hot_rows_are_spread(spark):
    big, other = skewed(spark), spark.createDataFrame([("hot", 1)], "k string, w int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = salted_join(big, other, ["k"], "inner").groupBy(F.spark_partition_id()).count()
        sizes = [r["count"] for r in got.collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(sizes) == 4 and max(sizes) < 0.5 * sum(sizes)


def facts(spark, data):
    return spark.createDataFrame(data, "drug_name string, ae_soc_class string")


def random_facts(spark, n=600):
    rng = random.Random(3)
    return [
        (f"d{rng.randrange(6)}", None if rng.random() < 0.1 else f"e{rng.randrange(5)}")
        for _ in range(n)
    ]


def test_prr_counts_add_up_and_follow_the_definition(spark):
    data = random_facts(spark)
    got = signals.signal_prr(facts(spark, data), digits=9).collect()
    pairs = Counter(data)
    assert {(r.drug_name, r.ae_soc_class) for r in got} == {p for p in pairs if p[1] is not None}
    for r in got:
        a = pairs[(r.drug_name, r.ae_soc_class)]
        b = sum(1 for d, e in data if d == r.drug_name and e != r.ae_soc_class)
        c = sum(1 for d, e in data if d != r.drug_name and e == r.ae_soc_class)
        assert (r.a, r.b, r.c, r.d) == (a, b, c, len(data) - a - b - c)
        assert r.prr == pytest.approx((a / (a + b)) / (c / (c + r.d)), abs=1e-8)


def test_event_of_one_drug_only_has_no_ratio(spark):
    data = [("x", "only")] * 4 + [("x", "e"), ("y", "e"), ("y", "f")]
    got = {(r.drug_name, r.ae_soc_class): r for r in
           signals.signal_prr(facts(spark, data)).collect()}
    assert got[("x", "only")].prr is None and not got[("x", "only")].is_signal
    one = signals.signal_prr(facts(spark, [("x", "e")])).first()
    assert one.prr is None and not one.is_signal


def test_threshold_and_minimum_cases(spark):
    # x: 2 of 4 with e; others: 1 of 4 -> ratio exactly 2
    data = [("x", "e")] * 2 + [("x", "f")] * 2 + [("y", "e")] + [("y", "f")] * 3

    def flag(**options):
        got = signals.signal_prr(facts(spark, data), **options)
        return got.filter("drug_name = 'x' and ae_soc_class = 'e'").first().is_signal

    assert flag(min_cases=2) and not flag(min_cases=2, inclusive=False) and not flag()


def test_relative_rate_against_joined_totals(spark):
    data = random_facts(spark)
    fact = facts(spark, data)
    pairs, total = Counter(data), len(data)
    drug, event = Counter(d for d, _ in data), Counter(e for _, e in data)
    got = {(r.drug_name, r.ae_soc_class): r for r in signals.relative_rates(fact).collect()}
    for key, n in pairs.items():
        if key[1] is None:
            assert key not in got
            continue
        want = (n / drug[key[0]]) / (event[key[1]] / total)
        assert got[key].de_count == n and got[key].prr == pytest.approx(want, abs=0.00501)
    top = signals.signal_relative_rate(fact, min_cases=3, top=4).collect()
    assert len(top) == 4 and [r.prr for r in top] == sorted((r.prr for r in top), reverse=True)


def test_pair_totals_share_one_shuffle(spark, tmp_path):
    path = str(tmp_path / "f")
    facts(spark, random_facts(spark)).write.parquet(path)
    query = signals.signal_prr(spark.read.parquet(path))
    query.collect()
    plan = query._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ReusedExchange") >= 3
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_unified_sources_and_mapping(spark, rows):
    fact = facts(spark, [("x", "Hepatotoxicity"), ("y", "Other")])
    calls = facts(spark, [("x", "liver disorder"), ("x", None)])
    mapping = spark.createDataFrame(
        [("liver disorder", "Hepatotoxicity")], "source_class string, unified_class string"
    )
    got = {(r.drug_name, r.ae_soc_class): (r.a, r.sources) for r in
           signals.unified_prr(fact, calls, mapping).collect()}
    assert got == {("x", "Hepatotoxicity"): (2, "CALL_CENTER, FAERS"), ("y", "Other"): (1, "FAERS")}
    counts = signals.unified_signal_counts(fact, calls)
    assert rows(signals.unified_sources(counts)) == [("CALL_CENTER", 2, 1), ("FAERS", 2, 2)]


def star(spark):
    fact = spark.createDataFrame(
        [("c1", "p1", "d", "5mg", "oral"), ("c2", "p1", "d", "5mg", "oral"),
         ("c3", "p9", "z", "5mg", "oral"), ("c4", "p2", "d", None, "oral")],
        "case_id string, patient_id string, drug_name string, drug_dose string, "
        "drug_route string",
    )
    patients = spark.createDataFrame(
        [("p1", 40, "F"), ("p1", 41, "F"), ("p2", 50, "M")],
        "patient_id string, patient_age int, patient_sex string",
    )
    drugs = spark.createDataFrame(
        [("d", "5mg", "oral", "a", "m1"), ("d", "5mg", "oral", "b", "m1"),
         ("d", "5mg", "oral", None, "m2")],
        "drug_name string, drug_dose string, drug_route string, indication string, "
        "manufacturer string",
    )
    return fact, patients, drugs


def test_view_fans_out_and_dedup_does_not(spark, rows):
    fact, patients, drugs = star(spark)
    view = gold.analytics_view(fact, patients, drugs)
    assert Counter(r.case_id for r in view.collect()) == {"c1": 6, "c2": 6, "c3": 1, "c4": 1}
    single = gold.analytics_view_dedup(fact, patients, drugs)
    assert rows(single, "case_id", "patient_age", "indication") == [
        ("c1", 40, None), ("c2", 40, None), ("c3", None, None), ("c4", 50, None),
    ]
    want = rows(gold.cases_by_drug(view))
    assert rows(gold.cases_by_drug_from_star(fact, patients, drugs)) == want


def call(spark, deadline, day, name="c"):
    return (name, "D", "T", "S", "none", "unknown", deadline, "text", "40", "F", day)


CALL_SCHEMA = (
    "source_call_id string, drug_name string, ae_preferred_term string, ae_soc_class string, "
    "ae_seriousness string, ae_outcome string, reporting_deadline string, "
    "case_narrative string, patient_age string, patient_sex string, report_date timestamp"
)


def test_triage_boundaries_and_order(spark):
    today = dt.date(2024, 6, 30)

    def at(days):
        return dt.datetime(2024, 6, 30, 15) - dt.timedelta(days=days)

    calls = spark.createDataFrame(
        [
            call(spark, "15_day_expedited", at(12), "due in 3"),
            call(spark, "15_day_expedited", at(11), "due in 4"),
            call(spark, "15_day_expedited", at(90), "overdue"),
            call(spark, "90_day_periodic", at(89), "periodic"),
            call(spark, "no_report_required", at(1), "none"),
            call(spark, None, at(1), "unknown"),
        ],
        CALL_SCHEMA,
    )
    scores = spark.createDataFrame(
        [("overdue", 55.0, "calm", "routine")],
        "call_id string, compliance_score double, caller_state string, urgency_level string",
    )
    queue = triage.triage_queue(calls, scores, today)
    got = [
        (r.source_call_id, r.priority_flag, r.submission_deadline)
        for r in triage.triage_sorted(queue).collect()
    ]
    assert got == [
        ("overdue", "URGENT", dt.date(2024, 4, 16)),
        ("due in 3", "URGENT", dt.date(2024, 7, 3)),
        ("due in 4", "ACTION_REQUIRED", dt.date(2024, 7, 4)),
        ("periodic", "STANDARD", dt.date(2024, 7, 1)),
        ("none", "STANDARD", None),
        ("unknown", "STANDARD", None),
    ]
    assert triage.urgent_count(queue).first().urgent_cases == 2
    assert queue.filter("compliance_score = 55.0").count() == 1


def test_score_buckets_and_flags(spark, rows):
    scores = [None, 50.0, 50.5, 69.9, 70.0, 70.5, 90.0, 100.0]
    comp = spark.createDataFrame(
        [(f"c{i}", s, True, "calm", "routine", "unknown", dt.datetime(2024, 1, 1))
         for i, s in enumerate(scores)],
        "call_id string, compliance_score double, tone_professional boolean, "
        "caller_state string, urgency_level string, call_type string, analyzed_at timestamp",
    )
    assert rows(dashboards.score_buckets(comp)) == [
        ("0-50", 1), ("51-70", 3), ("71-90", 2), ("91-100", 2),
    ]
    flagged = [r.compliance_score for r in dashboards.flagged_calls(comp).collect()]
    assert flagged == [50.0, 50.5, 69.9]


def test_headline_of_nothing_and_floor(spark):
    schema = "case_id string, drug_name string, ae_severity string, ae_outcome string"
    empty = dashboards.safety_headline(spark.createDataFrame([], schema)).first()
    assert tuple(empty) == (0, 0, 0, 0, 0)
    data = [("c1", "d1", "SEVERE", "Fatal"), ("c1", "d2", "Severe", "fatal"),
            ("c2", "d1", "Mild", None), ("c3", "d1", None, "Fatal")]
    got = dashboards.safety_headline(spark.createDataFrame(data, schema)).first()
    assert tuple(got) == (3, 2, 2, 2, 66)


def test_ties_break_on_the_key(spark):
    data = [(d, c) for d in "cab" for c in ("x", "y")]
    fact = spark.createDataFrame(data, "drug_name string, case_id string")
    assert [r.drug_name for r in gold.top_drugs(fact, 2).collect()] == ["a", "b"]
    assert [r.drug_name for r in dashboards.top_drugs_by_reports(fact, 2).collect()] == ["a", "b"]


def test_severity_matrix_rows_sum_to_the_reports(spark, rows):
    fact = spark.createDataFrame(
        [("a", "Mild"), ("a", "mild"), ("a", "Life-threatening"), ("b", "SEVERE"), ("c", None)],
        "drug_name string, ae_severity string",
    )
    got = dashboards.drug_severity_matrix(fact)
    assert got.columns == ["drug_name", "Mild", "Moderate", "Severe", "other"]
    assert rows(got) == [("a", 2, 0, 0, 1), ("b", 0, 0, 1, 0), ("c", 0, 0, 0, 1)]


def test_events_of_calls_are_built_once(spark, rows):
    event = "named_struct('meddra_preferred_term', term, 'meddra_soc_class', term, " \
        "'seriousness_criteria', array('none'), 'outcome', term, 'causality_who_umc', term)"
    record = f"""named_struct('ae_detected', true, 'suspect_drug', named_struct('drug_name', term,
        'drug_dose', term, 'drug_route', term), 'patient', named_struct('age', term, 'sex', term),
        'reporting_deadline', term, 'narrative_summary', term, 'adverse_events', case n
        when 0 then null when 1 then slice(array({event}), 1, 0) when 2 then array({event}, null)
        else array({event}) end)"""
    data = spark.createDataFrame([(i, f"t{i}") for i in range(4)], "n int, term string")
    calls = data.selectExpr("concat('f', n) as file_name", f"{record} as ae_extraction_json",
                            "current_timestamp() as extracted_at", "n as event", "n as at")
    facts = silver.fact_ae_calls(calls)
    got = rows(facts, "source_call_id", "ae_preferred_term")
    assert got == [("f2", "t2"), ("f2", None), ("f3", "t3")]
    plan = facts._jdf.queryExecution().optimizedPlan().toString()
    assert "size(" not in plan
