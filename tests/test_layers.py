from checks import fixture_rules as rules
from checks.queries import lexicons, narratives, reports
from medwarden.operators import signals
from medwarden.plans.layers import Layers, build_calls, build_reports
from medwarden.sources import fixtures

SF = "/root/testdata/sf0.001"


def test_report_layers(spark, tmp_path, rows):
    layers = Layers(str(tmp_path))
    out = build_reports(
        layers, reports(spark, SF), narratives(spark, SF), fixtures.FIXTURE_LABELS
    )
    fact = layers.load(spark, "silver", "fact_adverse_event")
    assert fact.count() == 6000 and out["analytics_view"].count() >= 6000
    assert rows(out["signal_prr"]) == rows(signals.signal_prr(fact))
    assert {r.ae_soc_class for r in fact.select("ae_soc_class").distinct().collect()} == set(
        fixtures.FIXTURE_LABELS
    )
    one_month = fact.filter("report_month = date'1996-03-01'")
    plan = one_month._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(report_month" in plan
    assert out["search_corpus"].count() >= 200


def test_call_layers(spark, tmp_path):
    out = build_calls(
        Layers(str(tmp_path)),
        fixtures.call_turns(spark, SF),
        *lexicons(spark),
        rules.CALL_RULES,
        rules.EXTRACTION_RULES,
    )
    assert out["fact_agent_compliance"].count() == 20
    assert out["fact_ae_calls"].count() > 0
