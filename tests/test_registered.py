import pytest

import __spark_entry__
from checks.compare import compare, connect
from checks.oracle import ORACLE
from checks.queries import QUERIES

SF = "/root/testdata/sf0.001"
# One query per area; ``python -m checks.compare`` runs all of them.
SAMPLE = [
    "load_ae_reports", "ingest_json_batches", "rejected_batches", "catalog_increment",
    "extract_fields", "call_intelligence", "extract_adverse_events", "validate_records",
    "fact_ae_calls", "analytics_view", "cases_by_drug", "metric_query", "signal_prr",
    "unified_prr_mapped", "triage_queue", "keyword_search_filtered", "hybrid_search",
    "search_batch", "drug_severity_matrix", "apply_policies_engineer", "classify_columns",
    "dq_report", "error_alerts",
]


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_sql(spark, name):
    verdict, _, _ = compare(spark, connect(SF), name, SF)
    assert verdict.startswith("ok"), verdict


def test_entry_contract(spark):
    assert __spark_entry__.entry(spark).count() == 129
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(ORACLE) == set(QUERIES)
