import random

import numpy as np
import pytest

from medwarden.operators import search, vector_index
from medwarden.operators.vector_index import build_vector_index, search_vector_index

SCHEMA = "case_id string, embedding array<float>"


def vectors(n=300, dim=16, clusters=10, spread=0.5):
    rng = np.random.default_rng(3)
    middle = rng.normal(size=(clusters, dim))
    rows = [(f"v{i:03d}", (middle[i % clusters] + spread * rng.normal(size=dim)).tolist()) for i in range(n)]
    return [*rows, ("same", rows[0][1]), ("zero", [0.0] * dim), ("none", None)]


@pytest.fixture
def index(spark, tmp_path):
    rows = vectors()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    build_vector_index(df, str(tmp_path))
    asked = [(i, rows[i][1]) for i in range(0, 300, 20)] + [(999, [0.0] * 16)]
    return df, str(tmp_path), spark.createDataFrame(asked, "query_id int, embedding array<float>")


def found(df, query_id):
    rows = [r for r in df if r.query_id == query_id]
    return [(r.case_id, r.similarity) for r in sorted(rows, key=lambda r: r["rank"])]


def test_exact_search_equals_the_scan(spark, index):
    df, root, asked = index
    got = search_vector_index(spark, root, asked, k=303).collect()
    for q in asked.collect():
        want = [tuple(r) for r in search.vector_search(df, q.embedding, k=303).collect()]
        mine = found(got, q.query_id)
        assert sorted(mine, key=str) == sorted(want, key=str)
        if q.query_id != 999:
            assert mine == want


def test_probing_reaches_the_recall(spark, index):
    _, root, asked = index
    exact = {(r.query_id, r.case_id) for r in search_vector_index(spark, root, asked, 10).collect() if r.query_id < 999}
    probed = search_vector_index(spark, root, asked, 10, probes=4).collect()
    hits = {(r.query_id, r.case_id) for r in probed}
    assert len(exact & hits) >= 0.9 * len(exact)
    assert not any(q == 999 for q, _ in hits)


def test_only_probed_lists_are_read(spark, index):
    _, root, asked = index
    plan = search_vector_index(spark, root, asked.limit(1), 5, probes=1)._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "PartitionFilters" in line and "norm" in line)
    assert "(list#" in scan and " = " in scan


@pytest.mark.parametrize("rows", [[], [("a", [1.0, 2.0])], [("z", [0.0, 0.0])], [("n", None)]])
def test_small_tables(spark, tmp_path, rows):
    build_vector_index(spark.createDataFrame(rows, SCHEMA), str(tmp_path))
    asked = spark.createDataFrame([(1, [1.0, 2.0])], "query_id int, embedding array<float>")
    for probes in (None, 1, 0.5):
        got = search_vector_index(spark, str(tmp_path), asked, 3, probes).collect()
        if probes is None:
            assert [r.case_id for r in got] == [r[0] for r in rows]
        elif rows and rows[0][0] == "a":
            assert [(r.case_id, r.similarity) for r in got] == [("a", 1.0)]


def test_training_on_a_sample_indexes_all(spark, tmp_path):
    random.seed(1)
    df = spark.createDataFrame(vectors(), SCHEMA)
    build_vector_index(df, str(tmp_path), lists=5, trained=40)
    assert spark.read.parquet(f"{tmp_path}/lists").count() == df.count()


def test_lists_and_queries_of_many_blocks(spark, tmp_path, monkeypatch):
    """Blocks that cut a list or hold several, copies of a vector and ragged queries change nothing."""
    for name, size in (("BLOCK_VECTORS", 7), ("BLOCK_QUERIES", 5), ("_ROWS", 2), ("_PAIRS", 11)):
        monkeypatch.setattr(vector_index, name, size)
    rows = vectors(60, dim=8, clusters=3)
    rows += [(f"copy{i}", rows[0][1]) for i in range(30)]
    df = spark.createDataFrame(rows, SCHEMA)
    build_vector_index(df, str(tmp_path), lists=9)
    asked = [(i, rows[i][1]) for i in range(0, 60, 5)] + [(90, [0.0] * 8), (91, [1.0] * 3), (92, None)]
    asked = spark.createDataFrame(asked, "query_id int, embedding array<float>")
    got = search_vector_index(spark, str(tmp_path), asked, k=12).collect()
    probed = search_vector_index(spark, str(tmp_path), asked.filter("query_id < 91"), k=12, probes=9).collect()
    for q in asked.collect():
        query = q.embedding if q.embedding and len(q.embedding) == 8 else [0.0] * 8
        want = [tuple(r) for r in search.vector_search(df, query, k=12).collect()]
        assert found(got, q.query_id) == want
        if q.query_id < 90:
            assert found(probed, q.query_id) == want


def test_pairs_are_not_rows(spark, index):
    """Queries and vectors meet in blocks: the plan has no join that makes a row of each pair."""
    _, root, asked = index
    for probes in (None, 4):
        plan = search_vector_index(spark, root, asked, 5, probes)._jdf.queryExecution().optimizedPlan().toString()
        assert "FlatMapCoGroupsInArrow" in plan and plan.count("Join") == 1  # that of lists and blocks
