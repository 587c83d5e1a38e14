import math
import random
import re

import pytest
from pyspark.sql import functions as F

from medwarden.functions.text import query_terms, shorten, tokens
from medwarden.operators import search

WORDS = ["rash", "liver", "pain", "mild", "severe", "the", "café", "x1"]


def corpus(spark, n=80):
    rng = random.Random(5)
    data = [
        (f"c{i:03d}", " ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 30))),
         rng.choice(["A", "B"]))
        for i in range(n)
    ]
    data.append(("c999", "!!!", "A"))
    return data, spark.createDataFrame(data, "case_id string, narrative_text string, drug string")


def bm25(data, query):
    docs = {k: re.findall(r"[^\W_]+", t.lower()) for k, t, _ in data}
    n, mean = len(docs), sum(map(len, docs.values())) / len(docs)
    scores = {}
    for key, words in docs.items():
        total = 0.0
        for term in set(re.findall(r"[^\W_]+", query.lower())):
            df, tf = sum(term in w for w in docs.values()), words.count(term)
            idf = math.log(1 + (n - df + 0.5) / (df + 0.5))
            total += idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(words) / mean))
        if total > 0:
            scores[key] = total
    return sorted(scores.items(), key=lambda kv: (-round(kv[1], 6), kv[0]))


def test_keyword_search_is_bm25(spark):
    data, df = corpus(spark)
    for query in ("liver pain", "CAFÉ rash rash", "nothing"):
        got = search.keyword_search(df, query, limit=10, cols=["case_id"]).collect()
        want = bm25(data, query)[:10]
        assert [(r.case_id, r.score) for r in got] == [
            (k, pytest.approx(s, abs=1e-6)) for k, s in want
        ]
    hits = search.keyword_search(df, "liver", {"drug": "A"}, ["case_id", "drug"], 100)
    names = {k for k, _, d in data if d == "A"}
    assert {r.case_id for r in hits.collect()} == {k for k, _ in bm25(data, "liver")} & names


def test_batch_search_equals_single_searches(spark):
    data, df = corpus(spark)
    asked = [(1, "liver pain"), (2, "severe x1 the"), (3, "nothing"), (4, None)]
    queries = spark.createDataFrame(asked, "query_id int, query string")
    got = search.search_batch(df, queries, 7).orderBy("query_id", "rank").collect()
    for number, query in asked[:3]:
        mine = [(r.case_id, r.score) for r in got if r.query_id == number]
        assert mine == [(k, pytest.approx(s, abs=1e-6)) for k, s in bm25(data, query)[:7]]
    assert {r.query_id for r in got} == {1, 2}


def test_vector_search(spark):
    vectors = [("a", [1.0, 0.0]), ("b", [1.0, 1.0]), ("c", [-1.0, 0.0]), ("z", [0.0, 0.0])]
    df = spark.createDataFrame(vectors, "case_id string, embedding array<float>")
    got = [(r.case_id, r.similarity) for r in search.vector_search(df, [2.0, 0.0], 4).collect()]
    assert got == [("a", 1.0), ("b", 0.707107), ("c", -1.0), ("z", None)]


def test_hybrid_ranks_items_of_both_lists_first(spark):
    kw = spark.createDataFrame([("a", 3.0), ("b", 2.0)], "case_id string, score double")
    vec = spark.createDataFrame([("b", 0.9), ("c", 0.8)], "case_id string, similarity double")
    got = [(r.case_id, r.score) for r in search.hybrid_search(kw, vec).collect()]
    assert got == [
        ("b", round(1 / 62 + 1 / 61, 6)), ("a", round(1 / 61, 6)), ("c", round(1 / 62, 6)),
    ]


def test_corpus_repeats_per_report_and_keeps_unmatched(spark, rows):
    narratives = spark.createDataFrame(
        [("c1", "t1"), ("c2", "t2")], "case_id string, narrative_text string"
    )
    fact = spark.createDataFrame(
        [("c1", f"d{i}", "s", "t", "2024") for i in range(300)],
        "case_id string, drug_name string, ae_soc_class string, ae_term string, "
        "report_date string",
    )
    got = search.search_corpus(narratives, fact)
    assert got.count() == 301
    assert rows(got.filter("case_id = 'c2'")) == [("c2", "t2", None, None)]


def test_substring_search_and_wildcards(spark):
    data = [("1", "50% better", None, None, None, 0.0), ("2", "500 better", "Rash", "D", None, 0.0)]
    df = spark.createDataFrame(
        data,
        "case_id string, narrative_text string, extracted_ae string, extracted_drug string, "
        "extracted_causality string, narrative_sentiment double",
    )
    ids = lambda *a, **k: [r.case_id for r in search.search_narratives(df, *a, **k).collect()]
    assert ids("50%") == ["1"]
    assert ids("50%", wildcards=True) == ["1", "2"]
    assert ids("RASH") == ["2"] and ids("better", 1) == ["1"] and ids("it's") == []


def test_text_helpers(spark):
    df = spark.createDataFrame([("A b-c  d",), ("",), (None,), ("x" * 2001,)], "t string")
    got = df.select(tokens(F.col("t")).alias("w"), shorten(F.col("t")).alias("s")).collect()
    assert got[0].w == ["a", "b", "c", "d"] and got[1].w == [] and got[2].w is None
    assert got[2].s == "" and got[3].s == "x" * 2000 + "..." and got[0].s == "A b-c  d"
    assert query_terms(spark, "İlaç b, B") == spark.sql("SELECT 'İlaç b, B' AS t").select(
        F.array_sort(F.array_distinct(tokens(F.col("t"))))
    ).first()[0]


def test_ranking_uses_unrounded_scores(spark):
    near = [("a", [1.0, 0.0009]), ("b", [1.0, 0.0])]
    vectors = spark.createDataFrame(near, "case_id string, embedding array<double>")
    assert [r.case_id for r in search.vector_search(vectors, [1.0, 0.0]).collect()] == ["b", "a"]
    # A word in every text still makes every text a hit.
    n = 4000
    corpus = spark.range(n).selectExpr("cast(id as string) as case_id", "'same word' as narrative_text")
    assert search.keyword_search(corpus, "word", limit=n).count() == n


def test_batch_search_on_repeated_rows_with_a_filter(spark):
    data = [("1", "rash and fever", "x"), ("1", "rash and fever", "y"), ("2", "fever", "x"),
            ("3", "none", "x"), ("4", "rash", None)]
    corpus = spark.createDataFrame(data, "case_id string, narrative_text string, drug_name string")
    asked = spark.createDataFrame([(1, "rash"), (2, "fever rash")], "query_id int, query string")
    got = search.search_batch(corpus, asked, 5, filters={"drug_name": "x"}, cols=["drug_name"]).collect()
    for query_id, query in [(1, "rash"), (2, "fever rash")]:
        alone = search.keyword_search(
            corpus, query, {"drug_name": "x"}, ["case_id", "drug_name"], tie_break=["case_id", "drug_name"]
        ).collect()
        batch = [(r.case_id, r.drug_name, r.score) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == query_id]
        assert batch == [tuple(r) for r in alone]


def test_fusion_sees_beyond_the_result(spark):
    words = spark.createDataFrame([(f"w{i}", 9.0 - i) for i in range(4)] + [("both", 1.0)], "case_id string, score double")
    near = spark.createDataFrame([(f"v{i}", 9.0 - i) for i in range(4)] + [("both", 1.0)], "case_id string, similarity double")
    assert search.hybrid_search(words, near, k=1).first().case_id == "both"
    with pytest.raises(ValueError):
        search.hybrid_search(words, near, k=5, depth=4)


def test_linked_events_keep_calls_without_events(spark, rows):
    hits = spark.createDataFrame([("a",), ("b",)], "file_name string")
    events = spark.createDataFrame(
        [("a", "D", "T", "S", "none", "fatal", "possible", "90_day_periodic")],
        "source_call_id string, drug_name string, ae_preferred_term string, "
        "ae_soc_class string, ae_seriousness string, ae_outcome string, causality string, "
        "reporting_deadline string",
    )
    got = search.linked_events(hits, events)
    assert rows(got, "file_name", "drug_name") == [("a", "D"), ("b", None)]


def test_corpus_takes_hot_cases_from_a_narrow_table(spark):
    """Where the cases of the reports are given, the sketch of hot keys does not read the fact."""
    fact = spark.createDataFrame(
        [("c1", f"d{i}", "s", "t", "r") for i in range(50)] + [("c2", "d", "s", "t", "r")],
        "case_id string, drug_name string, ae_soc_class string, ae_term string, report_date string",
    )
    texts = spark.createDataFrame([("c1", "one"), ("c2", "two"), ("c3", None)], "case_id string, narrative_text string")
    cases = spark.createDataFrame([("c1",)] * 50 + [("c2",)], "case_id string")
    plain, narrow = search.search_corpus(texts, fact), search.search_corpus(texts, fact, cases)
    assert sorted(map(str, narrow.collect())) == sorted(map(str, plain.collect()))
    assert narrow.count() == 52
