import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from medwarden.functions.phrases import PhraseTrie, phrases_in
from medwarden.operators import calls

WORD = st.sampled_from("abc")


def found_by_slices(phrases, words):
    spans = {tuple(words[i:j]) for i in range(len(words)) for j in range(i + 1, len(words) + 1)}
    return [n for n, p in enumerate(phrases) if tuple(p) in spans]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(WORD, max_size=5), max_size=12), st.lists(st.one_of(WORD, st.none()), max_size=25))
def test_trie_finds_what_slices_find(phrases, words):
    assert PhraseTrie(phrases).find(words) == found_by_slices(phrases, words)


def test_nested_phrases_and_odd_rows(spark):
    phrases = [["b", "c"], ["a", "b", "c", "d"], ["c"], [], ["b", "c"], ["x"]]
    data = [(1, ["a", "b", "c", "e"]), (2, None), (3, []), (4, [None, "x", "b"]), (5, ["a"] * 50_000 + ["b", "c", "d"])]
    df = spark.createDataFrame(data, "i int, words array<string>")
    got = {r.i: r.found for r in df.select("i", phrases_in(F.col("words"), phrases).alias("found")).collect()}
    assert got == {1: [0, 2, 4], 2: [], 3: [], 4: [5], 5: [0, 1, 2, 4]}


@pytest.fixture
def talk(spark):
    rng = random.Random(9)
    words = ["acute", "liver", "failure", "pain", "in", "Back", "the", "zolina", "xr", "x.r"]
    turns = [
        (f"c{rng.randrange(12)}", i, " ".join(rng.choices(words, k=rng.randrange(9))) if i % 9 else None)
        for i in range(150)
    ]
    df = spark.createDataFrame(turns, "file_name string, turn int, text string").repartition(3)
    terms = [("acute liver failure", "ALF"), ("Liver failure", "LF"), ("failure", "F"), ("back-pain", "BP"), ("!", "none"),
             ("pain in the back", "BP"), ("failure", "Again")]
    drugs = [("zolina", "Zolina"), ("Zolina XR", "Zolina XR"), ("absent", "Absent")]
    return (
        df.withColumn("file_path", F.lit("in")),
        spark.createDataFrame([(*t, "S") for t in terms], "phrase string, preferred_term string, soc_class string"),
        spark.createDataFrame(drugs, "phrase string, drug_name string"),
    )


def test_trie_and_join_give_equal_records(talk, monkeypatch):
    def records():
        got = calls.extract_adverse_events(*talk, key=["file_name"]).drop("extracted_at")
        return sorted(got.collect(), key=lambda r: r.file_name)

    by_trie = records()
    monkeypatch.setattr(calls, "TRIE_PHRASES", 2)
    assert by_trie == records()
    assert any(r.ae_extraction_json.ae_detected for r in by_trie)


def test_nothing_is_shuffled_before_the_matches(talk):
    turns, *lexicons = talk
    plain = turns.sparkSession.createDataFrame(turns.toPandas(), turns.schema)
    plan = calls.extract_adverse_events(plain, *lexicons, key=["file_name"])._jdf.queryExecution().executedPlan()
    lines = plan.toString().splitlines()
    walks = [i for i, line in enumerate(lines) if "ArrowEvalPython" in line]
    assert len(walks) == 1

    def depth(line: str) -> int:
        return line.index("- ")

    below = []
    for line in lines[walks[0] + 1 :]:
        if depth(line) <= depth(lines[walks[0]]):
            break
        below.append(line)
    assert "Scan" in below[-1] and not any("Exchange" in line or "Join" in line for line in below)
    assert "posexplode" not in plan.toString()


def test_lexicon_without_words(talk):
    turns, terms, drugs = talk
    got = calls.extract_adverse_events(turns, terms.limit(0), drugs.limit(0), key=["file_name"]).collect()
    assert got and not any(r.ae_extraction_json.ae_detected for r in got)
