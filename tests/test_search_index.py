import random

import pytest
from pyspark.sql import functions as F

from medwarden.operators import search, search_index
from medwarden.session import dropped_shuffles

WORDS = ["rash", "liver", "pain", "mild", "severe", "the", "the", "café", "x1"]
SCHEMA = "case_id string, narrative_text string, drug string"


def corpus_rows(seed, n=150, cases=60):
    rng = random.Random(seed)
    rows = [
        (f"c{rng.randrange(cases):03d}", " ".join(rng.choices(WORDS, k=rng.randrange(1, 25))), rng.choice(["A", "B", None]))
        for _ in range(n)
    ]
    return [*rows, *rows[:9], ("c000", None, "A"), ("c001", "", "A"), ("c002", "!!!", "B"), (None, "rash", "A")]


@pytest.fixture
def asked(spark):
    queries = [(1, "liver pain"), (2, "SEVERE x1 the the"), (3, "nothing"), (4, None), (5, "the"), (6, "")]
    return spark.createDataFrame(queries, "query_id int, query string")


@pytest.fixture(autouse=True)
def small_blocks(monkeypatch):
    monkeypatch.setattr(search_index, "BLOCK_BITS", 3)


def answers(df):
    rows = df.select("query_id", "rank", "case_id", "drug", "score").collect()
    return sorted((tuple(r) for r in rows), key=lambda r: r[:2])


def same_as_corpus(spark, root, rows, asked, **how):
    corpus = spark.createDataFrame(rows, SCHEMA)
    want = answers(search.search_batch(corpus, asked, cols=["drug"], **how))
    got = answers(search_index.search_index(spark, root, asked, cols=["drug"], **how))
    assert got == want
    assert want


HOWS = [{"k": 1}, {"k": 7}, {"k": 500}, {"k": 3, "filters": {"drug": "A"}}, {"k": 200, "filters": {"drug": "B"}}]


@pytest.mark.parametrize("how", HOWS)
def test_index_answers_as_the_corpus(spark, tmp_path, asked, how):
    rows = corpus_rows(1)
    search_index.write_segment(spark.createDataFrame(rows, SCHEMA).repartition(3), str(tmp_path), cols=["drug"])
    same_as_corpus(spark, str(tmp_path), rows, asked, **how)


def test_segments_replace_and_compact(spark, tmp_path, asked):
    root, rows = str(tmp_path), corpus_rows(2)
    frame = lambda x: spark.createDataFrame(x, SCHEMA)
    search_index.write_segment(frame(rows), root, 0, cols=["drug"])
    for number in (1, 2):
        changed = [r for r in corpus_rows(number + 10, 40, 20) if r[0] is not None]
        keys = {r[0] for r in changed}
        gone = {f"c{k:03d}" for k in range(number, 60, 7)}
        rows = [r for r in rows if r[0] not in keys | gone] + changed
        replaced = spark.createDataFrame([(k,) for k in sorted(keys | gone)], "case_id string")
        for _ in range(2):  # a retried batch counts once
            search_index.write_segment(frame(changed), root, number, cols=["drug"], replaced=replaced)
        same_as_corpus(spark, root, rows, asked, k=6)
        same_as_corpus(spark, root, rows, asked, k=6, filters={"drug": "A"})
    assert search_index.compact(spark, root) == 3
    same_as_corpus(spark, root, rows, asked, k=6)
    live = search_index._live(spark, root)
    assert live.segments == [3] and live.n == sum(r[1] is not None for r in rows)
    search_index.write_segment(frame(rows[:5]), root, 4, cols=["drug"])
    same_as_corpus(spark, root, [r for r in rows if r[0] not in {x[0] for x in rows[:5]}] + rows[:5], asked, k=6)


def test_only_asked_buckets_are_read(spark, tmp_path, asked):
    root = str(tmp_path)
    search_index.write_segment(spark.createDataFrame(corpus_rows(3), SCHEMA), root, cols=["drug"])
    one = spark.createDataFrame([(1, "liver")], "query_id int, query string")
    plan = search_index.search_index(spark, root, one)._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "PartitionFilters" in line and "max_tf" in line and "Scan" in line]
    bucket = spark.range(1).select(search_index._bucket(F.lit("liver"))).first()[0]
    assert scans and all("_bucket#" in line and f"= {bucket})" in line for line in scans)


def test_blocks_that_cannot_win_are_left_out(spark, tmp_path):
    """One block has a short text that scores far above all others."""
    rows = [(f"c{i:03d}", "rash " + "the " * 60, "A") for i in range(64)] + [("c900", "rash rash", "A")]
    search_index.write_segment(spark.createDataFrame(rows, SCHEMA).coalesce(1), str(tmp_path), cols=["drug"])
    one = spark.createDataFrame([(1, "rash")], "query_id int, query string")
    got = search_index.search_index(spark, str(tmp_path), one, k=1)
    assert got.first().case_id == "c900"


def test_empty_index_and_reserved_names(spark, tmp_path, asked):
    empty = spark.createDataFrame([], SCHEMA)
    search_index.write_segment(empty, str(tmp_path), cols=["drug"])
    assert search_index.search_index(spark, str(tmp_path), asked).count() == 0
    with pytest.raises(ValueError):
        search_index.write_segment(empty.withColumn("_x", F.lit(1)), str(tmp_path), cols=["_x"])


def test_many_asked_words_give_the_same_as_few(spark, asked, monkeypatch):
    corpus = spark.createDataFrame(corpus_rows(4), SCHEMA)
    few = answers(search.search_batch(corpus, asked, 9, cols=["drug"], filters={"drug": "A"}))
    monkeypatch.setattr(search, "LITERAL_WORDS", 1)
    many = answers(search.search_batch(corpus, asked, 9, cols=["drug"], filters={"drug": "A"}))
    assert few == many and few


def test_ties_have_a_total_order(spark):
    rows = [("c1", "rash", f"drug{i}") for i in (5, 3, 8, 1)]
    corpus = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = search.keyword_search(corpus, "rash", cols=["case_id", "drug"], limit=3).collect()
    assert [r.drug for r in got] == ["drug1", "drug3", "drug5"]


def test_postings_shuffle_a_word_once_a_row(spark):
    """Words are counted in their row: a repeated word is one entry before the exchange."""
    docs = spark.createDataFrame([(0, 4, "b a b b"), (1, 0, "!"), (2, 1, "a")], "_row bigint, _length int, _text string")
    made = search_index._postings(docs)
    got = {r.term: (r.n, r.max_tf, r.min_length, [tuple(e) for e in r.entries]) for r in made.collect()}
    assert got == {"a": (2, 1, 1, [(0, 1, 4), (2, 1, 1)]), "b": (1, 3, 4, [(0, 3, 4)])}
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1


def test_a_text_with_several_reports_is_indexed_once(spark, tmp_path):
    """Three reports of a case share its text: one entry a word that counts for three rows."""
    rows = [("c1", "rash rash pain", drug) for drug in ("A", "B", "A")] + [("c2", "rash rash pain", "A"), ("c1", "rash", "A")]
    root, corpus = str(tmp_path), spark.createDataFrame(rows, SCHEMA).repartition(3)
    search_index.write_segment(corpus, root, cols=["drug"])
    blocks = spark.read.parquet(f"{root}/postings").groupBy("term").agg(F.sum("n").alias("n"), F.sum(F.size("entries")).alias("e"))
    assert {tuple(r) for r in blocks.collect()} == {("rash", 5, 3), ("pain", 4, 2)}
    assert "_text" not in spark.read.parquet(f"{root}/docs").columns
    live = search_index._live(spark, root)
    assert (live.n, live.length) == (5, 13)
    # The text of c1 that three rows shared goes; what they counted for goes with it.
    search_index.write_segment(spark.createDataFrame([("c1", "mild", "B")], SCHEMA), root, 1, cols=["drug"])
    live = search_index._live(spark, root)
    assert (live.n, live.length) == (2, 4)
    gone = spark.read.parquet(f"{root}/dead_terms").select("term", "n").collect()
    assert {tuple(r) for r in gone} == {("rash", 4), ("pain", 3)}


def test_marks_pick_rows(spark):
    numbers = [0, 5, 63, 64, 4095, 4096, (7 << 33) + 70, (1 << 40) + 4097]
    texts = spark.createDataFrame([(s, n) for s in (0, 1) for n in numbers], "_segment int, _row bigint")
    rows = [(0, 0), (0, 63), (1, 64), (1, 4096), (0, (7 << 33) + 70), (1, (1 << 40) + 4097), (1, 6)]
    got = search_index._marked(texts, spark.createDataFrame(rows, "_segment int, _row bigint"))
    assert sorted(tuple(r) for r in got.collect()) == sorted(rows[:-1])


def test_shuffle_files_are_dropped_within_only(spark):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    with dropped_shuffles(spark):
        assert spark.conf.get(name) == "true"
        df = spark.range(99).groupBy((F.col("id") % 7).alias("k")).count()
        assert df.count() == len(df.collect()) == len(df.collect()) == 7
    assert spark.conf.get(name, None) == before


def test_reports_of_other_cases_are_left_out_before_they_are_joined(spark, tmp_path):
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    frame([("c1", 1), ("c1", 2), ("c9", 1), (None, 1)], "case_id string, part int").write.parquet(f"{tmp_path}/lines")
    frame([(1, "A"), (2, "B")], "part int, drug_name string").write.parquet(f"{tmp_path}/parts")
    lines, parts = (spark.read.parquet(f"{tmp_path}/{t}") for t in ("lines", "parts"))
    absent = [F.lit(None).cast("string").alias(c) for c in ("ae_soc_class", "ae_term", "report_date")]
    fact = lines.join(parts, "part").select("case_id", "drug_name", *absent)
    texts = frame([("c1", "rash"), ("c2", "pain"), (None, "mild")], "case_id string, narrative_text string")
    made = search.search_corpus(texts, fact, lines.select("case_id"))
    assert {tuple(r)[:3] for r in made.collect()} == {("c1", "rash", "A"), ("c1", "rash", "B"), ("c2", "pain", None), (None, "mild", None)}
    plan = made._jdf.queryExecution().optimizedPlan().toString().splitlines()
    inner = next(i for i, line in enumerate(plan) if "Join Inner" in line)
    assert "Join LeftSemi" in "".join(plan[inner + 1 :])
