import hashlib

from pyspark.sql import functions as F

from checks.compare import connect
from medwarden.llm import line_dedup as L
from medwarden.llm.common import table

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))


def texts(df):
    return {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in df.collect()}


def test_matches_sql(spark):
    got = L.report(table(spark, SF, "documents"))
    want = connect(SF).sql(L.ORACLE)
    rows = [tuple(r) for r in got.select(*want.columns).orderBy("doc_id").collect()]
    assert rows == sorted(want.fetchall())


def test_templates_generalise_variable_fields(spark):
    # Numbers, and a few differing words, are fields of one template; other lines stay.
    other = LONG.replace("wordad", "else").replace("wordbd", "else")
    far = " ".join(["wordaa", "wordba", "wordca"] + [f"far{i}x" for i in range(57)]).replace("far", "f")
    docs = [(i, f"own line {chr(97 + i)}\nuser {i} logged in from host {i * 7} today at noon\n\nend") for i in range(12)]
    docs += [(20, LONG), (21, f"a\n{LONG}"), (22, other), (23, far)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = texts(L.line_dedup(df))
    assert got[0] == (docs[0][1], 4, 0)
    assert all(got[i] == (f"own line {chr(97 + i)}\n\nend", 4, 1) for i in range(1, 12))
    assert (got[20][0], got[21][0], got[22][0], got[23][0]) == (LONG, "a", "", far)


def test_odd_tables(spark):
    data = [(None, LONG), (1, None), (2, ""), (3, LONG), (3, LONG), (4, " \n\t"), (5, f"{LONG}\n{LONG}\nx")]
    df = spark.createDataFrame(data, "doc_id bigint, text string").selectExpr(
        "*", "1 as n_lines", "2 as pos", "3 as _id", "4 as leaf", "5 as drop_"
    )
    got = L.line_dedup(df)
    assert set(got.columns) == {*df.columns, "n_dropped"} and got.count() == len(data)
    found = texts(got)
    assert found[1] == (None, 0, 0) and found[2] == ("", 1, 0) and found[4] == (" \n\t", 2, 0)
    assert found[None][0] == LONG  # NULL is the smallest id
    assert found[3] == ("", 1, 1) and found[5] == ("x", 3, 2)
    assert L.line_dedup(df.limit(0)).count() == 0
    assert L.report(df).filter("doc_id = 2").first().kept_sha256 == hashlib.sha256().hexdigest()


def test_repeated_keeper_and_shared_ids(spark):
    # The keeper's row twice, two texts of one id, and two texts without an id.
    other = " ".join(w[::-1] for w in LONG.split())
    data = [(1, f"a\n{LONG}"), (1, f"a\n{LONG}"), (2, f"{LONG}\nb"), (3, "own\nlast"), (3, f"{LONG}\nc"),
            (None, f"d\n{other}"), (None, "e\nf"), (4, other)]
    df = spark.createDataFrame(data, "doc_id bigint, text string")
    got = sorted((r.doc_id or 0, r.text) for r in L.line_dedup(df).collect())
    assert got == [(0, f"d\n{other}"), (0, "e\nf"), (1, f"a\n{LONG}"), (1, f"a\n{LONG}"), (2, "b"), (3, "c"),
                   (3, "own\nlast"), (4, "")]


def test_columns_of_any_name_come_through(spark):
    text = "\n".join(f"one line that recurs in all of these texts {'abcdefgh'[i]}" for i in range(8))
    docs = spark.createDataFrame([(i, text) for i in range(30)] + [(99, None)], "doc_id bigint, text string")
    more = {"drop": "d", "_lines": "l", "lines": "x", "doc": "o", "drop_id": "i", "_drop_h": "h", "a.b": "p"}
    got = L.line_dedup(docs.withColumns({k: F.lit(v) for k, v in more.items()})).collect()
    assert len(got) == 31 and sum(r.n_dropped for r in got) > 0
    assert all(r[k] == v for r in got for k, v in more.items())
    plain = {(r.doc_id, r.text, r.n_lines, r.n_dropped) for r in L.line_dedup(docs).collect()}
    assert {(r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got} == plain


def test_long_lines(spark):
    line = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}" for i in range(60_000))
    docs = spark.createDataFrame([(i, f"{line}\nown {chr(97 + i)}") for i in range(3)], "doc_id bigint, text string")
    got = {r.doc_id: (r.n_dropped, r.text[:5]) for r in L.line_dedup(docs).collect()}
    assert got == {0: (0, line[:5]), 1: (1, "own b"), 2: (1, "own c")}
