import hashlib

import duckdb
import public_tokenizers as P
from tokenizers import Tokenizer

import corpus_pipeline
from medwarden.llm import line_dedup, quality_rules
from medwarden.llm.common import stage, table
from medwarden.llm.simhash import shingles
from tests.llm.test_decontaminate import brute as leaks

SF = "/root/testdata/sf0.001"


def texts(df):
    return dict(df.select("doc_id", "text").collect())


def jaccard(a, b):
    a, b = (set(shingles(t.encode(), 5)) for t in (a, b))
    return len(a & b) / len(a | b) if a | b else 1.0


def test_stages(spark):
    con = duckdb.connect()
    docs = table(spark, SF, "documents")
    columns, states = docs.columns, [docs]
    for name, apply in corpus_pipeline.STAGES:
        docs = stage(apply(spark, docs, SF), name)
        states.append(docs)
    assert all(d.columns == columns for d in states[:-1])
    raw, good, lines, near, clean = map(texts, states[:-1])

    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    kept = con.sql(f"SELECT doc_id FROM ({quality_rules.ORACLE}) WHERE kept").fetchall()
    assert set(good) == {d for (d,) in kept}

    con.sql("CREATE OR REPLACE TABLE good AS SELECT * FROM documents WHERE doc_id IN (SELECT unnest(?))", params=[list(good)])
    con.sql("DROP VIEW documents")
    con.sql("CREATE VIEW documents AS SELECT * FROM good")
    want = con.sql(line_dedup.ORACLE).fetchall()
    assert {d: hashlib.sha256(t.encode()).hexdigest() for d, t in lines.items()} == {r[0]: r[3] for r in want}

    # One of each group stays: what left is near something smaller that was there; nothing that
    # stayed is a near copy of something else that did.
    gone = lines.keys() - near.keys()
    for d in gone:
        assert any(e < d and jaccard(lines[e], t) > 0.5 for e, t in lines.items() if e != d)
    ids = sorted(near)
    assert not [(a, b) for a in ids for b in ids if a < b and jaccard(near[a], near[b]) >= 0.8]

    bench = [tuple(r) for r in table(spark, SF, "benchmark").select("item_id", "text").collect()]
    assert near.keys() - clean.keys() == {d for d, _ in leaks(list(near.items()), bench)}

    own = Tokenizer.from_file(P.path(corpus_pipeline.TOKENIZER))
    last = {r.doc_id: r for r in states[-1].collect()}
    assert last.keys() == clean.keys()
    for d, t in clean.items():
        ids = own.encode(t, add_special_tokens=False).ids
        assert last[d].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


def test_odd_tables(spark):
    data = [(None, None, None, None, None), (1, "", "en", "a", 0), (1, "", "en", "a", 0),
            (2, "word " * 3, None, "b", 15), (2, " ".join(f"w{i}" for i in range(90)), "en", None, 0)]
    docs = spark.createDataFrame(data * 2, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    clashing = docs.selectExpr("*", "'r' as _row", "'o' as _other", "'d' as drop", "'l' as _lines", "'k' as kept")
    for rows, n in ((docs, 1), (docs.limit(0), 0), (clashing, 1)):
        out = rows
        for name, apply in corpus_pipeline.STAGES:
            out = stage(apply(spark, out, SF), name)
            if rows is clashing and name != "bpe":
                assert {(r["_row"], r["_other"], r.drop, r["_lines"], r.kept) for r in out.collect()} == {("r", "o", "d", "l", "k")}
        assert out.count() == n
