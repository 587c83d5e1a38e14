import hashlib
import random

from medwarden.llm.suffix_dedup import suffix_dedup
from medwarden.llm.suffix_sort import lyndon_groups, suffix_array


def test_suffix_array_matches_sorting():
    rng = random.Random(1)
    for trial in range(600):
        text = [rng.randrange(rng.choice([1, 2, 3, 20])) for _ in range(rng.randrange(60))]
        if trial % 3 == 0:
            text = text[: trial % 7] * rng.randrange(1, 12)
        assert suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def test_groups_hold_one_lyndon_prefix():
    text = list(b"graindraining")

    def prefix(i):
        return next(
            tuple(text[i:j]) for j in range(len(text), i, -1)
            if all(text[i:j] < text[k:j] for k in range(i + 1, j))
        )

    _, _, groups = lyndon_groups(text)
    words = [{prefix(i) for i in g} for g in groups]
    assert all(len(w) == 1 for w in words)
    assert [min(w) for w in words] == sorted(min(w) for w in words)


def brute(docs):
    counts = {}
    for _, t in docs:
        b = (t or "").encode()
        for i in range(len(b) - 199):
            counts[b[i : i + 200]] = counts.get(b[i : i + 200], 0) + 1
    out = []
    for d, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 199):
            if counts[b[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and (not i or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


COLUMNS = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


def got(df):
    return sorted((tuple(r) for r in suffix_dedup(df).select(*COLUMNS).collect()), key=str)


def test_matches_brute_force(spark):
    rng = random.Random(9)

    def words(n):
        return " ".join("".join(rng.choices("abcdeé\0", k=rng.randrange(1, 9))) for _ in range(n))

    shared = [words(n) for n in (34, 40, 60, 200)]
    docs = [(0, None), (1, ""), (2, "ab " * 150), (3, "x" * 199), (4, "y" * 200), (5, "y" * 201),
            (6, "z" * 700), (7, words(50) + "q" * 205 + words(9))]
    for i in range(8, 60):
        parts = [words(rng.randrange(60)), rng.choice(shared), words(rng.randrange(30))]
        if i % 5 == 0:
            edited = list(rng.choice(shared))
            edited[rng.randrange(len(edited))] = "#"
            parts.append("".join(edited))
        if i % 7 == 0:
            parts = [shared[3][rng.randrange(40) : 900], words(3), shared[3][100 : 300 + i]]
        docs.append((i, " ".join(parts)))
    docs += [(100, docs[-1][1]), (101, docs[-1][1]), (101, docs[9][1]), (None, docs[10][1])]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5)
    assert got(df) == brute(docs)


def test_test_data(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert got(docs) == brute([tuple(r) for r in docs.select("doc_id", "text").collect()])


def test_odd_tables(spark):
    df = spark.createDataFrame([(None, "a" * 300), (1, "b"), (1, "b")], "doc_id bigint, text string")
    named = df.selectExpr("*", "1 as u1", "2 as key", "3 as ranges", "4 as copies", "5 as _id")
    assert got(named) == brute([tuple(r) for r in df.collect()])
    assert suffix_dedup(df.limit(0)).count() == 0


def test_hot_anchors_are_counted(spark, monkeypatch):
    from medwarden.llm import suffix_dedup as S

    monkeypatch.setattr(S, "SORTED_VERSIONS", 3)
    rng = random.Random(4)
    passage = "".join(rng.choices("abcdefgh ", k=500))
    docs = [
        (i, "".join(rng.choices("xyz ", k=150)) + passage + "".join(rng.choices("xyz ", k=rng.randrange(9))))
        for i in range(12)
    ]
    docs += [(20, passage[:260] + "#" + passage[261:]), (21, passage[:260] + "+" + passage[261:])]
    assert got(spark.createDataFrame(docs, "doc_id bigint, text string")) == brute(docs)


def test_long_texts_are_cut_into_blocks(spark, monkeypatch):
    from medwarden.llm import suffix_dedup as S

    rng = random.Random(2)
    base = "".join(rng.choices("abcdefgh ", k=3000))
    texts = [base, base[500:2500] + "x" * 30 + base[:700]]
    monkeypatch.setattr(S, "_BLOCK", 700)
    anchors = S.Anchors()
    for t in texts:
        runs = [r for part in anchors.segments(t.encode()) for r in zip(*part)]
        assert sum(r[1] for r in runs) == len(t) - 199
        assert all(r[0] <= r[2] < r[0] + r[1] + 136 for r in runs)
