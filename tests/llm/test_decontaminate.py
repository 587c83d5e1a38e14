import random

import duckdb
import numpy as np
import pyarrow as pa

from medwarden.llm import decontaminate as decontaminate_module
from medwarden.llm.decontaminate import decontaminate, words_of

SF = "/root/testdata/sf0.01"


def brute(docs, bench):
    """Items of which half the runs of six words stand in a text."""
    inv = {}
    for i, t in bench:
        w = words_of(t)
        for k in range(len(w) - 5):
            inv.setdefault(tuple(w[k : k + 6]), set()).add((i, len(w) - 5))
    found = set()
    for d, t in docs:
        w, seen = words_of(t), {}
        for k in range(len(w) - 5):
            for item in inv.get(tuple(w[k : k + 6]), ()):
                seen.setdefault(item, set()).add(tuple(w[k : k + 6]))
        found |= {(d, i) for (i, n), s in seen.items() if 2 * len(s) >= n}
    return found


def test_finds_what_brute_force_finds(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in decontaminate(docs, bench).collect()}
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    items = duckdb.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall()
    assert got == brute(rows, items) and len(got) > 5


def test_paraphrases_and_answers(spark):
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(3000)]
    items = [(i, " ".join(rng.choices(vocabulary, k=40)), f"a{i} b{i}") for i in range(30)]
    docs = []
    for i, (_, text, answer) in enumerate(items):
        words = text.split()
        for k in rng.sample(range(40), 8):
            words[k] = f"x{rng.randrange(9999)}"  # a word in five is another
        around = rng.choices(vocabulary, k=200)
        docs.append((i, " ".join(around[:90] + words + answer.split() + around[90:])))
        docs.append((100 + i, " ".join(around[:90] + words + around[90:])))
        docs.append((200 + i, " ".join(rng.choices(vocabulary, k=300))))
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    bench = spark.createDataFrame(items, "item_id bigint, text string, answer string")
    got = {(r.doc_id, r.item_id) for r in decontaminate(df, bench, answer_col="answer").collect()}
    assert len(got & {(i, i) for i in range(30)}) >= 29
    assert got <= {(i, i) for i in range(30)}  # the others lack the answer
    assert len(decontaminate(df, bench.drop("answer")).filter("doc_id < 200").collect()) >= 40


def test_odd_tables(spark, rows):
    text = "one two three four five six seven eight nine ten"
    data = [(None, text), (1, None), (2, ""), (3, "X " + text.upper()), (3, "X " + text.upper()), (4, "the " * 9000)]
    df = spark.createDataFrame(data, "doc_id bigint, text string").selectExpr("*", "1 as item_id", "2 as _id", "3 as cosine")
    bench = spark.createDataFrame([(7, text), (8, None), (9, "!"), (7, text)], "item_id bigint, text string")
    got = rows(decontaminate(df, bench), "doc_id", "item_id", "common")
    assert got == [(3, 7, 1.0)] * 4 + [(None, 7, 1.0)] * 2
    assert decontaminate(df.limit(0), bench).count() == 0
    assert decontaminate(df, bench.limit(0)).count() == 0


def zipf(rng, n):
    """Words of a Zipf vocabulary of 50,000."""
    p = 1 / np.arange(1, 50_001)
    return [f"z{i}" for i in rng.choice(50_000, n, p=p / p.sum())]


def test_finds_exact_copies_of_5000_items(spark):
    rng = np.random.default_rng(1)
    words = zipf(rng, 5000 * 32)
    items = [(i, " ".join(words[i * 32 : i * 32 + 32])) for i in range(5000)]
    docs = [(i, " ".join(zipf(rng, 50)) + " " + items[i][1] + " " + " ".join(zipf(rng, 50))) for i in range(0, 5000, 10)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate(df, bench).collect()}
    assert got == {(i, i) for i, _ in docs}

def test_finds_copies_of_any_length(spark):
    rng = np.random.default_rng(2)
    sizes = [10, 15, 32, 33, 100, 300, 400, 1000]
    items = [(i, " ".join(zipf(rng, sizes[i % 8]))) for i in range(80)]
    docs = [(i, " ".join(zipf(rng, 90 + i) + [text] + zipf(rng, 100))) for i, text in items]
    # Other texts hold words the benchmark lacks, which weigh the more the larger the corpus is.
    docs += [(1000 + i, f"n{i} other") for i in range(20_000)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate(df, bench).collect()}
    assert got == {(i, i) for i in range(80)}


def test_space_is_shaped_by_every_passage(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join(zipf(rng, 20 + i % 90)) for i in range(4000)] + ["", None, "unknown"]
    vocabulary = sorted({w for t in texts[:40] for w in words_of(t)})
    terms = {w: i for i, w in enumerate(vocabulary)}
    df = spark.createDataFrame(list(enumerate(texts)), "_id bigint, _text string").repartition(4)
    rows = decontaminate_module._numbered(df, terms)
    counts, n, n_passages = decontaminate_module._document_counts(rows, len(terms))
    passages = [w[i : i + 32] for w in map(words_of, texts) for i in range(0, len(w), 32)]
    assert (n, n_passages) == (len(texts), len(passages)) and n_passages > 8000
    held = [set(words_of(t)) for t in texts]
    assert counts.tolist() == [sum(w in h for h in held) for w in vocabulary]

    rare, parts = 9.0, []
    idf = rare - np.log(counts + 1)
    for numbers in (np.arange(0, len(terms), 2), np.arange(1, len(terms), 2)):
        parts.append((numbers, idf[numbers]))
    right = [rng.standard_normal((len(t), 5)) for t, _ in parts]
    got = decontaminate_module._moments(rows, len(terms), parts, rare, right)
    for (numbers, weights), wide, found in zip(parts, right, got, strict=True):
        place = {vocabulary[t]: i for i, t in enumerate(numbers)}
        x = np.zeros((len(passages), len(numbers)))
        for at, p in enumerate(passages):
            for w in p:
                if w in place:
                    x[at, place[w]] = weights[place[w]]
            norm = (x[at] ** 2).sum() + sum(w not in place for w in p) * rare**2
            x[at] /= np.sqrt(norm)
        assert np.allclose(found, x.T @ (x @ wide), rtol=1e-3, atol=1e-3)


def test_bounds_leave_out_no_candidate(spark):
    rng = np.random.default_rng(4)
    terms, passages = np.arange(500), [np.unique(rng.integers(0, 500, 25)) for _ in range(40)]
    basis = np.linalg.qr(rng.standard_normal((500, 30)))[0]
    space = decontaminate_module.Space(
        terms, rng.uniform(1, 8, 500), basis, list(enumerate(passages)), 500
    )
    texts = [np.concatenate([passages[i % 40], rng.integers(0, 501, i)]).astype(np.int32) for i in range(90)]
    texts.insert(0, np.zeros(0, np.int32))
    lengths, words = np.array([len(t) for t in texts]), np.concatenate(texts)
    search = decontaminate_module.Search([], np.ones(500), [space])
    got = {c[:3] for c in search.candidates(lengths, words)}
    every = set()
    for at, text in enumerate(texts):
        for start in range(0, max(1, len(text) - 32) if len(text) else 0, 32):
            window = np.full((1, 64), 500, np.int32)
            window[0, : len(text[start : start + 64])] = text[start : start + 64]
            every |= {(at, start, item) for _, item, _ in space.candidates(window)}
    assert got == every and len(got) > 60


def test_words_are_cut_as_texts_are(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choices("aB9 .’é\n\t-", k=rng.randrange(12))) for _ in range(3000)]
    texts += ["", None, "x" * 9, " y ", "é", None, "a" * 3_000_000, "b c", ""]
    counts, words = zip(*decontaminate_module._words(pa.array([None, "no", *texts])[2:]), strict=True)
    assert np.concatenate(counts).tolist() == [len(words_of(t)) for t in texts] and len(counts) > 2
    assert [w for part in words for w in part.to_pylist()] == [w for t in texts for w in words_of(t)]
    assert [len(n) for n, _ in decontaminate_module._words(pa.array([None, ""], pa.string()))] == [2]


def test_texts_are_read_once_for_all_steps_of_the_basis(spark, monkeypatch):
    rng = np.random.default_rng(6)
    passages = rng.integers(0, 301, (9000, 32)).astype(np.int32)  # 300: no term
    texts = [(i, p.ravel().tolist()) for i, p in enumerate(passages.reshape(-1, 3, 32))]
    df = spark.createDataFrame(texts, "_id int, _words array<int>").repartition(3)
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    counts = np.bincount(passages.ravel())[:300]
    parts = [(t, 9 - np.log(counts[t])) for t in (np.arange(200), np.arange(100, 300))]
    own = [decontaminate_module._own(w, list(rng.integers(0, 200, (40, 20)))) for _, w in parts]
    found = []
    for kept in (1 << 24, 0):  # sums kept until a task ends, or handed on for every 1,000 passages
        monkeypatch.setattr(decontaminate_module, "_KEPT_PAIRS", kept)
        monkeypatch.setattr(decontaminate_module, "_SUMMED", 1000)
        read.value = 0
        rows = df.mapInArrow(counted, df.schema)
        found.append(decontaminate_module.latent_basis(rows, 300, parts, own, 9.0, 9000))
        assert read.value == 3000  # each text once, not once a step
    for (terms, weights), first, second in zip(parts, *found, strict=True):
        assert np.allclose(np.abs((first * second).sum(axis=0))[:30], 1, atol=1e-3)
        held = np.zeros((9000, 301))
        held[np.arange(9000)[:, None], passages] = 1
        x = held[:, terms] * weights
        rest = 9.0**2 * np.isin(passages, terms, invert=True).sum(axis=1)
        x /= np.sqrt((x**2).sum(axis=1) + rest)[:, None]
        got = decontaminate_module._summed_pairs(passages, 300, terms, weights, 9.0)
        assert np.allclose(got, x.T @ x, rtol=1e-3, atol=1e-3)
