import hashlib
import random
import tracemalloc

import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from medwarden.llm import bpe

PATH = P.path("word_bpe_49k.json")
OWN = Tokenizer.from_file(PATH)
ENCODER = bpe.Encoder(open(PATH, encoding="utf-8").read())


def brute(text):
    ids = OWN.encode(text, add_special_tokens=False).ids
    return len(ids), " ".join(map(str, ids)), OWN.decode(ids, skip_special_tokens=False)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_test_data(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r for r in bpe.bpe_round_trip(docs, PATH, keep_ids=True).collect()}
    for doc_id, text in docs.select("doc_id", "text").collect():
        n, ids, decoded = brute(text)
        r = got[doc_id]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (n, sha(ids), sha(decoded))
        assert " ".join(map(str, r.ids)) == ids


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from("aéÉİΣ \n\t  \u0085'.9<|가中sre\U0001f600\x00\x1c"), max_size=60))
def test_any_text(text):
    e = ENCODER.encode(text.encode())
    assert (e.n, e.ids, e.tokens) == brute(text)


def test_joins_and_special_tokens(monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK_WORDS", 1)
    encoder = bpe.Encoder(open(PATH, encoding="utf-8").read())
    rng = random.Random(1)
    for _ in range(200):
        words = rng.choices(["the", "́x", "<|endoftext|>", "a.b's", "École", "İ", "12"], k=30)
        text = "".join(w + rng.choice([" ", "\n", "  ", "\t"]) for w in words)
        e = encoder.encode(text.encode())
        assert (e.n, e.ids, e.tokens) == brute(text)


def test_a_join_that_differs_is_encoded_as_one(monkeypatch):
    encoder = bpe.Encoder(open(PATH, encoding="utf-8").read())
    monkeypatch.setattr(bpe, "cuts", lambda text: [3])
    e = encoder.encode(b"theory of")  # cut within a word
    assert (e.n, e.ids, e.tokens) == brute("theory of")


def test_odd_tables(spark, rows):
    data = [(None, "a b"), (1, None), (2, ""), (3, " \n"), (4, "x"), (4, "x")]
    df = spark.createDataFrame(data, "doc_id bigint, text string").selectExpr("*", "1 as n_tokens", "2 as ids", "3 as _id")
    got = rows(bpe.bpe_round_trip(df, PATH), "doc_id", "n_tokens")
    assert got == [(1, 0), (2, 0), (3, 0), (4, 1), (4, 1), (None, 2)]
    assert bpe.bpe_round_trip(df.limit(0), PATH).count() == 0
    with pytest.raises(ValueError):
        bpe.bpe_round_trip(df, P.path("byte_bpe_50k.json"))


def test_the_words_a_worker_keeps_take_little_memory():
    encoder = bpe.Encoder(open(PATH, encoding="utf-8").read())
    rng = random.Random(2)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=9)).encode() for _ in range(20_000)]
    tracemalloc.start()
    try:
        encoder._of_words(words)
        each = tracemalloc.get_traced_memory()[0] / len(encoder._words)
    finally:
        tracemalloc.stop()
    assert each * bpe._KEPT_WORDS < 100_000_000
