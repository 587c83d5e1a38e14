import random
import re
from collections import Counter

import numpy as np
import pytest

from medwarden.llm import collocations as m


def brute(docs, min_count, top):
    """Rows of the contract, phrase by phrase, in Python integers."""
    f, n = {}, Counter()
    for lang, text in docs:
        lang = lang or "und"
        text = re.sub("[A-Z]", lambda x: x[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in (1, 2, 3):
                for i in range(len(words) - k + 1):
                    f.setdefault(lang, Counter())[tuple(words[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        cand = {p: a for p, a in counts.items() if len(p) > 1 and a >= min_count}
        found = []
        for p, a in cand.items():
            longer = (q for q in cand if len(q) > len(p) and p in (q[:2], q[1:]))
            if any(100 * cand[q] >= 50 * a for q in longer):
                continue
            cuts = [(1000000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


def texts(seed, n):
    rng = random.Random(seed)
    words = ["the", "The", "a", "new", "york", "city", "hall", "São", "Paulo", "x-ray", "İ", " b", "é"]
    ends = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", "? "]
    return [
        (rng.choice(["en", "de", None, "und"]), "".join(rng.choice(words) + rng.choice(ends) for _ in range(rng.randrange(80))))
        for _ in range(n)
    ]


@pytest.mark.parametrize("shard", [m.SHARD, 50])
def test_matches_brute_force(spark, rows, monkeypatch, shard):
    monkeypatch.setattr(m, "SHARD", shard)
    docs = [*texts(1, 120), ("en", None), ("en", ""), (None, " \t"), ("en", "new york city hall " * 40)]
    df = spark.createDataFrame(docs, "lang string, text string").repartition(3)
    got = m.collocations(df, min_count=3, top=40)
    assert sorted(tuple(r) for r in got.collect()) == brute(docs, 3, 40)


def test_index_holds_what_stands_around_each_place():
    text = np.array([0, 3, 1, 2, 1, 2, 0, 1, 3, 1, 0])
    bwt, rbwt = m.fm_index(text)
    starts = np.concatenate([[0], np.cumsum(np.bincount(text))])
    for w in range(1, 4):
        at = np.flatnonzero(text == w)
        interval = slice(starts[w], starts[w + 1])
        assert sorted(bwt[interval]) == sorted(text[at - 1])
        assert sorted(rbwt[interval]) == sorted(text[at + 1])


def test_wide_ids_sort_as_narrow_ones():
    rng = np.random.default_rng(2)
    a, b, c = rng.integers(0, 5, (3, 200))
    wide = m.order_of(a + (a > 3) * (1 << 22), b, c)
    assert np.array_equal(wide, m.order_of(a, b, c))


def test_exact_beyond_64_bits(spark):
    df = spark.range(1).selectExpr("4000000000000L as f", "4000000000001L as l", "4000000000003L as r")
    a, first, rest = 4000000000000, 4000000000001, 4000000000003
    score = df.select(m._score("f", df.l, df.r).alias("s")).first().s
    assert score == 1000000 * a * a // (first * rest)


def test_odd_tables(spark, rows):
    df = spark.createDataFrame([("a b. " * 6, None), ("a b. " * 6, None)], "text string, lang string")
    df = df.selectExpr("*", "1 as w1", "'x' as word", "2 as words", "3 as n", "4 as rank", "5 as f", "6 as before")
    assert [tuple(r) for r in m.collocations(df).collect()] == [("und", 1, "a b", 12, 12, 12, 24, 1000000)]
    assert m.collocations(df.limit(0)).count() == 0
    nulls = spark.createDataFrame([(None, None)], "text string, lang string")
    assert m.collocations(nulls).count() == 0


def test_very_long_text(spark):
    df = spark.createDataFrame([("big data " * 300_000, "en")], "text string, lang string")
    got = {r.phrase: (r.a, r.l, r.r, r.n) for r in m.collocations(df).collect()}
    # "big data" and "data big" lie inside longer phrases of nearly as many occurrences.
    assert set(got) == {"big data big", "data big data"}
    assert got["big data big"] == (299_999, 300_000, 300_000, 600_000)
