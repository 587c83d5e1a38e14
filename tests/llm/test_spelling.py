import random
import re
import zlib
from collections import Counter

import numpy as np

from medwarden.llm import spelling as m


def counted(docs, min_count=5):
    n = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda x: x[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 6 and c >= min_count}


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def grouped(n):
    form, near = {}, {}
    for w in n:
        close = [x for x in n if one_apart(w, x)]
        near[w] = len(close)
        best = min(close, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], near[w], n[form[w]] if form[w] else None))
    return sorted(out)


def edited(rng, word):
    letters = "abcdeé÷ÿ"
    for _ in range(rng.randrange(3)):
        i = rng.randrange(len(word) + 1)
        word = rng.choice(
            [word[:i] + word[i + 1 :], word[:i] + rng.choice(letters) + word[i:], word[:i] + rng.choice(letters) + word[i + 1 :]]
        )
    return word


def test_matches_brute_force(spark):
    rng = random.Random(4)
    stems = ["".join(rng.choice("abcde") for _ in range(rng.randrange(6, 16))) for _ in range(25)]
    vocabulary = [edited(rng, rng.choice(stems)) for _ in range(250)] + stems
    weights = [rng.choice([1, 1, 2, 9, 60, 400]) for _ in vocabulary]
    seps = [" ", " ", "-", "1", "\n", "_", "Ā"]
    docs = [(None, None), (1, ""), (2, "Ünlike Ünlike ünlike " * 3), (None, "nullid " * 9), (3, "É" * 7 + " 12 ")]
    for i in range(4, 60):
        words = rng.choices(vocabulary, weights, k=200)
        docs.append((i, "".join((w if rng.random() < 0.8 else w.upper()) + rng.choice(seps) for w in words)))
    docs += docs[-3:]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    got = m.spelling_variants(df)
    assert sorted(tuple(r) for r in got.collect()) == grouped(counted(docs))


def test_no_near_pair_is_missed(spark, monkeypatch):
    """Edits at every place of words of every length, whether their grams are frequent or not."""
    rng = random.Random(6)
    words = set()
    for size in range(6, 30):
        for base in ("".join(rng.choice("ab") for _ in range(size)), "ab" * size, "x" * size):
            base = base[:size]
            words.add(base)
            for i in range(size + 1):
                words |= {base[:i] + "z" + base[i:], base[:i] + base[i + 1 :], base[:i] + "q" + base[i + 1 :]}
    words = sorted(w for w in words if len(w) >= 6)
    want = {(a, b) for a in words for b in words if abs(len(a) - len(b)) < 2 and one_apart(a, b)}
    df = spark.createDataFrame([(w, 7) for w in words], "word string, n bigint")
    for least in (1, m.FREQUENT, 10**6):
        monkeypatch.setattr(m, "FREQUENT", least)
        got = m.near_pairs(df).collect()
        assert {(r.word, r.other) for r in got} == want
        assert len(got) == len(want)


def test_forms_lead_on(spark, rows):
    chain = [(f"w{i}", f"w{i + 1}") for i in range(26)]
    df = spark.createDataFrame(chain, "word string, form string")
    assert rows(m.roots(df)) == sorted((w, "w26") for w, _ in chain)


def test_grams_grow_where_they_are_frequent():
    words = m._Words([b"abcdefgh", b"zzcdef"])
    known = m._Dictionary(np.array([0x6261, 0x636261], np.uint64), np.array([50, 40]))
    _, _, _, letters, rest = next(words.places())
    gram, size, count = known.grow(letters, rest, m.longest(words.length))
    assert size.tolist() == [4, 2] and count.tolist() == [0, 0]
    assert gram[0] == int.from_bytes(b"abcd", "little")


def test_odd_tables(spark, rows):
    df = spark.createDataFrame([(1, "letter " * 5), (1, "letter " * 5)], "doc_id bigint, text string")
    df = df.selectExpr("*", "1 as run", "2 as word", "3 as n", "4 as key", "5 as id", "6 as h", "7 as other")
    assert rows(m.spelling_variants(df)) == [("letter", None, "letter", 10, 0, None)]
    assert m.spelling_variants(df.limit(0)).count() == 0
    assert m.spelling_variants(df.selectExpr("doc_id", "cast(null as string) as text")).count() == 0


def test_very_long_words(spark, rows):
    long = "ab" * 20_000
    text = " ".join([long] * 25 + [long[:-1] + "c"] * 5 + ["x" + long] * 5)
    got = rows(m.spelling_variants(spark.createDataFrame([(3, text)], "doc_id bigint, text string")))
    assert got == grouped(counted([(3, text)]))
