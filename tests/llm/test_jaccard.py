import random

import numpy as np
import pytest

from medwarden.llm import jaccard as m


def shingles(text):
    words = (text or "").encode().lower().split()
    if len(words) < 3:
        return {b" ".join(words)} if words else set()
    return {b" ".join(words[i : i + 3]) for i in range(len(words) - 2)}


def brute(docs, percent=90):
    sets = [(i, shingles(text)) for i, text in docs]
    comp = list(range(len(sets)))

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and 100 * len(x & y) >= percent * len(x | y):
                comp[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(sets):
        least[find(a)] = min(i, least.get(find(a), i))
    return sorted((i, len(s), least[find(a)]) for a, (i, s) in enumerate(sets))


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        at = rng.randrange(len(words))
        words[at : at + rng.randrange(2)] = [f"e{rng.randrange(10**6)}"]
    return words


def corpus(seed):
    """Copies of texts of many lengths with few edits, so that many pairs are near the threshold."""
    rng = random.Random(seed)
    docs = [None, "", " \t\n", "One", "one two", "ONE  two", "one two three", "one two three four", "a b c d e f g h i j k l"]
    docs += ["a b c d e f g h i j k", "é È " * 9]
    for size in (8, 12, 15, 20, 30, 60, 150, 400):
        base = [f"w{rng.randrange(5000)}" for _ in range(size)]
        chain = base
        for k in range(14):
            docs.append(" ".join(edited(rng, base, rng.randrange(1 + size // 25))))
            chain = edited(rng, chain, max(1, size // 70))
            docs.append(" ".join(chain) if k % 3 else " ".join(chain).upper())
    rng.shuffle(docs)
    return [(i, text) for i, text in enumerate(docs)]


@pytest.mark.parametrize("blocks", [(4096, 1 << 21), (6, 1 << 21), (4096, 900)])
def test_matches_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(m, "BLOCK_SETS", blocks[0])
    monkeypatch.setattr(m, "BLOCK_GRAMS", blocks[1])
    monkeypatch.setattr(m, "LEADERS", 2)
    docs = corpus(3)
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    got = m.jaccard_groups(df).select("doc_id", "n_shingles", "component_id")
    want = brute(docs)
    assert sorted(tuple(r) for r in got.collect()) == want
    assert len({r[2] for r in want}) < len(want) - 60


@pytest.mark.parametrize("percent", [70, 80, 95])
def test_other_thresholds(spark, percent):
    docs = corpus(percent)
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = m.jaccard_groups(df, percent=percent).select("doc_id", "n_shingles", "component_id")
    assert sorted(tuple(r) for r in got.collect()) == brute(docs, percent)


@pytest.mark.parametrize("percent", [51, 80, 90, 97])
def test_linked_sets_share_a_key(percent):
    rng = np.random.default_rng(percent)
    for size in [*range(1, 60), 100, 333, 2000]:
        whole = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64) * np.uint64(2))
        for _ in range(4):
            kept = whole[rng.random(len(whole)) < 1 - rng.random() * (100 - percent) / 100]
            more = rng.integers(0, 1 << 63, int(rng.integers(0, 1 + size // 20))).astype(np.uint64)
            other = np.unique(np.concatenate([kept, more]))
            shared = len(np.intersect1d(whole, other))
            together = len(whole) + len(other) - shared
            if 100 * shared < percent * together or np.array_equal(whole, other):
                continue
            keys = [set(m.agreement_keys(x, m.Bands(percent)).tolist()) for x in (whole, other)]
            assert keys[0] & keys[1]


def test_sets_of_empty_groups_share_a_key():
    """All groups but few are empty, as they hardly are by chance."""
    base = np.arange(1, 41, dtype=np.uint64)
    other = np.append(base[:-1], np.uint64(1 << 63))
    keys = [set(m.agreement_keys(x, m.Bands(90)).tolist()) for x in (base, other)]
    assert keys[0] & keys[1]


def test_tree_finds_all_that_the_bound_lets_through():
    rng = np.random.default_rng(5)
    points = rng.poisson(rng.integers(1, 20, (700, 1)), (700, 32)).astype(np.int32)
    points[300:500] = points[:200] + (rng.random((200, 32)) < 0.05)
    tree, size = m.CountTree(points, 90), points.sum(axis=1)
    for i in range(0, 700, 7):
        shared = np.minimum(points, points[i]).sum(axis=1)
        want = np.flatnonzero(shared >= m.least_overlap(size, size[i], 90))
        assert sorted(tree.search(points[i])) == want.tolist()


def test_odd_tables(spark, rows):
    df = spark.createDataFrame(
        [(None, "a b c d"), (1, "a b c d"), (1, "A b c d"), (None, None), (2, "")], "doc_id bigint, text string"
    ).selectExpr("doc_id", "text", "1 as n", "2 as node", "3 as digest", "4 as _id", "5 as t1", "6 as keys", "7 as root")
    got = rows(m.jaccard_groups(df), "doc_id", "n_shingles", "component_id")
    assert got == [(1, 2, 1), (1, 2, 1), (2, 0, 2), (None, 0, None), (None, 2, 1)]
    assert m.jaccard_groups(df.limit(0)).count() == 0


def test_very_long_texts(spark, rows):
    rng = random.Random(1)
    base = [f"w{rng.randrange(10**6)}" for _ in range(100_000)]
    docs = [(1, " ".join(base)), (2, " ".join(base[:95_000])), (3, " ".join(base[:80_000]))]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert [r[2] for r in rows(m.jaccard_groups(df), "doc_id", "n_shingles", "component_id")] == [1, 1, 3]
