import random

import numpy as np
import xxhash

from medwarden.llm import simhash
from medwarden.llm.simhash import anchors_of, near_duplicates, simhash_groups


def brute(docs, n=4, bits=4):
    fps = {}
    for i, text in docs:
        words = (text or "").encode().lower().split()
        parts = [b" ".join(words[k : k + n]) for k in range(max(1, len(words) - n + 1))]
        hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts] if words else []
        fps[i] = sum(
            1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)
        )
    comp = {i: i for i in fps}
    changed = True
    while changed:
        changed = False
        for i in fps:
            for j in fps:
                if (fps[i] ^ fps[j]).bit_count() <= bits and comp[j] < comp[i]:
                    comp[i], changed = comp[j], True
    return sorted((i, f"{fps[i]:016x}", comp[i]) for i in fps)


def test_pairs_of_four_bits_share_an_anchor():
    rng = random.Random(3)
    for _ in range(500):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), 4):
            y ^= 1 << b
        fp = np.array([[x], [y]], np.uint64).view(np.int64)
        at, key = anchors_of(fp)
        assert set(key[at == 0]) & set(key[at == 1])
        assert len(key) <= 64


def test_matches_brute_force(spark, rows):
    rng = random.Random(5)
    base = [f"w{rng.randrange(400)}" for _ in range(300)]
    docs = [(0, None), (1, ""), (2, " \t\n"), (3, "One two"), (4, "one TWO"), (5, "é É"), (6, "a")]
    for i in range(7, 60):
        words = list(base) if i % 3 else [f"v{rng.randrange(99)}" for _ in range(20)]
        for _ in range(i % 4):
            words[rng.randrange(len(words))] = "edit"
        docs.append((i, " ".join(words)))
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = rows(simhash_groups(df), "doc_id", "fingerprint", "component_id")
    assert sorted(got) == brute(docs)


def test_odd_tables(spark, rows):
    df = spark.createDataFrame(
        [(None, "a b c d e"), (1, "a b c d e"), (1, "a b c d e")], "doc_id bigint, text string"
    ).selectExpr("doc_id", "text", "1 as fp", "2 as node", "3 as key", "4 as _id")
    assert rows(simhash_groups(df), "doc_id", "component_id") == [(1, 1), (1, 1), (None, 1)]
    assert simhash_groups(df.limit(0)).count() == 0


def test_near_duplicates(spark):
    rng = random.Random(8)
    docs = []
    for i in range(40):
        words = [f"w{rng.randrange(100000)}" for _ in range(400)]
        docs.append((2 * i, " ".join(words)))
        for _ in range(6):
            words[rng.randrange(400)] = "edit"
        docs.append((2 * i + 1, " ".join(words)))
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in near_duplicates(df).collect()}
    assert sum(got[2 * i + 1] == 2 * i for i in range(40)) >= 39
    assert all(got[2 * i] == 2 * i for i in range(40))


def test_forest_connects_like_all_pairs():
    rng = np.random.default_rng(1)
    fp = (rng.integers(0, 1 << 6, (60, 1)) | (1 << 40)).astype(np.int64)
    key = np.repeat([1, 2, 5], 20)
    i, j = simhash.forest(key, fp, 1)
    assert len(i) < 60 and (key[i] == key[j]).all()
