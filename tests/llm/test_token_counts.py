import random
from functools import lru_cache

import public_tokenizers as P

from medwarden.llm.token_counts import MARK, Counter, token_counts, vocabulary


def brute(word, pieces):
    byte = min(pieces.values()) - 10.0
    text = MARK + word

    @lru_cache(None)
    def best(end):
        if not end:
            return 0.0, 0
        s, t = best(end - 1)
        width = len(text[end - 1].encode())
        options = [(s + width * byte, -(t + width))]
        for start in range(end):
            if text[start:end] in pieces:
                s, t = best(start)
                options.append((s + pieces[text[start:end]], -(t + 1)))
        s, t = max(options)
        return s, -t

    return best(len(text))[1]


def test_counts_match_brute_force():
    pieces = vocabulary(P.path("piece_bpe_32k.model"))
    rng = random.Random(2)
    words = ["".join(rng.choice("theandor\u00e9\u4e2d!") for _ in range(rng.randrange(1, 14))) for _ in range(400)]
    counter = Counter(pieces)
    for start in range(0, 400, 40):
        part = words[start : start + 40] + words[:5]
        assert counter.count(part) == sum(brute(w, pieces) for w in part)


def test_ties_take_fewest_tokens():
    assert Counter({MARK: -1.0, "a": -1.0, "b": -1.0, "ab": -2.0}).count(["ab"]) == 2


def test_odd_tables(spark, rows):
    pieces = {MARK: -1.0, "a": -2.0, MARK + "a": -2.5}
    data = [(None, "a"), (1, None), (2, " \t"), (3, "a\x0ba a"), (3, "a\x0ba a"), (4, "aa" * 5000)]
    df = spark.createDataFrame(data, "doc_id bigint, text string").selectExpr("*", "1 as n_words", "2 as _id", "3 as n_tokens")
    got = rows(token_counts(df, pieces), "doc_id", "n_words", "n_tokens")
    assert got == [(1, 0, 0), (2, 0, 0), (3, 3, 3), (3, 3, 3), (4, 1, 10000), (None, 1, 1)]
    assert token_counts(df.limit(0), pieces).count() == 0
