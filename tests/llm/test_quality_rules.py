import random
from collections import Counter

import pytest

from checks.compare import connect
from medwarden.llm import quality_rules as Q
from medwarden.llm.common import table

SF = "/root/testdata/sf0.001"


def brute(text):
    words = (text or "").replace("\n", " ").replace("\t", " ").split(" ")
    words = [w for w in words if w]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = {w for w, n in Counter(windows).items() if n > 1}
    covered = {p + k for p, w in enumerate(windows) if w in often for k in range(3)}
    lines = [x for x in (text or "").split("\n") if x.strip(" \t")]
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return (len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered))


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def test_matches_sql(spark):
    got = Q.quality_rules(table(spark, SF, "documents"))
    want = connect(SF).sql(Q.ORACLE)
    rows = [tuple(r) for r in got.select(*want.columns).orderBy("doc_id").collect()]
    assert rows == sorted(want.fetchall())


def test_base_counts_match_brute_force(spark):
    rng = random.Random(3)
    docs = [(0, None), (1, ""), (2, " \n\t"), (3, "a b"), (4, "a a a a"), (5, "x y x y x y")]
    for i in range(6, 80):
        words = rng.choices(["a", "b", "é", "#c", "\U0001f600|", "longer"], k=rng.randrange(60))
        docs.append((i, "".join(w + rng.choice([" ", "  ", "\n", "\t"]) for w in words)))
    docs.append((80, "word " * 30_000))
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    rows = df.selectExpr("*", "'en' as lang", "cast(null as string) as source")
    got = {r.doc_id: r for r in Q.quality_rules(rows).collect()}
    for i, text in docs:
        want = brute(text)
        assert tuple(got[i][c] for c in COUNTS) == want, i
        assert got[i].base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (got[i].base_failed and got[i].kept)


def test_fences_follow_the_group(spark):
    rng = random.Random(4)

    def text(symbols):
        words = [f"{''.join(rng.choices('abcdefgh', k=5))}" for _ in range(100)]
        for i in range(symbols):
            words[i] = "#$%&*"
        return " ".join(words)

    # Signs are usual in code and not in prose.
    docs = [(i, text(20 + i % 3), "code", "s") for i in range(150)]
    docs += [(1000 + i, text(i % 2), "prose", "s") for i in range(150)]
    docs += [(2000, text(21), "prose", "s"), (2001, text(80), "code", "s")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string")
    kept = {r.doc_id: r.kept for r in Q.quality_rules(df).collect()}
    assert not kept.pop(2000) and not kept.pop(2001) and all(kept.values())


@pytest.mark.parametrize("n", [1, 0])
def test_odd_tables(spark, n):
    data = [(None, None, None, None), (1, "a b", None, "s"), (1, "a b", None, "s")] * n
    df = spark.createDataFrame(data, "doc_id bigint, text string, lang string, source string")
    named = df.selectExpr("*", "1 as n_words", "2 as bin", "3 as _w", "4 as kept")
    got = Q.quality_rules(named).collect()
    assert len(got) == len(data) and not any(r.kept for r in got)
