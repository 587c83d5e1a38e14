import zlib

from medwarden.llm import language_id as L
from medwarden.llm.language_id import Model, fit, language_id, words

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == 1000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == r.lang for r in held) > 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_words_before_grams_before_shorter_grams():
    model = Model(["a", "b"], {"cat": [-1.0, -9.0]}, {"dog": [-5.0, -1.0], "x": [-1.0, -2.0]})
    assert model.predict("Cat")[0] == "a"
    assert model.predict("dog")[0] == "b"
    assert model.predict("x")[0] == "a"
    assert model.scores(["zzz", "cat"]).tolist() == [[0.0, 0.0], [-1.0, -9.0]]
    model._most = 3
    assert model.predict("q dog r x s t u")[0] == "b"


def test_odd_tables(spark, rows):
    data = [(None, "the cat", "en"), (1, None, "en"), (3, " 12 !", None), (4, "der hund", "de"),
            (4, "der hund", "de"), (5, "the dog", "en"), (6, "", "xx")]
    df = spark.createDataFrame(data, "doc_id bigint, text string, lang string").selectExpr(
        "*", "1 as score", "2 as held_out", "3 as word", "4 as _id"
    )
    got = {r.doc_id: r for r in language_id(df).collect()}
    assert got[1].lang_pred == got[3].lang_pred == got[6].lang_pred == "und"
    assert language_id(df.limit(0)).count() == 0
    assert language_id(df).count() == 7
    assert fit(df.filter("false").select("text", "lang")).predict("a") == ("und", 0.0)


def test_words():
    assert words("Él-la 12 a_b") == ["él", "la", "a", "b"]
    assert words("a½b ²") == ["a", "b"]


def test_a_word_below_the_cut_of_a_language_keeps_its_count_there(spark, monkeypatch):
    # "cc" is the third word of "big" and was once quoted in "small".
    monkeypatch.setattr(L, "MAX_WORDS", 2)
    data = [("aa " * 50 + "bb " * 40 + "cc " * 30, "big"), ("dd " * 60 + "cc", "small")]
    model = fit(spark.createDataFrame(data, "text string, lang string"))
    assert model.predict("cc")[0] == "big" and model.predict("dd")[0] == "small"
