"""Keyword, vector, hybrid and substring search."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from medwarden.functions.numbers import count_where
from medwarden.functions.text import contains_ci, count_words, keep_words, query_terms, shorten, tokens
from medwarden.operators.skew import hot_keys, salted_join

K1 = 1.2
B = 0.75
# Asked words that a plan holds as a list; more are joined.
LITERAL_WORDS = 10_000


def search_corpus(narratives: DataFrame, fact: DataFrame, cases: DataFrame | None = None) -> DataFrame:
    """Narratives with the drug and class of their reports as filter attributes.

    A narrative repeats for each report of its case; a case with very many reports is split. ``cases``
    has the ``case_id`` of each report, where that is cheaper to read than the fact. Reports of other
    cases are left out before anything of them is made or moved.
    """
    # Unlike a join, this gets below the joins that the reports are made by. The reports are not sorted for it.
    known = F.col("case_id").isin(narratives.select("case_id").hint("shuffle_hash"))
    attributes = fact.select("case_id", "drug_name", "ae_soc_class", "ae_term", "report_date")
    attributes = attributes.filter(known)
    if cases is not None:
        cases = cases.filter(known)
    rows = salted_join(
        narratives.select("case_id", "narrative_text"),
        attributes,
        ["case_id"],
        "left",
        hot_side="right",
        hot=None if cases is None else hot_keys(cases, ["case_id"]),
    )
    return rows.select("case_id", "narrative_text", "drug_name", "ae_soc_class")


def bm25_idf(n_docs: Column, df: Column) -> Column:
    n, d = n_docs.cast("double"), df.cast("double")
    return F.log(F.lit(1.0) + (n - d + 0.5) / (d + 0.5))


def bm25_saturated(tf: Column, length: Column, mean_length: Column) -> Column:
    norm = K1 * (F.lit(1.0 - B) + F.lit(B) * length.cast("double") / mean_length)
    return tf.cast("double") * (K1 + 1.0) / (tf.cast("double") + norm)


def sum_ascending(part: Column) -> Column:
    """Sum of a group's few parts in ascending order, so that equal parts give equal sums."""
    return F.aggregate(F.array_sort(F.collect_list(part)), F.lit(0.0), lambda a, x: a + x)


def keyword_search(
    corpus: DataFrame,
    query: str,
    filters: Mapping[str, str] | None = None,
    cols: Sequence[str] = ("case_id", "narrative_text"),
    limit: int = 5,
    text_col: str = "narrative_text",
    tie_break: Sequence[str] = ("case_id",),
) -> DataFrame:
    """The best rows by BM25 over the words of the query, among rows that match the filters.

    Corpus statistics (rows, mean length, rows per word) are one small aggregate over the whole
    corpus. Scores are computed where the rows are; only the top ``limit`` rows move. Ties go by
    ``tie_break``, then by all other columns of the result.
    """
    terms = query_terms(corpus.sparkSession, query)
    if not terms:
        raise ValueError("the query has no words")
    text = F.col(text_col)
    words = corpus.select(tokens(text).alias("_words"))
    stats = words.agg(
        F.count("_words").alias("n"),
        F.avg(F.size("_words").cast("double")).alias("mean_length"),
        *[
            F.count(F.when(F.array_contains("_words", t), 1)).alias(f"df{i}")
            for i, t in enumerate(terms)
        ],
    )
    # The containment test skips splitting texts that cannot match.
    may_match = F.lower(text).contains(terms[0])
    for term in terms[1:]:
        may_match = may_match | F.lower(text).contains(term)
    rows = corpus.filter(may_match)
    for column, value in (filters or {}).items():
        rows = rows.filter(F.col(column) == value)
    counts = {f"_tf{i}": count_words(F.col("_words"), [t]) for i, t in enumerate(terms)}
    score = F.lit(0.0)
    for i, name in enumerate(counts):
        weight = bm25_idf(F.col("_stats.n"), F.col(f"_stats.df{i}"))
        score = score + weight * bm25_saturated(
            F.col(name), F.col("_length"), F.col("_stats.mean_length")
        )
    # Rows without a hit score 0 and sort last; any hit scores more, however common the word. They
    # are dropped after the limit: a filter below would be pushed down and split the texts again.
    return (
        rows.withColumn("_words", tokens(text))
        .withColumns({"_length": F.size("_words"), **counts})
        .withColumn("_stats", stats.select(F.struct("*")).scalar())
        .withColumn("score", score)
        .select(*dict.fromkeys([*cols, *tie_break]), "score")
        .orderBy(F.desc("score"), *dict.fromkeys([*tie_break, *cols]))
        .limit(limit)
        .filter(F.col("score") > 0)
        .withColumn("score", F.round("score", 6))
    )


def dot(a: Column | str, b: Column | str) -> Column:
    """Sum of products of two double arrays, in their order."""
    products = F.zip_with(a, b, lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two double arrays; NULL if one has no length."""
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def vector_search(
    vectors: DataFrame,
    query: Sequence[float] | Column,
    k: int = 5,
    id_col: str = "case_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """The ``k`` nearest vectors by cosine: one scan, and only ``k`` rows per task move.

    ``query`` is a list of numbers or an array column, for example a scalar subquery.
    """
    if isinstance(query, Column):
        target = query.cast("array<double>")
    else:
        target = F.array(*[F.lit(float(x)) for x in query])
    similarity = cosine(F.col("_vector"), F.col("_query"))
    return (
        vectors.withColumn("_vector", F.col(vector_col).cast("array<double>"))
        .withColumn("_query", target)
        .select(id_col, similarity.alias("similarity"))
        .orderBy(F.desc_nulls_last("similarity"), id_col)
        .limit(k)
        .withColumn("similarity", F.round("similarity", 6))
    )


def hybrid_search(
    keyword_hits: DataFrame,
    vector_hits: DataFrame,
    k: int = 5,
    c: int = 60,
    id_col: str = "case_id",
    depth: int = 200,
) -> DataFrame:
    """Reciprocal-rank fusion of the hit lists of the two searches.

    An item scores 1/(c + rank) in each list that has it. The first ``depth`` hits of each list
    count, so the searches should return that many, well above ``k``: an item just below the top
    of both lists may beat those on top of one. Ranking them in one task is bounded by ``depth``.
    """
    if depth < k:
        raise ValueError("depth must be at least k")

    def ranked(hits: DataFrame, value: str, name: str) -> DataFrame:
        order = Window.orderBy(F.desc_nulls_last(value), F.col(id_col))
        best = hits.orderBy(F.desc_nulls_last(value), id_col).limit(depth)
        return best.select(id_col, F.row_number().over(order).alias(name))

    by_word = ranked(keyword_hits, "score", "keyword_rank")
    by_vector = ranked(vector_hits, "similarity", "vector_rank")

    def part(name: str) -> Column:
        return F.coalesce(F.lit(1.0) / (F.lit(float(c)) + F.col(name)), F.lit(0.0))

    return (
        by_word.join(by_vector, id_col, "full")
        .withColumn("score", part("keyword_rank") + part("vector_rank"))
        .orderBy(F.desc("score"), id_col)
        .limit(k)
        .withColumn("score", F.round("score", 6))
    )


def search_batch(
    corpus: DataFrame,
    queries: DataFrame,
    k: int = 5,
    key: str = "case_id",
    text_col: str = "narrative_text",
    filters: Mapping[str, str] | None = None,
    cols: Sequence[str] = (),
) -> DataFrame:
    """Top ``k`` rows for each of many queries (query_id, query), scored as ``keyword_search``.

    Parts of a score are added in ascending order, so equal rows score equal. A row of the corpus
    is scored as a whole, also where several rows share ``key``; ties go by ``key`` and ``cols``.
    Rows that are equal altogether are scored once and shown as often as they are there. Scores are
    made where the words are: of up to ``LITERAL_WORDS`` asked words a row keeps only those, by a
    hash lookup in the row, and what is shuffled are the postings of asked words.
    """
    asked = queries.select(
        "query_id", F.explode(F.array_distinct(tokens(F.col("query")))).alias("term")
    ).distinct()
    vocabulary = asked.select("term").distinct()
    out = list(dict.fromkeys([key, *cols]))
    wanted = F.lit(True)
    for column, value in (filters or {}).items():
        wanted = wanted & F.coalesce(F.col(column) == value, F.lit(False))
    text = F.col(text_col)
    docs = corpus.filter(text.isNotNull())
    stats = docs.agg(
        F.struct(
            F.count(F.lit(1)).alias("n"),
            F.avg(F.size(tokens(text)).cast("double")).alias("mean_length"),
        )
    ).scalar()
    few = [r.term for r in vocabulary.limit(LITERAL_WORDS + 1).collect()]
    kept = tokens(text) if len(few) > LITERAL_WORDS else keep_words(tokens(text), few)
    # Each word with whether it is its text's first such one, which counts the equal rows.
    ordered = F.array_sort("_kept")
    before = F.concat(F.array(F.lit(None).cast("string")), F.slice(ordered, 1, F.size(ordered)))
    runs = F.zip_with(
        ordered, F.slice(before, 1, F.size(ordered)), lambda w, b: F.struct(w.alias("term"), (~b.eqNullSafe(w)).alias("new"))
    )
    words = docs.select(
        *out,
        wanted.alias("_wanted"),
        F.xxhash64(text).alias("_h"),
        F.size(tokens(text)).alias("length"),
        F.explode_outer(F.array(kept)).alias("_kept"),
    ).select(*out, "_wanted", "_h", "length", F.explode_outer(runs).alias("_w"))
    words = words.filter(F.col("_w").isNotNull()).select(*out, "_wanted", "_h", "length", "_w.term", "_w.new")
    if len(few) > LITERAL_WORDS:
        words = words.join(vocabulary, "term")
    copies = count_where(F.col("new"))
    postings = words.groupBy(*out, "_h", "length", "term").agg(
        (F.count(F.lit(1)) / copies).cast("long").alias("tf"),
        copies.alias("copies"),
        count_where(F.col("new") & F.col("_wanted")).alias("wanted"),
    )
    # A condition on all that is counted keeps this branch identical to the scored one, so postings
    # are built once.
    counted = F.when((F.col("tf") > 0) & (F.col("wanted") >= 0), F.col("copies"))
    frequency = postings.groupBy("term").agg(F.sum(counted).alias("df"))
    weighted = asked.join(frequency, "term")
    part = bm25_idf(F.col("_stats.n"), F.col("df")) * bm25_saturated(
        F.col("tf"), F.col("length"), F.col("_stats.mean_length")
    )
    scores = (
        postings.filter(F.col("wanted") > 0)
        .join(weighted, "term")
        .withColumn("_stats", stats)
        .groupBy("query_id", "_h", *out)
        .agg(sum_ascending(part).alias("score"), F.min("wanted").alias("copies"))
        .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.least("copies", F.lit(k)).cast("int"))))
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), *[F.col(c) for c in out])
    return (
        scores.withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= k)
        .select("query_id", *out, F.round("score", 6).alias("score"), "rank")
    )


# --- substring search ---------------------------------------------------------------------


def search_narratives(
    fact_narrative: DataFrame, text: str, limit: int = 5, wildcards: bool = False
) -> DataFrame:
    """Narratives whose text, event or drug contains the words, whatever their case."""
    found = (
        contains_ci(F.col("narrative_text"), text, wildcards)
        | contains_ci(F.col("extracted_ae"), text, wildcards)
        | contains_ci(F.col("extracted_drug"), text, wildcards)
    )
    return (
        fact_narrative.filter(found)
        .select(
            "case_id",
            "narrative_text",
            "extracted_drug",
            "extracted_ae",
            "extracted_causality",
            "narrative_sentiment",
        )
        .orderBy("case_id", F.col("narrative_text"))
        .limit(limit)
    )


def narrative_overview(fact_narrative: DataFrame) -> DataFrame:
    """All narratives, most negative first."""
    return fact_narrative.select(
        "case_id",
        "extracted_drug",
        "extracted_ae",
        "extracted_severity",
        "extracted_causality",
        F.col("narrative_sentiment").alias("sentiment_score"),
    ).orderBy(F.col("sentiment_score").asc_nulls_last(), "case_id")


def search_transcripts(
    transcripts: DataFrame,
    text: str,
    limit: int = 5,
    wildcards: bool = False,
    preview_length: int = 2000,
) -> DataFrame:
    """Transcripts that contain the words, with the start of the text for display."""
    full = F.col("transcription_result.text")
    return (
        transcripts.filter(contains_ci(full, text, wildcards))
        .select(
            "file_name",
            "received_at",
            full.alias("transcript_text"),
            shorten(full, preview_length).alias("transcript_preview"),
        )
        .orderBy(F.col("received_at").asc_nulls_last(), "file_name")
        .limit(limit)
    )


def linked_events(hits: DataFrame, fact_calls: DataFrame) -> DataFrame:
    """The events of each found call; calls without events keep one row of NULLs."""
    events = fact_calls.select(
        F.col("source_call_id").alias("file_name"),
        "drug_name",
        "ae_preferred_term",
        "ae_soc_class",
        "ae_seriousness",
        "ae_outcome",
        "causality",
        "reporting_deadline",
    )
    return hits.join(events, "file_name", "left")
