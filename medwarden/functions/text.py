"""Text column helpers. All of them stay inside the JVM."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

NON_WORD = r"[^\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits of the whole text."""
    return F.filter(F.split(F.lower(text), NON_WORD), lambda t: t != "")


def query_terms(spark: SparkSession, text: str) -> list[str]:
    """Distinct words of a search string held by the caller, by the expression texts are split with."""
    words = spark.sql("SELECT 1").select(F.array_sort(F.array_distinct(tokens(F.lit(text)))))
    return list(words.first()[0])


def keep_words(words: Column, wanted: Iterable[str]) -> Column:
    """The elements of a token array that are in ``wanted`` (a hash lookup per token)."""
    return F.filter(words, lambda t: t.isin(sorted(set(wanted))))


def count_words(words: Column, wanted: Iterable[str]) -> Column:
    """How many elements of a token array are in ``wanted``; 0 for a NULL array."""
    return F.coalesce(F.size(keep_words(words, wanted)), F.lit(0))


def contains_ci(column: Column, text: str, wildcards: bool = False) -> Column:
    """Case-insensitive substring test; ``wildcards`` lets % and _ in ``text`` act as in LIKE."""
    if wildcards:
        pattern = "%" + text.replace("\\", "\\\\") + "%"
        return F.like(F.lower(column), F.lower(F.lit(pattern)))
    return F.lower(column).contains(F.lower(F.lit(text)))


def preview(column: Column, length: int) -> Column:
    return F.left(column, F.lit(length))


def shorten(column: Column, length: int = 2000, mark: str = "...") -> Column:
    """Cut for display; ``mark`` tells that something was cut. NULL shows as empty text."""
    text = F.coalesce(column, F.lit(""))
    return F.when(
        F.length(text) > length, F.concat(F.substring(text, 1, length), F.lit(mark))
    ).otherwise(text)
