"""Spelling variants by an index of variable-length grams.

Words are near if one letter more, less or other makes them equal.

1. The gram dictionary: a gram of 2 letters or more grows by its next letter as long as more than
   a bounded number of places hold it. So a common beginning has long grams and a rare one short
   ones, and only the frequent grams, whose number is bounded, need be known to decide.
2. A word's grams are those its places grow to. A gram depends on its own letters alone, so an edit
   affects it only if it falls into them: of two grams that share no letter, one edit affects one
   at most. No gram is longer than half its word, so each word has such a pair. One more fact
   makes their lists short: the left gram keeps its distance from the word's beginning if the edit
   comes after it, and otherwise the right one keeps its distance from the end.
3. Each word is listed under its grams, with their distance and its length, and asks for two lists
   in each of three lengths: those of its rarest such pair. What the lists have is verified.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medwarden.llm.common import stage

MIN_LENGTH, MIN_COUNT = 6, 5
# A word's form occurs this many times as often.
RATIO = 5
# A run in so many loses a letter.
DAMAGED = 199
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
QMIN, QMAX = 2, 6
# Places of a word that start listed grams: the first ones, and those this far from the end.
HEADS, TAILS = 6, 8
# A gram grows where more places than this hold it, or more than 2**-DICTIONARY of all places; so
# there are at most 2**DICTIONARY frequent grams of each length.
FREQUENT, DICTIONARY = 32, 20
_SIDE = HEADS + QMAX - 1


def _letters(text: Column) -> Column:
    return F.split(F.translate(text, _UPPER, _LOWER), "[^a-z\\u00C0-\\u00FF]+")


def counted_words(docs: DataFrame, id_col: str, text_col: str, min_length: int, min_count: int) -> DataFrame:
    """(word, n) of the words that count, after the damage done to some runs."""
    run = F.col("run")
    # explode_outer: explode would add a filter that splits each text again.
    runs = docs.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"),
        F.explode_outer(_letters(F.col(text_col))).alias("run"),
    ).filter(F.length("run") >= min_length)
    h = F.crc32(F.concat("id", F.lit(":"), run).cast("binary"))
    at = (F.col("h") % F.length("run")).cast("int")
    word = F.when(
        F.col("h") % DAMAGED == 0,
        F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length("run"))),
    ).otherwise(run)
    return (
        runs.withColumn("h", h)
        .select(word.alias("word"))
        .filter(F.length("word") >= min_length)
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") >= min_count)
    )


class _Words:
    """Grams of many words: letters are one byte each, so a gram is a number."""

    def __init__(self, words: list[bytes]) -> None:
        self.length = np.fromiter(map(len, words), np.int64, len(words))
        head = b"".join([w[:_SIDE].ljust(_SIDE, b"\0") for w in words])
        tail = b"".join([w[-TAILS:].rjust(TAILS, b"\0") for w in words])
        self._head = np.frombuffer(head, np.uint8).reshape(-1, _SIDE).astype(np.uint64)
        self._tail = np.frombuffer(tail, np.uint8).reshape(-1, TAILS).astype(np.uint64)

    def places(self) -> Iterator[tuple[bool, int, np.ndarray, np.ndarray, np.ndarray]]:
        """(from the end, distance, start, letters from there on, how many) of each listed place."""
        for p in range(HEADS):
            yield False, p, np.full(len(self.length), p), self._head[:, p : p + QMAX], self.length - p
        for q in range(QMIN, TAILS + 1):
            letters = self._tail[:, TAILS - q : TAILS - q + QMAX]
            yield True, q, self.length - q, letters, np.full(len(self.length), q)


def _grown(letters: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(size, gram) for the grams of each size that ``letters`` begin with."""
    code = letters[:, 0].copy()
    for k in range(1, letters.shape[1]):
        code = code | (letters[:, k] << np.uint64(8 * k))
        yield k + 1, code


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = _Words(batch.column(0).to_pylist())
        made = []
        for from_end, _, start, letters, rest in words.places():
            # A place of both kinds counts once.
            once = (start >= HEADS) if from_end else (rest > 0)
            made += [code[once & (rest >= k)] for k, code in _grown(letters)]
        codes, counts = np.unique(np.concatenate(made), return_counts=True)
        yield pa.record_batch(
            [pa.array(codes.view(np.int64)), pa.array(counts, pa.int64())], names=["gram", "n"]
        )


def dictionary(words: DataFrame, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(grams, counts) of the frequent grams, in order of the grams."""
    places = n_words * (HEADS + TAILS)
    least = max(FREQUENT, places >> DICTIONARY)
    found = (
        words.select("bytes")
        .mapInArrow(_gram_counts, "gram bigint, n bigint")
        .groupBy("gram")
        .agg(F.sum("n").alias("n"))
        .filter(F.col("n") > least)
        .toArrow()
    )
    grams, counts = (found.column(i).to_numpy() for i in range(2))
    order = np.argsort(grams)
    return grams[order].view(np.uint64), counts[order]


def longest(length: np.ndarray) -> np.ndarray:
    """Letters a gram of a word may have: half of it, so that two grams without a shared letter fit."""
    return np.minimum(QMAX, length // 2)


class _Dictionary:
    def __init__(self, grams: np.ndarray, counts: np.ndarray) -> None:
        self._grams, self._counts = grams, counts

    def count(self, code: np.ndarray) -> np.ndarray:
        """Count of each gram, 0 if it is not frequent."""
        if not len(self._grams):
            return np.zeros(len(code), np.int64)
        at = np.minimum(np.searchsorted(self._grams, code), len(self._grams) - 1)
        return np.where(self._grams[at] == code, self._counts[at], 0)

    def grow(self, letters: np.ndarray, rest: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(gram, its size, its count) that the dictionary grows at a place: size 0 if it has no letters."""
        n = len(rest)
        gram, size, count = np.zeros(n, np.uint64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        open_ = rest >= QMIN
        for k, code in _grown(letters):
            now = self.count(code)
            gram, size, count = (np.where(open_, new, old) for new, old in ((code, gram), (k, size), (now, count)))
            open_ = open_ & (now > 0) & (k < most) & (k < rest)
        return gram, size, count


def _list_key(gram: np.ndarray, from_end: bool, at: int, length: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Names a list: a gram at a distance, in words of a length. Lists of one name do no harm."""
    h = gram ^ (length.astype(np.uint64) << np.uint64(56)) ^ (length.astype(np.uint64) >> np.uint64(8))
    h = h * np.uint64(0x9E3779B97F4A7C15) + most.astype(np.uint64) + np.uint64(64 * at + 16 * from_end)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return (h ^ (h >> np.uint64(32))).view(np.int64)


def _listed(words: _Words, known: _Dictionary) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of the lists each word stands in: for words that are one letter shorter to longer."""
    rows, keys = [], []
    own = longest(words.length)
    of = {-1: longest(np.maximum(words.length - 1, MIN_LENGTH)), 0: own, 1: longest(words.length + 1)}
    for step, most in of.items():
        new = np.ones(len(own), bool) if step == 0 else most != own
        if not new.any():
            continue
        for from_end, at, start, letters, rest in words.places():
            gram, size, _ = known.grow(letters, rest, most)
            use = np.flatnonzero(new & (size > 0) & (start >= 0))
            rows.append(use)
            keys.append(_list_key(gram[use], from_end, at, words.length[use], most[use]))
    return np.concatenate(rows), np.concatenate(keys)


def _asked(words: _Words, known: _Dictionary) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of the lists each word asks for: its cheapest two grams without a shared letter."""
    n = len(words.length)
    most = longest(words.length)
    places = []
    for from_end, at, start, letters, rest in words.places():
        gram, size, count = known.grow(letters, rest, most)
        places.append((from_end, at, start, gram, size, count))
    best = np.full(n, np.iinfo(np.int64).max)
    left, right = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i, (_, _, a, _, a_size, a_count) in enumerate(places[:HEADS]):
        for j, (_, _, b, _, b_size, b_count) in enumerate(places[HEADS:], HEADS):
            fits = (a_size > 0) & (b_size > 0) & (a + a_size <= b)
            cost = a_count + b_count
            use = fits & (cost < best)
            best, left, right = np.where(use, cost, best), np.where(use, i, left), np.where(use, j, right)
    rows, keys = [], []
    for i, (from_end, at, _, gram, _, _) in enumerate(places):
        of = np.flatnonzero((left == i) if i < HEADS else (right == i))
        for step in (-1, 0, 1):
            use = of[words.length[of] + step >= MIN_LENGTH]
            rows.append(use)
            keys.append(_list_key(gram[use], from_end, at, words.length[use] + step, most[use]))
    return np.concatenate(rows), np.concatenate(keys)


def _rows_of(words: DataFrame, grams: tuple[np.ndarray, np.ndarray], find) -> DataFrame:
    """(key, word, n): each word once for each list that ``find`` gives."""
    shared = words.sparkSession.sparkContext.broadcast(grams)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Dictionary(*shared.value)
        for batch in batches:
            if batch.num_rows:
                rows, keys = find(_Words(batch.column(2).to_pylist()), known)
                made = batch.take(pa.array(rows))
                yield pa.record_batch(
                    [pa.array(keys), made.column(0), made.column(1)], names=["key", "word", "n"]
                )

    return words.select("word", "n", "bytes").mapInArrow(run, "key bigint, word string, n bigint")


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, other, other_n) of all words (word, n) of ``MIN_LENGTH`` letters that are near, both ways."""
    words = words.withColumn("bytes", F.encode("word", "iso-8859-1"))
    grams = dictionary(words, words.count())
    listed = _rows_of(words, grams, _listed).select("key", F.col("word").alias("other"), F.col("n").alias("other_n"))
    asked = _rows_of(words, grams, _asked).select("key", "word")
    return (
        asked.join(listed, "key")
        .filter((F.col("word") != F.col("other")) & (F.levenshtein("word", "other", 1) == 1))
        .select("word", "other", "other_n")
        .distinct()
    )


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of words (word, form) that have a form: the last one that forms lead to.

    Each form occurs ``RATIO`` times as often as its word, so a chain of 64-bit counts is short, and
    each step doubles how far a word has come.
    """
    now = stage(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        made = now.join(ahead, "root", "left")
        made = stage(made.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if made.filter("moved").isEmpty():
            return made.select("word", "root")
        now = made.select("word", "root")


def spelling_variants(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_count: int = MIN_COUNT,
    ratio: int = RATIO,
) -> DataFrame:
    """(word, form, root, n, n_near, form_n): words of the texts, grouped by their usual spelling.

    Words are runs of ``A-Z a-z`` and U+00C0 to U+00FF of any length, lower-cased in A-Z only, of at
    least six letters and ``min_count`` occurrences; one run in 199, by a checksum of its id and
    itself, first loses a letter, as a planted error. ``form`` is the near word of most occurrences
    (ties: the smallest word) if those are ``ratio`` times the word's own, else NULL, as is
    ``form_n``; ``root`` is where forms lead in the end, the word itself if nowhere. A NULL id
    counts as an empty one, NULL and empty texts have no runs, repeated rows count each time, an
    empty table gives no rows. Other columns are not read.
    """
    words = stage(counted_words(docs, id_col, text_col, MIN_LENGTH, min_count), "words")
    best = F.min(F.struct((-F.col("other_n")).alias("less"), "other"))
    near = near_pairs(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    usual = F.when(-F.col("best.less") >= ratio * F.col("n"), F.col("best.other"))
    formed = stage(
        words.join(near, "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            usual.alias("form"),
            F.when(usual.isNotNull(), -F.col("best.less")).alias("form_n"),
        ),
        "forms",
    )
    led = roots(formed.filter(F.col("form").isNotNull()))
    return formed.join(led, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
