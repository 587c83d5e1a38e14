"""Language identification: known words first, shorter and shorter character n-grams otherwise.

A known word scores by its log frequency in each language. A word no language knows is spelled out
by its longest known n-grams: each position backs off from ``ORDERS[0]`` characters down to one.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from medwarden.llm.common import stage, text_of

ORDERS = (5, 4, 3, 2, 1)
# Size of the fitted model: the most frequent words and n-grams of each language and order.
MAX_WORDS = 20_000
MAX_GRAMS = 5_000
# Languages a model tells apart, most frequent first.
MAX_LANGS = 200
# Distinct words a task counts before it passes its counts on.
_HELD = 200_000
# Scores of unseen words that a task remembers, in bytes, and words scored at once.
_REMEMBERED_BYTES = 16_000_000
_AT_ONCE = 10_000
UNKNOWN = "und"
# Words that decide a text are weighed as this many at most, so that scores stay short of certain.
_EVIDENCE = 20.0
_RUNS = re.compile(r"[^\W\d_]+")
_LETTERS = regex.compile(r"\p{L}+")


def held_out(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string")) % 4 == 2


def words(text: str) -> list[str]:
    """Runs of letters, in lower case."""
    found = _RUNS.findall(text.lower())
    if all(map(str.isalpha, found)):
        return found
    # A run may hold signs that count as alphanumeric but are no letters.
    return [w for run in found for w in ([run] if run.isalpha() else _LETTERS.findall(run))]


def grams(word: str) -> Iterator[str]:
    padded = f" {word} "
    for n in ORDERS:
        yield from (padded[i : i + n] for i in range(len(padded) - n + 1))


_COUNTED = "lang string, word string, n bigint"


def _passed_on(held: dict[str, Counter]) -> pa.RecordBatch:
    """The counts held so far as rows; ``held`` is empty afterwards."""
    rows = [(lang, w, n) for lang, c in held.items() for w, n in c.items()]
    held.clear()
    lang, word, n = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.record_batch(
        [pa.array(lang, pa.string()), pa.array(word, pa.string()), pa.array(n, pa.int64())],
        names=["lang", "word", "n"],
    )


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, Counter] = defaultdict(Counter)
    for batch in batches:
        for text, lang in zip(batch.column(0), batch.column(1), strict=True):
            held[lang.as_py()].update(words(text.as_py()))
            if sum(map(len, held.values())) > _HELD:
                yield _passed_on(held)
    yield _passed_on(held)


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, Counter] = defaultdict(Counter)
    for batch in batches:
        for lang, word, n in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            counter = held[lang]
            for g in grams(word):
                counter[g] += n
            if len(counter) > _HELD:
                yield _passed_on(held)
    yield _passed_on(held)


class Model:
    """Log frequencies by language; small by the limits above, so it travels with the tasks."""

    def __init__(self, langs: list[str], known: dict[str, list[float]], spelled: dict):
        self.langs, self.known, self.spelled = langs, known, spelled
        width = max(1, len(langs))
        self._most = len(known) + _REMEMBERED_BYTES // (4 * width)
        self._scores = np.zeros((max(1024, 2 * len(known)), width), np.float32)
        if known:
            self._scores[: len(known)] = list(known.values())
        self._row = {w: i for i, w in enumerate(known)}
        self._grams = np.array([[0.0] * width, *spelled.values()], np.float32)
        self._gram_row = {g: i for i, g in enumerate(spelled, 1)}

    def _spell(self, word: str) -> list[int]:
        """Rows of the longest known n-gram at each position; at least the neutral row."""
        padded, get = f" {word} ", self._gram_row.get
        found = []
        for i in range(len(padded)):
            for n in ORDERS:
                if (row := get(padded[i : i + n])) is not None:
                    found.append(row)
                    break
        return found or [0]

    def _learn(self, unseen: list[str]) -> None:
        """Score words by their n-grams: the mean over positions, so that a long unseen word weighs
        as much as a known one."""
        rows = [self._spell(w) for w in unseen]
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        flat = np.fromiter((r for x in rows for r in x), np.int64, sizes.sum())
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        means = np.add.reduceat(self._grams[flat], starts, axis=0) / sizes[:, None]
        first = len(self._row)
        if first + len(unseen) > len(self._scores):
            grown = np.zeros((2 * (first + len(unseen)), self._scores.shape[1]), np.float32)
            grown[:first] = self._scores[:first]
            self._scores = grown
        self._scores[first : first + len(unseen)] = means
        self._row.update(zip(unseen, range(first, first + len(unseen)), strict=True))

    def scores(self, found: list[str]) -> np.ndarray:
        """A row of log frequencies for each word."""
        rows = list(map(self._row.get, found))
        if None in rows:
            unseen = {w for w, r in zip(found, rows, strict=True) if r is None}
            if len(self._row) + len(unseen) > self._most:
                self._row = {w: i for i, w in enumerate(self.known)}
                unseen = set(found) - self._row.keys()
            self._learn(list(unseen))
            rows = list(map(self._row.get, found))
        return self._scores[rows]

    def predict(self, text: str | None) -> tuple[str, float]:
        found = words(text or "")
        if not found or not self.langs:
            return UNKNOWN, 0.0
        total = np.zeros(len(self.langs))
        for start in range(0, len(found), _AT_ONCE):
            total += self.scores(found[start : start + _AT_ONCE]).sum(axis=0, dtype=np.float64)
        total *= min(1.0, _EVIDENCE / len(found))
        odds = np.exp(total - total.max())
        best = int(np.argmax(total))
        return self.langs[best], float(odds[best] / odds.sum())


def _logs(rows: list, langs: list[str], totals: dict[str, int]) -> dict[str, list[float]]:
    """Entry -> log frequency by language, one smoothing count for each distinct entry."""
    seen = defaultdict(dict)
    for r in rows:
        seen[r.word][r.lang] = r.n
    distinct = len(seen) or 1
    base = [math.log(totals.get(lang, 0) + distinct) for lang in langs]
    return {
        w: [math.log(c.get(lang, 0) + 1) - b for lang, b in zip(langs, base, strict=True)]
        for w, c in seen.items()
    }


def _top(counts: DataFrame, keys: list[str], most: int) -> DataFrame:
    """The ``most`` rows of highest n in each group, ties by word.

    Buckets by word are cut first, in many tasks, so a group's own task gets a bounded list.
    """
    order = [F.desc("n"), "word"]
    bucket = F.pmod(F.xxhash64("word"), F.lit(64))
    part = counts.withColumn(
        "_r", F.row_number().over(Window.partitionBy(*keys, bucket).orderBy(*order))
    ).filter(F.col("_r") <= most)
    return part.withColumn(
        "_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    ).filter(F.col("_r") <= most)


def _kept(counts: DataFrame, keys: list[str], most: int) -> DataFrame:
    """All languages' counts of the entries that are among the ``most`` frequent of any group."""
    return counts.join(_top(counts, keys, most).select("word").distinct(), "word", "left_semi")


def fit(rows: DataFrame) -> Model:
    """Model of (text, lang) rows. Every row is counted; only the most frequent entries of each
    language are kept, with their counts in every language."""
    counted = stage(
        rows.filter(F.col("text").isNotNull() & F.col("lang").isNotNull())
        .select("text", F.col("lang").cast("string").alias("lang"))
        .mapInArrow(_count_words, _COUNTED)
        .groupBy("lang", "word")
        .agg(F.sum("n").alias("n")),
        "words",
    )
    spelled = stage(
        counted.mapInArrow(_count_grams, _COUNTED)
        .groupBy("lang", "word")
        .agg(F.sum("n").alias("n")),
        "grams",
    ).withColumn("size", F.length("word"))
    sizes = counted.groupBy("lang").agg(F.sum("n").alias("n"))
    totals = {
        r.lang: int(r.n) for r in sizes.orderBy(F.desc("n"), "lang").limit(MAX_LANGS).collect()
    }
    langs = sorted(totals)
    wanted = F.col("lang").isin(langs)
    # Frequency ranks of words with one row per language fit by design: MAX_WORDS each.
    known = _logs(_kept(counted.filter(wanted), ["lang"], MAX_WORDS).collect(), langs, totals)
    gram_totals = defaultdict(dict)
    for r in spelled.filter(wanted).groupBy("lang", "size").agg(F.sum("n").alias("n")).collect():
        gram_totals[r["size"]][r.lang] = int(r.n)
    by_size = defaultdict(list)
    for r in _kept(spelled.filter(wanted), ["lang", "size"], MAX_GRAMS).collect():
        by_size[r["size"]].append(r)
    grams_known = {}
    for size, found in by_size.items():
        grams_known |= _logs(found, langs, gram_totals[size])
    return Model(langs, known, grams_known)


def predict(docs: DataFrame, model: Model, id_col: str, text_col: str) -> DataFrame:
    """(_id, lang_pred, score): the text alone decides."""
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.known, model.spelled))
    rows = text_of(docs, id_col, text_col)
    id_field = T.StructField("_id", rows.schema["_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in batches:
            found = [own.predict(t.as_py()) for t in batch.column(1)]
            yield pa.record_batch(
                [batch.column(0), pa.array([x for x, _ in found], pa.string()),
                 pa.array([x for _, x in found], pa.float64())],
                names=["_id", "lang_pred", "score"],
            )

    return rows.mapInArrow(
        run,
        T.StructType([id_field, T.StructField("lang_pred", T.StringType()),
                      T.StructField("score", T.DoubleType())]),
    )


def language_id(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """(id, held_out, lang_pred, score) per row, learned from the rows that are not held out.

    A NULL text, or one without a letter, is ``und`` with score 0, as is everything where no row
    has a language to learn from. A NULL id is not held out. Repeated rows are predicted alike;
    an empty table gives no rows.
    """
    out = F.coalesce(held_out(id_col), F.lit(False))
    known = docs.filter(~out).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    found = predict(docs, fit(known), id_col, text_col).withColumnRenamed("_id", id_col)
    return found.select(id_col, out.alias("held_out"), "lang_pred", "score")
