"""Quality rules: adaptive fences from mergeable quantile sketches per language and source.

Each text gets a few bounded measures in thousandths. The sketch of a measure in a group is its
histogram over the whole numbers up to ``BINS``: it has a fixed size, merges by addition, and its
quantiles are within one bin. Groups with few texts take the merged sketches of their language,
then of everything. A text is an outlier where a measure lies beyond the quartiles by more than
``REACH`` times the group's quartile distance. Only DataFrame functions run here.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medwarden.llm.common import SPACE, stage, text_of, trimmed, words_of

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = "#*$%&|<>"
# Bins of a sketch: measures are capped here, which only merges values far beyond any fence.
BINS = 2000
# Quartile distances a value may lie outside the quartiles.
REACH = 3
# Texts a group needs for fences of its own.
GROUP_ROWS = 100
# Measure -> (least quartile distance that counts, whether low values are outliers too). Most
# texts of a clean group share one value; the least distance keeps small differences harmless.
MEASURES = {
    "symbol_share": (10, False),
    "upper_share": (25, False),
    "repeat_share": (60, False),
    "dup_line_share": (150, False),
    "word_length": (50, True),
}


def _count(text: str, letters: str) -> Column:
    """Characters of ``text`` in a character class."""
    return F.length(F.regexp_replace(text, f"[^{letters}]+", "")).cast("long")


def text_counts(docs: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """The base counts of every text, as columns beside ``_id`` and ``more``.

    Three-word windows are compared by hash: of 64 bits, as many are kept as a position does not
    need, so two different windows of a text of n words agree with probability 2n / 2**64 at most.
    Everything stays within the row, so nothing is shuffled.
    """
    text = F.coalesce(F.col("_text"), F.lit(""))
    rows = text_of(docs, id_col, text_col, *more).select(
        "_id", *more, text.alias("_text"), words_of(text).alias("_words")
    )
    # Generate keeps the optimizer from copying the split into every lambda below.
    rows = rows.withColumn("_w", F.explode(F.array("_words"))).drop("_words")
    lines = F.filter(F.split("_text", "\n"), lambda x: F.length(trimmed(x)) > 0)
    rows = rows.select(
        "_id",
        *more,
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        _count("_text", SYMBOLS).alias("n_symbols"),
        _count("_text", "A-Z").alias("n_upper"),
        F.explode(F.array(lines)).alias("_lines"),
        "_w",
    )
    rows = rows.select(
        "_id",
        *more,
        "word_chars",
        "n_symbols",
        "n_upper",
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size("_w").cast("long").alias("n_words"),
        "_w",
        F.explode(
            F.array(
                F.expr(
                    "transform(slice(_w, 1, greatest(size(_w) - 2, 0)),"
                    " (w, i) -> xxhash64(w, get(_w, i + 1), get(_w, i + 2)))"
                )
            )
        ).alias("_h"),
    )
    # Hash above, position below, in one long: sorting brings equal windows together.
    rows = rows.withColumn("_bits", F.expr("length(bin(size(_h)))")).withColumn(
        "_k",
        F.expr(
            "explode(array(if(size(_h) = size(array_distinct(_h)), array(),"
            " sort_array(transform(_h, (h, i) -> shiftleft(h, _bits) | cast(i as bigint))))))"
        ),
    )
    same = "shiftright(k, _bits) = shiftright(get(_k, {j}), _bits)"
    rows = rows.withColumn(
        "_r",
        F.expr(
            "explode(array(sort_array(transform(filter(_k, (k, i) ->"
            f" coalesce({same.format(j='i + 1')}, false)"
            f" or coalesce({same.format(j='i - 1')}, false)),"
            " k -> int(k & (shiftleft(1L, _bits) - 1))))))"
        ),
    )
    covered = F.expr(
        "aggregate(transform(_r, (p, i) -> least(3, coalesce(get(_r, i + 1) - p, 3))), 0L,"
        " (a, x) -> a + x)"
    )
    return rows.select(
        "_id", *more, "n_words", "word_chars", "n_symbols", "n_dup_lines",
        covered.alias("n_repeat_words"), "n_upper", "n_lines",
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    )


def _measures(rows: DataFrame) -> DataFrame:
    def share(part: str, of: str, scale: int = 1000) -> Column:
        whole = F.expr(f"try_divide({scale} * {part}, {of})")
        return F.least(F.floor(F.coalesce(whole, F.lit(0))), F.lit(BINS)).cast("int")

    return rows.withColumns(
        {
            "symbol_share": share("n_symbols", "word_chars"),
            "upper_share": share("n_upper", "word_chars"),
            "repeat_share": share("n_repeat_words", "n_words"),
            "dup_line_share": share("n_dup_lines", "n_lines"),
            "word_length": share("word_chars", "n_words", 100),
        }
    )


def _quartiles(hist: DataFrame, keys: list[str]) -> DataFrame:
    """First and third quartile of every measure from histograms of (keys, measure, bin)."""
    merged = hist.groupBy(*keys, "measure", "bin").agg(F.sum("n").alias("n"))
    # At most BINS + 1 rows a group and measure, whatever the number of texts.
    bins = F.sort_array(F.collect_list(F.struct("bin", "n")))
    quartile = (
        "aggregate(b, struct(0L as seen, cast(null as int) as at), (a, x) -> struct("
        "a.seen + x.n as seen, coalesce(a.at, if(4 * (a.seen + x.n) >= {q} * total, x.bin, null))"
        " as at)).at"
    )
    return (
        merged.groupBy(*keys, "measure")
        .agg(bins.alias("b"), F.sum("n").alias("total"))
        .select(
            *keys, "measure", "total",
            F.expr(quartile.format(q=1)).alias("q1"), F.expr(quartile.format(q=3)).alias("q3"),
        )
    )


def fences(measured: DataFrame, lang_col: str = "_lang", source_col: str = "_source") -> DataFrame:
    """One row a (language, source) with the lowest and highest harmless value of every measure."""
    stacked = F.inline(
        F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("bin")) for m in MEASURES])
    )
    # Combined before the shuffle: at most BINS + 1 rows a group and measure.
    hist = stage(
        measured.select(lang_col, source_col, stacked)
        .groupBy(lang_col, source_col, "measure", "bin")
        .agg(F.count(F.lit(1)).alias("n")),
        "sketches",
    )
    own = _quartiles(hist, [lang_col, source_col])
    by_lang = _quartiles(hist, [lang_col]).select(
        F.col(lang_col).alias("_l"), F.col("measure").alias("_m"),
        F.col("total").alias("l_total"), F.col("q1").alias("l_q1"), F.col("q3").alias("l_q3"),
    )
    overall = _quartiles(hist, []).select(
        F.col("measure").alias("_om"), F.col("q1").alias("o_q1"), F.col("q3").alias("o_q3")
    )
    joined = own.join(
        by_lang, F.col(lang_col).eqNullSafe(F.col("_l")) & (F.col("measure") == F.col("_m"))
    ).join(F.broadcast(overall), F.col("measure") == F.col("_om"))  # a row a measure

    def pick(q: str) -> Column:
        return (
            F.when(F.col("total") >= GROUP_ROWS, F.col(q))
            .when(F.col("l_total") >= GROUP_ROWS, F.col(f"l_{q}"))
            .otherwise(F.col(f"o_{q}"))
        )

    least = reduce(
        lambda e, m: e.when(F.col("measure") == m, F.lit(MEASURES[m][0])),
        MEASURES,
        F.when(F.lit(False), F.lit(0)),
    )
    reach = REACH * F.greatest(pick("q3") - pick("q1"), least)
    low = F.col("measure").isin([m for m in MEASURES if MEASURES[m][1]])
    bound = joined.select(
        lang_col, source_col, "measure",
        F.when(low, pick("q1") - reach).otherwise(F.lit(0)).alias("lo"),
        (pick("q3") + reach).alias("hi"),
    )
    return bound.groupBy(lang_col, source_col).agg(
        *[
            F.max(F.when(F.col("measure") == m, F.col(c))).alias(f"{m}_{c}")
            for m in MEASURES
            for c in ("lo", "hi")
        ]
    )


def quality_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
) -> DataFrame:
    """Counts, base verdict and final verdict, one row per row of ``docs``.

    A NULL or empty text has no words and fails the base rules. NULL languages and sources are
    groups of their own. Repeated rows are judged one by one; an empty table gives no rows. The
    fences are taken from texts that pass the base rules.
    """
    rows = docs.select(
        id_col, text_col, F.col(lang_col).alias("_lang"), F.col(source_col).alias("_source")
    )
    counted = stage(
        _measures(text_counts(rows, id_col, text_col, "_lang", "_source")).withColumn(
            "base_failed", base_failed()
        ),
        "quality",
    )
    bounds = fences(counted.filter(~F.col("base_failed"))).withColumnsRenamed(
        {"_lang": "_fl", "_source": "_fs"}
    )
    outside = reduce(
        lambda a, b: a | b,
        [(F.col(m) < F.col(f"{m}_lo")) | (F.col(m) > F.col(f"{m}_hi")) for m in MEASURES],
    )
    judged = counted.join(
        bounds,
        F.col("_lang").eqNullSafe(F.col("_fl")) & F.col("_source").eqNullSafe(F.col("_fs")),
        "left",
    )
    kept = ~F.col("base_failed") & ~F.coalesce(outside, F.lit(False))
    return judged.select(
        F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines",
        "n_repeat_words", "base_failed", kept.alias("kept"), *MEASURES,
    )


SQL_SPACE = f"[{SPACE}]"
_SQL_COUNTS = f"""
WITH t AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS text,
    list_filter(string_split_regex(coalesce(text, ''), '{SQL_SPACE}+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)),
                lambda x: regexp_matches(x, '[^{SPACE}]')) AS lines
  FROM documents
), win AS (
  SELECT doc_id, p, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS p FROM t)
), dup AS (
  SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win
), rep AS (
  SELECT doc_id, count(DISTINCT q) AS n
  FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS q FROM dup WHERE c > 1) GROUP BY doc_id
), counts AS (
  SELECT t.doc_id, lang, source, len(w) AS n_words,
    length(regexp_replace(text, '{SQL_SPACE}', '', 'g')) AS word_chars,
    length(text) - length(translate(text, '{SYMBOLS}', '')) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    coalesce(rep.n, 0) AS n_repeat_words,
    length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) AS n_upper,
    len(lines) AS n_lines
  FROM t LEFT JOIN rep ON rep.doc_id = t.doc_id
), measured AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words
      AS base_failed,
    coalesce(least(1000 * n_symbols // nullif(word_chars, 0), {BINS}), 0) AS symbol_share,
    coalesce(least(1000 * n_upper // nullif(word_chars, 0), {BINS}), 0) AS upper_share,
    coalesce(least(1000 * n_repeat_words // nullif(n_words, 0), {BINS}), 0) AS repeat_share,
    coalesce(least(1000 * n_dup_lines // nullif(n_lines, 0), {BINS}), 0) AS dup_line_share,
    coalesce(least(100 * word_chars // nullif(n_words, 0), {BINS}), 0) AS word_length
  FROM counts
), long AS (
  UNPIVOT (SELECT lang, source, {", ".join(f"{m}::INT AS {m}" for m in MEASURES)}
           FROM measured WHERE NOT base_failed)
  ON {", ".join(MEASURES)} INTO NAME measure VALUE v
), own AS (
  SELECT lang, source, measure, count(*) AS n, quantile_disc(v, 0.25) AS q1,
    quantile_disc(v, 0.75) AS q3 FROM long GROUP BY ALL
), l AS (
  SELECT lang, measure, count(*) AS n, quantile_disc(v, 0.25) AS q1,
    quantile_disc(v, 0.75) AS q3 FROM long GROUP BY ALL
), o AS (
  SELECT measure, quantile_disc(v, 0.25) AS q1, quantile_disc(v, 0.75) AS q3
  FROM long GROUP BY ALL
), chosen AS (
  SELECT own.lang, own.source, own.measure,
    CASE WHEN own.n >= {GROUP_ROWS} THEN own.q1 WHEN l.n >= {GROUP_ROWS} THEN l.q1 ELSE o.q1 END
      AS q1,
    CASE WHEN own.n >= {GROUP_ROWS} THEN own.q3 WHEN l.n >= {GROUP_ROWS} THEN l.q3 ELSE o.q3 END
      AS q3
  FROM own JOIN l ON l.lang IS NOT DISTINCT FROM own.lang AND l.measure = own.measure
  JOIN o ON o.measure = own.measure
), spread AS (
  SELECT v.measure, v.least, v.low
  FROM (VALUES {", ".join(f"('{m}', {a}, {str(b).lower()})" for m, (a, b) in MEASURES.items())})
    AS v(measure, least, low)
), fence AS (
  SELECT lang, source, c.measure,
    CASE WHEN low THEN q1 - {REACH} * greatest(q3 - q1, least) ELSE 0 END AS lo,
    q3 + {REACH} * greatest(q3 - q1, least) AS hi
  FROM chosen c JOIN spread s ON s.measure = c.measure
)"""


def _sql_outside(measure: str) -> str:
    return (
        f"EXISTS (SELECT 1 FROM fence f WHERE f.measure = '{measure}'"
        " AND f.lang IS NOT DISTINCT FROM m.lang AND f.source IS NOT DISTINCT FROM m.source"
        f" AND (m.{measure} < f.lo OR m.{measure} > f.hi))"
    )


ORACLE = f"""{_SQL_COUNTS}
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars,
  n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND NOT ({" OR ".join(_sql_outside(m) for m in MEASURES)}) AS kept,
  {", ".join(f"{m}::INT AS {m}" for m in MEASURES)}
FROM measured m
"""
