"""A stored inverted index for keyword search, built once and kept fresh by segments.

A segment holds the texts of a corpus (``texts``), its rows without their texts (``docs``, by bucket of
the key) and the postings of the texts (by bucket of the term). Rows with the same key and text, as of
a case with several reports, share one text, which is stored and indexed once and counts for all of
them. The postings of a term are cut into blocks of ``1 << BLOCK_BITS`` neighbouring texts; each block
states for how many rows of the corpus it counts, its highest count and its shortest length, and so
the most any of its texts can score. A search reads the buckets of the words it asks for, scores the
blocks of the highest bounds first and then only those that can still reach the ``k``-th score.

A later segment replaces the rows of its keys: it marks the texts that are dead in older segments, and
what they counted for. ``compact`` writes all live rows as one new segment. A segment counts from when
its line of ``stats``, written last, is there; writing it again replaces it.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from medwarden.functions.text import tokens
from medwarden.operators.search import bm25_idf, bm25_saturated, sum_ascending
from medwarden.session import dropped_shuffles

BUCKETS, BLOCK_BITS = 64, 12
# monotonically_increasing_id has the number of the task in the bits from this one on.
_TASK_BIT = 33

# The row of an entry is its place in the block.
_POSTINGS = (
    "term string, _block bigint, n bigint, max_tf bigint, min_length int, "
    "entries array<struct<row: int, tf: int, length: int>>, _segment int, _bucket int"
)
_TEXT = "_text string, _copies bigint, _length int, _hash bigint, _row bigint, _segment int, _task int"
_DEAD = "in_segment int, row bigint, length int, copies bigint, _segment int"
_DEAD_TERMS = "term string, n bigint, _segment int"
_STATS = "n bigint, length bigint, base boolean, key string, docs string, _segment int"


def _bucket(column: Column) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(BUCKETS)).cast("int")


def _read(spark: SparkSession, root: str, table: str, schema: str | T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{root}/{table}")


@dataclass(frozen=True)
class _Live:
    """What readers see of an index: its segments since the last compaction."""

    segments: list[int]
    n: int
    length: int
    key: str
    docs: T.StructType

    @property
    def texts(self) -> T.StructType:
        return T.StructType([self.docs[self.key], *T.StructType.fromDDL(_TEXT).fields])

    @property
    def columns(self) -> list[str]:
        return [c for c in self.docs.names if not c.startswith("_")]


def _live(spark: SparkSession, root: str) -> _Live:
    # One line a segment; compaction bounds their number.
    lines = sorted(_read(spark, root, "stats", _STATS).collect(), key=lambda r: r["_segment"])
    base = max((r["_segment"] for r in lines if r.base), default=0)
    lines = [r for r in lines if r["_segment"] >= base]
    segments = [r["_segment"] for r in lines]
    lost = F.sum("copies").alias("n"), F.sum(F.col("length") * F.col("copies")).alias("length")
    dead = _dead(spark, root, segments).agg(*lost).first()
    return _Live(
        segments,
        sum(r.n for r in lines) - (dead.n or 0),
        sum(r.length for r in lines) - (dead.length or 0),
        lines[0].key,
        T.StructType.fromJson(json.loads(lines[0].docs)),
    )


def _dead(spark: SparkSession, root: str, segments: Sequence[int]) -> DataFrame:
    """(in_segment, row, length, copies) of replaced texts of live segments."""
    of_live = F.col("_segment").isin(list(segments)) & F.col("in_segment").isin(list(segments))
    return _read(spark, root, "dead", _DEAD).filter(of_live).drop("_segment")


def _live_docs(spark: SparkSession, root: str, live: _Live) -> DataFrame:
    docs = _read(spark, root, "docs", live.docs).filter(F.col("_segment").isin(live.segments))
    dead = _dead(spark, root, live.segments).select(F.col("in_segment").alias("_segment"), F.col("row").alias("_row"))
    return docs.join(dead, ["_segment", "_row"], "left_anti").select(docs.columns)


def _task(row: str, parts: int) -> Column:
    """Which of ``parts`` the task that wrote a text belongs to."""
    return F.pmod(F.shiftright(row, _TASK_BIT), F.lit(parts)).cast("int")


def _marks(rows: DataFrame) -> DataFrame:
    """(_segment, _words, bits) of rows (_segment, _row): a bit a row, 64 to a number, 64 of those a line."""
    word = rows.groupBy("_segment", F.shiftright("_row", 6).alias("_word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(_row & 63 as int))")).alias("bits")
    )
    bits = F.map_from_entries(F.collect_list(F.struct(F.col("_word").bitwiseAND(63).alias("at"), "bits")))
    return word.groupBy("_segment", F.shiftright("_word", 6).alias("_words")).agg(bits.alias("bits"))


def _marked(texts: DataFrame, rows: DataFrame) -> DataFrame:
    """The texts that are among rows (_segment, _row). Bits of the rows go to the texts, which stay."""
    near = texts.withColumn("_words", F.shiftright("_row", 12)).join(F.broadcast(_marks(rows)), ["_segment", "_words"])
    bit = F.expr("getbit(bits[shiftright(_row, 6) & 63], cast(_row & 63 as int))")
    return near.filter(bit == 1).select(texts.columns)


def _write(df: DataFrame, root: str, table: str, segment: int, by: str | None = None) -> None:
    """Replace a segment of a table, in folders ``by`` a column."""
    writer = df.write if by is None else df.write.partitionBy(by)
    writer.mode("overwrite").option("compression", "zstd").parquet(f"{root}/{table}/_segment={segment}")


def _postings(docs: DataFrame, copies: Column | None = None) -> DataFrame:
    """The blocks of each term; ``copies`` is the number of rows of the corpus that have the text.

    Entries are shuffled once: to the bucket of the term, in parts by the task that wrote the text, so
    that a block is in one part and a bucket in a few files.
    """
    parts = -(-4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) // BUCKETS)
    copies = (F.lit(1) if copies is None else copies).cast("long").alias("_copies")
    # Each row counts its own words, so only a word's entry is shuffled, not all its occurrences.
    # explode_outer: otherwise the optimizer splits and sorts each text again where it is used.
    words = docs.select("_row", "_length", copies, F.explode_outer(F.array(F.array_sort(tokens(F.col("_text"))))).alias("_words"))
    runs = F.transform("_words", lambda w, i: F.when((i == 0) | (w != F.get("_words", i - 1)), i))
    starts = words.select("*", F.explode_outer(F.array(F.array_compact(runs))).alias("_at"))
    ends = F.concat(F.slice("_at", 2, F.size("_at")), F.array(F.size("_words")))
    word = F.zip_with(
        "_at", ends, lambda a, e: F.struct(F.get("_words", a).alias("term"), (e - a).cast("long").alias("tf"))
    )
    counted = (
        starts.select("_row", "_length", "_copies", F.explode_outer(word).alias("_w"))
        .select("_row", "_length", "_copies", "_w.term", "_w.tf")
        .filter(F.col("term").isNotNull())
        .withColumns({"_bucket": _bucket(F.col("term")), "_part": _task("_row", parts)})
        .repartition("_bucket", "_part")
    )
    place = F.col("_row").bitwiseAND((1 << BLOCK_BITS) - 1).cast("int")
    entry = F.struct(place.alias("row"), F.col("tf").cast("int").alias("tf"), F.col("_length").alias("length"))
    return counted.groupBy("_bucket", "_part", "term", F.shiftright("_row", BLOCK_BITS).alias("_block")).agg(
        F.sum("_copies").alias("n"),
        F.max("tf").alias("max_tf"),
        F.min("_length").alias("min_length"),
        F.sort_array(F.collect_list(entry)).alias("entries"),
    ).drop("_part")


def write_segment(
    corpus: DataFrame,
    root: str,
    segment: int = 0,
    key: str = "case_id",
    cols: Sequence[str] = (),
    text_col: str = "narrative_text",
    replaced: DataFrame | None = None,
    base: bool = False,
) -> None:
    """Add the rows of ``corpus`` as a segment of the index in folder ``root``.

    ``cols`` are kept for filters and results. Rows without a text are not found and not kept. All
    older rows whose key is among ``replaced`` (default: the keys of ``corpus``) go. Segments are
    numbered in ascending order from 0; the same number again, as in a retry, replaces the segment.
    ``base`` hides all older segments. Column names must not begin with an underscore.
    ``corpus`` is read twice, for its texts and for its rows, and has to give the same rows each time.
    """
    spark = corpus.sparkSession
    out = list(dict.fromkeys([key, *cols]))
    if any(c.startswith("_") for c in out):
        raise ValueError("names that begin with an underscore are the index's own")
    with dropped_shuffles(spark):
        _write_segment(corpus, root, segment, key, out, text_col, replaced, base)


def _write_segment(
    corpus: DataFrame,
    root: str,
    segment: int,
    key: str,
    out: Sequence[str],
    text_col: str,
    replaced: DataFrame | None,
    base: bool,
) -> None:
    spark, of_segment = corpus.sparkSession, F.col("_segment") == segment
    text = F.col(text_col)
    rows = corpus.filter(text.isNotNull()).select(*out, text.alias("_text"))
    # Numbered where they are written: later reads see the numbers that were stored.
    written = (
        rows.groupBy(key, "_text")
        .agg(F.count(F.lit(1)).alias("_copies"))
        .withColumns({"_length": F.size(tokens(F.col("_text"))), "_hash": F.xxhash64("_text")})
        .withColumn("_row", F.monotonically_increasing_id())
        .withColumn("_task", _task("_row", BUCKETS))
    )
    _write(written, root, "texts", segment, "_task")
    # A text is told from others of its key by a hash, so that rows find theirs without it.
    known = T.StructType([written.schema[key], *T.StructType.fromDDL(_TEXT).fields])
    texts = _read(spark, root, "texts", known).filter(of_segment)
    ids = texts.select(F.col(key).alias("_key"), F.col("_hash").alias("_of"), "_row", "_length")
    same = F.col(key).eqNullSafe(F.col("_key")) & (F.col("_hash") == F.col("_of"))
    docs = rows.select(*out, F.xxhash64("_text").alias("_hash")).join(ids, same).select(
        *out, _bucket(F.col(key)).alias("_key_bucket"), "_length", "_row"
    )
    schema = T.StructType([*docs.schema.fields, T.StructField("_segment", T.IntegerType())])
    # Adaptive execution cuts large buckets and joins small ones.
    _write(docs.hint("rebalance", "_key_bucket"), root, "docs", segment, "_key_bucket")
    docs = _read(spark, root, "docs", schema).filter(of_segment)
    _write(_postings(texts, F.col("_copies")), root, "postings", segment, "_bucket")
    older = None if base or segment == 0 else _live_before(spark, root, segment)
    if older is not None:
        touched = (docs if replaced is None else replaced).select(key).distinct()
        # At most BUCKETS numbers: only these folders of the older segments are read.
        at = [r[0] for r in touched.select(_bucket(F.col(key))).distinct().collect()]
        gone = _live_docs(spark, root, older).filter(F.col("_key_bucket").isin(at)).join(touched, key, "left_semi")
        gone = gone.groupBy(F.col("_segment").alias("in_segment"), F.col("_row").alias("row")).agg(
            F.first("_length").alias("length"), F.count(F.lit(1)).alias("copies")
        )
        _write(gone, root, "dead", segment)
        dead = _read(spark, root, "dead", _DEAD).filter(of_segment)
        dead = dead.select(F.col("in_segment").alias("_segment"), F.col("row").alias("_row"))
        at = [r[0] for r in dead.select(_task("_row", BUCKETS)).distinct().collect()]
        here = F.col("_segment").isin(older.segments) & F.col("_task").isin(at)
        lost = _marked(_read(spark, root, "texts", older.texts).filter(here), dead)
        terms = lost.select("_copies", F.explode(F.array_distinct(tokens(F.col("_text")))).alias("term"))
        _write(terms.groupBy("term").agg(F.sum("_copies").alias("n")), root, "dead_terms", segment)
    else:
        for table, form in (("dead", _DEAD), ("dead_terms", _DEAD_TERMS)):
            _write(spark.createDataFrame([], form).drop("_segment"), root, table, segment)
    stats = texts.agg(
        F.coalesce(F.sum("_copies"), F.lit(0)).cast("long").alias("n"),
        F.coalesce(F.sum(F.col("_length") * F.col("_copies")), F.lit(0)).cast("long").alias("length"),
        F.lit(base).alias("base"),
        F.lit(key).alias("key"),
        F.lit(schema.json()).alias("docs"),
    )
    _write(stats, root, "stats", segment)


def _live_before(spark: SparkSession, root: str, segment: int) -> _Live | None:
    """The index without ``segment`` and what came after, as a retry finds it."""
    live = _live(spark, root)
    segments = [s for s in live.segments if s < segment]
    return _Live(segments, 0, 0, live.key, live.docs) if segments else None


def compact(spark: SparkSession, root: str) -> int:
    """Write all live rows as one new segment, which hides the older ones; its number."""
    live = _live(spark, root)
    number = live.segments[-1] + 1
    cols = [c for c in live.columns if c != live.key]
    texts = _read(spark, root, "texts", live.texts).select("_segment", "_row", "_text")
    rows = _live_docs(spark, root, live).join(texts, ["_segment", "_row"])
    write_segment(rows, root, number, live.key, cols, "_text", base=True)
    return number


def search_index(
    spark: SparkSession,
    root: str,
    queries: DataFrame,
    k: int = 5,
    filters: Mapping[str, str] | None = None,
    cols: Sequence[str] = (),
) -> DataFrame:
    """(query_id, key, ``cols``, score, rank): what ``search_batch`` gives for the live rows.

    Queries are rows (query_id, query). Blocks that cannot reach a query's ``k``-th score are not
    scored. With filters, which the blocks know nothing of, that score is that of matching rows.
    """
    live = _live(spark, root)
    out = list(dict.fromkeys([live.key, *cols]))
    asked = queries.select(
        "query_id", F.explode(F.array_distinct(tokens(F.col("query")))).alias("term")
    ).distinct()
    # At most BUCKETS numbers: the folders that are read.
    at = [r[0] for r in asked.select(_bucket(F.col("term"))).distinct().collect()]
    here = F.col("_segment").isin(live.segments)
    postings = _read(spark, root, "postings", _POSTINGS).filter(here & F.col("_bucket").isin(at)).drop("_bucket")
    dead = _dead(spark, root, live.segments).select(F.col("in_segment").alias("_segment"), F.col("row").alias("_row"))
    gone = _read(spark, root, "dead_terms", _DEAD_TERMS).filter(here).select("term", (-F.col("n")).alias("n"))

    vocabulary = asked.select("term").distinct()
    frequency = (
        postings.select("term", "n").unionByName(gone).join(vocabulary, "term").groupBy("term").agg(F.sum("n").alias("df"))
    )
    mean = F.lit(live.length / live.n if live.n else 0.0)
    weighted = (
        asked.join(frequency, "term")
        .filter(F.col("df") > 0)
        .select("query_id", "term", bm25_idf(F.lit(live.n), F.col("df")).alias("idf"))
    )
    most = F.col("idf") * bm25_saturated(F.col("max_tf"), F.col("min_length"), mean)
    # A hair above, as sums of other order may differ in their last digits.
    bounds = (
        postings.select("term", "_segment", "_block", "max_tf", "min_length")
        .join(weighted, "term")
        .groupBy("query_id", "_segment", "_block")
        .agg((F.sum(most) * (1 + 1e-9)).alias("bound"))
    )
    wanted = F.lit(True)
    for column, value in (filters or {}).items():
        wanted = wanted & F.coalesce(F.col(column) == value, F.lit(False))
    docs = _read(spark, root, "docs", live.docs).filter(here)
    matching = docs.filter(wanted).select("_segment", "_row")

    def scored(blocks: DataFrame) -> DataFrame:
        """(query_id, _segment, _row, score) of the live texts of the blocks."""
        part = F.col("idf") * bm25_saturated(F.col("e.tf"), F.col("e.length"), mean)
        hits = (
            blocks.select("query_id", "_segment", "_block")
            .join(weighted, "query_id")
            .join(postings.select("term", "_segment", "_block", "entries"), ["term", "_segment", "_block"])
            .select("query_id", "_segment", "_block", "idf", F.explode("entries").alias("e"))
            .groupBy("query_id", "_segment", (F.shiftleft("_block", BLOCK_BITS) + F.col("e.row")).alias("_row"))
            .agg(sum_ascending(part).alias("score"))
            .join(dead, ["_segment", "_row"], "left_anti")
        )
        return hits.join(matching, ["_segment", "_row"], "left_semi") if filters else hits

    by_bound = Window.partitionBy("query_id").orderBy(F.desc("bound"), "_segment", "_block")
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"))
    # Each block has a text at least, so the first k of them have k rows, if all are live and match.
    first = bounds.withColumn("o", F.row_number().over(by_bound)).filter(F.col("o") <= k)
    enough = (
        scored(first)
        .withColumn("o", F.row_number().over(by_score))
        .filter(F.col("o") == k)
        .select("query_id", F.col("score").alias("least"))
    )
    left = bounds.join(enough, "query_id", "left").filter(F.coalesce(F.col("bound") >= F.col("least"), F.lit(True)))
    # Ties at the k-th place stay until the columns that break them are there.
    best = scored(left).withColumn("o", F.rank().over(by_score)).filter(F.col("o") <= k).drop("o")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), *out)
    return (
        best.join(docs.filter(wanted).select("_segment", "_row", *out), ["_segment", "_row"])
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("query_id", *out, F.round("score", 6).alias("score"), "rank")
    )
