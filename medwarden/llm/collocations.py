"""Phrase collocations from FM-indexes over word ids.

1. Each task packs its texts into shards of one language and stores an FM-index of each: the word
   before (``bwt``) and the word after (``rbwt``) every place, in the order of what follows the
   place and of what precedes it. No phrase is longer than ``DEPTH`` words, so that order looks at
   ``DEPTH`` words only.
2. Words are counted from the shards' counts. The words of an interval in ``bwt`` extend its
   phrase to the left, those of the interval kept beside it in ``rbwt`` extend it to the right:
   words grow to pairs, and pairs to three words, each with its count.
3. Counts are summed across shards level by level. What stays below ``MIN_COUNT`` is not extended
   again: bitmaps of fixed size tell the shards what is frequent. Longer phrases, which are many,
   are summed by their hashes for that. Bitmaps and hashes may let more through, but never less;
   the sums over the words themselves decide.

Texts are read once; later steps read the stored indexes. Counts are shuffled as compressed blocks
of sorted rows, one a shard and bucket; there are as many buckets as the words need.
"""

from __future__ import annotations

from array import array
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from medwarden.llm.common import bitmap, bits_set, stage

MIN_COUNT, TOP = 10, 2000
DEPTH = 3
# A candidate goes where a longer one has this share of its occurrences, in percent.
ABSORBED = 50
SCALE = 1_000_000
# Words a task holds, over all languages, before it closes its largest shard.
SHARD = 3 << 19
# Stored indexes a file holds, so that what is read at once is bounded.
_PER_FILE = 4
# Rows of a batch.
_ROWS = 1 << 16
# Bits of a phrase's hash that are shuffled, and words a bucket of them is for.
KEY_BITS, BUCKET = 48, 1 << 23
# Between pieces; no UTF-8 text has this byte.
_END = b"\xff"
_MARKS = bytes.maketrans(b".,;:!?\x0a\x0b\x0c\x0d\x09", _END * 10 + b" ")
# Parts over which a language's candidates are dealt before its first ones are chosen.
_PARTS = 64

_INDEX = "lang string, words array<string>, counts array<bigint>, bwt binary, rbwt binary"


def order_of(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Stable order of the rows (a, b, c) of small non-negative ids."""
    if max(int(a.max()), int(b.max()), int(c.max())) < 1 << 21:
        return np.argsort((a << 42) | (b << 21) | c, kind="stable")
    return np.lexsort((c, b, a))


def fm_index(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bwt, rbwt) of ids that begin and end with 0, to a depth of three ids."""
    padded = np.concatenate([[0, 0], text, [0, 0]]).astype(np.int64)
    here, n = padded[2:-2], len(text)
    before, before2 = padded[1 : n + 1], padded[:n]
    after, after2 = padded[3 : n + 3], padded[4:]
    bwt = before[order_of(here, after, after2)]
    rbwt = after[order_of(here, before, before2)]
    return bwt.astype(np.int32), rbwt.astype(np.int32)


class _Shard:
    """Ids of the words of one language; 0 stands between pieces."""

    def __init__(self) -> None:
        self.ids: defaultdict[bytes, int] = defaultdict()
        self.ids.default_factory = self.ids.__len__
        self.text = array("i", [self.ids[_END]])

    def add(self, text: bytes) -> None:
        marked = text.lower().translate(_MARKS).replace(_END, b" \xff ")
        self.text.extend(map(self.ids.__getitem__, marked.split()))
        self.text.append(0)

    def stored(self, lang: str) -> pa.RecordBatch:
        text = np.frombuffer(self.text, np.int32)
        bwt, rbwt = fm_index(text)
        # Id 0 is no word; its name is empty here.
        words = pa.array([b"", *list(self.ids)[1:]], pa.binary()).view(pa.string())
        counts = np.bincount(text, minlength=len(self.ids))
        ends = pa.array([0, len(words)], pa.int32())
        return pa.record_batch(
            [
                pa.array([lang]),
                pa.ListArray.from_arrays(ends, words),
                pa.ListArray.from_arrays(ends, pa.array(counts, pa.int64())),
                pa.array([bwt.tobytes()], pa.binary()),
                pa.array([rbwt.tobytes()], pa.binary()),
            ],
            names=["lang", "words", "counts", "bwt", "rbwt"],
        )


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shards: dict[str, _Shard] = {}
    held = 0
    for batch in batches:
        for lang, text in zip(*batch.columns, strict=True):
            shard = shards.setdefault(lang.as_py(), _Shard())
            held -= len(shard.text)
            shard.add(text.as_py())
            held += len(shard.text)
            if held >= SHARD:
                full = max(shards, key=lambda x: len(shards[x].text))
                held -= len(shards[full].text)
                yield shards.pop(full).stored(full)
    while shards:
        lang, shard = shards.popitem()
        yield shard.stored(lang)


def indexes(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """The stored FM-indexes of all texts: rows (lang, words, counts, bwt, rbwt)."""
    rows = docs.select(
        F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
        F.encode(F.col(text_col), "utf-8").alias("text"),
    ).filter(F.col("text").isNotNull())
    made = rows.mapInArrow(_indexed, _INDEX)
    return stage(made, "indexes", maxRecordsPerFile=_PER_FILE, compression="zstd")


def _hash(words: list[bytes], lang: str) -> np.ndarray:
    seed = xxhash.xxh32_intdigest(lang.encode())
    return np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in words), np.uint64, len(words))


def _pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b + np.uint64(0x632BE59BD9B4E019))
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hash of each row (lang, word)."""
    for batch in batches:
        rows = zip(*(c.to_pylist() for c in batch.columns), strict=True)
        made = np.fromiter((_hash([w.encode()], lang)[0] for lang, w in rows), np.uint64, batch.num_rows)
        yield pa.record_batch([pa.array(made.view(np.int64))], names=["key"])


class _Opened:
    """One shard's index, opened for interval extension."""

    def __init__(self, lang: str, words: pa.Array, bwt: bytes, rbwt: bytes) -> None:
        self.words = words
        self.hash = _hash(words.cast(pa.binary()).to_pylist(), lang)
        self.bwt, self.rbwt = np.frombuffer(bwt, np.int32), np.frombuffer(rbwt, np.int32)
        size = len(words)
        counts = np.bincount(self.bwt, minlength=size)
        # Rows of one first word are an interval; extending it to the left by its words gives pairs.
        first = np.repeat(np.arange(size, dtype=np.int64), counts)
        made, self.count = np.unique(first * size + self.bwt, return_counts=True)
        self.right, self.left = np.divmod(made, size)
        self.pair_hash = _pair_hash(self.hash[self.left], self.hash[self.right])

    def pairs(self, frequent: np.ndarray) -> np.ndarray:
        """Which of the pairs have two frequent words."""
        usual = bits_set(frequent, self.hash)
        usual[0] = False
        return usual[self.left] & usual[self.right]

    def starts(self) -> tuple[np.ndarray, np.ndarray]:
        """Where the intervals of the pairs begin in the order of ``bwt`` and of ``rbwt``."""
        by_left = np.lexsort((self.right, self.left))
        ahead = np.empty(len(by_left), np.int64)
        ahead[by_left] = np.cumsum(self.count[by_left]) - self.count[by_left]
        # The pairs stand in order of their right word, as the places of ``rbwt`` do.
        return ahead, np.cumsum(self.count) - self.count

    def extended(
        self, symbols: np.ndarray, pair: np.ndarray, start: np.ndarray, usual: Callable
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pair, word, count) of the words of the pairs' intervals for which ``usual`` holds."""
        count = self.count[pair]
        ends = np.cumsum(count)
        at = np.repeat(start[pair] - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)
        word, pair = symbols[at].astype(np.int64), np.repeat(pair, count)
        use = word > 0
        word, pair = word[use], pair[use]
        use = usual(word, pair)
        made, n = np.unique(pair[use] * len(self.words) + word[use], return_counts=True)
        return made // len(self.words), made % len(self.words), n


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, _Opened]]:
    for batch in batches:
        for i in range(batch.num_rows):
            lang, words, bwt, rbwt = (column[i] for column in batch.columns)
            yield lang.as_py(), _Opened(lang.as_py(), words.values, bwt.as_py(), rbwt.as_py())


_STORED = ["lang", "words", "bwt", "rbwt"]


_BLOCKS = "bucket int, block binary"


def _packed(columns: dict[str, pa.Array]) -> bytes:
    """One compressed block of one row of lists, which may differ in length."""
    made = {}
    for name, column in columns.items():
        ends = pa.array([0, len(column)], pa.int32())
        made[name] = pa.ListArray.from_arrays(ends, column)
    row = pa.record_batch(made)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, row.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(row)
    return sink.getvalue().to_pybytes()


def _unpacked(block: pa.Scalar) -> dict[str, pa.Array]:
    row = pa.ipc.open_stream(block.as_buffer()).read_next_batch()
    return {name: row.column(i)[0].values for i, name in enumerate(row.schema.names)}


def _dealt(bucket: np.ndarray, buckets: int, pack: Callable[[np.ndarray], bytes]) -> Iterator[pa.RecordBatch]:
    """(bucket, block): what ``pack`` makes of the rows of each bucket, in their order."""
    order = np.argsort(bucket, kind="stable")
    ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
    at = np.flatnonzero(np.diff(ends))
    made = [pack(order[ends[i] : ends[i + 1]]) for i in at.tolist()]
    if made:
        yield pa.record_batch([pa.array(at, pa.int32()), pa.array(made, pa.binary())], names=["bucket", "block"])


def _summed(blocks: DataFrame, columns: str, least: int, rows_of: Callable[[dict], dict]) -> DataFrame:
    """The rows ``columns`` of all blocks, ``n`` summed over equal rows, where it is ``least`` or more.

    ``rows_of`` makes equally long columns of a block. A bucket's rows are in one task, one bucket
    after the other.
    """
    names = [c.split()[0] for c in columns.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in zip(batch.column(0).to_pylist(), batch.column(1), strict=True))
        for _, group in groupby(rows, lambda r: r[0]):
            parts = [pa.table(rows_of(_unpacked(block))) for _, block in group]
            found = pa.concat_tables(parts).group_by(names[:-1]).aggregate([("n", "sum")])
            found = found.filter(pc.greater_equal(found.column("n_sum"), least)).select([*names[:-1], "n_sum"])
            yield from found.rename_columns(names).combine_chunks().to_batches(max_chunksize=_ROWS)

    return blocks.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, columns)


def _hash_rows(block: dict) -> dict:
    return {"key": pa.array(np.cumsum(block["step"].to_numpy())), "n": block["n"].cast(pa.int64())}


def _word_rows(block: dict) -> dict:
    n = len(block["n"])
    return {"lang": block["lang"].take(pa.array(np.zeros(n, int))), "word": block["word"], "n": block["n"].cast(pa.int64())}


def _phrase_rows(block: dict) -> dict:
    words = block["words"]
    rows = {"lang": block["lang"].take(pa.array(np.zeros(len(block["n"]), int)))}
    return rows | {w: words.take(block[w]) for w in ("w1", "w2", "w3")} | {"n": block["n"].cast(pa.int64())}


def _phrase_block(lang: str, words: pa.Array, ids: list[np.ndarray], n: np.ndarray) -> bytes:
    """Phrases of word ids, -1 for none, with their words once."""
    used = np.unique(np.concatenate(ids))
    used = used[used >= 0]
    own = [pa.array(np.searchsorted(used, x).astype(np.int32), mask=x < 0) for x in ids]
    columns = {"lang": pa.array([lang]), "words": words.take(pa.array(used)), "n": pa.array(n.astype(np.int32))}
    return _packed(columns | dict(zip(("w1", "w2", "w3"), own, strict=True)))


class _Buckets:
    """Deals hashes out: their highest bits name the bucket, so sorted hashes are sorted buckets."""

    def __init__(self, words: int) -> None:
        self.bits = max(3, (max(words, 1) // BUCKET).bit_length())

    @property
    def count(self) -> int:
        return 1 << self.bits

    def of(self, key: np.ndarray) -> np.ndarray:
        return (key >> np.uint64(KEY_BITS - self.bits)).astype(np.int64)


def _frequent(index: DataFrame, min_count: int, buckets: _Buckets, held: tuple, hashes: Callable) -> np.ndarray:
    """Bitmap of the phrase hashes that ``hashes`` finds ``min_count`` times in all, and few more."""
    shared = index.sparkSession.sparkContext.broadcast(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, shard in _opened(batches):
            key, n = hashes(shard, *shared.value)
            key = key & np.uint64((1 << KEY_BITS) - 1)
            order = np.argsort(key)
            key = key[order]
            n = n[order].astype(np.int32)

            def pack(rows: np.ndarray, key: np.ndarray = key.view(np.int64), n: np.ndarray = n) -> bytes:
                # Steps between sorted hashes are small.
                return _packed({"step": pa.array(np.diff(key[rows], prepend=0)), "n": pa.array(n[rows])})

            yield from _dealt(buckets.of(key), buckets.count, pack)

    made = index.select(*_STORED).mapInArrow(run, _BLOCKS)
    return bitmap(_summed(made, "key bigint, n bigint", min_count, _hash_rows))


def word_counts(index: DataFrame, buckets: _Buckets) -> DataFrame:
    """(lang, word, n) of all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, words, counts in zip(*batch.columns, strict=True):
                lang = lang.as_py()
                made = pa.record_batch({"word": words.values, "n": counts.values})
                # The first one stands between pieces; the others occur.
                made = made.slice(1).sort_by("word")
                key = _hash(made.column(0).cast(pa.binary()).to_pylist(), lang) & np.uint64((1 << KEY_BITS) - 1)

                def pack(rows: np.ndarray, lang: str = lang, made: pa.RecordBatch = made) -> bytes:
                    part = made.take(pa.array(rows))
                    return _packed({"lang": pa.array([lang]), "word": part.column(0), "n": part.column(1)})

                yield from _dealt(buckets.of(key), buckets.count, pack)

    blocks = index.select("lang", "words", "counts").mapInArrow(run, _BLOCKS)
    return _summed(blocks, "lang string, word string, n bigint", 1, _word_rows)


def _pair_hashes(shard: _Opened, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    use = shard.pairs(words)
    return shard.pair_hash[use], shard.count[use]


def _usual_pairs(shard: _Opened, words: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    known = shard.pairs(words)
    known[known] = bits_set(pairs, shard.pair_hash[known])
    return np.flatnonzero(known)


def _triple_hashes(shard: _Opened, words: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frequent pairs, extended to the right where the pair this makes is frequent, too."""
    h = shard.hash

    def usual(word: np.ndarray, p: np.ndarray) -> np.ndarray:
        return bits_set(pairs, _pair_hash(h[shard.right[p]], h[word]))

    _, back = shard.starts()
    p, word, n = shard.extended(shard.rbwt, _usual_pairs(shard, words, pairs), back, usual)
    return _pair_hash(shard.pair_hash[p], h[word]), n


def phrase_counts(
    index: DataFrame, min_count: int, buckets: _Buckets, words: np.ndarray, pairs: np.ndarray, triples: np.ndarray
) -> DataFrame:
    """(lang, w1, w2, w3, n) of frequent pairs, ``w3`` being NULL, and of what extends them to the left."""
    shared = index.sparkSession.sparkContext.broadcast((words, pairs, triples))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pairs, triples = shared.value
        for lang, shard in _opened(batches):
            h = shard.hash

            def usual(word: np.ndarray, p: np.ndarray, shard: _Opened = shard, h: np.ndarray = h) -> np.ndarray:
                first = _pair_hash(h[word], h[shard.left[p]])
                return bits_set(pairs, first) & bits_set(triples, _pair_hash(first, h[shard.right[p]]))

            pair = _usual_pairs(shard, words, pairs)
            ahead, _ = shard.starts()
            p, word, n = shard.extended(shard.bwt, pair, ahead, usual)
            left, right = shard.left[p], shard.right[p]
            key = np.concatenate([shard.pair_hash[pair], _pair_hash(_pair_hash(h[word], h[left]), h[right])])
            none = np.full(len(pair), -1)
            ids = [
                np.concatenate(x)
                for x in ((shard.left[pair], word), (shard.right[pair], left), (none, right), (shard.count[pair], n))
            ]
            # Rows of a first word stand together, which compresses well.
            order = np.lexsort((ids[2], ids[1], ids[0]))
            *ids, n = (x[order] for x in ids)

            def pack(rows: np.ndarray, lang: str = lang, shard: _Opened = shard, ids: list = ids, n: np.ndarray = n) -> bytes:
                return _phrase_block(lang, shard.words, [x[rows] for x in ids], n[rows])

            yield from _dealt(buckets.of(key[order] & np.uint64((1 << KEY_BITS) - 1)), buckets.count, pack)

    blocks = index.select(*_STORED).mapInArrow(run, _BLOCKS)
    return _summed(blocks, "lang string, w1 string, w2 string, w3 string, n bigint", min_count, _phrase_rows)


def _score(a: str, first: Column, rest: Column) -> Column:
    """floor(SCALE * a * a / (first * rest)) in 38 digits."""
    wide = [x.cast("decimal(19,0)") for x in (F.col(a), first, rest)]
    top = (wide[0] * wide[0] * F.lit(SCALE).cast("decimal(7,0)")).cast("decimal(38,0)")
    return F.call_function("div", top, (wide[1] * wide[2]).cast("decimal(38,0)"))


def collocations(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    min_count: int = MIN_COUNT,
    top: int = TOP,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of 2 to 3 words of each language.

    Texts are lower-cased (A-Z), cut at ``.,;:!?`` and line ends into pieces, and those at spaces
    and tabs into words. ``a`` counts a phrase's occurrences within pieces, ``l`` and ``r`` those of
    its two parts at the cut of the lowest score (the earliest on a tie), ``n`` all words of the
    language. Phrases below ``min_count`` are no candidates; candidates inside a longer candidate
    with at least half their occurrences are left out. Order is by score, ``a``, then phrase, so
    no ties are left. A NULL language counts as ``und``, NULL and blank texts have no words,
    repeated rows count each time, an empty table gives no rows. A text of any length is one
    stretch of a shard. Other columns are not read.
    """
    index = indexes(docs, text_col, lang_col)
    size = index.agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda x, y: x + y))).first()[0]
    buckets = _Buckets(size or 0)
    counted = stage(word_counts(index, buckets), "words")
    total = counted.groupBy("lang").agg(F.sum("n").alias("n"))
    word = counted.filter(F.col("n") >= min_count)
    words = bitmap(word.select("lang", "word").mapInArrow(_keys, "key bigint"))
    pairs = _frequent(index, min_count, buckets, (words,), _pair_hashes)
    triples = _frequent(index, min_count, buckets, (words, pairs), _triple_hashes)
    # Frequent phrases are few, and larger blocks share more of their words.
    few = _Buckets((size or 0) // 8)
    grown = stage(phrase_counts(index, min_count, few, words, pairs, triples), "phrases")
    pair = grown.filter(F.col("w3").isNull()).select("lang", "w1", "w2", F.col("n").alias("f"))
    more = grown.filter(F.col("w3").isNotNull()).withColumnRenamed("n", "f")
    inside = more.select("lang", "w1", "w2", "f").union(more.select("lang", "w2", "w3", "f"))

    def ones(name: str, f: str) -> DataFrame:
        return word.select("lang", F.col("word").alias(name), F.col("n").alias(f))

    none = F.lit(None).cast("string"), F.lit(None).cast("long")
    two = (
        pair.join(inside.groupBy("lang", "w1", "w2").agg(F.max("f").alias("longer")), ["lang", "w1", "w2"], "left")
        .filter(F.coalesce(100 * F.col("longer") < ABSORBED * F.col("f"), F.lit(True)))
        .select("lang", "w1", F.col("w2").alias("last"), none[0].alias("w2"), "f", none[1].alias("head"), none[1].alias("tail"))
    )
    heads = pair.withColumnRenamed("f", "head")
    tails = pair.select("lang", F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("f").alias("tail"))
    three = (
        more.join(heads, ["lang", "w1", "w2"])
        .join(tails, ["lang", "w2", "w3"])
        .select("lang", "w1", F.col("w3").alias("last"), "w2", "f", "head", "tail")
    )
    # The first word and the rest; of three words also the first pair and the last word.
    cut1 = _score("f", F.col("first"), F.coalesce("tail", "end"))
    cut2 = _score("f", F.coalesce("head", "first"), F.col("end"))
    early = F.col("w2").isNull() | (F.col("cut1") <= F.col("cut2"))
    scored = (
        two.union(three)
        .join(ones("w1", "first"), ["lang", "w1"])
        .join(ones("last", "end"), ["lang", "last"])
        .withColumns({"cut1": cut1, "cut2": cut2})
        .select(
            "lang", F.concat_ws(" ", "w1", "w2", "last").alias("phrase"), F.col("f").alias("a"),
            F.when(early, F.col("first")).otherwise(F.col("head")).alias("l"),
            F.when(early, F.coalesce("tail", "end")).otherwise(F.col("end")).alias("r"),
            F.when(early, F.col("cut1")).otherwise(F.col("cut2")).alias("score"),
        )
    )
    best = [F.desc("score"), F.desc("a"), F.col("phrase")]
    # The first ones of each part of a language hold the first ones of all of it.
    part = F.pmod(F.xxhash64("phrase"), F.lit(_PARTS))
    return (
        scored.withColumn("part", part)
        .withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*best)))
        .filter(F.col("rank") <= top)
        .withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long"))
        .filter(F.col("rank") <= top)
        .join(total, "lang")
        .select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    )


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLE = f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\\x0A-\\x0D]')) AS p
  FROM documents
), w AS (
  SELECT lang, list_filter(string_split_regex(p, '[\\x20\\x09]+'), lambda x: x <> '') AS ws FROM pieces
), grams AS (
  SELECT lang, 1 AS k, unnest(ws) AS phrase FROM w
  UNION ALL
  SELECT lang, 2, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) FROM w
  UNION ALL
  SELECT lang, 3, unnest(list_transform(range(1, len(ws) - 1),
    lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) FROM w
), f AS (
  SELECT lang, k, phrase, count(*) AS a FROM grams GROUP BY lang, k, phrase HAVING count(*) >= {MIN_COUNT}
), total AS (
  SELECT lang, count(*) AS n FROM grams WHERE k = 1 GROUP BY lang
), cand AS (
  SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE k > 1
), cuts AS (
  SELECT lang, phrase, a, k, c, array_to_string(ws[1:c], ' ') AS p1, array_to_string(ws[c + 1:k], ' ') AS p2
  FROM (SELECT *, unnest(range(1, k)) AS c FROM cand)
), scored AS (
  SELECT cuts.lang, cuts.phrase, cuts.a, cuts.k, c, x.a AS l, y.a AS r,
    ({SCALE}::HUGEINT * cuts.a * cuts.a) // (x.a::HUGEINT * y.a) AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = p1 JOIN f y ON y.lang = cuts.lang AND y.phrase = p2
), best AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) AS o FROM scored)
  WHERE o = 1
), longer AS (
  SELECT lang, phrase, max(a) AS a FROM (
    SELECT lang, ws[1] || ' ' || ws[2] AS phrase, a FROM cand WHERE k = 3
    UNION ALL SELECT lang, ws[2] || ' ' || ws[3], a FROM cand WHERE k = 3) GROUP BY lang, phrase
), ranked AS (
  SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, encode(b.phrase)) AS rank
  FROM best b LEFT JOIN longer g ON g.lang = b.lang AND g.phrase = b.phrase AND b.k = 2
  WHERE g.a IS NULL OR 100 * g.a < {ABSORBED} * b.a
)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r,
  n::BIGINT AS n, score::BIGINT AS score
FROM ranked JOIN total USING (lang) WHERE rank <= {TOP}
"""
