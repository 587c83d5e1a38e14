"""Removal of repeated byte strings by suffix arrays.

Any string of ``LENGTH`` bytes names an anchor: the position of its lowest-hashed run of ``GRAM``
bytes. Equal strings name equal runs at equal distance, so only strings of one anchor need be
compared. Neighbouring strings of one anchor form a segment of the text.

1. All segments are counted by the hashes of anchor and segment; nothing else is shuffled.
2. Segments whose anchor recurs are written down; those that exist in several versions with their
   bytes. The versions of an anchor are cut into blocks counted from the anchor and suffix-sorted
   block by block; strings that start within a block are told apart by the bytes before it.
3. The strings found to recur come back to their texts as ranges.

Which anchors recur is held in bitmaps of fixed size. As they fill up, more segments are written
down than need be, but the result stays the same.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from medwarden.llm.common import stage, text_of
from medwarden.llm.suffix_sort import suffix_array

LENGTH, GRAM, STEP = 200, 64, 16
# Bits of a bitmap of anchors, in buckets of Spark's own bitmap functions.
BITMAP_BITS, _BUCKET = 1 << 27, 32768
# Starts whose anchors are found at once.
_BLOCK = 1 << 19
# Bytes of segments sorted at once; the versions of one anchor stay together.
_SORTED = 1 << 20
# Versions of one anchor that are sorted in one task. An anchor of more, at the edge of a passage
# that very many texts share, has its strings counted one by one, all over the cluster.
SORTED_VERSIONS = 20_000
# Texts a task remembers to skip further copies of.
_SEEN = 1 << 20
_BASE = 0x9E3779B97F4A7C15


class Anchors:
    """Finds the anchors of texts; holds the powers that the rolling hash needs."""

    def __init__(self) -> None:
        n = _BLOCK + LENGTH
        step = np.full(n, _BASE, np.uint64)
        step[0] = 1
        self._power = np.cumprod(step)
        step[1:] = pow(_BASE, -1, 1 << 64)
        self._inverse = np.cumprod(step)

    def segments(self, text: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(first start, starts, anchor, anchor hash) arrays over runs of strings of one anchor."""
        whole = np.frombuffer(text, np.uint8)
        for at in range(0, len(whole) - LENGTH + 1, _BLOCK):
            part = whole[at : at + _BLOCK + LENGTH - 1]
            n = len(part)
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum((part.astype(np.uint64) + np.uint64(1)) * self._power[:n], out=sums[1:])
            h = (sums[GRAM:] - sums[:-GRAM]) * self._inverse[: n - GRAM + 1]
            h ^= h >> np.uint64(32)
            h *= np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(32)
            # Hash above, position below: the lowest is the leftmost of the lowest hash.
            low = np.uint64((1 << 21) - 1)
            lowest = _sliding_min((h & ~low) | np.arange(len(h), dtype=np.uint64), LENGTH - GRAM + 1)
            anchor = (lowest & low).astype(np.int64)
            first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
            count = np.diff(np.append(first, len(anchor)))
            yield first + at, count, anchor[first] + at, h[anchor[first]].view(np.int64)


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values, from running minima of blocks of that width."""
    n = len(values)
    blocks = np.full(-(-n // width) * width, np.iinfo(np.uint64).max)
    blocks[:n] = values
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def _segment_hash(segment: bytes) -> int:
    h = xxhash.xxh3_64_intdigest(segment)
    return h - (1 << 64) if h >> 63 else h


class _Copies:
    """Remembers texts, so that a task handles copies once; forgetting costs only work."""

    def __init__(self) -> None:
        self._seen: set[tuple[int, int]] = set()

    def first(self, u1: int, u2: int) -> bool:
        if (u1, u2) in self._seen:
            return False
        if len(self._seen) >= _SEEN:
            self._seen.clear()
        self._seen.add((u1, u2))
        return True


def _count_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, segment hash) of every segment of (u1, u2, text) rows."""
    anchors, copies = Anchors(), _Copies()
    for batch in batches:
        for u1, u2, text in zip(*batch.columns, strict=True):
            text = text.as_py()
            if len(text) < LENGTH or not copies.first(u1.as_py(), u2.as_py()):
                continue
            for first, count, _, key in anchors.segments(text):
                ends = (first + count + LENGTH - 1).tolist()
                made = [_segment_hash(text[a:b]) for a, b in zip(first.tolist(), ends, strict=True)]
                yield pa.record_batch(
                    [pa.array(key), pa.array(made, pa.int64())], names=["key", "segment"]
                )


def _bitmap(keys: DataFrame) -> np.ndarray:
    """Set bits for the keys: at most ``BITMAP_BITS`` bits, however many keys there are."""
    bit = F.pmod("key", F.lit(BITMAP_BITS))
    rows = (
        keys.select(bit.alias("bit"))
        .groupBy(F.floor(F.col("bit") / _BUCKET).alias("bucket"))
        .agg(F.bitmap_construct_agg((F.col("bit") % _BUCKET).cast("long")).alias("bits"))
        .collect()
    )
    bits = np.zeros((BITMAP_BITS // _BUCKET, _BUCKET // 8), np.uint8)
    for r in rows:
        bits[r.bucket] = np.frombuffer(r["bits"], np.uint8)
    return bits.ravel()


def _has(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys & (BITMAP_BITS - 1)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


_WRITTEN = "u1 bigint, u2 bigint, first int, starts int, key bigint, segment bigint, anchor int, bytes binary"


def _write_down(texts: DataFrame, repeated: np.ndarray, several: np.ndarray) -> DataFrame:
    """Segments whose anchor recurs; with their bytes where it has several versions."""
    shared = texts.sparkSession.sparkContext.broadcast((repeated, several))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, copies = Anchors(), _Copies()
        repeated, several = shared.value
        for batch in batches:
            for u1, u2, text in zip(*batch.columns, strict=True):
                text = text.as_py()
                if len(text) < LENGTH or not copies.first(u1.as_py(), u2.as_py()):
                    continue
                for first, count, anchor, key in anchors.segments(text):
                    use = _has(repeated, key)
                    first, count, anchor, key = (x[use] for x in (first, count, anchor, key))
                    ends = (first + count + LENGTH - 1).tolist()
                    cut = [text[a:b] for a, b in zip(first.tolist(), ends, strict=True)]
                    known = zip(cut, _has(several, key).tolist(), strict=True)
                    n = len(cut)
                    yield pa.record_batch(
                        [pa.array([u1.as_py()] * n, pa.int64()), pa.array([u2.as_py()] * n, pa.int64()),
                         pa.array(first.astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(key),
                         pa.array(map(_segment_hash, cut), pa.int64()),
                         pa.array((anchor - first).astype(np.int32)),
                         pa.array([c if k else None for c, k in known], pa.binary())],
                        names=["u1", "u2", "first", "starts", "key", "segment", "anchor", "bytes"],
                    )

    return texts.mapInArrow(run, _WRITTEN)


def repeated_starts(segments: list[tuple[int, int, bytes]]) -> list[np.ndarray]:
    """For each (anchor, starts, bytes), which of its starts have their string elsewhere among these.

    The anchor's distance from the segment's start sets where blocks of ``STEP`` bytes are cut.
    """
    offset = [a % STEP for a, _, _ in segments]
    blocks, owner, place, valid, data = [], [], [], [], []
    for s, ((_, _, segment), cut) in enumerate(zip(segments, offset, strict=True)):
        for at in range(cut, len(segment), STEP):
            piece = segment[at : at + STEP]
            blocks.append(piece.ljust(STEP, b"\0") + bytes([len(piece)]))
            owner.append(s)
            place.append(at)
            valid.append(len(piece))
        blocks.append(b"")  # ends the segment, below any block
        owner.append(s)
        place.append(len(segment))
        valid.append(0)
    flags = [np.zeros(starts, bool) for _, starts, _ in segments]
    if not blocks:
        return flags
    table = np.array(blocks, f"S{STEP + 1}")
    names = np.unique(table, return_inverse=True)[1].ravel()
    order = np.array(suffix_array(names.tolist()))
    raw = np.zeros((len(blocks), STEP), np.uint8)
    raw[:] = np.frombuffer(table.tobytes(), np.uint8).reshape(-1, STEP + 1)[:, :STEP]
    valid = np.array(valid)
    # Bytes that a suffix has in common with the one before it in order, as far as they matter.
    common = np.zeros(len(order), np.int64)
    left, right = order[:-1], order[1:]
    going = np.ones(len(left), bool)
    for step in range(-(-LENGTH // STEP) + 1):
        a, b = np.minimum(left + step, len(names) - 1), np.minimum(right + step, len(names) - 1)
        same = (raw[a] == raw[b]) & (np.arange(STEP) < np.minimum(valid[a], valid[b])[:, None])
        shared = np.where(same.all(axis=1), STEP, same.argmin(axis=1))
        common[1:] += np.where(going, shared, 0)
        going &= shared == STEP
    owner, place = np.array(owner), np.array(place)
    starts = np.array([n for _, n, _ in segments])
    joined = np.frombuffer(b"".join(x[2] for x in segments), np.uint8)
    base = np.concatenate([[0], np.cumsum([len(x[2]) for x in segments])[:-1]])
    # Only suffixes with a near twin can hold a repeated string.
    near = common >= LENGTH - STEP + 1
    order_use = near | np.append(near[1:], False)
    suffix, common = order[order_use], common[order_use]
    seg, off = owner[suffix], place[suffix]
    before = np.zeros(len(suffix), np.int64)
    for r in range(STEP):
        if r:
            byte = joined[np.maximum(base[seg] + off - r, 0)].astype(np.int64)
            before = np.unique(before * 256 + byte, return_inverse=True)[1].ravel()
        cluster = np.cumsum(common < LENGTH - r)
        at = off - r
        fits = (at >= 0) & (at < starts[seg])
        code = (cluster * (before.max(initial=0) + 1) + before)[fits]
        _, back, times = np.unique(code, return_inverse=True, return_counts=True)
        for s, p in zip(*(x[fits][times[back.ravel()] > 1].tolist() for x in (seg, at)), strict=True):
            flags[s][p] = True
    return flags


def _ranges(flags: np.ndarray) -> list[dict]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    return [{"lo": int(a), "hi": int(b)} for a, b in zip(edges[::2], edges[1::2], strict=True)]


_FOUND = "key bigint, segment bigint, ranges array<struct<lo: int, hi: int>>"


def _sort_versions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges of repeated starts for the versions (key, segment, anchor, starts, bytes), by key."""
    held, size = [], 0

    def sorted_out(rows: list) -> pa.RecordBatch:
        flags = repeated_starts([r[2:] for r in rows])
        found = [(k, s, x) for (k, s, *_), f in zip(rows, flags, strict=True) if (x := _ranges(f))]
        kind = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
        return pa.record_batch(
            [pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64()),
             pa.array([f[2] for f in found], kind)],
            names=["key", "segment", "ranges"],
        )

    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if size >= _SORTED and row[0] != held[-1][0]:
                yield sorted_out(held)
                held, size = [], 0
            held.append(row)
            size += len(row[4])
    if held:
        yield sorted_out(held)


def _string_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, segment, at, h1, h2) for every string that starts in a version."""
    for batch in batches:
        for key, segment, _, starts, data in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            made = [xxhash.xxh3_128_digest(data[i : i + LENGTH]) for i in range(starts)]
            halves = np.frombuffer(b"".join(made), np.int64).reshape(-1, 2)
            yield pa.record_batch(
                [pa.array([key] * starts, pa.int64()), pa.array([segment] * starts, pa.int64()),
                 pa.array(range(starts), pa.int32()), pa.array(halves[:, 0].copy()),
                 pa.array(halves[:, 1].copy())],
                names=["key", "segment", "at", "h1", "h2"],
            )


def _counted_versions(versions: DataFrame) -> DataFrame:
    """The same as ``_sort_versions`` gives, from counts of every single string."""
    strings = stage(
        versions.mapInArrow(_string_hashes, "key bigint, segment bigint, at int, h1 bigint, h2 bigint"),
        "strings",
    )
    again = strings.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    one = F.struct(F.col("at").alias("lo"), (F.col("at") + 1).alias("hi"))
    return (
        strings.join(again, ["h1", "h2"], "left_semi")
        .groupBy("key", "segment")
        .agg(F.sort_array(F.collect_list(one)).alias("ranges"))
    )


def repeated_ranges(texts: DataFrame) -> DataFrame:
    """(u1, u2, ranges): sorted (first, last) starts of strings that start elsewhere too.

    ``texts`` has (u1, u2, text); rows of equal u1 and u2 are copies of one text and count once.
    """
    counted = (
        texts.mapInArrow(_count_segments, "key bigint, segment bigint")
        .groupBy("key", "segment")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    keys = stage(
        counted.groupBy("key").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("versions")).filter("n > 1"),
        "anchors",
    )
    written = stage(_write_down(texts, _bitmap(keys), _bitmap(keys.filter("versions > 1"))), "segments")
    places = written.select("u1", "u2", "first", "starts", "key", "segment").distinct()
    places = stage(places, "places")
    versions = (
        written.filter(F.col("bytes").isNotNull())
        .groupBy("key", "segment")
        .agg(F.first("anchor").alias("anchor"), F.first("starts").alias("starts"), F.first("bytes").alias("bytes"))
    )
    hot = keys.filter(F.col("versions") > SORTED_VERSIONS).select("key")
    if hot.isEmpty():
        sorted_, counted = versions, None
    else:
        versions = stage(versions, "versions")
        sorted_, counted = (versions.join(hot, "key", how) for how in ("left_anti", "left_semi"))
    partly = sorted_.repartition("key").sortWithinPartitions("key").mapInArrow(_sort_versions, _FOUND)
    if counted is not None:
        partly = partly.unionByName(_counted_versions(counted))
    partly = stage(partly, "ranges")
    whole = places.groupBy("key", "segment").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    verdict = partly.join(whole, ["key", "segment"], "full").select(
        "key", "segment", (F.col("n") > 1).alias("all"), "ranges"
    )
    each = places.join(verdict, ["key", "segment"]).select(
        "u1", "u2", "first",
        F.explode(
            F.when(F.col("all"), F.array(F.struct(F.lit(0).alias("lo"), F.col("starts").alias("hi"))))
            .otherwise(F.col("ranges"))
        ).alias("r"),
    )
    found = F.struct((F.col("first") + F.col("r.lo")).alias("first"), (F.col("first") + F.col("r.hi") - 1).alias("last"))
    # A text has no more ranges than segments.
    return each.groupBy("u1", "u2").agg(F.sort_array(F.collect_list(found)).alias("ranges"))


def _spans(ranges: list[dict]) -> list[list[int]]:
    """Maximal runs of bytes covered by the strings that start in the ranges."""
    out: list[list[int]] = []
    for r in ranges:
        lo, hi = r["first"], r["last"] + LENGTH
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return out


def _identity(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("u1"), F.xxhash64(F.lit(7), text).alias("u2")]


def suffix_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False
) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256), and ``kept`` on request, per row of ``docs``.

    Removed is each byte covered by a string of ``LENGTH`` bytes that starts anywhere else too. A
    NULL text counts as empty. Repeated rows are copies, so their texts of at least ``LENGTH``
    bytes go altogether. An empty table gives no rows.
    """
    text = F.encode(F.coalesce(F.col("_text"), F.lit("")), "utf-8")
    rows = text_of(docs, id_col, text_col).select("_id", text.alias("text"))
    rows = rows.select("_id", "text", *_identity(F.col("text")))
    copies = rows.groupBy("u1", "u2").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    ranges = repeated_ranges(rows.select("u1", "u2", "text"))
    known = stage(copies.join(ranges, ["u1", "u2"], "full"), "known")
    joined = rows.join(known, ["u1", "u2"], "left").select("_id", "text", "copies", "ranges")
    fields = [
        T.StructField("_id", rows.schema["_id"].dataType),
        *[T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")],
        T.StructField("kept_sha256", T.StringType()),
    ]
    if keep_text:
        fields.append(T.StructField("kept", T.BinaryType()))
    schema = T.StructType(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for text, copies, ranges in zip(*batch.columns[1:], strict=True):
                text = text.as_py()
                spans = _spans(ranges.as_py() or [])
                if (copies.as_py() or 0) > 1 and len(text) >= LENGTH:
                    spans = [[0, len(text)]]
                bounds = [0, *[x for s in spans for x in s], len(text)]
                kept = b"".join([text[a:b] for a, b in zip(bounds[::2], bounds[1::2], strict=True)])
                made.append((len(text), len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept))
            types = [pa.int64()] * 3 + [pa.string(), pa.binary()]
            columns = [pa.array([m[k] for m in made], t) for k, t in enumerate(types)]
            yield pa.record_batch([batch.column(0), *columns[: len(fields) - 1]], names=schema.names)

    return joined.mapInArrow(run, schema).withColumnRenamed("_id", id_col)
