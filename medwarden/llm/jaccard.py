"""Jaccard join of word n-gram sets by R-trees over count vectors.

1. A set's n-grams fall by hash into groups. Sets that reach the threshold differ in so few
   n-grams that they agree wholly in at least one of sufficiently many groups; sets of about one
   size use as many. Sets that agree in a group are brought together, and what hangs together is a
   cluster. Most sets have none, and no text is moved for them.
2. A set's counts of ``GROUPS`` groups are a point. Two sets share no more n-grams than the sum of
   the smaller of their counts, nor does a set share more with any set below a tree's node than
   the sum of the smaller of its counts and the node's upper bounds. An R-tree of a block of a
   cluster finds what may link; finer counts, then the sets themselves decide.
3. Clusters of any size are cut into blocks. First, blocks are joined within, with a few sets of
   their neighbours. Blocks of near copies hang together after that; only sets outside a cluster's
   largest component are compared across blocks, with all others.

Equal sets are one from the beginning, and pairs that hang together already are not compared.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from medwarden.llm.common import SPACE, bitmap, bits_set, stage, text_of
from medwarden.llm.components import components

WORDS, PERCENT = 3, 90
# Groups a set is told apart by in a tree, and before it is compared itself, as powers of 2.
GROUPS, FINE = 5, 9
LEAF, FANOUT = 16, 16
# Sets and n-grams of a block.
BLOCK_SETS, BLOCK_GRAMS = 4096, 1 << 21
# Sets of a block that are joined with the next block, too.
LEADERS = 8
# Groups in which a linked pair agrees at least.
AGREED = 3
# Sets a task remembers, to list copies once.
_SEEN = 1 << 20


def grams(text: bytes, n: int) -> tuple[np.ndarray, int]:
    """(sorted hashes, number) of the distinct runs of ``n`` words; all words where there are fewer."""
    words = text.lower().split()
    if len(words) < n:
        found = {b" ".join(words)} if words else set()
    else:
        found = set(map(b" ".join, zip(*[words[i:] for i in range(n)], strict=False)))
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    return np.unique(hashes), len(found)


def least_overlap(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """N-grams that sets of ``a`` and ``b`` n-grams share if they link."""
    return -(-percent * (a + b) // (100 + percent))


class Bands:
    """Bands of sizes: sets that link are of one band or of neighbouring ones."""

    def __init__(self, percent: int) -> None:
        self._percent = percent
        self._starts = [1, 2]

    def of(self, size: int) -> int:
        while self._starts[-1] <= size:
            last = self._starts[-1]
            self._starts.append(max(last + 1, (last - 1) * 100 // self._percent + 1))
        return int(np.searchsorted(self._starts, size, "right")) - 1

    def differing(self, band: int) -> int:
        """N-grams that linked sets of this band, or of it and the one below, differ in at most."""
        while len(self._starts) < band + 2:
            self.of(self._starts[-1])
        most = 2 * (self._starts[band + 1] - 1)
        return most * (100 - self._percent) // (100 + self._percent)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def agreement_keys(hashes: np.ndarray, bands: Bands) -> np.ndarray:
    """What sets that link have in common one of: the content of a group, for one of two bands.

    Pairs that differ in ``t`` n-grams agree in at least ``AGREED`` of ``t + AGREED`` groups. Only
    if a set has that many empty ones can they all be empty; then those count as well.
    """
    made = []
    own = bands.of(len(hashes))
    for band in (own, own + 1):
        t = bands.differing(band)
        if not t:
            continue
        size = t + AGREED
        group = ((hashes >> np.uint64(32)) * np.uint64(size)) >> np.uint64(32)
        starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        sums, names = np.add.reduceat(hashes, starts), group[starts]
        if size - len(starts) >= AGREED:
            empty = np.setdiff1d(np.arange(size, dtype=np.uint64), names)
            sums, names = np.concatenate([sums, np.zeros(len(empty), np.uint64)]), np.concatenate([names, empty])
        made.append(_mixed(_mixed(sums + names) + names * np.uint64(0x9E3779B97F4A7C15) + np.uint64(band)))
    return np.concatenate(made) if made else np.zeros(0, np.uint64)


_SETS = "digest binary, n bigint, node bigint, t1 bigint, t2 bigint, keys array<bigint>"


def sets(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> DataFrame:
    """(_id, digest, n, node, t1, t2, keys) of every text; ``digest`` is NULL for the empty set.

    ``t1`` and ``t2`` name the text, ``keys`` are there once in a task for each set.
    """
    rows = text_of(docs, id_col, text_col).select(
        "_id", F.xxhash64("_text").alias("t1"), F.xxhash64("_text", F.lit(1)).alias("t2"),
        F.encode("_text", "utf-8").alias("_text"),
    )
    id_type = rows.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, seen = Bands(percent), set()
        for batch in batches:
            digests, sizes, nodes, keys = [], [], [], []
            for text in batch.column(3):
                hashes, n = grams(text.as_py() or b"", words)
                digest = xxhash.xxh3_128_digest(hashes.tobytes()) if n else None
                digests.append(digest)
                sizes.append(n)
                nodes.append(int.from_bytes(digest[:8], "little", signed=True) if n else None)
                if n and digest not in seen:
                    if len(seen) >= _SEEN:
                        seen.clear()
                    seen.add(digest)
                    keys.append(agreement_keys(hashes, bands).view(np.int64))
                else:
                    keys.append(None)
            yield pa.record_batch(
                [batch.column(0), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()),
                 batch.column(1), batch.column(2), pa.array(keys, pa.list_(pa.int64()))],
                names=["_id", "digest", "n", "node", "t1", "t2", "keys"],
            )

    return rows.mapInArrow(run, f"_id {id_type}, {_SETS}")


class CountTree:
    """R-tree of points of group counts, packed by size and by the widest coordinate."""

    def __init__(self, points: np.ndarray, percent: int) -> None:
        self._percent = percent
        sizes = points.sum(axis=1)
        self.order = self._tiled(points, sizes)
        # Level by level, from the points up: the largest counts, the least and the largest size.
        self._levels = [(points[self.order], sizes[self.order], sizes[self.order])]
        width = LEAF
        while len(self._levels[-1][0]) > FANOUT or len(self._levels) < 2:
            counts, least, most = self._levels[-1]
            cuts = np.arange(0, len(least), width)
            self._levels.append(
                (np.maximum.reduceat(counts, cuts), np.minimum.reduceat(least, cuts), np.maximum.reduceat(most, cuts))
            )
            width = FANOUT

    @staticmethod
    def _tiled(points: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        by_size = np.argsort(sizes, kind="stable")
        slab = LEAF * max(1, int(np.sqrt(len(sizes) / LEAF)))
        tiles = []
        for at in range(0, len(by_size), slab):
            part = by_size[at : at + slab]
            widest = int(np.argmax(np.ptp(points[part], axis=0)))
            tiles.append(part[np.argsort(points[part, widest], kind="stable")])
        return np.concatenate(tiles)

    def search(self, point: np.ndarray) -> np.ndarray:
        """Positions of the points that may share as much with ``point`` as a link needs."""
        size = int(point.sum())
        at = np.arange(len(self._levels[-1][0]))
        for depth in range(len(self._levels) - 1, -1, -1):
            counts, least, most = (x[at] for x in self._levels[depth])
            fits = (100 * most >= self._percent * size) & (self._percent * least <= 100 * size)
            at, counts, least = at[fits], counts[fits], least[fits]
            shared = np.minimum(counts, point).sum(axis=1)
            at = at[shared >= least_overlap(least, size, self._percent)]
            if depth:
                width = FANOUT if depth > 1 else LEAF
                at = (at[:, None] * width + np.arange(width)).ravel()
                at = at[at < len(self._levels[depth - 1][0])]
        return self.order[at]


def _counts(hashes: list[np.ndarray], bits: int) -> np.ndarray:
    shift = np.uint64(64 - bits)
    return np.array([np.bincount((h >> shift).astype(np.int64), minlength=1 << bits) for h in hashes], np.int32)


def forest(
    hashes: list[np.ndarray], label: np.ndarray, side: np.ndarray | None, percent: int
) -> list[tuple[int, int]]:
    """Links that connect all sets which links connect, where ``label`` does not connect them yet.

    Only pairs of different ``side`` are looked at, if sides are given.
    """
    label = label.copy()
    sizes = np.array([len(h) for h in hashes])
    tree = CountTree(_counts(hashes, GROUPS), percent)
    points, fine = _counts(hashes, GROUPS), _counts(hashes, FINE)
    out = []
    for i in range(len(hashes)):
        near = tree.search(points[i])
        near = near[(near > i) & (label[near] != label[i])]
        if side is not None:
            near = near[side[near] != side[i]]
        need = least_overlap(sizes[near], sizes[i], percent)
        close = np.minimum(fine[near], fine[i]).sum(axis=1) >= need
        for j, least in zip(near[close].tolist(), need[close].tolist(), strict=True):
            if label[j] == label[i]:
                continue
            if len(np.intersect1d(hashes[i], hashes[j], assume_unique=True)) >= least:
                out.append((i, j))
                label[label == label[j]] = label[i]
    return out


def _links(units: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (u, v) within the units (cluster, kind, a, b, digest, label, side, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        # Rows of a unit follow one another, so one unit is held at a time.
        for (_, kind, a, b), group in groupby(rows(), lambda r: r[:4]):
            members = {r[4]: r for r in group}
            if len(members) < 2:
                continue
            digests = list(members)
            made = [grams(members[d][7], words)[0] for d in digests]
            label = np.unique([members[d][5] for d in digests], return_inverse=True)[1]
            side = np.array([members[d][6] for d in digests])
            found = forest(made, label, None if kind == 0 and a == b else side, percent)
            u, v = ([digests[pair[k]] for pair in found] for k in range(2))
            yield pa.record_batch([pa.array(u, pa.binary()), pa.array(v, pa.binary())], names=["u", "v"])

    names = ["cluster", "kind", "a", "b"]
    return (
        units.select(*names, "digest", "label", "side", F.encode("text", "utf-8").alias("text"))
        .repartition(*names)
        .sortWithinPartitions(*names)
        .mapInArrow(run, "u binary, v binary")
    )


def _texts_of(docs: DataFrame, text_col: str, members: DataFrame) -> DataFrame:
    """(t1, t2, text), once for each text of ``members``."""
    bits = bitmap(members.select(F.col("t1").alias("key")))
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(bits_set(shared.value, batch.column(0).to_numpy())))

    rows = docs.select(
        F.xxhash64(text_col).alias("t1"), F.xxhash64(text_col, F.lit(1)).alias("t2"), F.col(text_col).alias("text")
    )
    some = rows.mapInArrow(run, "t1 bigint, t2 bigint, text string")
    return some.groupBy("t1", "t2").agg(F.first("text").alias("text"))


def _blocks(weighed: DataFrame, by: list[str], name: str) -> DataFrame:
    """(*by, ``name``): into how many blocks the sets of each group go."""
    sets_, grams_ = F.count(F.lit(1)) / BLOCK_SETS, F.sum("n") / BLOCK_GRAMS
    return weighed.groupBy(*by).agg(F.greatest(F.ceil(sets_), F.ceil(grams_)).cast("int").alias(name))


def _block(count: Column) -> Column:
    return F.pmod(F.xxhash64("digest"), count).cast("int")


def _unit(kind: int, a: Column, b: Column, side: Column) -> Column:
    fields = {"kind": F.lit(kind), "a": a, "b": b, "side": side}
    return F.struct(*[x.cast("int").alias(name) for name, x in fields.items()])


def _upto(count: Column, make: Callable[[Column], Column]) -> Column:
    return F.transform(F.sequence(F.lit(0), count - 1), make)


def _rooted(edges: DataFrame) -> DataFrame:
    """(node, root) of the components of ``edges``, the roots included."""
    hung = components(edges)
    return hung.union(hung.select("root", "root").distinct())


def set_links(marked: DataFrame, docs: DataFrame, text_col: str, words: int, percent: int) -> DataFrame:
    """Links (u, v) of digests, enough to connect all sets of ``marked`` that links connect."""
    keys = marked.select(F.explode("keys").alias("key"), "node")
    chain = F.lag("node").over(Window.partitionBy("key").orderBy("node"))
    met = keys.withColumn("u", chain).filter(F.col("u") < F.col("node"))
    clusters = _rooted(met.select("u", F.col("node").alias("v"))).withColumnRenamed("root", "cluster")
    members = stage(
        marked.filter(F.col("node").isNotNull())
        .groupBy("digest")
        .agg(F.min(F.struct("t1", "t2", "n", "node")).alias("m"))
        .select("digest", "m.*")
        .join(clusters, "node"),
        "members",
    )
    texts = stage(_texts_of(docs, text_col, members), "texts")

    def joined(units: DataFrame) -> DataFrame:
        made = units.select("t1", "t2", "cluster", "digest", "label", F.explode("units").alias("unit"))
        return _links(made.select("*", "unit.*").join(texts, ["t1", "t2"]), words, percent)

    # Within blocks, and from each block a few sets to the next.
    counted = members.join(_blocks(members, ["cluster"], "blocks"), "cluster").withColumn("block", _block(F.col("blocks")))
    own = _unit(0, F.col("block"), F.col("block"), F.lit(0))
    next_block = F.pmod(F.col("block") + 1, F.col("blocks"))
    after = _unit(0, next_block, next_block, F.lit(0))
    leads = (F.col("blocks") > 1) & (F.pmod(F.xxhash64("digest", F.lit(1)), F.lit(BLOCK_SETS // LEADERS)) == 0)
    units = F.when(leads, F.array(own, after)).otherwise(F.array(own))
    first = stage(joined(counted.withColumn("label", F.col("digest")).withColumn("units", units)), "links")

    # Across the blocks: sets outside the largest component of their cluster with all others.
    wide = counted.filter(F.col("blocks") > 1).drop("blocks", "block")
    if wide.isEmpty():
        return first
    comps = _rooted(first).select(F.col("node").alias("digest"), F.col("root").alias("label"))
    labelled = wide.join(comps, "digest", "left").withColumn("label", F.coalesce("label", "digest"))
    shares = labelled.groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("c"))
    largest = shares.groupBy("cluster").agg(F.max(F.struct("c", "label"))["label"].alias("main"))
    placed = stage(labelled.join(largest, "cluster").withColumn("stray", F.col("label") != F.col("main")), "placed")
    strays = _blocks(placed.filter("stray"), ["cluster"], "strays")
    mains = _blocks(placed.filter(~F.col("stray")), ["cluster"], "mains")
    cut = placed.join(strays, "cluster").join(mains, "cluster")
    cut = cut.withColumn("i", _block(F.when(F.col("stray"), F.col("strays")).otherwise(F.col("mains"))))
    i = F.col("i")
    with_strays = _upto(F.col("strays"), lambda j: _unit(0, F.least(i, j), F.greatest(i, j), i > j))
    with_mains = _upto(F.col("mains"), lambda j: _unit(1, i, j, F.lit(0)))
    of_main = _upto(F.col("strays"), lambda j: _unit(1, j, i, F.lit(1)))
    units = F.when(F.col("stray"), F.concat(with_strays, with_mains)).otherwise(of_main)
    return first.union(stage(joined(cut.withColumn("units", units)), "links"))


def jaccard_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = WORDS,
    percent: int = PERCENT,
) -> DataFrame:
    """(id, n_shingles, component_id) per row of ``docs``; component_id is the smallest linked id.

    A text's set are its distinct runs of ``words`` words (``A-Z`` lower-cased, between white
    space), or all its words as one where there are fewer. Texts link where the sets share
    ``percent`` of their union or more; n-grams are compared by 64-bit hashes. A NULL, empty or blank
    text has no n-grams and is alone. Equal sets are one node, so a group of copies of any size is
    one row until the ids come back. A NULL id keeps its row and names a component only if all its
    ids are NULL. Repeated rows give repeated rows; an empty table gives none. Texts may have any
    length; other columns are not read.
    """
    if not 50 < percent < 100:
        raise ValueError("percent must lie between 50 and 100")
    marked = stage(sets(docs, id_col, text_col, words, percent), "sets")
    roots = _rooted(set_links(marked, docs, text_col, words, percent))
    rows = marked.select("_id", "digest", "n").join(roots.withColumnRenamed("node", "digest"), "digest", "left")
    rows = rows.withColumn("root", F.coalesce("root", "digest"))
    named = rows.filter(F.col("root").isNotNull()).groupBy("root").agg(F.min("_id").alias("component_id"))
    return rows.join(named, "root", "left").select(
        F.col("_id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(F.col("root").isNull(), F.col("_id")).otherwise(F.col("component_id")).alias("component_id"),
    )


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLE = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'),
    '[{SPACE}]+'), lambda x: x <> '') AS ws
  FROM documents
), grams AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {WORDS} THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS g
  FROM w
), each AS (
  SELECT doc_id, len(g) AS n, unnest(g) AS gram FROM grams
), linked AS (
  SELECT a.doc_id AS u, b.doc_id AS v
  FROM each a JOIN each b ON b.gram = a.gram AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n
  HAVING 100 * count(*) >= {PERCENT} * (a.n + b.n - count(*))
), reached AS (
  SELECT doc_id AS u, doc_id AS v FROM documents
  UNION
  SELECT r.u, l.v FROM reached r JOIN linked l ON l.u = r.v
)
SELECT g.doc_id, len(g.g)::BIGINT AS n_shingles, min(r.v) AS component_id
FROM grams g JOIN reached r ON r.u = g.doc_id GROUP BY g.doc_id, len(g.g)
"""
