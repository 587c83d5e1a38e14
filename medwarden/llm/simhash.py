"""SimHash near-duplicates by anchor-point covering.

Anchors are the words of the perfect Hamming code of length 31: every 31-bit word lies within
distance 1 (the covering radius) of one. Two fingerprints that differ in at most ``2 * HALF_BITS``
bits differ in at most ``HALF_BITS`` = 2 bits of one of their halves. Half-way between those two
lies a word whose anchor is within 1 + 1 of both. So each half goes to every anchor within the
covering radius plus half the threshold, some 16 of 2**26, and pairs are compared per anchor.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medwarden.llm.common import stage, text_of
from medwarden.llm.components import components

SHINGLE_WORDS = 4
# Differing bits of linked fingerprints; the anchors below are laid out for 4.
MAX_BITS = 4
SEED = 42
_BLOCK = 1 << 16
# Rows whose anchors are made at once.
_ANCHORED = 1024


def shingles(text: bytes, n: int) -> list[bytes]:
    """Space-joined runs of ``n`` words; all words where there are fewer; none without a word."""
    words = text.lower().split()
    if len(words) < n:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*[words[i:] for i in range(n)], strict=False)))


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The hashes themselves for k = 0, else other well mixed 64-bit values made from them."""
    if k:
        h = (h + np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    return h


def fingerprint(text: bytes, n: int = SHINGLE_WORDS, size: int = 1) -> list[int]:
    """``size`` times 64 bits, each set where it is set in over half the hashes; 0 without a word."""
    found = shingles(text, n)
    ones = np.zeros((size, 64), np.int64)
    for start in range(0, len(found), _BLOCK):
        part = found[start : start + _BLOCK]
        h = np.fromiter(map(xxhash.xxh64_intdigest, part, repeat(SEED)), np.uint64, len(part))
        for k in range(size):
            octets = _mixed(h, k).view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(octets, axis=1, bitorder="little")
            ones[k] += np.add.reduce(bits, axis=0, dtype=np.int32)
    packed = np.packbits(2 * ones > len(found), axis=1, bitorder="little")
    return packed.view(np.int64)[:, 0].tolist()


def fingerprints(
    docs: DataFrame, id_col: str, text_col: str, plan: tuple[tuple[int, int], ...]
) -> DataFrame:
    """(_id, fp0, fp1, ...): for each (shingle words, size) of ``plan`` the fingerprint of every
    whole text as an array of signed longs; NULL text counts as empty."""
    rows = text_of(docs, id_col, text_col).select("_id", F.encode("_text", "utf-8").alias("_text"))
    id_type = rows.schema["_id"].dataType.simpleString()
    names = ["_id", *[f"fp{i}" for i in range(len(plan))]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [
                [fingerprint(t.as_py() or b"", n, size) for t in batch.column(1)]
                for n, size in plan
            ]
            columns = [pa.array(x, pa.list_(pa.int64())) for x in made]
            yield pa.record_batch([batch.column(0), *columns], names=names)

    types = ", ".join(f"{name} array<bigint>" for name in names[1:])
    return rows.mapInArrow(run, f"_id {id_type}, {types}")


def _masks() -> np.ndarray:
    """For each syndrome, what to flip to reach the anchors within distance 2; repeats where fewer."""
    table = np.zeros((32, 16), np.uint32)
    for s in range(1, 32):
        pairs = {frozenset((a, a ^ s)) for a in range(1, 32) if a != s}
        flips = [1 << (s - 1), *(sum(1 << (a - 1) for a in p) for p in pairs)]
        table[s] = flips
    return table


def anchors_of(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row of ``fp``, anchor) pairs for all halves of all words of the (rows, words) array.

    The anchor also carries which half it is for.
    """
    masks = _masks()
    at, found = [], []
    for half in range(2 * fp.shape[1]):
        word = fp[:, half // 2].view(np.uint64) >> np.uint64(32 * (half % 2))
        word = (word & np.uint64(0x7FFFFFFF)).astype(np.uint32)
        syndrome = np.zeros(len(word), np.uint32)
        for i in range(31):
            syndrome ^= ((word >> np.uint32(i)) & np.uint32(1)) * np.uint32(i + 1)
        keys = (word[:, None] ^ masks[syndrome]).astype(np.int64) | (half << 31)
        use = np.ones(keys.shape, bool)
        use[syndrome == 0, 1:] = False
        row, col = np.nonzero(use)
        at.append(row)
        found.append(keys[row, col])
    return np.concatenate(at), np.concatenate(found)


def _find(parent: np.ndarray, i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def forest(key: np.ndarray, fp: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of a spanning forest of the links between rows of one key; ``key`` is sorted.

    All pairs of a key are compared, at one distance in the list after the other, but no more
    links come out than there are rows. ``fp`` has a row of 64-bit words for each key.
    """
    n = len(key)
    fp = fp.view(np.uint64)
    root = np.arange(n)
    left, right = [], []
    active, k = np.arange(n), 1
    while True:
        active = active[active + k < n]
        active = active[key[active] == key[active + k]]
        if not len(active):
            break
        apart = active[root[active] != root[active + k]]
        differ = np.bitwise_count(fp[apart] ^ fp[apart + k]).sum(axis=1, dtype=np.int32)
        close = apart[differ <= bits]
        if len(close):
            parent = root.copy()
            for i in close.tolist():
                a, b = _find(parent, i), _find(parent, i + k)
                if a != b:
                    parent[b] = a
                    left.append(i)
                    right.append(i + k)
            while not np.array_equal(up := parent[parent], parent):
                parent = up
            root = parent
        k += 1
    return np.array(left, int), np.array(right, int)


def links(nodes: DataFrame, bits: int) -> DataFrame:
    """Links (u, v) between rows (node, cover, fp), enough to connect what the anchors bring together.

    ``cover`` holds the words that are anchored, ``fp`` those that are compared: rows link where
    ``fp`` differs in at most ``bits`` bits. With one word for both, no link of up to 4 bits is
    missed; longer fingerprints meet where one of their halves differs in at most 2 bits.
    """
    schema = "key bigint, node bigint, fp array<bigint>"

    def matrix(column: pa.Array) -> np.ndarray:
        return column.flatten().to_numpy().reshape(len(column), -1)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, _ANCHORED):
                batch = whole.slice(start, _ANCHORED)
                at, key = anchors_of(matrix(batch.column(1)))
                rows = batch.take(pa.array(at))
                yield pa.record_batch(
                    [pa.array(key), rows.column(0), rows.column(2)], names=["key", "node", "fp"]
                )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def closed(key: np.ndarray, node: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            i, j = forest(key, fp, bits)
            return pa.record_batch([pa.array(node[i]), pa.array(node[j])], names=["u", "v"])

        # The last anchor of a batch may go on in the next.
        for batch in batches:
            if not batch.num_rows:
                continue
            new = [batch.column(0).to_numpy(), batch.column(1).to_numpy(), matrix(batch.column(2))]
            held = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
            cut = int(np.searchsorted(held[0], held[0][-1]))
            yield closed(*[x[:cut] for x in held])
            held = [x[cut:] for x in held]
        if held is not None:
            yield closed(*held)

    by_anchor = (
        nodes.select("node", "cover", "fp")
        .mapInArrow(spread, schema)
        .repartition("key")
        .sortWithinPartitions("key")
    )
    return by_anchor.mapInArrow(compare, "u bigint, v bigint")


def _grouped(marked: DataFrame, keys: list[str], bits: int) -> DataFrame:
    """``marked`` with component_id, where rows of equal fingerprint columns ``keys`` are one node."""
    nodes = stage(
        marked.groupBy(*keys)
        .agg(F.min("_id").alias("first"))
        .select(
            F.xxhash64(*keys).alias("node"),
            F.col(keys[0]).alias("cover"),
            F.col(keys[-1]).alias("fp"),
            "first",
        ),
        "nodes",
    )
    roots = components(links(nodes, bits)).withColumnRenamed("node", "n")
    rooted = nodes.join(roots, F.col("node") == F.col("n"), "left").select(
        "node", "first", F.coalesce("root", "node").alias("root")
    )
    named = rooted.join(
        rooted.groupBy("root").agg(F.min("first").alias("component_id")), "root"
    ).select(F.col("node").alias("_n"), "component_id")
    return marked.join(named, F.xxhash64(*keys) == F.col("_n")).drop("_n")


def simhash_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle_words: int = SHINGLE_WORDS,
    bits: int = MAX_BITS,
) -> DataFrame:
    """(id, fingerprint, component_id) per row of ``docs``; component_id is the smallest linked id.

    Texts link where their 64-bit fingerprints differ in at most ``bits`` (up to 4) bits. Equal
    fingerprints are one node, so a group of copies of any size is one row from there on. NULL,
    empty and blank texts have fingerprint zero and are linked like any other. A NULL id keeps its
    row and never names a component unless all its group is NULL. Repeated rows give repeated
    rows; an empty table gives none.
    """
    if not 0 <= bits <= 4:
        raise ValueError("the anchors are laid out for at most 4 bits")
    marked = stage(fingerprints(docs, id_col, text_col, ((shingle_words, 1),)), "fingerprints")
    return _grouped(marked, ["fp0"], bits).select(
        F.col("_id").alias(id_col),
        F.lpad(F.lower(F.hex(F.col("fp0")[0])), 16, "0").alias("fingerprint"),
        "component_id",
    )


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    similarity: float = 0.8,
    shingle_words: int = 5,
    size: int = 4,
) -> DataFrame:
    """(id, component_id) per row of ``docs``, for texts that share most of their shingles.

    Texts link where ``size`` times 64 bits over shingles of ``shingle_words`` words put the cosine
    of their shingle counts at ``similarity`` or more. Pairs meet at the anchors of as many bits
    over two-word shingles, which an edit changes less: of texts whose sets of five-word shingles
    overlap by 0.8, 98 % meet. Texts without a word are one group.
    """
    marked = stage(
        fingerprints(docs, id_col, text_col, ((2, size), (shingle_words, size))), "fingerprints"
    )
    bits = int(64 * size * np.arccos(similarity) / np.pi)
    return _grouped(marked, ["fp0", "fp1"], bits).select(
        F.col("_id").alias(id_col), "component_id"
    )
