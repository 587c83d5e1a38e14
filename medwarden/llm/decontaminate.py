"""Benchmark decontamination by latent semantic retrieval.

Items are cut into passages of up to ``PASSAGE`` words, which become TF-IDF vectors over the
benchmark's words. A randomised SVD of the benchmark's and all the texts' passages, computed over the
partitions, gives the latent space of up to ``RANK`` passages; a larger benchmark has several spaces.
Every window of every text is searched: how far its projection reaches along each passage in that
space names candidates, which then have to pass a longest common subsequence, weighted by how rare the
words are, and a check for the item's answer.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from medwarden.llm.common import stage, text_of

# Words of a passage. A window of a text is two passages and one starts at every PASSAGE words, so
# any run of that many words stands whole in a window.
PASSAGE, WINDOW = 32, 64
# Dimensions of a latent space, passages it is for, and extra dimensions of the random projection.
RANK, OVERSAMPLE = 256, 16
# Share of a passage's norm that its space has to keep; further dimensions are added where it is less.
KEPT = 0.98
# Passages searched in one pass over the texts, in spaces of RANK; a larger benchmark takes several.
BLOCK_PASSAGES = 2_048
# Passages of a space that share a bound, and passages of texts bounded at once.
GROUP, _AT_ONCE = 8, 2_048
# Bytes of texts cut into words at once.
_BYTES = 1 << 20
# Passages of texts whose pairs of terms are sums of their own, those summed at once, and terms' rows
# that are added up together.
_SUMMED, _SLICE, _STRIP = 262_144, 4_096, 8
# Places in a strip: a space has at most RANK * PASSAGE terms.
_PLACE = np.min_scalar_type(RANK * PASSAGE * _STRIP - 1)
# Pairs of terms, of all spaces together, up to which a task keeps its sums until its end.
_KEPT_PAIRS = 1 << 24
# What all passages of the texts together weigh in a space, as a share of the benchmark's.
CORPUS = 0.1
# How far a candidate reaches along a passage, in lengths of the passage's vector, share of an
# item's weight in the common subsequence, and share of the answer's words near by.
COSINE, COMMON, ANSWER = 0.4, 0.6, 0.6
# An item without an answer of its own is asked for this many of its rarest words.
RAREST = 5
_SIGNS = bytes(c if chr(c).isalnum() or c > 127 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words without signs, A-Z in lower case."""
    return (text or "").encode().lower().translate(_SIGNS).split()


def passages_of(words: list) -> list[list]:
    """An item's words in passages of about equal length."""
    n = -(-len(words) // PASSAGE)
    return [words[i * len(words) // n : (i + 1) * len(words) // n] for i in range(n)]


class Space:
    """The latent basis of up to ``RANK`` passages over their own terms, and where they lie in it."""

    def __init__(self, terms: np.ndarray, idf: np.ndarray, basis: np.ndarray,
                 passages: list[tuple[int, np.ndarray]], size: int):
        """``terms`` are the block's numbers of the basis' rows, of ``size``; ``passages`` are
        (item, rows)."""
        own = _own(idf, [rows for _, rows in passages])
        basis = _filled(basis, own)
        latent = own @ basis
        norm = np.linalg.norm(latent, axis=1)
        latent = (latent / norm[:, None] ** 2).T
        # Passages of like direction side by side, so that those of a group share their bound.
        order = _likes(latent / np.linalg.norm(latent, axis=0))
        self.item = np.array([passages[i][0] for i in order])
        self.norm, self.latent = norm[order], latent[:, order].astype(np.float32)
        self.basis = (basis * idf[:, None]).astype(np.float32)
        self.row = _rows(terms, size)
        # How far a term alone can reach along any passage of a group; nothing for other terms.
        reach = np.maximum(self.basis @ self.latent, 0)
        most = np.maximum.reduceat(reach, np.arange(0, len(order), GROUP), axis=1)
        self.most = np.vstack([most, np.zeros(most.shape[1], np.float32)])

    def bounds(self, passages: np.ndarray) -> np.ndarray:
        """(passages, groups): no window reaches further along a group than its passages' sum."""
        rows = _distinct(self.row[passages], len(self.most) - 1)
        total = np.zeros((len(rows), self.most.shape[1]), np.float32)
        for column in rows.T:
            total += self.most[column]
        return total

    def candidates(self, windows: np.ndarray) -> Iterator[tuple[int, int, float]]:
        """(window, item, cosine) of windows that reach ``COSINE`` along a passage of an item.

        Words that are not in the passage do not shorten the reach, so short items are found in any
        surroundings. The cosine is within the space.
        """
        other = len(self.basis)
        rows = _distinct(self.row[windows], other)
        known = rows < other
        at = np.flatnonzero(known.any(axis=1))
        if not len(at):
            return
        rows, known = rows[at], known[at]
        starts = np.concatenate([[0], np.cumsum(known.sum(axis=1))[:-1]])
        latent = np.add.reduceat(self.basis[rows[known]], starts, axis=0)
        reach = latent @ self.latent
        for w, p in np.argwhere(reach >= COSINE):
            cosine = reach[w, p] * self.norm[p] / np.linalg.norm(latent[w])
            yield int(at[w]), int(self.item[p]), min(1.0, float(cosine))


def _own(idf: np.ndarray, passages: list[np.ndarray]) -> np.ndarray:
    """TF-IDF vectors of passages, given as rows of a space's terms."""
    own = np.zeros((len(passages), len(idf)))
    for at, rows in enumerate(passages):
        own[at, rows] = idf[rows]
    return own


def _rows(terms: np.ndarray, size: int) -> np.ndarray:
    """The row of each of a block's ``size`` terms in a space; ``len(terms)`` for others."""
    row = np.full(size + 1, len(terms), np.int32)
    row[terms] = np.arange(len(terms))
    return row


def _distinct(rows: np.ndarray, other: int) -> np.ndarray:
    """Rows of terms, sorted, with ``other`` in place of what repeats."""
    rows = np.sort(rows, axis=1)
    rows[:, 1:][rows[:, 1:] == rows[:, :-1]] = other
    return rows


def _likes(unit: np.ndarray) -> list[int]:
    """An order of unit vectors (columns) in which each group holds the nearest of its first."""
    near, left, order = unit.T @ unit, np.ones(unit.shape[1], bool), []
    while left.any():
        first = int(np.argmax(left))
        best = np.argsort(np.where(left, -near[first], np.inf), kind="stable")[:GROUP]
        best = best[left[best]]
        left[best] = False
        order.extend(best.tolist())
    return order


def _passages(lengths: np.ndarray, words: np.ndarray, other: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts' words in rows of ``PASSAGE``, each text from a row of its own, and texts' first rows."""
    first = np.concatenate([[0], np.cumsum(-(-lengths // PASSAGE))])
    rows = np.full((first[-1] + 1) * PASSAGE, other, np.int32)  # the last is empty
    shift = first[:-1] * PASSAGE - (np.cumsum(lengths) - lengths)
    rows[np.arange(len(words)) + np.repeat(shift, lengths)] = words
    return rows.reshape(-1, PASSAGE), first


def _filled(basis: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The basis and what it lacks of the passages (rows of ``own``) it keeps less than ``KEPT`` of."""
    lost = own - (own @ basis) @ basis.T
    norm = np.linalg.norm(own, axis=1)
    short = np.linalg.norm(own @ basis, axis=1) < KEPT * norm
    if not short.any():
        return basis
    _, size, more = np.linalg.svd(lost[short] / norm[short][:, None], full_matrices=False)
    return np.hstack([basis, more[size > 1e-6].T])


class Search:
    """What a task needs to search: items, weights of terms, and the spaces of their passages."""

    def __init__(self, items: list, idf: np.ndarray, spaces: list[Space]):
        """``items`` are (id, words, answer), words and answers as numbers of terms."""
        self.items, self.idf, self.spaces = items, idf, spaces

    def candidates(self, lengths: np.ndarray, words: np.ndarray) -> Iterator[tuple[int, int, int, float]]:
        """(text, first word, item, cosine) of the windows near an item."""
        rows, first = _passages(lengths, words, len(self.idf))
        # A window is a passage and the next of its text; a text of one passage has one window.
        starts = np.arange(first[-1])
        text = np.searchsorted(first, starts, "right") - 1
        last, alone = starts + 1 == first[text + 1], starts == first[text]
        follow = np.where(last, len(rows) - 1, starts + 1)
        starts, follow, text = (a[~last | alone] for a in (starts, follow, text))
        for begin in range(0, len(starts), _AT_ONCE):
            ones, twos = starts[begin : begin + _AT_ONCE], follow[begin : begin + _AT_ONCE]
            held, at = np.unique(np.concatenate([ones, twos]), return_inverse=True)
            for space in self.spaces:
                bounds = space.bounds(rows[held])
                most = bounds[at[: len(ones)]] + bounds[at[len(ones) :]]
                near = np.flatnonzero((most >= COSINE * (1 - 1e-4)).any(axis=1))
                windows = np.hstack([rows[ones[near]], rows[twos[near]]])
                for w, item, cosine in space.candidates(windows):
                    row = int(ones[near[w]])
                    of = int(text[begin + near[w]])
                    yield of, (row - int(first[of])) * PASSAGE, item, cosine

    def check(self, words: list[int], start: int, item: int) -> float:
        """Share of the item's weight in common with the words around a window; 0 without its answer.

        Asked of the words around each passage's length of the window, half a passage apart.
        """
        _, wanted, answer = self.items[item]
        asked = set(answer)
        if not asked:
            asked = set(sorted(set(wanted), key=lambda w: (-self.idf[w], w))[:RAREST])
        if len(asked.intersection(words[max(0, start - len(wanted)) : start + WINDOW + len(wanted)])) < (
            ANSWER * len(asked)
        ):
            return 0.0
        place = {}
        for i, w in enumerate(wanted):
            place.setdefault(w, []).append(i)
        weights = self.idf[wanted]
        hits = {w: (np.array(at), weights[at]) for w, at in place.items()}
        share, seen = 0.0, None
        for core in range(start, start + WINDOW - PASSAGE + 1, PASSAGE // 2):
            near = words[max(0, core - len(wanted)) : core + PASSAGE + len(wanted)]
            held = set(near)
            if near == seen or len(asked & held) < ANSWER * len(asked):
                continue
            seen = near
            if weights[[w in held for w in wanted]].sum() < COMMON * weights.sum():
                continue
            best = np.zeros(len(wanted) + 1)
            for w in near:
                if w in hits:
                    at, more = hits[w]
                    best[at + 1] = np.maximum(best[at + 1], best[at] + more)
                    np.maximum.accumulate(best, out=best)
            share = max(share, float(best[-1] / weights.sum()))
            if share > 1 - 1e-9:  # all of it
                break
        return share

    def search(self, lengths: np.ndarray, words: np.ndarray) -> dict[tuple[int, int], tuple[float, float]]:
        """(text, item) -> (cosine, common share) of the items found in texts, the best of each."""
        near: dict[tuple[int, int, int], float] = {}
        for text, start, item, cosine in self.candidates(lengths, words):
            near[text, start, item] = max(cosine, near.get((text, start, item), 0.0))
        begins, found = np.cumsum(lengths) - lengths, {}
        of, own = -1, []
        for (text, start, item), cosine in sorted(near.items()):
            if text != of:
                of, own = text, words[begins[text] : begins[text] + lengths[text]].tolist()
            common = self.check(own, start, item)
            if common >= COMMON:
                old = found.get((text, item), (0.0, 0.0))
                found[text, item] = (max(old[0], cosine), max(old[1], common))
        return found


def _words(texts: pa.Array) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """How many words each text has, and all their words (see ``words_of``), ``_BYTES`` at a time."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    _, ends, data = texts.buffers()
    ends = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(ends, ends[at] + _BYTES, "right")) - 1)
        bounds = ends[at : end + 1] - ends[at]
        part = data.slice(int(ends[at]), int(bounds[-1])).to_pybytes() if bounds[-1] else b""
        part = part.lower().translate(_SIGNS)
        letter = np.frombuffer(part, np.uint8) != 32
        first, last = letter.copy(), letter.copy()
        first[1:] &= ~letter[:-1]
        last[:-1] &= ~letter[1:]
        # A word ends with its text, whatever the next one starts with.
        between = bounds[(bounds > 0) & (bounds < len(part))]
        first[between], last[between - 1] = letter[between], letter[between - 1]
        first, last = np.flatnonzero(first), np.flatnonzero(last)
        starts = np.concatenate([[0], np.cumsum(last + 1 - first)])
        letters = part.translate(None, b" ")
        words = [None, pa.py_buffer(starts), pa.py_buffer(letters)]
        yield (
            np.diff(np.searchsorted(first, bounds)),
            pa.Array.from_buffers(pa.large_binary(), len(first), words),
        )
        at = end


def _numbered(docs: DataFrame, terms: dict[bytes, int]) -> DataFrame:
    """The texts' words as numbers of terms, in order; words that are none have the number after."""
    other = len(terms)
    # At most a block of items' words.
    shared = docs.sparkSession.sparkContext.broadcast(sorted(terms, key=terms.get))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(shared.value, pa.large_binary())
        for batch in batches:
            lengths, numbers = [np.zeros(1, np.int64)], [np.zeros(0, np.int32)]
            for counts, words in _words(batch.column(1)):
                lengths.append(counts)
                numbers.append(pc.index_in(words, value_set=known).fill_null(other).to_numpy())
            ends = np.cumsum(np.concatenate(lengths)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(numbers)))
            yield pa.record_batch([batch.column(0), lists], names=["_id", "_words"])

    schema = T.StructType([docs.schema["_id"], T.StructField("_words", T.ArrayType(T.IntegerType()))])
    return docs.mapInArrow(run, schema)


def _read(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of a batch's texts, and their words one after the other."""
    lists = batch.column(batch.num_columns - 1)
    ends = lists.offsets.to_numpy()
    return np.diff(ends).astype(np.int64), lists.values.to_numpy()[ends[0] : ends[-1]]


def _document_counts(rows: DataFrame, size: int) -> tuple[np.ndarray, int, int]:
    """Texts that hold each term, how many texts and how many passages there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, place = np.zeros(size + 3, np.int64), np.zeros(size + 1, np.int64)
        for batch in batches:
            lengths, words = _read(batch)
            for end, n in zip(np.cumsum(lengths).tolist(), lengths.tolist(), strict=True):
                own, at = words[end - n : end], np.arange(n)
                place[own] = at
                held[own[place[own] == at]] += 1  # one place of each of its words
            held[size + 1 :] += len(lengths), (-(-lengths // PASSAGE)).sum()
        yield pa.record_batch(
            [pa.array(np.arange(size + 3)), pa.array(held)], names=["term", "n"]
        )

    counts = rows.mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    found = np.zeros(size + 3, np.int64)
    for r in counts.collect():  # a row a term
        found[r.term] = r.n
    return found[:size].astype(float), int(found[size + 1]), int(found[size + 2])


def _summed_pairs(passages: np.ndarray, size: int, terms: np.ndarray, idf: np.ndarray, rare: float):
    """X'X over a space's terms, X being the unit TF-IDF vectors of ``passages``."""
    other, row, weight = len(terms), _rows(terms, size), np.append(idf, 0.0)
    pairs = np.zeros(other * other, np.float32)
    for start in range(0, len(passages), _SLICE):
        part = passages[start : start + _SLICE]
        held = row[part]
        lost = ((held == other).sum(axis=1) - (part == -1).sum(axis=1)) * rare**2
        held = _distinct(held, other)
        values = weight[held]
        norm = np.sqrt((values**2).sum(axis=1) + lost)
        values = (values / np.where(norm > 0, norm, 1)[:, None]).astype(np.float32)
        # Terms of a passage one after the other; how many of its own follow each.
        known = held < other
        term, value, count = held[known].astype(np.int64), values[known], known.sum(axis=1)
        follow = np.repeat(np.cumsum(count), count) - np.arange(len(term)) - 1
        at, far = np.arange(len(term)), 0
        while len(at):
            product = value[at] * value[at + far]
            np.add.at(pairs, term[at] * other + term[at + far], product if far else product / 2)
            far += 1
            at = at[follow[at] >= far]
    pairs = pairs.reshape(other, other)
    return pairs + pairs.T


def _pairs(rows: DataFrame, size: int, parts: list[tuple], rare: float) -> DataFrame:
    """For each space of ``parts``, (terms, idf): X'X, X being the unit TF-IDF vectors of all passages
    of the texts; in strips of ``_STRIP`` rows, of which those values that are not 0.

    Read once: a task sums what its passages add to each pair of a space's terms, and strips are
    added up by number.
    """
    shared = rows.sparkSession.sparkContext.broadcast(parts)
    widths = [len(terms) for terms, _ in parts]
    keep = sum(width**2 for width in widths) <= _KEPT_PAIRS

    def batch_of(space: int, strip: int, values: np.ndarray) -> pa.RecordBatch:
        at = np.flatnonzero(values)
        return pa.record_batch(
            [pa.array([space], pa.int32()), pa.array([strip], pa.int32()),
             pa.array([at.astype(_PLACE).tobytes()], pa.binary()),
             pa.array([values[at].astype(np.float32).tobytes()], pa.binary())],
            names=["space", "strip", "at", "values"],
        )

    def strips(space: int, pairs: np.ndarray) -> Iterator[pa.RecordBatch]:
        for start in range(0, len(pairs), _STRIP):
            yield batch_of(space, start // _STRIP, pairs[start : start + _STRIP].ravel())

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        waiting, n = [], 0
        for batch in batches:
            passages = _passages(*_read(batch), -1)[0][:-1]
            for start in range(0, len(passages), _SUMMED):
                waiting.append(passages[start : start + _SUMMED])
                n += len(waiting[-1])
                if n >= _SUMMED:
                    yield np.concatenate(waiting)
                    waiting, n = [], 0
        if n:
            yield np.concatenate(waiting)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {}
        for passages in grouped(batches):
            for space, (terms, idf) in enumerate(shared.value):
                pairs = _summed_pairs(passages, size, terms, idf, rare)
                if not keep:
                    yield from strips(space, pairs)
                elif space in total:
                    total[space] += pairs
                else:
                    total[space] = pairs
        for space, pairs in total.items():
            yield from strips(space, pairs)

    def add_up(found):  # a pyarrow table: one row a partial sum
        space, strip = found["space"][0].as_py(), found["strip"][0].as_py()
        total = np.zeros(_STRIP * widths[space])
        for at, values in zip(found["at"], found["values"], strict=True):
            total[np.frombuffer(at.as_py(), _PLACE)] += np.frombuffer(values.as_py(), np.float32)
        return pa.Table.from_batches([batch_of(space, strip, total)])

    out = "space int, strip int, at binary, values binary"
    return rows.mapInArrow(run, out).groupBy("space", "strip").applyInArrow(add_up, out)


def _times(pairs: DataFrame, right: list[np.ndarray]) -> list[np.ndarray]:
    """The matrix of each space in ``pairs`` times its matrix of ``right``, strip by strip."""
    shared = pairs.sparkSession.sparkContext.broadcast(right)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            products = []
            for r in zip(*batch.columns, strict=True):
                space, strip, at, values = (v.as_py() for v in r)
                wide = shared.value[space]
                full = np.zeros((min(_STRIP, len(wide) - strip * _STRIP), len(wide)))
                full.flat[np.frombuffer(at, _PLACE)] = np.frombuffer(values, np.float32)
                products.append((full @ wide).tobytes())
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array(products, pa.binary())],
                names=["space", "strip", "product"],
            )

    sums = [np.zeros(wide.shape) for wide in right]
    for r in pairs.mapInArrow(run, "space int, strip int, product binary").collect():  # terms' rows
        strip = np.frombuffer(r["product"], float).reshape(-1, right[r.space].shape[1])
        sums[r.space][r.strip * _STRIP : r.strip * _STRIP + len(strip)] = strip
    return sums


def _moments(rows: DataFrame, size: int, parts: list[tuple], rare: float, right: list) -> list[np.ndarray]:
    """For each space of ``parts``, (terms, idf): X'X times its matrix of ``right``, X being the unit
    TF-IDF vectors of all passages of the texts. ``latent_basis`` multiplies more often and keeps X'X."""
    return _times(_pairs(rows, size, parts, rare), right)


def latent_basis(
    rows: DataFrame, size: int, parts: list[tuple], own: list[np.ndarray], rare: float, n: int
) -> list[np.ndarray]:
    """For each space of ``parts`` the right singular vectors (terms x rank) of the TF-IDF matrix of
    its own passages and all ``n`` passages of the texts, which together weigh ``CORPUS`` of them.

    Randomised range finding with one power step. The texts are read once, for X'X of all spaces;
    each step multiplies that, strip by strip.
    """
    pairs = stage(_pairs(rows, size, parts, rare), "pairs")
    own = [o / np.linalg.norm(o, axis=1)[:, None] for o in own]

    def times(y: list[np.ndarray]) -> list[np.ndarray]:
        texts = _times(pairs, y)
        return [
            o.T @ (o @ v) + t * (CORPUS * len(o) / max(1, n))
            for o, v, t in zip(own, y, texts, strict=True)
        ]

    rng = np.random.default_rng(7)
    y = [rng.standard_normal((len(t), min(len(t), RANK + OVERSAMPLE))) for t, _ in parts]
    for _ in range(2):
        y = [np.linalg.qr(p)[0] for p in times(y)]
    basis = []
    for v, p in zip(y, times(y), strict=True):
        small = v.T @ p
        _, vectors = np.linalg.eigh((small + small.T) / 2)
        basis.append(v @ vectors[:, ::-1][:, :RANK])
    return basis


def _search(docs: DataFrame, items: list[tuple]) -> tuple[DataFrame, Search]:
    """The texts as numbers of the items' words, and what is needed to search them."""
    words = {w for _, wanted, answer in items for w in (*wanted, *answer)}
    terms = {w: i for i, w in enumerate(sorted(words))}
    rows = stage(_numbered(docs, terms), "words")
    counts, n, n_passages = _document_counts(rows, len(terms))
    rare = math.log(n + 1) + 1
    idf = rare - np.log(counts + 1)
    items = [(i, [terms[w] for w in wanted], [terms[w] for w in answer]) for i, wanted, answer in items]
    passages = [(i, p) for i, (_, wanted, _) in enumerate(items) for p in passages_of(wanted)]
    passages.sort(key=lambda p: (len(p[1]), p))  # like lengths together
    parts, lying = [], []
    for start in range(0, len(passages), RANK):
        part = passages[start : start + RANK]
        numbers = np.unique([w for _, p in part for w in p])
        parts.append((numbers, idf[numbers]))
        lying.append([(i, np.searchsorted(numbers, np.unique(p))) for i, p in part])
    own = [_own(w, [p for _, p in at]) for (_, w), at in zip(parts, lying, strict=True)]
    bases = latent_basis(rows, len(terms), parts, own, rare, n_passages)
    spaces = [
        Space(numbers, weights, basis, at, len(terms))
        for (numbers, weights), basis, at in zip(parts, bases, lying, strict=True)
    ]
    return rows, Search(items, idf, spaces)


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    answer_col: str | None = None,
) -> DataFrame:
    """(id, item, cosine, common) for every benchmark item found in a text.

    ``cosine`` is that of the item's nearest passage and a window of the text in the latent space.
    ``common`` is the share of the item's weighted words in the longest common subsequence. NULL
    and empty texts and items match nothing; repeated rows are searched and reported one by one;
    without texts or items there are no rows. An answer, where ``answer_col`` has one, has to stand
    near the passage; otherwise the item's rarest words do.
    """
    rows = text_of(docs, id_col, text_col)
    answer = F.col(answer_col) if answer_col else F.lit(None).cast("string")
    picked = benchmark.select(
        F.col(item_col).alias("i"), F.col(item_text_col).alias("t"), answer.alias("a")
    )
    schema = T.StructType(
        [
            T.StructField(id_col, rows.schema["_id"].dataType),
            T.StructField(item_col, picked.schema["i"].dataType),
            T.StructField("cosine", T.DoubleType()),
            T.StructField("common", T.DoubleType()),
        ]
    )
    result = docs.sparkSession.createDataFrame([], schema)
    for items in _blocks(picked):
        numbered, search = _search(rows, items)
        result = result.unionByName(numbered.mapInArrow(_searcher(docs, search, schema), schema))
    return result


def _blocks(picked: DataFrame) -> Iterator[list[tuple]]:
    """Items of at least one word, up to ``BLOCK_PASSAGES`` passages or one item at a time, each
    read when its turn comes."""
    held, n = [], 0
    for r in picked.toLocalIterator():
        words = words_of(r.t)
        if not words:
            continue
        more = len(passages_of(words))
        if held and n + more > BLOCK_PASSAGES:
            yield held
            held, n = [], 0
        held.append((r.i, words, words_of(r.a)))
        n += more
    if held:
        yield held


def _searcher(docs: DataFrame, search: Search, schema: T.StructType):
    # One block: bounded by BLOCK_PASSAGES passages and their terms.
    shared = docs.sparkSession.sparkContext.broadcast(search)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        types = None
        for batch in batches:
            ids, found = [], []
            for (at, item), scores in own.search(*_read(batch)).items():
                ids.append(at)
                found.append((own.items[item][0], *scores))
            types = types or [pa.int64() if f.dataType.typeName() == "long" else None for f in schema]
            yield pa.record_batch(
                [batch.column(0).take(pa.array(ids, pa.int64())),
                 pa.array([f[0] for f in found], types[1]),
                 pa.array([round(f[1], 6) for f in found], pa.float64()),
                 pa.array([round(f[2], 6) for f in found], pa.float64())],
                names=schema.names,
            )

    return run
