"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the last bytes picks some of a text's white space as chunk ends, so the same
passage is cut alike wherever it stands. A worker encodes a chunk once and reuses its ids, also for
its next task; a chunk it has not met is put together from its words, whose ids are kept as well.
Where two chunks meet, the words around the join are encoded together; if that differs from their
own ids, the chunks are encoded as one and the next join is tried, until both agree.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from medwarden.llm.common import kept_in_worker, text_of

# Bytes the rolling hash covers; one white space in CHUNK_WORDS ends a chunk on average.
HASH_BYTES = 8
CHUNK_WORDS = 128
# What a worker keeps: words (half of them those in use, half those before), and bytes of chunks.
_KEPT_WORDS, _KEPT_LENGTH, _KEPT_BYTES = 300_000, 64, 32_000_000
_POWERS = np.array([pow(0x01000193, k, 1 << 32) for k in range(HASH_BYTES)], np.uint32)
_MARKS = b".,;:!?"
# Bytes cut at once, which bounds the arrays for long texts.
_BLOCK = 1 << 20


def cuts(text: bytes) -> list[int]:
    """Positions of the white space that ends a chunk, ascending."""
    found = []
    whole = np.frombuffer(text, np.uint8)
    for start in range(0, len(whole), _BLOCK):
        block = whole[start : start + _BLOCK]
        at = np.flatnonzero((block == 32) | (block == 10)) + start
        at = at[at >= HASH_BYTES]
        h = np.zeros(len(at), np.uint32)
        for k in range(HASH_BYTES):
            h += whole[at - 1 - k].astype(np.uint32) * _POWERS[k]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA6B)
        found += at[(h >> np.uint32(8)) % CHUNK_WORDS == 0].tolist()
    return found


class Encoded(NamedTuple):
    """Ids of a piece of text, as the result needs them: their count, decimals and tokens."""

    n: int
    ids: str
    tokens: str


class Encoder:
    """A worker's tokenizer and what it has encoded so far."""

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_str(definition)
        suffix = json.loads(definition)["model"].get("end_of_word_suffix")
        size = self._tokenizer.get_vocab_size()
        self._decimals = list(map(str, range(size)))
        tokens = list(map(self._tokenizer.id_to_token, range(size)))
        self._token_of = dict(zip(self._decimals, tokens, strict=True))
        self._ends = [bool(suffix) and t.endswith(suffix) for t in tokens]
        # Only the decimals, as there are many words.
        self._words: dict[bytes, str] = {}
        self._earlier: dict[bytes, str] = {}
        self._chunks: dict[bytes, Encoded] = {}
        self._chunk_bytes = 0

    def _plain(self, texts: list[bytes]) -> list[str]:
        made = self._tokenizer.encode_batch_fast(
            [t.decode("utf-8") for t in texts], add_special_tokens=False
        )
        return [self._written(e.ids) for e in made]

    def _written(self, ids: list[int]) -> str:
        decimals = self._decimals
        return " ".join([decimals[i] for i in ids])

    def _encoded(self, written: str) -> Encoded:
        ids, tokens = written.split(), self._token_of
        return Encoded(len(ids), written, " ".join([tokens[i] for i in ids]))

    def _parts(self, parts: list[bytes]) -> dict[bytes, str]:
        """The ids of each part; runs of plain letters all in one text, as each is one word in it, too."""
        plain = [p for p in parts if p.isalpha()]
        made = {}
        if len(plain) > 1:
            start, ends = 0, self._ends
            ids = self._tokenizer.encode_batch_fast([b" ".join(plain).decode()], add_special_tokens=False)[0].ids
            found = []
            for at, i in enumerate(ids, 1):
                if ends[i]:
                    found.append(ids[start:at])
                    start = at
            if len(found) == len(plain) and start == len(ids):
                made = dict(zip(plain, map(self._written, found), strict=True))
        left = [p for p in parts if p not in made]
        if left:
            made.update(zip(left, self._plain(left), strict=True))
        return made

    def _of_words(self, words: list[bytes]) -> list[str]:
        kept = self._words
        found = list(map(kept.get, words))
        if None in found:
            at = [i for i, f in enumerate(found) if f is None]
            asked, earlier = {words[i] for i in at}, self._earlier
            made = {w: earlier[w] for w in asked if w in earlier}
            new = {w: _apart(w) for w in asked if w not in made}
            needed = {p for parts in new.values() for p in parts if p not in kept and p not in made}
            made.update((p, earlier[p]) for p in needed if p in earlier)
            needed = [p for p in needed if p not in made]
            made.update(self._parts(needed))
            for word, parts in new.items():
                if word not in made:
                    made[word] = _spaced([made[p] if p in made else kept[p] for p in parts])
            for i in at:
                found[i] = made[words[i]]
            if len(kept) + len(made) > _KEPT_WORDS // 2:
                self._earlier, self._words = kept, {}
            self._words.update((w, e) for w, e in made.items() if len(w) <= _KEPT_LENGTH)
        return found

    def _chunk(self, chunk: bytes) -> Encoded:
        found = self._chunks.get(chunk)
        if found is None:
            found = self._encoded(_spaced(self._of_words(chunk.split())))
            if self._chunk_bytes > _KEPT_BYTES:
                self._chunks.clear()
                self._chunk_bytes = 0
            self._chunks[chunk] = found
            self._chunk_bytes += len(chunk) + len(found.ids) + len(found.tokens)
        return found

    def _agree(self, left: bytes, right: bytes) -> bool:
        """Whether the words around a join have the ids they have apart."""
        tail, head = left.split()[-1:], right.split(None, 1)[:1]
        if not tail or not head:
            return True
        both = self._plain([tail[0] + right[: len(right) - len(right.lstrip())] + head[0]])[0]
        return both == _spaced(self._of_words([tail[0], head[0]]))

    def encode(self, text: bytes) -> Encoded:
        ends = cuts(text)
        parts, made = [], []
        for start, end in zip([0, *ends], [*ends, len(text)], strict=True):
            part = text[start:end]
            if parts and not self._agree(parts[-1], part):
                parts[-1] += part
                made[-1] = self._encoded(self._plain([parts[-1]])[0])
            else:
                parts.append(part)
                made.append(self._chunk(part))
        return _join(made)


def _apart(word: bytes) -> list[bytes]:
    """A word and the marks at its end, which share no token with a letter before them.

    Tokens are in lower case. That is done here for plain letters only: among others, composing
    marks may come first.
    """
    core = word.rstrip(_MARKS)
    if len(core) == len(word) or not core[-1:].isalpha():
        core = word
    parts = [core.lower() if core.isalpha() else core]
    return parts if core is word else [*parts, word[len(core) :]]


def _spaced(parts: list[str]) -> str:
    return " ".join(filter(None, parts))


def _join(parts: list[Encoded]) -> Encoded:
    counts, ids, tokens = zip(*parts, strict=True) if parts else ((), (), ())
    if 0 in counts:
        ids, tokens = filter(None, ids), filter(None, tokens)
    return Encoded(sum(counts), " ".join(ids), " ".join(tokens))


def bpe_round_trip(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
    keep_ids: bool = False,
) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of every whole text, and ``ids`` on request.

    Equal to the tokenizer's own encode and decode, as long as it has no decoder (tokens are joined
    by a space) and keeps no token across white space; both are checked. A NULL text is encoded as
    empty: no tokens, the hashes of nothing. Repeated rows are encoded alike; an empty table gives
    no rows. Nothing is shuffled: chunks are shared within a worker, as sharing them between workers
    would move more bytes than the texts have.
    """
    with open(tokenizer_path, encoding="utf-8") as file:
        definition = file.read()
    _check(definition)
    shared = docs.sparkSession.sparkContext.broadcast(definition)
    rows = text_of(docs, id_col, text_col).select("_id", F.encode("_text", "utf-8").alias("_text"))
    fields = [
        T.StructField("_id", rows.schema["_id"].dataType),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType()),
    ]
    if keep_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    schema = T.StructType(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        definition = shared.value
        encoder = kept_in_worker(("bpe", definition), lambda: Encoder(definition))
        for batch in batches:
            made = [encoder.encode(t.as_py() or b"") for t in batch.column(1)]
            columns = [
                batch.column(0),
                pa.array([e.n for e in made], pa.int64()),
                pa.array([hashlib.sha256(e.ids.encode()).hexdigest() for e in made], pa.string()),
                pa.array([hashlib.sha256(e.tokens.encode()).hexdigest() for e in made], pa.string()),
            ]
            if keep_ids:
                ids = [list(map(int, e.ids.split())) for e in made]
                columns.append(pa.array(ids, pa.list_(pa.int32())))
            yield pa.record_batch(columns, names=schema.names)

    return rows.mapInArrow(run, schema).withColumnRenamed("_id", id_col)


def _check(definition: str) -> None:
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(definition)
    if tokenizer.decoder is not None:
        raise ValueError("decoding by joining tokens needs a tokenizer without a decoder")
    one, other = (tokenizer.encode(t, add_special_tokens=False).ids for t in ("a b", "a\n b"))
    if one != other or len(one) != 2:
        raise ValueError("chunks end at white space, which the tokenizer has to drop")
