"""Token counts under a unigram vocabulary, by dynamic programming over a trie of words.

The distinct words of a batch are walked in order, which is the depth-first order of their trie:
the forward scores of a prefix are computed once and stay on a stack for all words that share it.
The count of a word's best split is kept for the words to come.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from medwarden.llm.common import SPACE, kept_in_worker, text_of

_WORD = re.compile(f"[^{SPACE}]+")
MARK = "\u2581"
# Words and characters of words whose counts a worker keeps.
_KEPT_WORDS, _KEPT_LENGTH = 800_000, 64


def vocabulary(path: str) -> dict[str, float]:
    """Piece -> log chance, from the ranked pieces of a sentencepiece model file.

    The file ranks its pieces but gives no chances; by Zipf's law rank r gets one in proportion to
    1 / r. Control pieces and single bytes are left out: bytes are the way out for characters that
    no piece holds.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [
        model.id_to_piece(i)
        for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))
    ]
    whole = math.log(sum(1 / r for r in range(1, len(pieces) + 1)))
    return {p: -math.log(r) - whole for r, p in enumerate(pieces, 1)}


class Counter:
    """Counts tokens of words; a word is split behind a mark that stands for the space before it.

    The best split has the highest sum of log chances, added from the left; among equals the one
    of fewest tokens. A character that no piece covers costs one token a byte, each less likely
    than any piece.
    """

    def __init__(self, pieces: dict[str, float]):
        self._pieces = pieces
        self._longest = max(map(len, pieces), default=1)
        self._byte = min(pieces.values(), default=0.0) - 10.0
        self._kept: dict[str, int] = {}

    def count(self, words: list[str]) -> int:
        kept = self._kept
        counts = list(map(kept.get, words))
        if None not in counts:
            return sum(counts)
        new = {w for w, c in zip(words, counts, strict=True) if c is None}
        found = self._walk(sorted(new))
        total = sum(found[w] if c is None else c for w, c in zip(words, counts, strict=True))
        if len(kept) + len(found) > _KEPT_WORDS:
            kept.clear()
        kept.update((w, c) for w, c in found.items() if len(w) <= _KEPT_LENGTH)
        return total

    def _walk(self, words: list[str]) -> dict[str, int]:
        get, longest = self._pieces.get, self._longest
        found = {}
        # Forward score and token count of each prefix of the word at hand.
        score, tokens, before = [0.0], [0], ""
        for word in words:
            text = MARK + word
            shared = 0
            for a, b in zip(before, text, strict=False):
                if a != b:
                    break
                shared += 1
            del score[shared + 1 :], tokens[shared + 1 :]
            for end in range(shared + 1, len(text) + 1):
                width = len(text[end - 1].encode("utf-8", "surrogatepass"))
                best, fewest = score[end - 1] + width * self._byte, tokens[end - 1] + width
                for start in range(max(0, end - longest), end):
                    chance = get(text[start:end])
                    if chance is not None:
                        s, t = score[start] + chance, tokens[start] + 1
                        if s > best or s == best and t < fewest:
                            best, fewest = s, t
                score.append(best)
                tokens.append(fewest)
            found[word] = tokens[-1]
            before = text
        return found


def token_counts(
    docs: DataFrame, pieces: dict[str, float], id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, n_words, n_tokens) of every whole text.

    A NULL or blank text has no words and no tokens. Repeated rows are counted alike; an empty
    table gives no rows. Nothing is shuffled: a task needs only its own texts.
    """
    shared = docs.sparkSession.sparkContext.broadcast(pieces)  # a tokenizer's fixed vocabulary
    name = hashlib.sha256(repr(sorted(pieces.items())).encode()).hexdigest()
    rows = text_of(docs, id_col, text_col)
    schema = T.StructType(
        [
            T.StructField("_id", rows.schema["_id"].dataType),
            T.StructField("n_words", T.LongType()),
            T.StructField("n_tokens", T.LongType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = shared.value
        counter = kept_in_worker(("unigram", name), lambda: Counter(pieces))
        for batch in batches:
            made = []
            for text in batch.column(1):
                words = _WORD.findall(text.as_py() or "")
                made.append((len(words), counter.count(words)))
            yield pa.record_batch(
                [batch.column(0), pa.array([m[0] for m in made], pa.int64()),
                 pa.array([m[1] for m in made], pa.int64())],
                names=schema.names,
            )

    return rows.mapInArrow(run, schema).withColumnRenamed("_id", id_col)
