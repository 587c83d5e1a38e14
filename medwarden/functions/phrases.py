"""Phrases of a lexicon found in token arrays by a trie with failure links (Aho-Corasick)."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


class PhraseTrie:
    """Finds all phrases in one walk over the words, however long and nested the phrases are.

    A node is a run of words that begins a phrase. Its failure link leads to the longest proper
    ending of that run which begins a phrase, too; so no word is looked at twice.
    """

    def __init__(self, phrases: Sequence[Sequence[str]]) -> None:
        """Phrases are numbered as they come; those without a word are never found."""
        self._next: list[dict[str, int]] = [{}]
        self._found: list[list[int]] = [[]]
        for number, phrase in enumerate(phrases):
            if phrase:
                self._found[self._add(phrase)].append(number)
        self._fail = [0] * len(self._next)
        self._link()

    def _add(self, phrase: Iterable[str]) -> int:
        node = 0
        for word in phrase:
            if word not in self._next[node]:
                self._next[node][word] = len(self._next)
                self._next.append({})
                self._found.append([])
            node = self._next[node][word]
        return node

    def _link(self) -> None:
        level = deque(self._next[0].values())
        while level:
            node = level.popleft()
            for word, child in self._next[node].items():
                self._fail[child] = self._step(self._fail[node], word)
                # What ends at the link ends here as well; links are shorter, so they are done.
                self._found[child] = self._found[child] + self._found[self._fail[child]]
                level.append(child)

    def _step(self, node: int, word: str) -> int:
        while node and word not in self._next[node]:
            node = self._fail[node]
        return self._next[node].get(word, 0)

    def find(self, words: Iterable[str | None]) -> list[int]:
        """Numbers of the phrases that occur, in ascending order; a NULL word matches none."""
        found: set[int] = set()
        node = 0
        for word in words:
            node = self._step(node, word)
            if self._found[node]:
                found.update(self._found[node])
        return sorted(found)


def phrases_in(words: Column, phrases: Sequence[Sequence[str]]) -> Column:
    """Numbers of the ``phrases`` that the token array has; empty for a NULL array.

    The trie travels with the plan, so the caller bounds the number of phrases. Rows without any
    word that begins a phrase should be filtered out before.
    """
    trie = PhraseTrie(phrases)

    @F.arrow_udf("array<int>")
    def find(batch: pa.Array) -> pa.Array:
        return pa.array([trie.find(row or ()) for row in batch.to_pylist()], pa.list_(pa.int32()))

    return find(words)
