"""Substring removal by suffix automata of reference shards.

The reference is the set of passages that may be repeated, each stored once with its count, dealt into shards by
routing key (see ``repeats``).  A shard builds a suffix automaton over its reference passages, sums the counts over
the suffix links, and streams the passages through it for matching statistics: after every word, the state of the
longest match tells how often the window ending there occurs.  Maximal spans of repeated windows are removed.

The automata stay in the shard that uses them instead of being broadcast: a reference that grows with the corpus has
no bound on its size, and sending every document through every shard would be quadratic.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from . import repeats
from .repeats import Unit


class SuffixAutomaton:
    """Suffix automaton over token sequences, with occurrence counts of the strings of every state."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]
        self.count = [0]

    def _state(self, length: int, edges: dict, link: int) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        self.count.append(0)
        return len(self.next) - 1

    def _split(self, state: int, token, target: int) -> int:
        """A copy of ``target`` for the strings that end in ``state`` and ``token``."""
        copy = self._state(self.length[state] + 1, dict(self.next[target]), self.link[target])
        self.link[target] = copy
        while state >= 0 and self.next[state].get(token) == target:
            self.next[state][token] = copy
            state = self.link[state]
        return copy

    def extend(self, last: int, token) -> int:
        """Append a token behind state ``last``; returns the state of the longer string."""
        target = self.next[last].get(token)
        if target is not None:
            return target if self.length[target] == self.length[last] + 1 else self._split(last, token, target)
        new = self._state(self.length[last] + 1, {}, 0)
        state = last
        while state >= 0 and token not in self.next[state]:
            self.next[state][token] = new
            state = self.link[state]
        if state >= 0:
            target = self.next[state][token]
            self.link[new] = target if self.length[target] == self.length[state] + 1 else self._split(state, token, target)
        return new

    def add(self, tokens, weight: int, first: int = 0) -> None:
        """Add a reference passage that occurs ``weight`` times; ends before ``first`` are not counted."""
        last = 0
        for i, token in enumerate(tokens):
            last = self.extend(last, token)
            if i >= first:
                self.count[last] += weight

    def finish(self) -> None:
        """Sum the counts of longer strings into their suffixes."""
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            if self.link[state] >= 0:
                self.count[self.link[state]] += self.count[state]

    def matching(self, tokens, longest: int):
        """Yields ``(matched length, occurrences)`` after every token, for matches of at most ``longest`` tokens."""
        state, size = 0, 0
        following, link, length, count = self.next, self.link, self.length, self.count
        for token in tokens:
            while state and token not in following[state]:
                state = link[state]
                size = length[state]
            if token in following[state]:
                state, size = following[state][token], size + 1
            while link[state] >= 0 and length[link[state]] >= longest:
                state = link[state]
                size = length[state]
            yield min(size, longest), count[state]


def decide(unit: Unit, groups: dict[int, dict[bytes, int]]) -> dict[int, dict[bytes, np.ndarray]]:
    """Which windows of each passage occur twice or more among the passages of its key."""
    out = {}
    for key, passages in groups.items():
        automaton = SuffixAutomaton()
        split = {p: p.split(b" ") if unit.words else p for p in passages}
        for passage, weight in passages.items():
            automaton.add(split[passage], weight, unit.length - 1)
        automaton.finish()
        out[key] = {p: np.fromiter((size >= unit.length and n > 1 for size, n in automaton.matching(tokens, unit.length)),
                                   bool, len(tokens))[unit.length - 1:] for p, tokens in split.items()}
    return out


def substring_dedup(docs: DataFrame, length: int = 35, k: int = 8, id_col: str = "doc_id", text_col: str = "text",
                    kept_text: bool = True) -> DataFrame:
    """Remove every word covered by a ``length``-word window that also starts anywhere else.

    One row per document: id, ``n_tokens`` (words), ``n_removed``, ``n_spans``, ``kept_sha256``, ``spans`` (removed
    word ranges) and ``kept`` (the kept words joined by spaces, UTF-8; null if ``kept_text`` is off).
    Defined cases: a null or empty text has no words and hashes as the empty string; a null id is kept; rows that
    repeat an id, or a whole row, are rows like any other, so their windows count as occurring elsewhere; an empty
    table gives no rows; other columns are ignored.
    """
    return repeats.removed(docs, Unit(True, length, min(k, length)), decide, 4 << 20, id_col, text_col, kept_text)
