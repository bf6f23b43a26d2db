"""Substring removal by threshold-bounded interval expansion on a Burrows-Wheeler transform.

Passages that may be repeated are dealt into shards by routing key (see ``repeats``).  A shard joins its passages into
one text, computes its Burrows-Wheeler transform, and finds common prefixes breadth first: the intervals of suffixes
that share ``l`` bytes are extended backward by every preceding byte, which sets the boundaries of common prefix ``l``;
values are set in increasing order and the expansion stops at the wanted length.  Boundaries still unset then separate
suffixes that share at least that many bytes, so every run between set boundaries is one repeated string.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from . import repeats
from .repeats import Unit


def suffix_order(codes: np.ndarray) -> np.ndarray:
    """Suffix order of ``codes`` (values below 2**16), by prefix doubling; every passage ends with a code of its own."""
    n = len(codes)
    padded = np.concatenate([codes.astype(np.int64) + 1, np.zeros(4, np.int64)])
    key = (padded[:n] << 48) | (padded[1:n + 1] << 32) | (padded[2:n + 2] << 16) | padded[3:n + 3]
    order, at = np.argsort(key), np.arange(n)
    some, key, rank, known = order, key[order], np.empty(n, np.int64), 4
    while True:
        # ``at`` are the places still in doubt; suffixes of one group share the place of its first.
        new = np.concatenate([[True], key[1:] != key[:-1]])
        rank[some] = at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        alone = new & np.append(new[1:], True)
        at = at[~alone]
        if not len(at):
            return order
        some = order[at]
        ahead = some + known
        key = rank[some] * (n + 1) + np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        turn = np.argsort(key)
        some, key = some[turn], key[turn]
        order[at] = some
        known *= 2


def common_prefix_boundaries(codes: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """For each place in suffix order, whether it shares less than ``depth`` codes with the place before.

    Breadth-first backward extension: at level ``l`` the open intervals hold suffixes that share ``l`` codes.
    """
    n = len(codes)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    before = order - 1
    before[before < 0] = n - 1
    back = place[before]                     # LF mapping
    forward = np.empty(n, np.int64)
    forward[back] = np.arange(n)
    bwt = codes[before]
    same = np.zeros(n + 1, bool)             # suffixes of one first code stand together
    same[1:n] = codes[order[1:]] == codes[order[:-1]]
    nearby = forward[np.minimum(back + 1, n - 1)]
    following = np.where(same[back + 1], nearby, n)      # next place with the same BWT code
    leading = np.where(same[back], forward[back - 1], -1)  # the one before
    # Within an interval the first and last place of a code begin or end a run of equal codes, so only runs are visited.
    run = np.cumsum(np.concatenate([[0], bwt[1:] != bwt[:-1]]))
    starts = np.flatnonzero(np.concatenate([[True], bwt[1:] != bwt[:-1]]))
    ends = np.append(starts[1:], n) - 1
    boundary = np.zeros(n + 1, bool)
    boundary[0] = boundary[n] = True
    low, high = np.array([0]), np.array([n])
    for level in range(depth):
        if not len(low):
            break
        begin = run[low]
        size = run[high - 1] - begin + 1
        interval = np.repeat(np.arange(len(low)), size)
        piece = np.repeat(begin - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(int(size.sum()))
        if level:  # a code that ends a passage stands alone, and its places were set first
            inner = bwt[starts[piece]] < 256
            interval, piece = interval[inner], piece[inner]
        lo, hi = low[interval], high[interval]
        start, end = np.maximum(starts[piece], lo), np.minimum(ends[piece], hi - 1)
        first, last = leading[start] < lo, following[end] >= hi
        pair = interval.astype(np.int64) << 20
        start, end = start[first], end[last]
        start = start[np.argsort(pair[first] | bwt[start], kind="stable")]
        end = end[np.argsort(pair[last] | bwt[end], kind="stable")]
        low, high = back[start], back[end] + 1
        new = ~boundary[high]
        low, high = low[new], high[new]
        boundary[high] = True
    return boundary[:n]


def _repeated(unit: Unit, passages: list[bytes], weights: np.ndarray) -> list[np.ndarray]:
    sizes = np.fromiter(map(len, passages), np.int64, len(passages))
    codes = np.frombuffer(b"\0".join(passages) + b"\0", np.uint8).astype(np.int64)
    ends = np.cumsum(sizes + 1) - 1
    codes[ends] = 256 + np.arange(len(passages))         # every passage ends with a code of its own
    order = suffix_order(codes)
    group = np.cumsum(common_prefix_boundaries(codes, order, unit.length)) - 1
    owner = np.repeat(np.arange(len(passages)), sizes + 1)
    total = np.bincount(group, weights[owner[order]])
    found = np.zeros(len(codes), bool)
    found[order] = total[group] > 1
    starts = ends - sizes
    return [found[a:a + n - unit.length + 1] for a, n in zip(starts.tolist(), sizes.tolist())]


def decide(unit: Unit, groups: dict[int, dict[bytes, int]]) -> dict[int, dict[bytes, np.ndarray]]:
    """Which windows of each passage occur twice or more; all groups of the shard share one transform."""
    passages = [(key, p, n) for key, group in groups.items() for p, n in group.items()]
    if not passages:
        return {}
    flags = _repeated(unit, [p for _, p, _ in passages], np.array([n for *_, n in passages], np.int64))
    out: dict[int, dict[bytes, np.ndarray]] = {key: {} for key in groups}
    for (key, passage, _), found in zip(passages, flags):
        out[key][passage] = found
    return out


def suffix_dedup(docs: DataFrame, length: int = 400, k: int = 200, id_col: str = "doc_id", text_col: str = "text",
                 kept_text: bool = True) -> DataFrame:
    """Remove every byte covered by a ``length``-byte string that also starts anywhere else.

    One row per document: id, ``n_tokens`` (bytes), ``n_removed``, ``n_spans`` (maximal removed runs), ``kept_sha256``,
    ``spans`` (removed byte ranges) and ``kept`` (the remaining bytes; null if ``kept_text`` is off).  Texts are cut as
    UTF-8 bytes, so ``kept`` may cut through a character.
    Defined cases: a null or empty text has no bytes and hashes as the empty string; a null id is kept; rows that
    repeat an id, or a whole row, are rows like any other, so their strings count as occurring elsewhere; an empty
    table gives no rows; other columns are ignored.
    """
    return repeats.removed(docs, Unit(False, length, min(k, length)), decide, 2 << 20, id_col, text_col, kept_text)
