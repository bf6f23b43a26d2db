"""Routing of repeated passages, shared by the two exact substring removals.

A window of ``length`` tokens is repeated if the same tokens start anywhere else.  Every window is routed by
the smallest hash of the k-grams inside it (its key), so equal windows always meet:

1. count the keys over all documents; only keys seen twice or more can hold repeated windows;
2. consecutive windows of one key form a *passage*; equal passages are counted, and one text of each goes to the
   shard of its key;
3. a shard decides which windows of its passages are repeated (suffix automaton or BWT, passed in as ``decide``);
4. the decisions return to every document that holds the passage.

The corpus is never paired with itself, no group of copies meets in one task (equal passages are counted where
they are read, decisions go back by a join that Spark can split).  Windows of a key with more than ``HOT`` occurrences
are routed by longer grams instead, whose keys are counted alike, and those of a longer gram with more than ``HOT``
different passages go window by window; so a line in a third of all documents has no shard of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslake.session import cut_lineage

from . import common as C
from .decontamination import BitFilter, bit_filter

#: A key with more occurrences is split by longer grams, and one of those with more different passages by whole windows.
HOT = 1000
#: Passages of which a task keeps counts before it hands them on.
HELD = 100_000
#: Bytes of texts that are taken at once.
SLICE = 1 << 20

PASSAGE = pa.schema([("key", pa.int64()), ("ctx", pa.int64()), ("passage", pa.large_binary()), ("n", pa.int64())])
PLACE = pa.schema([("key", pa.int64()), ("ctx", pa.int64()), ("did", pa.int64()), ("dn", pa.int64()), ("start", pa.int32())])
VERDICT = pa.schema([("key", pa.int64()), ("ctx", pa.int64()), ("runs", pa.list_(pa.int32()))])


@dataclass(frozen=True)
class Unit:
    """What a token is: words or bytes, how many make a window, and how many a k-gram."""

    words: bool
    length: int
    k: int

    @property
    def width(self) -> int:
        """k-grams in a window."""
        return self.length - self.k + 1

    @property
    def fine_width(self) -> int:
        """Grams in a window of those that split a hot key."""
        return max(1, self.length // 8)


class Tokens:
    """Tokens of a list of texts: codes for hashing, the owner of each, and the bytes of a range."""

    def __init__(self, unit: Unit, texts: list[bytes]):
        self.unit, self.n_docs = unit, len(texts)
        if unit.words:
            words = C.Words(texts)
            self.first, self.codes, self.raw = words.first, words.hashes(), words.raw
            self.start, self.end = words.start, words.end
        else:
            self.raw = b"".join(texts)
            self.first = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))])
            self.codes = C.BYTE_CODE[np.frombuffer(self.raw, np.uint8)]

    def content(self, a: int, b: int) -> bytes:
        if self.unit.words:
            return b" ".join(self.raw[self.start[a]:self.end[b - 1]].split())
        return self.raw[a:b]

    def windows(self) -> tuple[np.ndarray, ...]:
        """``(prefix sums, k-gram hashes, key of each window, document of each token)``; the key of a window over two documents is 0."""
        unit = self.unit
        prefix = C.running(self.codes)
        gram = C.grams(prefix, unit.k)
        doc = np.repeat(np.arange(self.n_docs), np.diff(self.first))
        if len(self.codes) < unit.length:
            return prefix, gram, np.empty(0, np.uint64), doc
        key = C.sliding(gram, unit.width, np.minimum)
        key = np.where(doc[:len(key)] == doc[unit.length - 1:], np.maximum(key, np.uint64(1)), np.uint64(0))
        return prefix, gram, key, doc

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """``(key, document)`` of every k-gram that is the key of a window."""
        _, gram, key, doc = self.windows()
        if not len(key):
            return key, doc[:0]
        around = np.zeros(self.unit.width - 1, np.uint64)
        most = C.sliding(np.concatenate([around, key, around]), self.unit.width, np.maximum)
        at = np.flatnonzero(np.maximum(gram, np.uint64(1)) == most)
        return np.maximum(gram[at], np.uint64(1)), doc[at]

    def runs(self) -> tuple[np.ndarray, ...]:
        """``(prefix sums, first window, end window, key, document)`` of each run of windows with one key."""
        prefix, _, key, doc = self.windows()
        m = len(key)
        if not m:
            none = np.empty(0, np.int64)
            return prefix, none, none, key, none
        edge = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (doc[1:m] != doc[:m - 1]), [True]]))
        a, b = edge[:-1], edge[1:]
        ok = key[a] > 0
        a, b = a[ok], b[ok]
        return prefix, a, b, key[a], doc[a]


def _keys_of(unit: Unit):
    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for part in C.slices(rows, "text", SLICE):
            key, doc = Tokens(unit, C.column_bytes(part, "text")).keys()
            out.append((C.signed(key), part.column("did").to_numpy()[doc], part.column("dn").to_numpy()[doc]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["key", "did", "dn"])
    return C.per_batch(batch)


def _expanded(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places ``starts[i] .. starts[i] + sizes[i] - 1`` of every ``i``."""
    return np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(int(sizes.sum())) if len(starts) else np.empty(0, np.int64)


class Finer:
    """Hot runs ``[a, b)`` cut where the smallest longer gram of a window changes: ``run``, ``lo``, ``hi`` and ``key`` of each piece."""

    def __init__(self, unit: Unit, prefix: np.ndarray, a: np.ndarray, b: np.ndarray):
        self.width = unit.fine_width
        self.gram = C.grams(prefix, unit.length - self.width + 1) if len(a) else np.empty(0, np.uint64)
        at, run = _expanded(a, b - a), np.repeat(np.arange(len(a)), b - a)
        key = C.sliding(self.gram, self.width, np.minimum)[at] if len(a) else self.gram
        first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (run[1:] != run[:-1])])) if len(at) else at
        self.run, self.key, self.lo = run[first], key[first], at[first]
        self.hi = self.lo + np.diff(np.append(first, len(at)))

    def occurrences(self) -> np.ndarray:
        """How often the gram of each piece stands in it: a piece that repeats a window within itself holds it twice."""
        sizes = self.hi - self.lo + self.width - 1
        same = self.gram[_expanded(self.lo, sizes)] == np.repeat(self.key, sizes)
        return np.add.reduceat(same.astype(np.int64), np.cumsum(sizes) - sizes)


def _finer_counts(unit: Unit, hot):
    """``(key, ctx, n)`` of the pieces of hot runs, counted where they are read: copies and common passages are a row a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], int] = {}

        def flush():
            key, ctx = zip(*held)
            out = pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (key, ctx, list(held.values()))], ["key", "ctx", "n"])
            held.clear()
            return out

        for batch in batches:
            for part in C.slices(batch, "text", SLICE):
                prefix, a, b, key, _ = Tokens(unit, C.column_bytes(part, "text")).runs()
                some = np.flatnonzero(hot.holds(key))
                if not len(some):
                    continue
                finer = Finer(unit, prefix, a[some], b[some])
                ctx = C.spans_hash(prefix, finer.lo, finer.hi + unit.length - 1)
                for k, c, n in zip(C.signed(finer.key).tolist(), C.signed(ctx).tolist(), finer.occurrences().tolist()):
                    held[k, c] = held.get((k, c), 0) + n
                if len(held) > HELD:
                    yield flush()
        if held:
            yield flush()
    return run


def _passages(unit: Unit, part: pa.RecordBatch, fine: BitFilter, single: BitFilter):
    """``(tokens, document, key, ctx, first window, end window)`` of what is sent to the shards: runs whose keys are repeated,
    pieces of hot runs, or single windows of hot pieces."""
    tokens = Tokens(unit, C.column_bytes(part, "text"))
    prefix, a, b, key, doc = tokens.runs()
    among = lambda values, column: np.isin(C.signed(values), part.column(column).flatten().to_numpy())
    wanted, split = among(key, "keys"), among(key, "hot")
    plain, many = np.flatnonzero(wanted & ~split), np.flatnonzero(wanted & split)
    finer = Finer(unit, prefix, a[many], b[many])
    wanted, split = fine.holds(finer.key), single.holds(finer.key)
    piece, last = np.flatnonzero(wanted & ~split), np.flatnonzero(wanted & split)
    sizes = finer.hi[last] - finer.lo[last]
    single = _expanded(finer.lo[last], sizes)
    run = np.concatenate([plain, many[finer.run[piece]], np.repeat(many[finer.run[last]], sizes)]).astype(np.int64)
    lo = np.concatenate([a[plain], finer.lo[piece], single]).astype(np.int64)
    hi = np.concatenate([b[plain], finer.hi[piece], single + 1]).astype(np.int64)
    ctx = C.spans_hash(prefix, lo, hi + unit.length - 1) if len(lo) else np.empty(0, np.uint64)
    own = np.concatenate([key[plain], finer.key[piece], C.mix(ctx[len(ctx) - len(single):] ^ np.uint64(unit.length))])
    return tokens, doc[run], C.signed(own), C.signed(ctx), lo, hi


def _collect(unit: Unit, fine: BitFilter, single: BitFilter):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list] = {}

        def flush():
            rows = [(k, c, v[0], v[1]) for (k, c), v in held.items()]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows), PASSAGE.types)], schema=PASSAGE)

        for batch in batches:
            for part in C.slices(batch, "text", SLICE):
                tokens, _, own, ctx, lo, hi = _passages(unit, part, fine, single)
                for k, c, s, e in zip(own.tolist(), ctx.tolist(), lo.tolist(), hi.tolist()):
                    at = held.get((k, c))
                    if at is None:
                        held[k, c] = [tokens.content(s, e + unit.length - 1), 1]
                    else:
                        at[1] += 1
                if len(held) > HELD:
                    yield flush()
        if held:
            yield flush()
    return run


def _places(unit: Unit, fine: BitFilter, single: BitFilter):
    def batch(rows: pa.RecordBatch) -> pa.RecordBatch | None:
        out = []
        for part in C.slices(rows, "text", SLICE):
            tokens, at, own, ctx, lo, _ = _passages(unit, part, fine, single)
            did, dn = part.column("did").to_numpy(), part.column("dn").to_numpy()
            out.append((own, ctx, did[at], dn[at], (lo - tokens.first[at]).astype(np.int32)))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], schema=PLACE)
    return C.per_batch(batch)


def _shards(unit: Unit, decide: Callable, limit: int):
    """Groups of a sorted partition, gathered up to ``limit`` bytes, each with its passages counted."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: list[tuple[int, dict[bytes, list]]] = []
        size = 0

        def out():
            rows = [(key, ctx, runs) for key, passages in groups for ctx, runs in _settle(unit, passages, several.get(key))]
            return pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows), VERDICT.types)], schema=VERDICT) if rows else None

        for batch in batches:
            for key, ctx, passage, n in zip(*(batch.column(c).to_pylist() for c in ("key", "ctx", "passage", "n"))):
                if not groups or groups[-1][0] != key:
                    if size > limit:
                        several = decide(unit, _open(unit, groups))
                        if (rows := out()) is not None:
                            yield rows
                        groups, size = [], 0
                    groups.append((key, {}))
                at = groups[-1][1].get(passage)
                if at is None:
                    groups[-1][1][passage] = [n, ctx]
                    size += len(passage)
                else:
                    at[0] += n
        if groups:
            several = decide(unit, _open(unit, groups))
            if (rows := out()) is not None:
                yield rows
    return run


def _open(unit: Unit, groups) -> dict[int, dict[bytes, int]]:
    """Groups that need a comparison: several passages, or one that may repeat windows within itself."""
    def settled(passages: dict[bytes, list]) -> bool:
        (passage, (n, _)), *more = passages.items()
        return not more and (n > 1 or _n_windows(unit, passage) == 1)

    return {key: {p: v[0] for p, v in passages.items()} for key, passages in groups if not settled(passages)}


def _n_windows(unit: Unit, passage: bytes) -> int:
    return (passage.count(b" ") + 1 if unit.words else len(passage)) - unit.length + 1


def _settle(unit: Unit, passages: dict[bytes, list], several: dict | None):
    for passage, (n, ctx) in passages.items():
        if n == 1 and several is None:
            continue  # a lone window
        flags = np.ones(_n_windows(unit, passage), bool) if n > 1 else several[passage]
        edge = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).view(np.int8)))
        if len(edge):
            yield ctx, edge.astype(np.int32).tolist()


def _fine_filters(docs: DataFrame, unit: Unit, hot: DataFrame) -> tuple[BitFilter, BitFilter]:
    """The keys of longer grams that may repeat windows of hot keys, and those to be split by windows.  A filter holds a
    key in every document or in none, so one that holds too much sends more passages and decides the same."""
    keys = bit_filter(hot, "key")
    if not keys.packed.any():
        return BitFilter(()), BitFilter(())
    seen = docs.mapInArrow(_finer_counts(unit, keys), "key long, ctx long, n long")
    each = seen.groupBy("key", "ctx").agg(F.sum("n").alias("n"))
    total = cut_lineage(each.groupBy("key").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("texts")).filter("total > 1").select("key", "texts"))
    return bit_filter(total, "key"), bit_filter(total.filter(F.col("texts") > HOT), "key")


def repeated_spans(docs: DataFrame, unit: Unit, decide: Callable, limit: int) -> tuple[DataFrame, DataFrame]:
    """``(rows, spans)``: the keyed rows of ``docs`` dealt by key, and per row the token ranges of its repeated windows.

    ``docs`` comes from ``common.keyed``.  ``decide(unit, groups)`` gets ``{key: {passage: count}}`` and returns, per
    key and passage, which of its windows occur at least twice in the group.  ``spans`` has ``did, dn`` and ``spans``,
    an array of ``struct(a, b)``: token positions, end exclusive, unordered and overlapping.
    """
    rows = docs.repartition("did", "dn")
    seen = docs.mapInArrow(_keys_of(unit), "key long, did long, dn long")
    # Counted by (high bits, key), so that the join deals both sides itself and can split a hot key.
    total = (seen.groupBy((F.col("key") / (1 << 32)).cast("int").alias("high"), "key").agg(F.count(F.lit(1)).alias("total"))
             .filter("total > 1").select("key", "total"))
    wanted = seen.join(total, "key")
    lists = cut_lineage(wanted.groupBy("did", "dn").agg(
        F.collect_set("key").alias("keys"),
        F.collect_set(F.when(F.col("total") > HOT, F.col("key"))).alias("hot")))
    filters = _fine_filters(docs, unit, lists.select(F.explode("hot").alias("key")))
    # With all columns of ``rows``, so that the texts are dealt out once, for this join and for the caller's.
    suspects = rows.join(lists, ["did", "dn"]).select(*rows.columns, "keys", "hot")
    passages = suspects.mapInArrow(_collect(unit, *filters), "key long, ctx long, passage binary, n long")
    verdicts = (passages.repartition("key").sortWithinPartitions("key")
                .mapInArrow(_shards(unit, decide, limit), "key long, ctx long, runs array<int>"))
    places = suspects.mapInArrow(_places(unit, *filters), "key long, ctx long, did long, dn long, start int")
    found = places.join(verdicts, ["key", "ctx"])
    pairs = F.transform(F.sequence(F.lit(0), F.size("runs") - 2, F.lit(2)), lambda i: F.struct(
        (F.col("start") + F.get("runs", i)).alias("a"),
        (F.col("start") + F.get("runs", i + 1) + unit.length - 1).alias("b")))
    spans = (found.select("did", "dn", F.explode(pairs).alias("s")).groupBy("did", "dn")
             .agg(F.collect_list("s").alias("spans")))
    return rows, spans


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Sorted, disjoint ranges."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["a"], s["b"]) for s in spans or ()):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def kept_of(unit: Unit, text: bytes, spans: list[tuple[int, int]]) -> tuple[int, int, bytes]:
    """``(tokens, removed tokens, what is kept)`` of a text."""
    if unit.words:
        words = text.split()
        kept = [w for (a, _), (b, _) in zip([(0, 0), *((e, e) for _, e in spans)], [*((s, s) for s, _ in spans), (len(words),) * 2])
                for w in words[a:b]]
        return len(words), len(words) - len(kept), b" ".join(kept)
    edges = [0, *(x for span in spans for x in span), len(text)]
    kept_bytes = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
    return len(text), len(text) - len(kept_bytes), kept_bytes


def removed(docs: DataFrame, unit: Unit, decide: Callable, limit: int, id_col: str = "doc_id", text_col: str = "text",
            kept_text: bool = True) -> DataFrame:
    """One row per document: id, ``n_tokens``, ``n_removed``, ``n_spans``, ``kept_sha256``, ``spans`` and the kept text."""
    rows, spans = repeated_spans(C.keyed(docs, id_col, text_col), unit, decide, limit)
    fields = "n_tokens long, n_removed long, n_spans long, kept_sha256 string, spans array<array<long>>, kept binary"

    def batch(part: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for text, found in zip(C.column_bytes(part, "text"), part.column("spans").to_pylist()):
            ranges = merged(found)
            n, gone, kept = kept_of(unit, text, ranges)
            out.append((n, gone, len(ranges), hashlib.sha256(kept).hexdigest(), [list(r) for r in ranges], kept if kept_text else None))
        columns = [pa.array(list(x), t) for x, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int64())), pa.binary()))]
        return pa.RecordBatch.from_arrays([part.column(id_col), *columns], [id_col, "n_tokens", "n_removed", "n_spans", "kept_sha256", "spans", "kept"])

    joined = rows.join(spans, ["did", "dn"], "left").select(id_col, "text", "spans")
    return joined.mapInArrow(C.per_batch(batch), f"{id_col} {dict(joined.dtypes)[id_col]}, {fields}")
