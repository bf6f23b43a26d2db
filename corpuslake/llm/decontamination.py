"""Benchmark decontamination by a distributed positional inverted index.

Every test window asks for its two rarest terms, by their counts in the whole corpus.  The index stores the postings
(document, position) of the rarest terms next to which the second term stands at the window's distance, so the
offset-adjusted lists are intersected while they are built; each posting carries the words around it, which decide
the exact match.  What tasks are given beforehand are bit filters of fixed size, so neither the benchmark nor the
index has to fit anywhere; a filter that is too full only lets more postings through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslake.session import cut_lineage

from . import common as C

#: Bits of the fixed-size filters.
FILTER_BITS = 1 << 22
#: Terms whose counts a task holds before it hands them on.
HELD = 500_000

_WINDOW = pa.schema([("wid", pa.int64()), ("words", pa.large_binary()), ("terms", pa.list_(pa.int64()))])
_POSTING = pa.schema([("did", pa.int64()), ("dn", pa.int64()), ("n_words", pa.int64()), ("pair", pa.int64()),
                      ("at", pa.int64()), ("lead", pa.int32()), ("around", pa.large_binary())])


class BitFilter:
    """A set of 64-bit hashes in a fixed number of bits: may hold too much, never too little."""

    def __init__(self, buckets, bits: int = FILTER_BITS):
        flags = np.zeros(bits, bool)
        flags[np.asarray(list(buckets), np.int64)] = True
        self.bits, self.packed = bits, np.packbits(flags)

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        at = (hashes & np.uint64(self.bits - 1)).astype(np.int64)
        return (self.packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0


def bit_filter(hashes: DataFrame, column: str) -> BitFilter:
    """The filter of a column of hashes; the driver gets at most one number per bit."""
    bucket = F.col(column).bitwiseAND(F.lit(FILTER_BITS - 1)).alias("b")
    return BitFilter(r["b"] for r in hashes.select(bucket).distinct().toLocalIterator())


def pair_hash(rare: np.ndarray, other: np.ndarray, gap) -> np.ndarray:
    """Hash of two terms and their distance."""
    return C.mix(C.mix(rare) ^ (other + np.asarray(gap, np.int64).view(np.uint64) * C.BASE))


def _windows(length: int):
    def batch(rows: pa.RecordBatch) -> pa.RecordBatch | None:
        words = C.Words(C.column_bytes(rows, "text"), C.NOT_ALNUM, lower=True)
        hashes = words.hashes()
        prefix = C.running(hashes)
        text = words.data.tobytes()
        item, out = [], []
        for i, (a, b) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist())):
            size = min(length, b - a)
            for s in range(a, b - size + 1) if size else ():
                spelled = b" ".join(text[words.start[j]:words.end[j]] for j in range(s, s + size))
                wid = C.spans_hash(prefix, np.array([s]), np.array([s + size]))[0] ^ np.uint64(size)
                item.append(i)
                out.append((int(C.signed(np.array([wid]))[0]), spelled, C.signed(hashes[s:s + size]).tolist()))
        if not out:
            return None
        arrays = [pa.array(list(x), t) for x, t in zip(zip(*out), _WINDOW.types)]
        return pa.RecordBatch.from_arrays([rows.column("item").take(pa.array(item)), *arrays], ["item", *_WINDOW.names])
    return C.per_batch(batch)


def test_windows(items: DataFrame, length: int, item_col: str, text_col: str) -> DataFrame:
    """``(item, wid, words, terms)`` of every window of every item; an item of fewer words is one window."""
    read = items.select(F.col(f"`{item_col}`").cast("string").alias("item"), F.col(f"`{text_col}`").alias("text")).filter("text IS NOT NULL")
    return read.mapInArrow(_windows(length), "item string, wid long, words binary, terms array<long>")


def _count_terms(kept: BitFilter):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, int] = {}

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array(list(held.values()), pa.int64())], ["term", "n"])
            held.clear()
            return out

        for batch in batches:
            for part in C.slices(batch, "text"):
                hashes = C.Words(C.column_bytes(part, "text"), C.NOT_ALNUM, lower=True).hashes()
                terms, counts = np.unique(hashes[kept.holds(hashes)], return_counts=True)
                for t, n in zip(C.signed(terms).tolist(), counts.tolist()):
                    held[t] = held.get(t, 0) + n
            if len(held) > HELD:
                yield flush()
        if held:
            yield flush()
    return run


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """``(term, n)``: how often each test term occurs in all documents."""
    kept = bit_filter(terms, "term")
    return docs.mapInArrow(_count_terms(kept), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).join(terms.distinct(), "term")


def _asked(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the hash of the two chosen terms of each window."""
    for batch in rows:
        rare, other = (batch.column(c).to_numpy().view(np.uint64) for c in ("rare", "other"))
        gap = (batch.column("other_at").to_numpy() - batch.column("rare_at").to_numpy()).astype(np.int64)
        yield batch.append_column("pair", pa.array(C.signed(pair_hash(rare, other, gap))))


def asked_pairs(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """Windows whose terms all occur, with the places of the rarest term and of the next rarest."""
    terms = windows.select("wid", "words", F.size("terms").alias("size"), F.posexplode("terms").alias("at", "term"))
    ranked = terms.join(counts, "term").groupBy("wid", "words", "size").agg(
        F.sort_array(F.collect_list(F.struct("n", "at", "term"))).alias("t")).filter(F.size("t") == F.col("size"))
    other = F.coalesce(F.get("t", F.lit(1)), F.get("t", F.lit(0)))
    first = F.get("t", F.lit(0))
    chosen = ranked.select("wid", "words", "size", first["term"].alias("rare"), first["at"].cast("long").alias("rare_at"),
                           other["term"].alias("other"), other["at"].cast("long").alias("other_at"))
    return chosen.mapInArrow(_asked, "wid long, words binary, size int, rare long, rare_at long, other long, other_at long, pair long")


def _postings(rare: BitFilter, pairs: BitFilter, reach: int):
    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for part in C.slices(rows, "text"):
            words = C.Words(C.column_bytes(part, "text"), C.NOT_ALNUM, lower=True)
            hashes, text = words.hashes(), words.data.tobytes()
            did, dn = part.column("did").to_numpy(), part.column("dn").to_numpy()
            out += [(d, n, w, 0, -1, 0, b"") for d, n, w in zip(did.tolist(), dn.tolist(), np.diff(words.first).tolist())]
            at = np.flatnonzero(rare.holds(hashes))
            for gap in range(-reach, reach + 1):
                other = at + gap
                ok = (other >= 0) & (other < len(hashes))
                mine, theirs = at[ok], other[ok]
                same = words.doc[mine] == words.doc[theirs]
                mine, theirs = mine[same], theirs[same]
                pair = pair_hash(hashes[mine], hashes[theirs], gap)
                hit = pairs.holds(pair)
                for p, h in zip(mine[hit].tolist(), C.signed(pair[hit]).tolist()):
                    doc = words.doc[p]
                    a, b = max(int(words.first[doc]), p - reach), min(int(words.first[doc + 1]), p + reach + 1)
                    around = b" ".join(text[words.start[j]:words.end[j]] for j in range(a, b))
                    out.append((int(did[doc]), int(dn[doc]), -1, h, p - int(words.first[doc]), p - a, around))
        return pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*out), _POSTING.types)], schema=_POSTING)
    return C.per_batch(batch)


def index(docs: DataFrame, asked: DataFrame, length: int) -> DataFrame:
    """Postings of ``docs`` (from ``common.keyed``) for the asked pairs, and one row per document with its word count."""
    rare, pairs = bit_filter(asked, "rare"), bit_filter(asked, "pair")
    return docs.mapInArrow(_postings(rare, pairs, length - 1),
                           "did long, dn long, n_words long, pair long, at long, lead int, around binary")


def _verdicts(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        hits, digests, counts = [], [], []
        for spans, items in zip(batch.column("spans").to_pylist(), batch.column("items").to_pylist()):
            n, end = 0, -1
            for s in sorted((s["a"], s["b"]) for s in spans or ()):
                n += max(0, s[1] - max(s[0], end))
                end = max(end, s[1])
            hits.append(n)
            counts.append(len(items or ()))
            digests.append(hashlib.sha256(",".join(sorted(items or ())).encode()).hexdigest())
        keep = [batch.column(c) for c in ("did", "dn", "n_words")]
        yield pa.RecordBatch.from_arrays([*keep, *map(pa.array, (hits, counts, digests))],
                                         ["did", "dn", "n_words", "n_hit", "n_items", "items_sha256"])


def decontamination(docs: DataFrame, items: DataFrame, length: int = 13, id_col: str = "doc_id", text_col: str = "text",
                    item_col: str = "item_id", item_text_col: str = "text", share: int = 20) -> DataFrame:
    """One row per distinct document key of ``common.keyed``: ``did, dn, n_words, n_hit, n_items, items_sha256, contaminated``.

    A document word inside any occurrence of a test window is hit; a document is contaminated if
    ``share * n_hit >= n_words`` and a word is hit.  Join the result to the rows with ``common.keyed``.
    Defined cases: null or empty texts have no words and are clean; items without words ask for nothing; items with a
    null id hit words but are not listed; repeated items and rows count once; empty tables are allowed on either side.
    """
    rows = C.keyed(docs, id_col, text_col)
    windows = cut_lineage(test_windows(items, length, item_col, item_text_col))
    distinct = windows.dropDuplicates(["wid"]).select("wid", "words", "terms")
    counts = term_counts(rows, distinct.select(F.explode("terms").alias("term")))
    asked = cut_lineage(asked_pairs(distinct, counts))
    postings = cut_lineage(index(rows, asked, length))
    found = postings.filter("n_words < 0").join(asked, "pair").filter(
        (F.col("lead") >= F.col("rare_at")) & (F.col("words").cast("string") == F.array_join(F.slice(
            F.split(F.col("around").cast("string"), " "), (F.col("lead") - F.col("rare_at") + 1).cast("int"), F.col("size")), " ")))
    spans = found.select("did", "dn", "wid", (F.col("at") - F.col("rare_at")).alias("a"), (F.col("at") - F.col("rare_at") + F.col("size")).alias("b"))
    listed = spans.select("did", "dn", "wid").distinct().join(windows.select("wid", "item").distinct(), "wid")
    hit = spans.groupBy("did", "dn").agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    named = listed.groupBy("did", "dn").agg(F.collect_set("item").alias("items"))
    every = postings.filter("n_words >= 0").groupBy("did", "dn").agg(F.max("n_words").alias("n_words"))
    joined = every.join(hit, ["did", "dn"], "left").join(named, ["did", "dn"], "left")
    out = joined.mapInArrow(_verdicts, "did long, dn long, n_words long, n_hit long, n_items long, items_sha256 string")
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))


def near_pairs(windows: DataFrame, counts: DataFrame, slop: int) -> DataFrame:
    """``(wid, rare, other, gap, spare)``: pairs of the three rarest terms of a window that occur; ``spare`` is the third, to be missing for a later pair.

    Up to ``slop`` terms of a window may occur nowhere; of a window of several words, two have to occur.
    """
    terms = windows.select("wid", F.size("terms").alias("size"), F.posexplode("terms").alias("at", "term"))
    ranked = terms.join(counts, "term").groupBy("wid", "size").agg(F.sort_array(F.collect_list(F.struct("n", "at", "term"))).alias("t"))
    kept = ranked.filter((F.col("size") - F.size("t") <= slop) & ((F.size("t") > 1) | (F.col("size") == 1)))
    t = [F.get("t", F.lit(i)) for i in range(3)]

    def pair(a, b, spare):
        return F.struct(a["term"].alias("rare"), b["term"].alias("other"), (b["at"] - a["at"]).cast("long").alias("gap"), spare.alias("spare"))

    none = F.lit(None).cast("long")
    pairs = F.array(pair(t[0], F.coalesce(t[1], t[0]), none), pair(t[0], t[2], t[1]["term"]), pair(t[1], t[2], t[0]["term"]))
    return kept.select("wid", F.explode(pairs).alias("p")).select("wid", "p.*").filter("other IS NOT NULL")


def proximity_matches(docs: DataFrame, items: DataFrame, length: int = 13, slop: int = 5, id_col: str = "doc_id", text_col: str = "text",
                      item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``(id_col, item, at, distance)``: places where a window's two rarest terms stand up to ``slop`` words off their distance.

    Terms that occur in no document are passed over, and where one of the two is not near, the third rarest stands for it;
    so one replaced word loses no match, whether or not it occurs elsewhere.  The postings of both terms are joined by document and block of positions, so no document pairs all its postings.
    """
    rows = C.keyed(docs, id_col, text_col)
    windows = test_windows(items, length, item_col, item_text_col)
    distinct = windows.dropDuplicates(["wid"]).select("wid", "words", "terms")
    asked = cut_lineage(near_pairs(distinct, term_counts(rows, distinct.select(F.explode("terms").alias("term"))), slop))
    chosen = bit_filter(asked.select(F.explode(F.array("rare", "other")).alias("term")), "term")

    def batch(part: pa.RecordBatch) -> pa.RecordBatch:
        words = C.Words(C.column_bytes(part, "text"), C.NOT_ALNUM, lower=True)
        hashes = words.hashes()
        at = np.flatnonzero(chosen.holds(hashes))
        doc = words.doc[at]
        return pa.RecordBatch.from_arrays([part.column(id_col).take(pa.array(doc)), *map(pa.array, (
            part.column("did").to_numpy()[doc], part.column("dn").to_numpy()[doc], C.signed(hashes[at]), at - words.first[doc]))],
            [id_col, "did", "dn", "term", "at"])

    postings = rows.mapInArrow(C.per_batch(batch), f"{id_col} {dict(rows.dtypes)[id_col]}, did long, dn long, term long, at long")
    width = length + slop
    block = lambda c: F.floor(c / F.lit(width)).cast("long")
    blocks = F.explode(F.array(*[block(F.col("at")) + d for d in (-1, 0, 1)])).alias("block")
    left = postings.join(asked, F.col("term") == F.col("rare")).select(
        id_col, "did", "dn", "wid", "other", "gap", "spare", F.col("at").alias("p"), blocks)
    right = postings.select("did", "dn", F.col("term").alias("other"), F.col("at").alias("q"), block(F.col("at")).alias("block"))
    near = left.join(right, ["did", "dn", "other", "block"]).withColumn("distance", F.abs(F.col("q") - F.col("p") - F.col("gap"))).filter(
        F.col("distance") <= slop)
    spare = postings.select(*(F.col(c).alias(f"s_{c}") for c in ("did", "dn", "term", "at")), blocks.alias("s_block"))
    near = near.join(spare, (F.col("did") == F.col("s_did")) & (F.col("dn") == F.col("s_dn")) & (F.col("spare") == F.col("s_term"))
                     & (block(F.col("p")) == F.col("s_block")) & (F.abs(F.col("p") - F.col("s_at")) <= width), "left_anti")
    return near.join(windows.select("wid", "item").distinct(), "wid").groupBy(id_col, "item", F.col("p").alias("at")).agg(
        F.min("distance").alias("distance"))
