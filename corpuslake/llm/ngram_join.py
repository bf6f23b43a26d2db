"""Jaccard join of word n-gram sets by PartEnum signatures.

Sets fall into size bands so that a linked pair lies in one band or in two neighbours.  For each such pair of bands
at most ``k`` elements can differ, so the hashed feature domain is cut into more than ``k`` parts: linked sets agree
wholly on at least one part, and the hash of a part's elements is a signature.  Extra parts allow for empty ones; a
set with more empty parts than that also signs with its prefix (its smallest elements), so no link is lost.

Equal sets are one from the start.  Sets sharing a signature are first compared with the group's smallest member
only; what is linked becomes one component, and only members of different components are compared further: two
rounds name spanning forests of likely pairs, and a last one the likely pairs still apart.  Exact set comparison decides
which are links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C
from .decontamination import bit_filter
from .tokens import Encoder

#: Linked: 100 * intersection >= 80 * union, so at most a ninth of both sizes differs.
_NINTH = 9
#: Bytes of a sketch: the parity of the number of elements in each of as many buckets as it has bits.
_SKETCH = 128
#: Sets of so many elements have a wider sketch besides, of so many bytes: the narrow one is full when a thousand elements differ.
_LARGE, _WIDE = 1000, 1024
#: Sets a task remembers, so that copies sign once.
_SEEN = 500_000
#: Bytes of texts whose sets are made at once; a worker holds some sixty times as many besides what it keeps.
_SLICE = 1 << 18

_MEMBER = pa.schema([("did", pa.int64()), ("dn", pa.int64()), ("n", pa.int64()), ("sid", pa.int64()), ("key", pa.int64()), ("sketch", pa.binary()), ("wide", pa.binary())])
_GROUP = pa.schema([("gid", pa.int64()), ("sid", pa.int64()), ("rep", pa.int64())])
_FOUND = pa.schema([("gid", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])
#: Sets of a group that one task compares; a larger group is cut into blocks of about as many.
_BLOCK = 8192


@cache
def bands(upto: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(smallest size, parts, spare empty parts)`` of each band of sizes; parts 0 where only equal sets link."""
    low, parts, spare, smallest, before = [], [], [], 1, 1
    while smallest <= 2 * upto + 8:
        largest = smallest * 5 // 4
        k = 2 * largest // _NINTH
        n = m = 0
        if k:
            n = k + 1
            for _ in range(20):
                mean = n * math.exp(-before / n)
                m = math.ceil(mean + 3 * math.sqrt(mean))
                n = k + 1 + m
        low.append(smallest)
        parts.append(n)
        spare.append(m)
        before, smallest = smallest, largest + 1
    return np.array(low), np.array(parts), np.array(spare)


class Sets:
    """The distinct n-gram hashes of each text, sorted: ``hash``, ``doc``, ``first`` (with an end), ``size`` and ``sid``."""

    def __init__(self, texts: list[bytes], n: int):
        words = C.Words(texts, lower=True)
        codes = words.hashes()
        prefix = C.running(codes)
        start = np.arange(len(codes))
        count = np.diff(words.first)
        begins = words.first[:-1]
        short = np.flatnonzero((count > 0) & (count < n))
        whole = start[:max(0, len(codes) - n + 1)]
        whole = whole[words.doc[whole] == words.doc[whole + n - 1]] if len(whole) else whole
        spans = np.concatenate([whole, begins[short]])
        ends = np.concatenate([whole + n, begins[short] + count[short]])
        value = C.mix(C.spans_hash(prefix, spans, ends) + (ends - spans).astype(np.uint64)) if len(spans) else np.empty(0, np.uint64)
        doc = words.doc[spans] if len(spans) else np.empty(0, np.int64)
        order = np.lexsort((value, doc))
        value, doc = value[order], doc[order]
        new = np.concatenate([[True], (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])]) if len(value) else np.empty(0, bool)
        self.hash, self.doc = value[new], doc[new]
        self.first = np.searchsorted(self.doc, np.arange(len(texts) + 1))
        self.size = np.diff(self.first)
        self.sid = np.zeros(len(texts), np.uint64)
        full = np.flatnonzero(self.size)
        if len(full):
            at = self.first[full]
            total, mixed = np.add.reduceat(self.hash, at), np.bitwise_xor.reduceat(C.mix(self.hash), at)
            self.sid[full] = C.mix(total + C.mix(mixed + self.size[full].astype(np.uint64)))

    def sketches(self, size: int = _SKETCH) -> list[bytes]:
        """One bit per bucket of hashes: whether the set has an odd number of elements there."""
        bits = 8 * size
        cell = self.doc * bits + (self.hash & np.uint64(bits - 1)).astype(np.int64)
        odd = np.packbits((np.bincount(cell, minlength=len(self.size) * bits) & 1).astype(bool)).tobytes()
        return [odd[i:i + size] for i in range(0, len(odd), size)]

    def wide_sketches(self) -> list[bytes]:
        """Wider sketches of large sets, empty for the others."""
        large = np.flatnonzero(self.size >= _LARGE)
        out = [b""] * len(self.size)
        for i, sketch in zip(large.tolist(), self.take(large).sketches(_WIDE) if len(large) else ()):
            out[i] = sketch
        return out

    def take(self, docs: np.ndarray) -> Sets:
        """The sets of some texts."""
        out = object.__new__(Sets)
        keep = np.isin(self.doc, docs)
        out.hash, out.size, out.sid = self.hash[keep], self.size[docs], self.sid[docs]
        out.doc = np.searchsorted(docs, self.doc[keep])
        out.first = np.concatenate([[0], np.cumsum(out.size)])
        return out

    def signatures(self) -> tuple[np.ndarray, np.ndarray]:
        """``(signature, text)`` rows; every set signs for its own band and for the next."""
        low, parts, spare = bands(1 << int(self.size.max(initial=1)).bit_length())  # few different tables are made and kept
        band = np.searchsorted(low, self.size, side="right") - 1
        out_sig, out_doc = [], []
        for step in (0, 1):
            j = band + step
            n = np.where(self.size > 0, parts[j], 0)
            used = n[self.doc] > 0
            value, doc = self.hash[used], self.doc[used]
            if not len(value):
                continue
            wide = n[doc].astype(np.uint64)
            part = ((value >> np.uint64(32)) * wide) >> np.uint64(32)
            edge = np.flatnonzero(np.concatenate([[True], (part[1:] != part[:-1]) | (doc[1:] != doc[:-1])]))
            content = np.add.reduceat(C.mix(value), edge)
            where = doc[edge]
            place = (j[where].astype(np.uint64) << np.uint64(40)) | part[edge]
            out_sig.append(C.mix(content ^ C.mix(place + np.uint64(1))))
            out_doc.append(where)
            empty = n - np.bincount(where, minlength=len(n))
            for d in np.flatnonzero((n > 0) & (empty > spare[j])):
                size = int(self.size[d])
                prefix = self.hash[self.first[d]:self.first[d] + size - -(-4 * size // 5) + 1]
                out_sig.append(C.mix(prefix ^ C.mix(np.uint64(int(j[d]) << 40 | 1 << 39))))
                out_doc.append(np.full(len(prefix), d))
        none = np.empty(0, np.int64)
        return np.concatenate([none.view(np.uint64), *out_sig]), np.concatenate([none, *out_doc])


def _row_keys(part: pa.RecordBatch) -> np.ndarray:
    """One hash of ``(did, dn)``."""
    did, dn = (part.column(c).to_numpy().view(np.uint64) for c in ("did", "dn"))
    return C.mix(C.mix(did) ^ dn)


def _members(n: int):
    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for part in C.slices(rows, "text", _SLICE):
            sets = Sets(C.column_bytes(part, "text"), n)
            out.append((part.column("did").to_numpy(), part.column("dn").to_numpy(), sets.size.astype(np.int64), C.signed(sets.sid),
                        C.signed(_row_keys(part)), np.array(sets.sketches(), object), np.array(sets.wide_sketches(), object)))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), t) for x, t in zip(zip(*out), _MEMBER.types)], schema=_MEMBER)
    return C.per_batch(batch, begin=Encoder.release)  # a worker may come from packing


def _signatures(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        Encoder.release()
        seen: set[int] = set()
        for batch in batches:
            for part in C.slices(batch, "text", _SLICE):
                sets = Sets(C.column_bytes(part, "text"), n)
                _, once = np.unique(sets.sid, return_index=True)
                fresh = np.array([i for i in np.sort(once).tolist() if sets.size[i] and int(sets.sid[i]) not in seen], np.int64)
                if len(seen) > _SEEN:
                    seen.clear()
                seen.update(sets.sid[fresh].tolist())
                if len(fresh):
                    some = sets.take(fresh)
                    sig, doc = some.signatures()
                    for a in range(0, len(sig), 200_000):
                        yield pa.RecordBatch.from_arrays([pa.array(C.signed(sig[a:a + 200_000])), pa.array(C.signed(some.sid[doc[a:a + 200_000]]))], ["sig", "sid"])
    return run


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups of two or more sets with one signature, each list of members once per task."""
    sig, sid = [], []
    for batch in batches:
        sig.append(batch.column("sig").to_numpy())
        sid.append(batch.column("sid").to_numpy())
    if not sig:
        return
    sig, sid = np.concatenate(sig), np.concatenate(sid)
    order = np.lexsort((sid, sig))
    sig, sid = sig[order], sid[order]
    new = np.concatenate([[True], (sig[1:] != sig[:-1]) | (sid[1:] != sid[:-1])])
    sig, sid = sig[new], sid[new]
    first = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
    size = np.diff(np.append(first, len(sig)))
    gid = C.mix(np.add.reduceat(C.mix(sid.view(np.uint64)), first) + size.astype(np.uint64))
    _, once = np.unique(gid, return_index=True)
    once = once[size[once] > 1]
    at = np.repeat(first[once] - np.concatenate([[0], np.cumsum(size[once])[:-1]]), size[once]) + np.arange(int(size[once].sum())) if len(once) else once
    rows = [np.repeat(C.signed(gid[once]), size[once]), sid[at], np.repeat(sid[first[once]], size[once])]
    for a in range(0, len(at), 200_000):
        yield pa.RecordBatch.from_arrays([pa.array(x[a:a + 200_000]) for x in rows], schema=_GROUP)


def _packed(hashes: np.ndarray) -> bytes:
    """The high 48 bits of sorted hashes; of two sets of a million elements, not one in a hundred would show a false match."""
    return np.ascontiguousarray(hashes.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unpacked(packed: bytes) -> np.ndarray:
    wide = np.zeros((len(packed) // 6, 8), np.uint8)
    wide[:, 2:] = np.frombuffer(packed, np.uint8).reshape(-1, 6)
    return np.unique(wide.reshape(-1).view(">u8").astype(np.uint64))


def _sets_of(n: int, wanted):
    """``(sid, set)`` of the rows whose key is wanted, once per task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            batch = batch.filter(pa.array(wanted.holds(_row_keys(batch))))
            for part in C.slices(batch, "text", _SLICE) if batch.num_rows else ():
                sets = Sets(C.column_bytes(part, "text"), n)
                sids = C.signed(sets.sid).tolist()
                some = [i for i in np.flatnonzero(sets.size).tolist() if sids[i] not in seen]
                seen.update(sids[i] for i in some)
                if some:
                    yield pa.RecordBatch.from_arrays([pa.array([sids[i] for i in some], pa.int64()), pa.array(
                        [_packed(sets.hash[sets.first[i]:sets.first[i + 1]]) for i in some], pa.binary())], ["sid", "set"])
    return run


def _may_link(n_a, n_b, sketch_a, sketch_b) -> np.ndarray:
    """Every bucket whose parity differs holds an element of one set only, and linked sets have few: never false for a linked pair."""
    apart = np.bitwise_count(sketch_a ^ sketch_b).sum(axis=-1, dtype=np.int64)
    return _NINTH * apart <= n_a + n_b


def _bytes_matrix(column: pa.Array, size: int = _SKETCH) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, size // 8)


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            n_a, n_b = batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy()
            ok = _may_link(n_a, n_b, _bytes_matrix(batch.column("k_a")), _bytes_matrix(batch.column("k_b")))
            large = np.flatnonzero(ok & (np.minimum(n_a, n_b) >= _LARGE))
            if len(large):
                w_a, w_b = (_bytes_matrix(batch.column(c).take(pa.array(large)), _WIDE) for c in ("w_a", "w_b"))
                ok[large] = _may_link(n_a[large], n_b[large], w_a, w_b)
            yield batch.select(["a", "b"]).filter(pa.array(ok))


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose sets are linked."""
    for batch in batches:
        ok = []
        for a, b in zip(batch.column("set_a").to_pylist(), batch.column("set_b").to_pylist()):
            a, b = _unpacked(a), _unpacked(b)
            both = len(np.intersect1d(a, b, assume_unique=True))
            ok.append(100 * both >= 80 * (len(a) + len(b) - both))
        if ok:
            yield batch.select(["a", "b"]).filter(pa.array(ok))


class _Forests:
    """Edge-disjoint spanning forests over components, grown by all units of a task: of ``m`` components at most
    ``count * (m - 1)`` edges are chosen, whatever the number of pairs."""

    def __init__(self, count: int):
        self.above: list[dict[int, int]] = [{} for _ in range(count)]

    @staticmethod
    def _root(above: dict[int, int], node: int) -> int:
        root = node
        while (up := above.get(root, root)) != root:
            root = up
        while node != root:
            above[node], node = root, above.get(node, root)
        return root

    def choose(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, bool]:
        """The edges ``(x[i], y[i])`` that a forest takes in, and whether others are left."""
        left, taken = np.arange(len(x)), []
        for above in self.above:
            if len(above) > _SEEN:
                above.clear()
            names, at = np.unique(np.concatenate([x[left], y[left]]), return_inverse=True)
            roots = np.array([self._root(above, c) for c in names.tolist()], np.int64)[at].reshape(2, -1)
            _, first = np.unique(roots, axis=1, return_index=True)
            new = []
            for i in np.sort(first[roots[0, first] != roots[1, first]]).tolist():
                p, q = self._root(above, int(roots[0, i])), self._root(above, int(roots[1, i]))
                if p != q:
                    above[max(p, q)] = min(p, q)
                    new.append(i)
            taken.append(left[new])
            left = np.delete(left, new)
            if not len(left):
                break
        return np.concatenate(taken), len(left) > 0


def _across(count: int | None, block: int = 512, step: int = 1 << 14):
    """Likely pairs of different components within a unit, as ``count`` forests a task (None: every one); a row without a
    pair names a group with more.  Units ``(gid, low, high)`` arrive whole, sorted by size within."""
    def likely(n, comp, sketch):
        for i in range(0, len(n), block):
            x = slice(i, i + block)
            for k in range(i, len(n), block):
                if 4 * n[k] > 5 * n[min(i + block, len(n)) - 1]:
                    break
                y = slice(k, k + block)
                a, b = np.nonzero((comp[x, None] != comp[None, y]) & (4 * n[None, y] <= 5 * n[x, None]) & (4 * n[x, None] <= 5 * n[None, y]))
                for c in range(0, len(a), step):
                    p, q = a[c:c + step] + i, b[c:c + step] + k
                    ok = np.flatnonzero(p < q)
                    ok = ok[_may_link(n[p[ok]], n[q[ok]], sketch[p[ok]], sketch[q[ok]])]
                    if len(ok):
                        yield p[ok], q[ok]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        forests = _Forests(count or 0)
        told: set[tuple[int, int]] = set()  # families share many groups: a task tells a pair once

        def flush():
            t = pa.Table.from_batches(held)
            n, comp, sid = (t.column(c).to_numpy() for c in ("n", "comp", "sid"))
            more = False
            for p, q in likely(n, comp, _bytes_matrix(t.column("sketch"))):
                low, high = np.minimum(sid[p], sid[q]), np.maximum(sid[p], sid[q])
                if count:
                    some, left = forests.choose(comp[p], comp[q])
                    more |= left
                else:
                    names = list(zip(low.tolist(), high.tolist()))
                    some = np.array([i for i, name in enumerate(names) if name not in told], np.int64)
                    if len(told) > _SEEN:
                        told.clear()
                    told.update(names)
                if len(some):
                    yield pa.RecordBatch.from_arrays([pa.nulls(len(some), pa.int64()), pa.array(low[some]), pa.array(high[some])], schema=_FOUND)
            if more:
                yield pa.RecordBatch.from_pylist([{"gid": last[0], "a": None, "b": None}], schema=_FOUND)

        for batch in batches:
            unit = np.stack([batch.column(c).to_numpy() for c in ("gid", "low", "high")])
            cut = [0, *(np.flatnonzero((unit[:, 1:] != unit[:, :-1]).any(axis=0)) + 1).tolist(), unit.shape[1]]
            for a, b in zip(cut, cut[1:]):
                if b > a:
                    if held and tuple(unit[:, a].tolist()) != last:
                        yield from flush()
                        held = []
                    held.append(batch.slice(a, b - a))
                    last = tuple(unit[:, a].tolist())
        if held:
            yield from flush()
    return run


def _units(open_: DataFrame, block: int, alone: bool) -> DataFrame:
    """Rows of open groups (``sets`` in all) by unit: a group of up to ``block`` sets is one, a larger one is cut into
    blocks, and a unit is a block by itself (``alone``) or a pair of blocks."""
    parts = F.ceil(F.col("sets") / block).cast("long")
    own = open_.withColumn("parts", parts).withColumn("own", F.pmod(F.xxhash64("sid"), F.col("parts")))
    other = F.array("own") if alone else F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)
    return own.withColumn("other", F.explode(other)).select(
        "gid", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "n", "sid", "comp", "sketch")


def components(edges: DataFrame) -> DataFrame:
    """``(node, comp)`` of every node of ``edges (a, b)``: the smallest node reachable.

    Every round takes the smallest label next to a node and then the label of that label, from one written table to the next.
    """
    ends = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    both = C.stored(edges.select(F.explode(ends).alias("e")).select("e.a", "e.b").distinct())
    labels = C.stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("comp")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        step = labels.join(near, "node").select("node", "comp", F.least("comp", "near").alias("least"))
        jump = labels.select(F.col("node").alias("least"), F.col("comp").alias("beyond"))
        following = C.stored(step.join(jump, "least").select("node", F.least("least", "beyond").alias("comp"), (F.col("comp") != F.least("least", "beyond")).alias("moved")))
        labels = following.select("node", "comp")
        if not following.filter("moved").limit(1).count():
            return labels


def _apart(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    """The pairs whose sets ``(sid, comp)`` lie in different components."""
    return (pairs.join(comp.select(F.col("sid").alias("a"), F.col("comp").alias("x")), "a")
            .join(comp.select(F.col("sid").alias("b"), F.col("comp").alias("y")), "b").filter("x != y").select("a", "b"))


def merged(comp: DataFrame, links: DataFrame) -> DataFrame:
    """``(sid, comp)`` after new links: only the components they touch are connected anew."""
    named = links.join(comp.select(F.col("sid").alias("a"), F.col("comp").alias("x")), "a").join(
        comp.select(F.col("sid").alias("b"), F.col("comp").alias("y")), "b")
    least = components(named.filter("x != y").select(F.col("x").alias("a"), F.col("y").alias("b"))).withColumnRenamed("comp", "least")
    return C.stored(comp.join(least, F.col("comp") == F.col("node"), "left").select("sid", F.coalesce("least", "comp").alias("comp")))


def _verified(rows: DataFrame, n: int, pairs: DataFrame, brief: DataFrame) -> DataFrame:
    """The linked pairs among ``(a, b)``: sketches rule most others out, and the sets of the rest are made again from the texts."""
    side = lambda c: brief.select(F.col("sid").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"k_{c}"), F.col("wide").alias(f"w_{c}"))
    likely = C.stored(pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(_likely, "a long, b long"))
    asked = likely.select(F.explode(F.array("a", "b")).alias("sid")).distinct()
    wanted = bit_filter(asked.join(brief, "sid"), "key")
    sets = rows.mapInArrow(_sets_of(n, wanted), "sid long, set binary")
    # Both joins deal the sets out by ``sid`` alike, so Spark makes and shuffles them once.
    half = likely.join(sets, F.col("a") == F.col("sid")).select("a", "b", F.col("set").alias("set_a"))
    full = half.join(sets, F.col("b") == F.col("sid")).select("a", "b", "set_a", F.col("set").alias("set_b"))
    return full.mapInArrow(_linked, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, n: int = 5, id_col: str = "doc_id", text_col: str = "text", block: int = _BLOCK) -> DataFrame:
    """``(did, dn, n_shingles, component)`` per distinct document key of ``common.keyed``; documents of one component
    are connected by links of ``100 * intersection >= 80 * union`` between their sets of ``n``-word shingles.

    Defined cases: null or empty texts have empty sets, link with nothing, and have a null ``component``; a text of
    fewer words is one shingle; repeated rows and equal texts are one component; an empty table gives no rows.
    ``block`` bounds the sets of a group that one task holds; it does not change the result.
    """
    rows = C.keyed(docs, id_col, text_col)
    members = C.stored(rows.mapInArrow(_members(n), "did long, dn long, n long, sid long, key long, sketch binary, wide binary").dropDuplicates(["did", "dn"]))
    signed = rows.mapInArrow(_signatures(n), "sig long, sid long")
    groups = C.stored(signed.repartition("sig").mapInArrow(_groups, "gid long, sid long, rep long").dropDuplicates(["gid", "sid"]))
    # One row per set that shares a signature; the row of the smallest key stands for its copies.
    chosen = F.min_by(F.struct("n", "sketch", "wide"), "key")
    brief = C.stored(members.join(groups.select("sid").distinct(), "sid", "left_semi").groupBy("sid").agg(
        F.min("key").alias("key"), chosen.alias("s")).select("sid", "key", "s.n", "s.sketch", "s.wide"))
    # First every set with the smallest one it shares a signature with, then groups' smallest across components, then the rest.
    stars = groups.filter("sid != rep").groupBy("sid", "rep").agg(F.count(F.lit(1)).alias("n"))
    nearest = stars.groupBy(F.col("sid").alias("b")).agg(F.min("rep").alias("a")).select("a", "b")
    comp = merged(brief.select("sid", F.col("sid").alias("comp")), _verified(rows, n, nearest, brief))
    crossing = C.stored(_apart(stars.select(F.col("rep").alias("a"), F.col("sid").alias("b")), comp).join(nearest, ["a", "b"], "left_anti"))
    comp = merged(comp, _verified(rows, n, crossing, brief))
    tested = nearest.union(crossing)
    # One forest of likely pairs first, then four; what still lies apart after that is seldom linked, and is tested whole.
    asked = groups.select("gid", "sid")
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for count in (1, 4, None):
        now = asked.join(comp, "sid")
        mixed = now.groupBy("gid").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count(F.lit(1)).alias("sets")).filter("x != y").select("gid", "sets")
        mixed = C.stored(mixed)
        open_ = now.join(mixed, "gid").join(brief.select("sid", "n", "sketch"), "sid")
        units = _units(open_, block, count == 1).repartition(tasks, "gid", "low", "high").sortWithinPartitions("gid", "low", "high", "n", "sid")
        found = C.stored(units.mapInArrow(_across(count), "gid long, a long, b long").distinct())
        fresh = C.stored(_apart(found.filter("gid IS NULL").select("a", "b"), comp).join(tested, ["a", "b"], "left_anti"))
        if fresh.limit(1).count():
            comp = merged(comp, _verified(rows, n, fresh, brief))
        more = found.filter("gid IS NOT NULL").select("gid")
        if count == 1:
            more = more.union(mixed.filter(F.col("sets") > block).select("gid")).distinct()
        asked, tested = C.stored(asked.join(more, "gid", "left_semi")), tested.union(fresh)
        if not asked.limit(1).count():
            break
    return members.join(comp, "sid", "left").select(
        "did", "dn", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("comp", "sid")).alias("component"))


def component_ids(docs: DataFrame, n: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``n_shingles`` and ``component_id``, the smallest id of its component (its own if alone)."""
    found = C.stored(near_duplicates(docs, n, id_col, text_col))
    ids = C.keyed(docs, id_col, text_col).select(id_col, "did", "dn")
    named = ids.join(found, ["did", "dn"])
    least = named.filter("component IS NOT NULL").groupBy("component").agg(F.min(id_col).alias("least"))
    return named.join(least, "component", "left").select(id_col, "n_shingles", F.coalesce("least", id_col).alias("component_id"))


def drop_near_duplicates(docs: DataFrame, n: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component: the one of the smallest id; documents without words all stay."""
    found = C.stored(near_duplicates(docs, n, id_col, text_col))
    best = found.filter("component IS NOT NULL").groupBy("component").agg(F.min(F.struct("did", "dn")).alias("k")).select("k.did", "k.dn")
    stay = best.union(found.filter("component IS NULL").select("did", "dn"))
    kept = C.with_keys(docs, id_col, text_col).join(stay.select(F.col("did").alias("__did"), F.col("dn").alias("__dn")), ["__did", "__dn"], "left_semi")
    same = Window.partitionBy("__did", "__dn").orderBy(F.lit(0))
    once = kept.withColumn("__at", F.row_number().over(same)).filter(F.expr("__at = 1"))
    return once.select(*[F.col(f"`{c}`") for c in docs.columns])
