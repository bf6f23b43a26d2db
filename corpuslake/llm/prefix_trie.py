"""Trie of conversation prefixes by van Emde Boas recursion on depth.

Depths ``[0, 2**K)`` are cut in half: the prefixes that end at the cut are named, the upper trie and the lower forests hanging from
the named prefixes are built the same way, all at once, and totals of the lower forests are grafted onto the upper trie.  A depth is
a cut of exactly one recursion level, so naming takes K steps over 1, 2, 4, ... cuts a sequence, and grafting K steps back.
Names are digests, so equal prefixes meet without numbering them first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslake.session import cut_lineage

from .ordering import positions

#: Rows of one sequence are looked up in stretches of 2**12 depths, so a very long one is spread over tasks.
_STRETCH = 12
#: Member ids of one node are joined to text in blocks of this many.
_IDS = 4096
_NOTHING = hashlib.sha256(b"").hexdigest()


def _name(*parts: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*parts), 256))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """``(conv_id, pos, n, role, text)``: turns numbered from 0 by turn, role and text; null role or text is empty."""
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return positions(rows, ["conv_id"], ["turn", "role", "text"]).select("conv_id", F.col("idx").alias("pos"), F.col("group_size").alias("n"), "role", "text")


def rebuilt(turns: DataFrame, family: int = 5, longest: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations that share the first turns of their family's first: ``(conv_id, size)`` and ``(conv_id, pos, role, text)``.

    Conversation c takes the first h turns of conversation c - c % family, then its own after its first h; h = crc32(c) % longest.
    """
    own = turns.groupBy("conv_id").agg(F.max("n").alias("n"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % longest
    lead = own.select(F.col("conv_id").alias("lead"), F.col("n").alias("lead_n"))
    facts = cut_lineage(own.withColumn("lead", F.col("conv_id") - F.col("conv_id") % family).withColumn("h", h).join(lead, "lead", "left").select(
        "conv_id", "lead", "h", "n", F.least("h", F.coalesce("lead_n", F.lit(0))).alias("taken")))
    shared = facts.filter("taken > 0").select("conv_id", "lead", F.explode(F.sequence(F.lit(0).cast("long"), F.col("taken") - 1)).alias("pos")).join(
        turns.filter(F.col("pos") < longest).select(F.col("conv_id").alias("lead"), "pos", "role", "text"), ["lead", "pos"]).drop("lead")
    stretch = F.shiftright("pos", _STRETCH).alias("stretch")
    spread = facts.filter("n > h").select("conv_id", "h", "taken", F.explode(F.sequence(F.lit(0).cast("long"), F.shiftright(F.col("n") - 1, _STRETCH))).alias("stretch"))
    rest = turns.select("conv_id", "pos", "role", "text", stretch).join(spread, ["conv_id", "stretch"]).filter(F.col("pos") >= F.col("h")).select(
        "conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "role", "text")
    sizes = facts.select("conv_id", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("size"))
    return sizes, shared.unionByName(rest)


def _named_prefixes(sizes: DataFrame, steps: DataFrame, levels: int) -> DataFrame:
    """``(c, d, name)`` of every prefix.  Blocks of 2**k steps are named upwards, then cuts downwards from the roots."""
    blocks = [steps.select("c", F.col("pos").alias("j"), "name")]
    for _ in range(levels - 1):
        half = lambda bit: F.max(F.when(F.col("j") % 2 == bit, F.col("name")))
        pairs = blocks[-1].groupBy("c", F.shiftright("j", 1).alias("j")).agg(half(0).alias("a"), half(1).alias("b"))
        blocks.append(cut_lineage(pairs.filter(F.col("b").isNotNull()).select("c", "j", _name(F.col("a"), F.col("b")).alias("name"))))
    known = [sizes.select("c", F.lit(0).cast("long").alias("d"), F.unhex(F.lit("00")).alias("name"))]
    for k in reversed(range(levels)):
        # Every known prefix ends at a multiple of 2**(k+1); the block after it leads to the next cut.
        cuts = _union(known).select("c", F.shiftright("d", k).alias("j"), F.col("name").alias("upper")).join(blocks[k], ["c", "j"])
        known.append(cut_lineage(cuts.select("c", F.shiftleft(F.col("j") + 1, k).alias("d"), _name(F.col("upper"), F.col("name")).alias("name"))))
    return _union(known)


def _grafted(nodes: DataFrame, prefixes: DataFrame, levels: int, totals: list[str]) -> DataFrame:
    """``(d, name, *totals)`` summed over subtrees.  A cut's total, complete within its forest, goes to all nodes of the trie above it."""
    sums = [F.sum(t).alias(t) for t in totals]
    parts = [nodes.select("d", "name", *totals)]
    for k in range(levels):
        is_cut = lambda d: F.shiftright(d, k) % 2 == 1
        at_cut = lambda f: f.filter(is_cut(F.col("d")) & (F.col("d") % (1 << k) == 0))
        complete = _union([at_cut(p) for p in parts]).groupBy("d", "name").agg(*sums)
        s = min(k, _STRETCH)
        cuts = complete.join(at_cut(nodes).select("d", "name", "c"), ["d", "name"]).select(
            "c", F.explode(F.sequence(F.shiftright(F.col("d") - (1 << k), s), F.shiftright(F.col("d") - 1, s))).alias("stretch"), *totals)
        above = prefixes.filter(~is_cut(F.col("d"))).select("c", F.shiftright("d", s).alias("stretch"), "d", "name").join(cuts, ["c", "stretch"])
        parts.append(cut_lineage(above.groupBy("d", "name").agg(*sums)))
    return _union(parts).groupBy("d", "name").agg(*sums)


def _ends(prefixes: DataFrame, sizes: DataFrame) -> DataFrame:
    """``(d, name, ends_sha256)``: the digest of the comma-joined ids of the sequences that end at a node, ascending.

    Ids are joined to bounded blocks in parallel; a node's blocks are then streamed through one hash, which no task holds whole.
    """
    last = prefixes.join(sizes.select("c", F.col("size").alias("d")), ["c", "d"])
    numbered = positions(last, ["d", "name"], ["c"])
    text = F.array_join(F.transform(F.sort_array(F.collect_list("c")), lambda c: c.cast("string")), ",")
    blocks = numbered.groupBy("d", "name", F.floor(F.col("idx") / _IDS).alias("block")).agg(text.alias("ids"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            out = []
            for d, name, ids in zip(*(batch.column(c).to_pylist() for c in ("d", "name", "ids"))):
                if (d, name) != node:
                    if node is not None:
                        out.append((*node, state.hexdigest()))
                    node, state = (d, name), hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if out:
                yield as_batch(out)
        if node is not None:
            yield as_batch([(*node, state.hexdigest())])

    def as_batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.binary(), pa.string()))],
                                          ["d", "name", "ends_sha256"])

    return blocks.repartition("d", "name").sortWithinPartitions("d", "name", "block").mapInArrow(digest, "d long, name binary, ends_sha256 string")


def prefix_trie(sizes: DataFrame, turns: DataFrame, texts: bool = True) -> DataFrame:
    """One row per distinct prefix: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    ``sizes`` has ``(conv_id, size)`` of every sequence, ``turns`` its ``(conv_id, pos, role, text)`` with positions 0 to size - 1.
    ``conv_id`` is the smallest sequence with the prefix.  With ``texts`` the last turn's ``role`` and ``text`` are added (null for the root).
    Defined cases: a sequence without turns is a member of the root alone; equal sequences share every node; no sequences give
    no rows; very long ones take log2(length) steps; other columns are ignored.
    """
    sizes = sizes.select(F.col("conv_id").alias("c"), "size")
    content = F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary")
    steps = cut_lineage(turns.select(F.col("conv_id").alias("c"), "pos", _name(content).alias("name"), F.octet_length("text").cast("long").alias("bytes")))
    deepest = sizes.agg(F.max("size")).first()[0] or 0
    levels = int(deepest).bit_length()
    prefixes = cut_lineage(_named_prefixes(sizes, steps, levels))
    members = prefixes.groupBy("d", "name").agg(F.min("c").alias("c"), F.count(F.lit(1)).alias("n_convs"))
    # A node's parent and last turn, by its smallest member.
    above = prefixes.select("c", (F.col("d") + 1).alias("d"), F.col("name").alias("parent"))
    nodes = cut_lineage(members.join(above, ["c", "d"], "left").join(steps.select("c", (F.col("pos") + 1).alias("d"), "bytes"), ["c", "d"], "left"))
    children = nodes.filter("d > 0").groupBy((F.col("d") - 1).alias("d"), F.col("parent").alias("name")).agg(F.count(F.lit(1)).alias("n_children"))
    facts = cut_lineage(nodes.join(children, ["d", "name"], "left").select(
        "c", "d", "name", "parent", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
        F.col("n_children").isNull().cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.coalesce("bytes", F.lit(0))).alias("saved_tokens")))
    totals = _grafted(facts, prefixes, levels, ["n_leaves", "saved_tokens"])
    parents = facts.select((F.col("d") + 1).alias("d"), F.col("name").alias("parent"), F.col("c").alias("parent_conv_id"))
    out = (facts.drop("n_leaves", "saved_tokens").join(totals, ["d", "name"]).join(_ends(prefixes, sizes), ["d", "name"], "left").join(parents, ["d", "parent"], "left")
           .select(F.col("c").alias("conv_id"), F.col("d").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                   F.coalesce("ends_sha256", F.lit(_NOTHING)).alias("ends_sha256")))
    if not texts:
        return out
    return out.join(turns.select("conv_id", (F.col("pos") + 1).alias("depth"), "role", "text"), ["conv_id", "depth"], "left")
