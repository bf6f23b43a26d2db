"""Merkle manifest of a dataset with an inclusion proof per record, found by pointer jumping.

Leaves of a group, in order, are combined in runs of ``ARITY`` into a subroot, and the subroots, in group order, into one root.
Every node holds the segment of siblings on its way to an ancestor, at first its parent.  A self-join of nodes with their
ancestors concatenates two segments and doubles the distance, so all leaves reach the root in log2(depth) joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslake.session import cut_lineage

from .ordering import positions

ARITY = 3
#: A side is broadcast when its counted rows are at most this many bytes; beyond it the join shuffles.
BROADCAST_BYTES = 8 << 20
#: The tree number of the upper tree, over the subroots.
TOP = -1


def _top() -> Column:
    return F.lit(TOP).cast("long")


def _hex(value: Column) -> Column:
    return F.lower(F.hex(value))


def _hash(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def record_digest(*values: Column) -> Column:
    """SHA-256 of the values, each as its UTF-8 byte count, a colon and itself; ``-`` if null."""
    parts = [F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values]
    return _hash(F.concat(*parts))


def _small(rows: DataFrame, count: int, row_bytes: int) -> DataFrame:
    return F.broadcast(rows) if count * row_bytes <= BROADCAST_BYTES else rows


def _levels(count: int) -> int:
    """Levels above ``count`` nodes until one remains."""
    steps = 0
    while count > 1:
        count, steps = -(-count // ARITY), steps + 1
    return steps


def _grow(nodes: DataFrame, levels: int, payload: list[str]) -> tuple[list[DataFrame], list[DataFrame]]:
    """Per level, ``(tree, idx, n, digest)`` of the nodes, and each node's place: its parent's and its siblings' digests.

    ``payload`` columns of the lowest nodes go with their places, so leaves are shuffled once.
    """
    heights, places = [nodes], []
    for level in range(levels):
        carried = payload if level == 0 else []
        runs = cut_lineage(heights[-1].filter("n > 1").groupBy("tree", F.floor(F.col("idx") / ARITY).alias("up")).agg(
            F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("idx", "digest", *carried))).alias("run")))
        joined = F.array_join(F.transform("run", lambda c: _hex(c["digest"])), "")
        heights.append(runs.select("tree", F.col("up").alias("idx"), F.ceil(F.col("n") / ARITY).alias("n"), _hash(joined).alias("digest")))
        children = runs.select("tree", "up", "n", "run", F.explode(F.transform("run", lambda c, i: F.struct(i.alias("at"), c.alias("node")))).alias("child"))
        side = lambda start, length: F.array_join(F.transform(F.slice("run", start, length), lambda c: _hex(c["digest"])), "")
        before, after = side(F.lit(1), F.col("child.at")), side(F.col("child.at") + 2, F.lit(ARITY))
        places.append(children.select("tree", F.lit(level).alias("level"), F.col("child.node.idx").alias("idx"), "n", "up", F.col("child.node.digest").alias("digest"),
                                      F.unhex(before).alias("before"), F.unhex(after).alias("after"), *[F.col(f"child.node.{c}").alias(c) for c in carried]))
    return heights, places


def _nodes(places: DataFrame, payload: list[str] = ()) -> DataFrame:
    """Places as nodes with their first segment.  A subroot goes by its name in the upper tree, whose level 0 it is."""
    is_subroot = (F.ceil(F.col("n") / ARITY) == 1) & (F.col("tree") != TOP)
    parent = F.struct(F.when(is_subroot, _top()).otherwise(F.col("tree")).alias("tree"), F.when(is_subroot, 0).otherwise(F.col("level") + 1).alias("level"),
                      F.when(is_subroot, F.col("tree")).otherwise(F.col("up")).alias("idx"))
    return places.select(F.struct("tree", "level", "idx").alias("node"), parent.alias("ancestor"),
                         F.array(F.struct("before", "after")).alias("segment"), *payload)


def _jump(rows: DataFrame, upper: DataFrame, count: int, segment_bytes: int) -> DataFrame:
    """Rows whose ancestor is a node of ``upper`` move to that node's ancestor; the others have reached the root."""
    up = _small(upper.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("__next"), F.col("segment").alias("__more")), count, segment_bytes)
    moved = rows.join(up, "ancestor", "left")
    return moved.withColumns({"segment": F.when(F.col("__next").isNull(), F.col("segment")).otherwise(F.concat("segment", "__more")),
                              "ancestor": F.coalesce("__next", "ancestor")}).drop("__next", "__more")


def fold(leaf: Column, segment: Column) -> Column:
    """The root, hashed upwards from a leaf and its segment of siblings."""
    return F.aggregate(segment, leaf, lambda node, s: _hash(F.concat(_hex(s["before"]), _hex(node), _hex(s["after"]))))


def manifest(records: DataFrame, id_col: str, group_col: str, digest: Column, forged: Column | None = None) -> DataFrame:
    """``(id_col, leaf, subroot, root, segment, proof_sha256, folded_root, verified)`` per record, digests as hex text.

    ``digest`` makes a record's leaf from its columns; ``forged``, where not null, is the leaf that is put in its place when the
    proof is checked.  ``segment`` lists the siblings before and after, level by level.
    Defined cases: a null group is a group of its own and comes first; null ids come first in their group; equal ids are ordered by
    leaf, wholly equal records lie side by side, each with its proof; a single record is subroot and root with an empty proof; an
    empty table gives no rows; other columns are ignored.
    """
    group = F.col(f"`{group_col}`").cast("string")
    rows = records.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.concat(F.lit("="), group), F.lit("")).alias("grp"), digest.alias("digest"),
                          (F.lit(None).cast("binary") if forged is None else forged).alias("forged"))
    leaves = cut_lineage(positions(rows, ["grp"], ["id", "digest"]).select(F.col("group_no").alias("tree"), "idx", F.col("group_size").alias("n"), "digest", "id", "forged"))
    # Two scalars: the largest group and the number of groups.
    largest, trees = leaves.agg(F.max("n"), F.max("tree") + 1).first()
    largest, trees = largest or 0, trees or 0
    heights, places = _grow(leaves, _levels(largest), ["id", "forged"])
    subroots = cut_lineage(_union([h.filter("n = 1").select("tree", "digest") for h in heights]))
    top, top_places = _grow(subroots.select(_top().alias("tree"), F.col("tree").alias("idx"), F.lit(trees).cast("long").alias("n"), "digest"), _levels(trees), [])
    root = top[-1].select(F.col("digest").alias("root"))

    inner = [_nodes(p) for p in [*places[1:], *top_places]]
    at_leaf = leaves.filter("n = 1").select(F.struct(_top().alias("tree"), F.lit(0).alias("level"), F.col("tree").alias("idx")).alias("ancestor"),
                                            F.array().cast("array<struct<before:binary,after:binary>>").alias("segment"), "id", "digest", "forged", "tree")
    jumping = at_leaf if not places else at_leaf.unionByName(_nodes(places[0], ["id", "digest", "forged", "tree"]).drop("node"))
    depth, reach = _levels(largest) + _levels(trees), 1
    nodes = cut_lineage(_union(inner)) if inner else None
    far = depth + (largest == 1)  # a single record begins at its subroot, one jump behind the others
    while nodes is not None and reach < far:
        # Leaves stand at distance ``reach``: they need the nodes that are some multiple of it above a leaf, and the upper tree's.
        row_bytes = 64 + reach * 80
        needed = nodes.filter((F.col("node.tree") == TOP) | (F.col("node.level") % reach == 0))
        count = needed.count()
        jumping = _jump(jumping, needed, count, row_bytes)
        reach *= 2
        if reach < far:
            onward = needed.filter((F.col("node.tree") == TOP) | (F.col("node.level") % reach == 0))
            nodes = cut_lineage(_jump(onward, needed, count, row_bytes))
    leaf = _hex(F.col("digest"))
    siblings = F.array_join(F.transform("segment", lambda s: F.concat(_hex(s["before"]), _hex(s["after"]))), "")
    shown = jumping.join(_small(subroots.withColumnRenamed("digest", "subroot"), trees, 64), "tree").crossJoin(F.broadcast(root))
    folded = fold(F.coalesce("forged", "digest"), F.col("segment"))
    hexed = F.transform("segment", lambda s: F.struct(_hex(s["before"]).alias("before"), _hex(s["after"]).alias("after")))
    return (shown.select(F.col("id").alias(id_col), leaf.alias("leaf"), _hex(F.col("subroot")).alias("subroot"), _hex(F.col("root")).alias("root"),
                         hexed.alias("segment"), F.sha2(siblings.cast("binary"), 256).alias("proof_sha256"), _hex(folded).alias("folded_root"))
            .withColumn("verified", F.col("folded_root") == F.col("root")))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out
