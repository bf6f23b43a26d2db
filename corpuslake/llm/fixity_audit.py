"""Fixity audit of record archives by Merkle trees over ordered ranges.

Records are hashed; the hashes of a key range are combined in key order, and ranges combine into larger ranges up to a
root, each with its record and byte counts, so a node is also an ordered range of offsets.  Two replicas are compared
root first, and only the children of differing nodes are looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslake.session import cut_lineage


def record_bytes(url: Column, body: Column) -> Column:
    """A response record in WARC form; null parts are empty."""
    body = F.coalesce(body, F.lit(""))
    return F.concat(F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
                    F.lit("\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(body).cast("string"),
                    F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"))


def leaves(records: DataFrame, key_col: str, content: Column) -> DataFrame:
    """``(key, n, bytes, digest)`` per key.  Equal records of one key are counted first, then combined regardless of order.

    A null key counts as -1.
    """
    rows = records.select(F.coalesce(F.col(f"`{key_col}`").cast("long"), F.lit(-1)).alias("key"), F.sha2(content.cast("binary"), 256).alias("sha"),
                          F.octet_length(content).cast("long").alias("size"))
    same = rows.groupBy("key", "sha").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    lane = lambda i: F.sum((F.conv(F.substring("part", 8 * i + 1, 8), 16, 10).cast("decimal(20,0)")))
    part = F.sha2(F.concat_ws(":", "sha", F.col("n").cast("string")), 256)
    combined = same.withColumn("part", part).groupBy("key").agg(
        F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.concat_ws(":", *[lane(i).cast("string") for i in range(8)]).alias("lanes"))
    return combined.select("key", "n", "bytes", F.sha2("lanes", 256).alias("digest"))


def tree(leaf: DataFrame, fanout_bits: int, height: int) -> DataFrame:
    """``(level, node, n, bytes, digest)``: level 0 are the leaves, level ``height`` holds the root.

    A node's digest hashes its children's in order; a node has at most ``2 ** fanout_bits`` children.
    """
    level = cut_lineage(leaf.select(F.lit(0).alias("level"), F.col("key").alias("node"), "n", "bytes", "digest"))
    out = level
    for step in range(1, height + 1):
        # Arithmetic shift keeps -1 apart from the ordinary keys until the root.
        parent = F.shiftright("node", fanout_bits) if step < height else F.lit(0).cast("long")
        joined = F.concat_ws("|", F.transform(F.array_sort(F.collect_list(F.struct("node", "digest"))),
                                              lambda c: F.concat_ws("=", c["node"].cast("string"), c["digest"])))
        level = level.groupBy(parent.alias("node")).agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.sha2(joined, 256).alias("digest"))
        level = cut_lineage(level.select(F.lit(step).alias("level"), "node", "n", "bytes", "digest"))
        out = out.union(level)
    return out


def fixity_audit(original: DataFrame, replica: DataFrame, key_col: str, content, fanout_bits: int = 8) -> DataFrame:
    """One row per key whose records differ: ``key, state, record_offset, original_bytes, replica_bytes, nodes_read``.

    ``content`` makes the record bytes from a frame's columns.  ``state`` is ``changed``, ``missing`` or ``extra``;
    ``record_offset`` is where the key's records begin in the original, null for extra ones; ``nodes_read``
    counts the nodes that the descent compared on all levels.
    Defined cases: null keys are one key, -1; repeated records are compared by how often they occur; null contents are
    empty; equal or empty replicas give no rows; other columns are ignored.
    """
    bounds = [f.agg(F.max(F.col(f"`{key_col}`").cast("long"))).first()[0] for f in (original, replica)]
    top = max([b for b in bounds if b is not None], default=0)
    height = max(1, -(-max(1, top.bit_length()) // fanout_bits)) + 1
    ours, theirs = (tree(leaves(f, key_col, content(f)), fanout_bits, height) for f in (original, replica))

    def compare(level: int, parents: DataFrame | None) -> DataFrame:
        """Nodes of a level, under differing parents only, with both digests."""
        sides = []
        for side in (ours, theirs):
            rows = side.filter(F.col("level") == level)
            if parents is not None:
                up = F.shiftright("node", fanout_bits) if level < height - 1 else F.lit(0).cast("long")
                rows = rows.withColumn("parent", up).join(parents.select(F.col("node").alias("parent")), "parent", "left_semi")
            sides.append(rows.select("node", "n", "bytes", "digest"))
        a, b = sides[0].alias("a"), sides[1].alias("b")
        return a.join(b, "node", "full").select(
            "node", F.coalesce("a.bytes", F.lit(0)).alias("original_bytes"), F.coalesce("b.bytes", F.lit(0)).alias("replica_bytes"),
            (~F.col("a.digest").eqNullSafe(F.col("b.digest"))).alias("differs"), F.col("a.digest").isNull().alias("extra"), F.col("b.digest").isNull().alias("missing"))

    wrong, seen = None, None
    for level in range(height, -1, -1):
        nodes = cut_lineage(compare(level, wrong))
        count = nodes.agg(F.count(F.lit(1)).alias("c"))
        seen = count if seen is None else seen.union(count)
        wrong = nodes.filter("differs")
    total = seen.agg(F.sum("c").alias("nodes_read"))
    # Offsets: bytes of all ranges before the key, from one running total per level and parent.
    offset = wrong.select(F.col("node").alias("key"))
    position = offset.withColumn("record_offset", F.lit(0).cast("long"))
    for level in range(height - 1, -1, -1):
        shift = level * fanout_bits
        at = F.shiftright("key", shift)
        up = F.shiftright("node", fanout_bits) if level < height - 1 else F.lit(0).cast("long")
        run = Window.partitionBy("up").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
        before = ours.filter(F.col("level") == level).withColumn("up", up).select(
            F.col("node").alias("at"), F.coalesce(F.sum("bytes").over(run), F.lit(0)).alias("before"))
        position = position.withColumn("at", at).join(before, "at", "left").select("key", (F.col("record_offset") + F.coalesce("before", F.lit(0))).alias("record_offset"))
    state = F.when(F.col("extra"), "extra").when(F.col("missing"), "missing").otherwise("changed")
    return (wrong.select(F.col("node").alias("key"), state.alias("state"), "original_bytes", "replica_bytes")
            .join(position, "key").withColumn("record_offset", F.when(F.col("state") != "extra", F.col("record_offset")))
            .crossJoin(F.broadcast(total)))
