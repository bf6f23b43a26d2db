"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

The ring has a fixed number of slots; every shard owns virtual nodes at hashed slots, and a document belongs to the
first virtual node clockwise of its own slot.  No shard takes more than its capacity: documents that find their shard
full continue clockwise.  Rows are only counted per slot (a fixed number), the ring is filled from these counts, and
every row finds its shard from its rank within its slot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslake.session import cut_lineage


def ring_points(spark, n_shards: int, vnodes: int, slots: int) -> list[tuple[int, int]]:
    """``(slot, shard)`` of every virtual node in clockwise order; their number is set by the parameters."""
    shard, node = F.expr(f"id div {vnodes}"), F.expr(f"id % {vnodes}")
    points = spark.range(n_shards * vnodes).select(
        F.pmod(F.xxhash64(F.lit("virtual node"), shard, node), F.lit(slots)).alias("slot"), shard.alias("shard"), "id")
    return [(r["slot"], r["shard"]) for r in points.orderBy("slot", "id").collect()]


def capacities(total: int, n_shards: int, slack: float) -> list[int]:
    """Rows each shard may take: equal counts (at most one apart) without slack, else ``1 + slack`` times the mean."""
    if slack > 0:
        return [int((1 + slack) * total / n_shards) + 1] * n_shards
    return [total // n_shards + (s < total % n_shards) for s in range(n_shards)]


def fill_ring(counts: dict[int, int], points: list[tuple[int, int]], room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """``(slot, first rank, end rank, shard, first place in the shard)``: rows of each slot go clockwise past full shards.

    Every round offers what is left of each slot to its next virtual node, so shards first fill from their own arcs.
    """
    room, used = list(room), [0] * len(room)
    at, j = {}, 0
    for slot in sorted(counts):
        while j < len(points) and points[j][0] < slot:
            j += 1
        at[slot] = j
    placed = dict.fromkeys(counts, 0)
    out, waiting, step = [], sorted(counts), 0
    while waiting:
        for slot in waiting:
            shard = points[(at[slot] + step) % len(points)][1]
            take = min(room[shard], counts[slot] - placed[slot])
            if take:
                out.append((slot, placed[slot], placed[slot] + take, shard, used[shard]))
                placed[slot] += take
                room[shard] -= take
                used[shard] += take
        waiting = [slot for slot in waiting if placed[slot] < counts[slot]]
        step += 1
    return out


def ring_shards(docs: DataFrame, n_shards: int = 40, vnodes: int = 64, slots: int = 4096, slack: float = 0.0,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``size`` (UTF-8 bytes plus 16), ``text_crc32``, ``shard`` and ``slot`` (place in the shard).

    With ``slack`` 0 the shards' row counts are at most one apart; with more, a shard takes at most ``1 + slack`` times
    the mean, and fewer rows move when a shard is added.
    Defined cases: a null text has size 16 and the checksum of no bytes; null ids share one slot of the ring; equal
    rows, and any number of rows of one id, are rows like any other and overflow clockwise; an empty table gives no
    rows; other columns are ignored.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = cut_lineage(docs.select(
        F.col(f"`{id_col}`").alias(id_col), (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.pmod(F.xxhash64(F.col(f"`{id_col}`")), F.lit(slots)).alias("__slot"), F.spark_partition_id().alias("__part")))
    parts = rows.groupBy("__slot", "__part").agg(F.count(F.lit(1)).alias("__n"))
    counts = {r["__slot"]: r["n"] for r in parts.groupBy("__slot").agg(F.sum("__n").alias("n")).collect()}  # at most ``slots`` rows
    plan = fill_ring(counts, ring_points(spark, n_shards, vnodes, slots), capacities(sum(counts.values()), n_shards, slack))
    pieces = spark.createDataFrame(plan, "__slot long, a long, b long, shard int, base long").groupBy("__slot").agg(
        F.collect_list(F.struct("a", "b", "shard", "base")).alias("__pieces"))
    before = Window.partitionBy("__slot").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select("__slot", "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    within = Window.partitionBy("__slot", "__part").orderBy(id_col, "text_crc32", "size")
    ranked = (rows.withColumn("__rank", F.row_number().over(within) - 1).join(bases, ["__slot", "__part"])
              .withColumn("__rank", F.col("__rank") + F.col("__before")).join(pieces, "__slot"))
    piece = F.filter("__pieces", lambda p: (p["a"] <= F.col("__rank")) & (F.col("__rank") < p["b"]))[0]
    return ranked.select(id_col, "size", "text_crc32", piece["shard"].alias("shard"),
                         (piece["base"] + F.col("__rank") - piece["a"]).alias("slot"))
