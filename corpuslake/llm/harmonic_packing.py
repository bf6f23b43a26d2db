"""Harmonic packing of token sequences.

Lengths fall into reciprocal-capacity classes: class ``k`` holds what fits ``k`` times, and its bins take exactly ``k``
pieces, whatever they are.  Documents may be cut, so long ones give whole bins (class 1), and what is left is cut
twice at most down to a class's full length, ``capacity // k``; only the last, short piece leaves a gap.  Workers fill the bins
of their own pieces independently; only the pieces of unfilled bins, fewer than ``k`` per worker and class, meet again.
"""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslake.session import cut_lineage

from . import common as C
from .tokens import Encoder

_PIECE = pa.schema([("row", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
                    ("doc_tokens", pa.int64()), ("class", pa.int64()), ("ids", pa.binary())])


def cut(n: int, capacity: int, cuts: int = 2) -> list[int]:
    """Lengths of the pieces of ``n`` tokens: whole bins, up to ``cuts`` full class lengths, and the rest."""
    pieces = [capacity] * (n // capacity)
    rest = n % capacity
    while rest and cuts:
        full = capacity // -(-capacity // rest)
        pieces.append(full)
        rest -= full
        cuts -= 1
    return [*pieces, rest] if rest else pieces


def _share(sizes: dict[int, int], capacity: int) -> list[tuple[int, int, int]]:
    """``(class, bin, offset)``: open bins put together, the largest first, each into the first with room."""
    room: list[int] = []
    out = []
    for k, size in sorted(sizes.items(), key=lambda item: (-item[1], item[0])):
        n = next((i for i, free in enumerate(room) if free >= size), len(room))
        if n == len(room):
            room.append(capacity)
        out.append((k, n, capacity - room[n]))
        room[n] -= size
    return out


def _pieces(path: str, end_id: int, capacity: int, with_ids: bool, id_col: str):
    end = end_id.to_bytes(4, "little")

    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or "" for t in rows.column("text").to_pylist()]
        out = []
        for i, ids in enumerate(Encoder.of(path).batch(texts)):
            ids += end
            start = 0
            for length in cut(len(ids) // 4, capacity):
                part = ids[4 * start:4 * (start + length)]
                out.append((i, start, length, zlib.crc32(part), len(ids) // 4, capacity // length, part if with_ids else None))
                start += length
        row, *rest = [pa.array(list(x), t) for x, t in zip(zip(*out), _PIECE.types)]
        return pa.RecordBatch.from_arrays([rows.column(id_col).take(row), *rest], [id_col, *_PIECE.names[1:]])
    return C.per_batch(batch, end=Encoder.rest)


def harmonic_packing(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 2048,
                     id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: id, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset`` (and ``ids``).

    Every document's ids, with ``end_id`` behind them, lie in its pieces without gap or overlap; every sequence is
    filled gaplessly from offset 0 up to ``capacity`` at most.
    Defined cases: a null or empty text is the end id alone; a null id is kept; rows that repeat an id, or a whole row,
    are packed like any other; an empty table gives no rows; other columns are ignored.
    """
    spark, kind = docs.sparkSession, dict(docs.dtypes)[id_col]
    read = docs.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text_col}`").alias("text"))
    fields = f"{id_col} {kind}, start long, length long, ids_crc32 long, doc_tokens long, class long, ids binary"
    pieces = read.mapInArrow(_pieces(tokenizer, end_id, capacity, with_ids, id_col), fields).withColumn("worker", F.spark_partition_id())
    pieces = cut_lineage(pieces if with_ids else pieces.drop("ids"))
    # Places within a worker and class, then bins of exactly k pieces.
    mine = Window.partitionBy("worker", "class").orderBy(id_col, "start", "ids_crc32")
    counts = pieces.groupBy("worker", "class").agg(F.count(F.lit(1)).alias("n")).withColumn("full", F.expr("n - n % class"))
    earlier = Window.partitionBy("class").orderBy("worker").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.coalesce(F.sum(F.expr("full div class")).over(earlier), F.lit(0))).withColumn(
        "left_before", F.coalesce(F.sum(F.expr("n - full")).over(earlier), F.lit(0)))
    # What the driver sees are sums per class, and there are at most ``capacity`` classes.
    sums = {r["class"]: (r["bins"], r["lefts"]) for r in counts.groupBy("class").agg(
        F.sum(F.expr("full div class")).alias("bins"), F.sum(F.expr("n - full")).alias("lefts")).collect()}
    table, base = [], 0
    for k, (bins, lefts) in sorted(sums.items()):
        table.append((k, base, bins, lefts - lefts % k))
        base += bins + lefts // k
    classes = spark.createDataFrame(table, "class long, base long, bins long, whole long")
    rows = (pieces.withColumn("at", F.row_number().over(mine) - 1).join(counts, ["worker", "class"]).join(F.broadcast(classes), "class")
            .withColumn("left", F.expr("left_before + at - full"))
            .withColumn("open", F.expr("at >= full AND left >= whole"))
            .withColumn("bin", F.expr("CASE WHEN at < full THEN before + at div class ELSE bins + left div class END")))
    place = Window.partitionBy("class", "bin").orderBy("worker", "at").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("length").over(place), F.lit(0)))
    # The last bin of a class may stay open; these bins, one a class at most, share the last sequences.
    sizes = {r["class"]: r["size"] for r in rows.filter("open").groupBy("class").agg(F.sum("length").alias("size")).collect()}
    shared = [(k, base + n, shift) for k, n, shift in _share(sizes, capacity)]
    joint = spark.createDataFrame(shared, "class long, shared long, shift long")
    rows = rows.join(F.broadcast(joint), "class", "left").select(
        "*", F.expr("CASE WHEN open THEN shared ELSE base + bin END").alias("sequence_id"),
        F.expr("CASE WHEN open THEN shift + inside ELSE inside END").alias("offset"))
    return rows.select(id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if with_ids else []))
