"""Token-id files: whole texts encoded, written as coded frames in document order, and read back.

Rows are dealt by ranges of ids and sorted, a task codes its documents into frames of a few million ids (see
``range_coder``), and Spark writes one frame per row, so a lost task is simply run again.  Reading needs the frames
only; where a document starts is the running total of the frames before it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C
from .range_coder import pack_frame, unpack_frame
from .tokens import Encoder

#: Ids after which a frame is closed; a frame holds whole documents.
FRAME_IDS = 1 << 22

_FRAME = pa.schema([("part", pa.int64()), ("frame", pa.int64()), ("n_ids", pa.int64()), ("data", pa.binary())])


def _frames(path: str, end_id: int, frame_ids: int, id_col: str):
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held, n, frame = [], 0, 0

        def row():
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((part, frame, n, pack_frame(held)), _FRAME.types)], schema=_FRAME)

        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for doc, ids in zip(batch.column(id_col).to_pylist(), Encoder.of(path).batch(texts)):
                held.append((doc, ids + end))
                n += len(ids) // 4 + 1
                if n >= frame_ids:
                    yield row()
                    held, n, frame = [], 0, frame + 1
        if held:
            yield row()
        Encoder.rest()
    return run


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2, frame_ids: int = FRAME_IDS,
                      id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of every text, with ``end_id`` behind them, in ascending order of id (nulls first).

    Defined cases: a null or empty text is the end id alone; rows of one id follow each other in order of content;
    an empty table writes no frames; other columns are ignored.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias(id_col), F.col(f"`{text_col}`").alias("text"),
                       F.xxhash64(F.col(f"`{text_col}`")).alias("hash"), F.spark_partition_id().alias("source"))
    ordered = rows.repartitionByRange(id_col, "hash", "source").sortWithinPartitions(id_col, "hash", "source")
    frames = ordered.select(id_col, "text").mapInArrow(_frames(tokenizer, end_id, frame_ids, id_col), "part long, frame long, n_ids long, data binary")
    frames.write.mode("overwrite").option("compression", "uncompressed").parquet(folder)


def _documents(id_col: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, data in zip(batch.column("base").to_pylist(), batch.column("data").to_pylist()):
                ids, starts, sizes, sums, raw = [], [], [], [], []
                for doc, tokens in unpack_frame(data):
                    ids.append(doc)
                    starts.append(base)
                    sizes.append(len(tokens) // 4)
                    sums.append(zlib.crc32(tokens))
                    raw.append(tokens if with_ids else None)
                    base += sizes[-1]
                yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in (ids, starts, sizes, sums)), pa.array(raw, pa.binary())],
                                                 [id_col, "start", "n_tokens", "ids_crc32", "ids"])
    return run


def read_token_files(spark: SparkSession, folder: str, id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """One row per document: id, ``start`` (ids of all documents before it), ``n_tokens``, ``ids_crc32`` (and ``ids``)."""
    frames = spark.read.schema("part long, frame long, n_ids long, data binary").parquet(folder)
    sizes = frames.select("part", "frame", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))  # as many rows as tasks that wrote
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before(Window.orderBy("part"))), F.lit(0)).alias("earlier"))
    bases = sizes.withColumn("inside", F.coalesce(F.sum("n_ids").over(before(Window.partitionBy("part").orderBy("frame"))), F.lit(0))).join(
        parts, "part").select("part", "frame", (F.col("earlier") + F.col("inside")).alias("base"))
    read = frames.join(bases, ["part", "frame"]).select("base", "data")
    out = read.mapInArrow(_documents(id_col, with_ids), f"{id_col} long, start long, n_tokens long, ids_crc32 long, ids binary")
    return out if with_ids else out.drop("ids")
