"""Helpers shared by the operators: row keys, Arrow batches, and vectorised hashes of words and bytes."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslake.session import apply_settings, checkpoint_dir

#: An odd multiplier and its inverse modulo 2**64, for polynomial hashes that can be cut out of a running sum.
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
BYTE_CODE = np.random.default_rng(20260101).integers(1, 1 << 63, 256, dtype=np.uint64)


def table(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """A table of the data directory; batches for Python are kept small, since texts may be long."""
    apply_settings(spark).conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """The rows, written once to the shared folder.

    The size of the files is what the optimizer goes by; a checkpoint hands on the estimate of the plan it cuts, which
    squares from join to join, and a loop soon spends its time on multiplying such numbers.
    """
    spark = df.sparkSession
    folder = f"{checkpoint_dir(spark)}/stored-{uuid4().hex}"
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, did, dn, text)``: ``(did, dn)`` identifies a row by content and is never null.

    Rows of one id but of different texts get different keys; wholly equal rows share one.  Other columns
    of ``docs`` are dropped, so their names cannot clash.
    """
    identity, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    return docs.select(identity.alias(id_col), F.coalesce(identity.cast("long"), F.lit(0)).alias("did"),
                       F.xxhash64(identity.isNull(), text).alias("dn"), F.coalesce(text, F.lit("")).alias("text"))


def with_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the key of ``keyed`` as ``__did, __dn``."""
    return docs.withColumns({"__did": F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(0)),
                             "__dn": F.xxhash64(F.col(f"`{id_col}`").isNull(), F.col(f"`{text_col}`"))})


def per_batch(fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], begin: Callable[[], None] | None = None,
              end: Callable[[], None] | None = None):
    """An Arrow iterator function from one that maps a batch; ``begin`` and ``end`` are called once a task,
    and the worker, which lives on, gives back what Arrow no longer uses."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if begin:
            begin()
        for batch in batches:
            if batch.num_rows:
                out = fn(batch)
                if out is not None and out.num_rows:
                    yield out
        if end:
            end()
        pa.default_memory_pool().release_unused()
    return run


def slices(batch: pa.RecordBatch, column: str, limit: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts sum to about ``limit`` bytes; a longer text is a part of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    group = np.cumsum(sizes) // limit
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    for a, b in zip(starts, np.append(starts[1:], batch.num_rows)):
        yield batch.slice(int(a), int(b - a))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


class Powers:
    """Powers of the multiplier and of its inverse, grown on demand and kept per worker."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = 1 << max(16, (n - 1).bit_length())
            up, down = np.full(size, BASE), np.full(size, BASE_INVERSE)
            up[0] = down[0] = 1
            cls.up, cls.down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        return cls.up[:n], cls.down[:n]


def running(codes: np.ndarray) -> np.ndarray:
    """Prefix sums of ``codes[i] * BASE**i`` with a leading zero."""
    up, _ = Powers.upto(len(codes) + 1)
    out = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * up[:-1], out=out[1:])
    return out


def spans_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each span, equal for equal content wherever it lies."""
    _, down = Powers.upto(len(prefix))
    return mix((prefix[ends] - prefix[starts]) * down[starts])


def grams(prefix: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` codes."""
    n = len(prefix) - k
    if n <= 0:
        return np.empty(0, np.uint64)
    _, down = Powers.upto(len(prefix))
    return mix((prefix[k:] - prefix[:n]) * down[:n])


def sliding(values: np.ndarray, w: int, op) -> np.ndarray:
    """Minimum or maximum (``op``) of every window of ``w`` values, by doubling."""
    out, width = values, 1
    while width * 2 <= w:
        out = op(out[:-width], out[width:])
        width *= 2
    return op(out[:len(out) - (w - width)], out[w - width:]) if width < w else out


#: ASCII bytes between words: white space, or everything but digits and lower-case letters.
SPACES = np.zeros(256, bool)
SPACES[[32, *range(9, 14)]] = True
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


class Words:
    """Words of a list of UTF-8 texts as positions in one buffer.

    ``start``/``end`` are byte positions, ``doc`` the index of the text, ``first[i]`` the index of the first
    word of text ``i`` (with one entry more at the end).  Delimiters are ASCII bytes, so words are whole characters.
    """

    def __init__(self, texts: list[bytes], delimiters: np.ndarray = SPACES, lower: bool = False):
        self.raw = b" ".join(texts) + b" "
        data = np.frombuffer(self.raw, np.uint8)
        self.data = LOWER[data] if lower else data
        inside = ~delimiters[self.data]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(sizes + 1)
        edge = np.flatnonzero(np.diff(np.concatenate([[False], inside]).view(np.int8)))
        self.start, self.end = edge[::2], edge[1::2]
        self.first = np.searchsorted(self.start, np.concatenate([[0], ends]))
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))
        self.offset = ends - sizes - 1

    def hashes(self) -> np.ndarray:
        return spans_hash(running(BYTE_CODE[self.data]), self.start, self.end)


def column_bytes(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A text column as UTF-8 bytes, null as empty."""
    return [v or b"" for v in batch.column(name).cast(pa.large_binary()).to_pylist()]


def signed(values: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit values as the signed ones Spark holds."""
    return np.ascontiguousarray(values).view(np.int64)
