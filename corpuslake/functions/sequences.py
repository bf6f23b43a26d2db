"""Ordered computations that stay parallel when one key holds most of the rows.

A plain ``Window.partitionBy(session)`` sends a whole session to one task.  Here
every key is cut into ordered blocks; a block is summarised with a map-side
combined aggregate, the (few) block summaries are scanned with a window, and the
carried value is joined back on (key, block).  The in-block window uses the same
(key, block) partitioning as that join, so the rows are shuffled once.

``block`` must be a deterministic column that never decreases along ``order``
within a key, for example ``floor(turn / 4096)`` or an hour number.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_BLOCK = "__block"


def _with_block(df: DataFrame, block: Column) -> DataFrame:
    return df.withColumn(_BLOCK, block.cast("long"))


def _order(columns: Sequence[str]) -> list[Column]:
    return [F.col(c) for c in columns]


def _carry(summary: DataFrame, keys: Sequence[str], names: dict[str, Column]) -> DataFrame:
    return summary.select(*keys, _BLOCK, *[c.alias(n) for n, c in names.items()])


def _earlier_blocks(keys: Sequence[str]):
    return (Window.partitionBy(*keys).orderBy(_BLOCK)
            .rowsBetween(Window.unboundedPreceding, -1))


def running_sums(df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column,
                 sums: dict[str, Column]) -> DataFrame:
    """Add inclusive running sums ``{name: expression}`` per key in ``order``."""
    rows = _with_block(df, block)
    for name, expr in sums.items():
        rows = rows.withColumn(f"__v_{name}", expr)
    totals = rows.groupBy(*keys, _BLOCK).agg(*[F.sum(f"__v_{n}").alias(f"__t_{n}") for n in sums])
    carried = _carry(totals, keys, {
        f"__c_{n}": F.coalesce(F.sum(f"__t_{n}").over(_earlier_blocks(keys)), F.lit(0)) for n in sums})
    inside = (Window.partitionBy(*keys, _BLOCK).orderBy(*_order(order))
              .rowsBetween(Window.unboundedPreceding, 0))
    out = rows.join(carried, [*keys, _BLOCK])
    for name in sums:
        out = out.withColumn(name, F.coalesce(F.sum(f"__v_{name}").over(inside), F.lit(0)) + F.col(f"__c_{name}"))
    drop = [_BLOCK] + [f"__{p}_{n}" for n in sums for p in ("v", "c")]
    return out.drop(*drop)


def positions(df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column,
              name: str = "pos") -> DataFrame:
    """Add dense 0-based positions per key in ``order``."""
    return running_sums(df, keys, order, block, {name: F.lit(1).cast("long")}).withColumn(
        name, F.col(name) - 1)


def last_earlier(df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column,
                 value: Column, name: str) -> DataFrame:
    """Add the latest non-null ``value`` strictly before each row (as-of the row)."""
    rows = _with_block(df, block).withColumn("__v", value)
    latest = F.max(F.when(F.col("__v").isNotNull(), F.struct(*_order(order), F.col("__v"))))
    summary = rows.groupBy(*keys, _BLOCK).agg(latest.getField("__v").alias("__last"))
    carried = _carry(summary, keys, {
        "__c": F.last("__last", ignorenulls=True).over(_earlier_blocks(keys))})
    inside = (Window.partitionBy(*keys, _BLOCK).orderBy(*_order(order))
              .rowsBetween(Window.unboundedPreceding, -1))
    return (rows.join(carried, [*keys, _BLOCK])
            .withColumn(name, F.coalesce(F.last("__v", ignorenulls=True).over(inside), F.col("__c")))
            .drop(_BLOCK, "__v", "__c"))


def sliding_list(df: DataFrame, keys: Sequence[str], position: str, value: Column, size: int,
                 name: str, include_current: bool = True, width: int = 4096) -> DataFrame:
    """Add the list of the last ``size`` values per key.

    ``position`` must be dense.  The rows near a block's end are also handed to the
    next block as a halo, so no window ever spans more than ``width + size`` rows.
    """
    reach = size - 1 if include_current else size
    if width < reach:
        raise ValueError("a block must be at least as wide as the window")
    block = F.floor(F.col(position) / width).cast("long")
    late = F.pmod(F.col(position), F.lit(width)) >= width - reach
    homes = F.array_compact(F.array(
        F.struct(block.alias("b"), F.lit(False).alias("halo")),
        F.when(late, F.struct((block + 1).alias("b"), F.lit(True).alias("halo")))))
    rows = df.withColumn("__v", value).withColumn("__home", F.explode(homes))
    rows = rows.withColumn(_BLOCK, F.col("__home.b")).withColumn("__halo", F.col("__home.halo"))
    frame = Window.partitionBy(*keys, _BLOCK).orderBy(position)
    frame = frame.rowsBetween(-reach, 0 if include_current else -1)
    return (rows.withColumn(name, F.collect_list("__v").over(frame))
            .filter(~F.col("__halo")).drop("__v", "__home", "__halo", _BLOCK))
