"""Exact quantiles over groups of any size.

``percentile`` keeps every distinct value of a group in one aggregation buffer.
This form reads the input twice instead: a bounded sketch brackets each wanted
rank, an exact count places the bracket, and only the values inside it (a few
thousandths of the group) are ranked.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_SKETCH_ACCURACY = 20000
_MARGIN = 0.002
_SMALL_GROUP = 10000


def nearest_rank(n: Column, q: Column) -> Column:
    """0-based index of the nearest-rank quantile: min(floor(q*n), n-1)."""
    return F.least(F.floor(q * n), n - 1).cast("long")


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str,
                    wanted: dict[str, tuple[float, str]]) -> DataFrame:
    """One row per group with a column per wanted quantile.

    ``wanted`` maps a column name to ``(q, mode)`` where mode is ``"linear"``
    (interpolated) or ``"nearest"`` (a value some row really has).  Null values are
    ignored; groups without values are absent.
    """
    keys = list(keys)
    rows = df.select(*keys, F.col(value).cast("double").alias("__x")).filter(F.col("__x").isNotNull())
    lows = [max(0.0, q - _MARGIN) for q, _ in wanted.values()]
    highs = [min(1.0, q + _MARGIN) for q, _ in wanted.values()]
    sketch = F.percentile_approx("__x", F.array(*[F.lit(p) for p in lows + highs]), _SKETCH_ACCURACY)
    bounds = rows.groupBy(*keys).agg(
        F.count("__x").alias("__n"), F.min("__x").alias("__min"), F.max("__x").alias("__max"),
        sketch.alias("__s"))
    size = len(wanted)
    small = F.col("__n") <= _SMALL_GROUP
    specs = []
    for i, (name, (q, mode)) in enumerate(wanted.items()):
        n = F.col("__n")
        exact = (n - 1) * F.lit(float(q))
        low_rank = F.floor(exact).cast("long") if mode == "linear" else nearest_rank(n, F.lit(float(q)))
        high_rank = F.ceil(exact).cast("long") if mode == "linear" else low_rank
        weight = exact - F.floor(exact) if mode == "linear" else F.lit(0.0)
        whole_low = small if lows[i] > 0 else F.lit(True)
        whole_high = small if highs[i] < 1 else F.lit(True)
        specs.append(F.struct(
            F.lit(name).alias("name"), low_rank.alias("r0"), high_rank.alias("r1"),
            weight.cast("double").alias("w"),
            F.when(whole_low, F.col("__min")).otherwise(F.col("__s")[i]).alias("lo"),
            F.when(whole_high, F.col("__max")).otherwise(F.col("__s")[size + i]).alias("hi")))
    targets = bounds.select(*keys, F.array(*specs).alias("__t"))
    joined = rows.join(targets, keys) if keys else rows.crossJoin(F.broadcast(targets))
    flat = joined.select(*keys, "__x", F.explode("__t").alias("t")).filter(F.col("__x") <= F.col("t.hi"))
    below = flat.filter(F.col("__x") < F.col("t.lo")).groupBy(*keys, F.col("t.name").alias("name")).agg(
        F.count(F.lit(1)).alias("__below"))
    inside = flat.filter(F.col("__x") >= F.col("t.lo")).groupBy(
        *keys, F.col("t.name").alias("name"), "__x").agg(
        F.count(F.lit(1)).alias("__c"), F.first("t.r0").alias("r0"), F.first("t.r1").alias("r1"),
        F.first("t.w").alias("w"))
    ranked = inside.withColumn("__upto", F.sum("__c").over(
        Window.partitionBy(*keys, "name").orderBy("__x").rowsBetween(Window.unboundedPreceding, 0)))
    ranked = ranked.join(below, [*keys, "name"], "left").withColumn(
        "__end", F.col("__upto") + F.coalesce("__below", F.lit(0)))
    ranked = ranked.withColumn("__start", F.col("__end") - F.col("__c"))

    def holds(rank: str) -> Column:
        return (F.col("__start") <= F.col(rank)) & (F.col(rank) < F.col("__end"))

    picked = ranked.groupBy(*keys, "name").agg(
        F.max(F.when(holds("r0"), F.col("__x"))).alias("a"),
        F.max(F.when(holds("r1"), F.col("__x"))).alias("b"), F.first("w").alias("w"))
    result = picked.withColumn("v", F.col("a") * (1 - F.col("w")) + F.col("b") * F.col("w"))
    return result.groupBy(*keys).agg(*[
        F.max(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in wanted])
