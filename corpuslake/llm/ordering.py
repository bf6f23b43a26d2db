"""Dense positions in an ordered group, whatever share of the rows one group holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslake.session import cut_lineage


def positions(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """``rows`` with ``idx`` (0-based in the group), ``group_no`` (0-based in group order) and ``group_size``.

    The rows are sorted once into ranges, so a hot group lies in many tasks; a group's rows in the ranges before are counted
    per (group, range).  Group columns must not be null; nulls in order columns come first; equal rows keep any order.
    """
    keys = [*group, *order, "__tie"]
    ranged = rows.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("__tie")
    placed = cut_lineage(ranged.withColumn("__at", F.monotonically_increasing_id())).withColumn("__part", F.shiftright("__at", 33))
    own, earlier = Window.partitionBy(*group), (Window.unboundedPreceding, -1)
    runs = placed.groupBy(*group, "__part").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n")).select(
        *group, "__part", "__first", F.sum("__n").over(own).alias("group_size"), F.min("__first").over(own).alias("__start"),
        F.coalesce(F.sum("__n").over(own.orderBy("__part").rowsBetween(*earlier)), F.lit(0)).alias("__before"))
    # A group is numbered by the range it begins in; there is one row per range in the running sum.
    heads = runs.filter(F.col("__first") == F.col("__start")).select(
        *group, F.col("__part").alias("__home"), F.row_number().over(Window.partitionBy("__part").orderBy("__first")).alias("__k"))
    homes = heads.groupBy("__home").agg(F.count(F.lit(1)).alias("__m")).select(
        "__home", F.coalesce(F.sum("__m").over(Window.orderBy("__home").rowsBetween(*earlier)), F.lit(0)).alias("__base"))
    numbers = heads.join(homes, "__home").select(*group, (F.col("__base") + F.col("__k") - 1).alias("group_no"))
    spots = runs.join(numbers, group).select(*group, "__part", "__first", "__before", "group_size", "group_no")
    return (placed.join(spots, [*group, "__part"]).withColumn("idx", F.col("__at") - F.col("__first") + F.col("__before"))
            .drop("__at", "__part", "__first", "__before"))
