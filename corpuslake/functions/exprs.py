"""Small helpers for building plans that compute each expression once."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` applied to a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def unnest(df: DataFrame, columns: Sequence, array: Column, value: str = "value", position: str = "pos") -> DataFrame:
    """One row per array element, with its 0-based position.

    A plain explode makes the optimizer test ``size(array) > 0`` before it, which computes the
    array expression twice; the outer form does not, and its empty rows are dropped after.
    """
    rows = df.select(*columns, F.posexplode_outer(array).alias(position, value))
    return rows.filter(F.col(position).isNotNull())
