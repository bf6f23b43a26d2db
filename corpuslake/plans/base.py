"""Catalog of named queries: a Spark plan and, where SQL can say it, an independent SQL form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import apply_settings

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name``."""
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(apply_settings(spark), sf_dir)

        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data directory, in the splits that the reader makes at any size."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(value: Column) -> Column:
    return F.round(value.cast("double"), 6)


def sql_text(value: str) -> str:
    """A Python string as an SQL literal."""
    return "'" + value.replace("'", "''") + "'"


def sql_list(values) -> str:
    return "[" + ", ".join(sql_text(v) for v in values) + "]"


def sql_any(column: str, words) -> str:
    """SQL test for plain containment of any word."""
    return f"list_bool_or([contains({column}, w) for w in {sql_list(words)}])"


def re2(pattern: str) -> str:
    """A pattern in the dialect of the SQL engine used for checking (no possessive quantifiers)."""
    return pattern.replace("?+", "?").replace("}+", "}")


WORD = r"[\p{L}\p{N}\p{M}_]"
NOT_WORD = r"[^\p{L}\p{N}\p{M}_]"


def bounded(inner: str) -> str:
    """Whole-word form of a pattern without look-around, for existence tests."""
    return rf"(?:^|{NOT_WORD})(?:{inner})(?:$|{NOT_WORD})"


def sql_match(column: str, pattern: str, fold: bool = True) -> str:
    flag = "(?i)" if fold else ""
    return f"regexp_matches({column}, {sql_text(flag + re2(pattern))})"
