"""Run catalog queries and their SQL forms side by side: ``python tests/compare.py [sf_dir] [names...]``."""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def oracle(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def rows(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    values = [tuple("NULL" if v is None or v is pd.NA or (isinstance(v, float) and v != v) else repr(v) if isinstance(v, float) else str(v)
                    for v in row) for row in frame.astype(object).itertuples(index=False)]
    return sorted(values)


def kinds(frame: pd.DataFrame) -> dict:
    return {c: frame[c].dtype.kind for c in sorted(frame.columns)}


def compare(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    if len(got) and kinds(got) != kinds(want):
        return f"types {kinds(got)} != {kinds(want)}"
    a, b = rows(got), rows(want)
    if a != b:
        bad = [(x, y) for x, y in zip(a, b) if x != y]
        only = sorted(set(a) - set(b))[:2], sorted(set(b) - set(a))[:2]
        return f"{len(bad)} rows differ, spark only {str(only[0])[:900]} sql only {str(only[1])[:900]}"
    return None


def pandas_rows(df) -> pd.DataFrame:
    """A result as pandas, with whole numbers kept whole where some are null."""
    whole = [f.name for f in df.schema if f.dataType.typeName() in ("byte", "short", "integer", "long")]
    return df.toPandas().astype(dict.fromkeys(whole, "Int64"))


def main() -> None:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(entry.queries())
    spark = (SparkSession.builder.master(f"local[{os.environ.get('CPUS', 8)}]").config("spark.ui.enabled", "false")
             .config("spark.driver.memory", "12g").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("OFF")
    con, sql, queries = oracle(sf_dir), entry.oracle_sql(), entry.queries()
    failed = 0
    for name in names:
        start = time.time()
        try:
            got = pandas_rows(queries[name](spark, sf_dir))
        except Exception as error:
            failed += 1
            print(f"{name}: ERROR {str(error)[:1500]}", flush=True)
            continue
        took = time.time() - start
        if name not in sql:
            print(f"{name}: {len(got)} rows, no SQL form, {took:.1f}s", flush=True)
            continue
        start = time.time()
        try:
            want = con.execute(sql[name]).df()
            problem = compare(got, want)
        except Exception as error:
            problem = f"SQL ERROR {str(error)[:1500]}"
        failed += problem is not None
        print(f"{name}: {problem or 'ok'} ({len(got)} rows, spark {took:.1f}s, sql {time.time() - start:.1f}s)", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main()
