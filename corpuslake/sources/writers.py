"""Writers: Parquet tables are the truth, text exports and pointers come second."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas


def page_document() -> Column:
    """Front matter and Markdown of one page as a single text."""
    return F.concat(
        F.concat_ws("\n", F.lit("---"),
                    F.concat(F.lit("url: "), "url"),
                    F.concat(F.lit("title: "), "title"),
                    F.concat(F.lit("crawled_at: "), "crawled_at"),
                    F.concat(F.lit("lastmod: "), F.coalesce("lastmod", F.lit(""))),
                    F.concat(F.lit("content_hash: "), "content_hash"),
                    F.lit("---"), F.lit("")),
        F.col("markdown"), F.lit("\n"))


def write_pages(pages: DataFrame, path: str, raw_html_path: str | None = None) -> None:
    """Write (slug, document) rows; raw HTML goes to its own table when asked for."""
    pages.select("slug", page_document().alias("document")).write.mode("overwrite").parquet(path)
    if raw_html_path is not None:
        pages.select("slug", "html").write.mode("overwrite").parquet(raw_html_path)


def publish_version(df: DataFrame, root: str, fmt: str = "json") -> str:
    """Write a new version directory and then flip the pointer file to it.

    Readers follow the pointer, so they see the old rows or the new ones and never a mix;
    a task retry or a lost executor only ever touches the unpublished directory.
    """
    version = f"v-{uuid.uuid4().hex}"
    df.write.format(fmt).save(f"{root}/{version}")
    _replace_text(df.sparkSession, f"{root}/CURRENT", version)
    return version


def current_version(spark: SparkSession, root: str, schema=schemas.MANIFEST, fmt: str = "json") -> DataFrame:
    """The published version, or an empty table before the first publication."""
    fs, path = _filesystem(spark, f"{root}/CURRENT")
    if not fs.exists(path):
        return spark.createDataFrame([], schema)
    version = spark.read.text(f"{root}/CURRENT").first()[0]
    return spark.read.schema(schema).format(fmt).load(f"{root}/{version}")


def _filesystem(spark: SparkSession, location: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(location)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _replace_text(spark: SparkSession, location: str, text: str) -> None:
    """Write a draft and rename it over the old file in one step, so a stop in between leaves the old text."""
    fs, path = _filesystem(spark, location)
    _, draft = _filesystem(spark, location + ".tmp")
    stream = fs.create(draft, True)
    stream.write(bytearray(text, "utf-8"))
    stream.close()
    kinds = getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(kinds, 1)
    how[0] = kinds.OVERWRITE
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    context.rename(fs.makeQualified(draft), fs.makeQualified(path), how)


def write_report(report: DataFrame, path: str) -> None:
    """Write the one-row run report as JSON text."""
    row = report.first().asDict(recursive=True)
    _replace_text(report.sparkSession, path, json.dumps(row, default=str))


def append_traces(traces: DataFrame, path: str, enabled: bool = True) -> bool:
    """Append trace rows.  Disabled is a no-op, and a failed write is reported, not raised."""
    if not enabled:
        return False
    try:
        traces.write.mode("append").parquet(path)
        return True
    except Exception:  # telemetry must not fail its producer
        return False


def write_baseline(results: DataFrame, path: str, embed_model: str, fingerprint: str) -> None:
    """Snapshot of per-case results with the model and corpus they belong to."""
    results.select("id", "rank", "gold_score", "top1_score", F.lit(embed_model).alias("embed_model"),
                   F.lit(fingerprint).alias("fingerprint")).write.mode("overwrite").parquet(path)


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.BASELINE).parquet(path)


def upsert_chunks(stored: DataFrame, fresh: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    """Stored chunks with the pages in ``fresh`` replaced and the slugs in ``removed`` dropped."""
    gone = fresh.select("slug")
    if removed is not None:
        gone = gone.unionByName(removed.select("slug"))
    return stored.join(gone.distinct(), "slug", "left_anti").unionByName(fresh, allowMissingColumns=True)
