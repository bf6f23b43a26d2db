"""Streaming forms of the keyed and incremental jobs, run over what is available now."""

import uuid
from contextlib import contextmanager

from pyspark.sql import functions as F

from ..operators.chunking import chunk_pages
from ..session import checkpoint_dir
from ..streaming import jobs
from .base import query, r6, table
from .telemetry_queries import STREAK_SQL
from .crawl_queries import CHUNK_SQL


def place(spark, name):
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Files that one batch of pages admits; their versions make the order of files irrelevant.
FILES_A_BATCH = 32


def stream(spark, sf_dir, name):
    """A table, one file or a folder of them, as a stream of one batch: its files are in no order of time, so none may come late."""
    return jobs.read_stream(spark, f"{sf_dir}/{name}.parquet*", table(spark, sf_dir, name).schema)


@contextmanager
def state_store(spark):
    """Keyed state in RocksDB while a query runs; the caller's setting comes back after it."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, jobs.ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


@query("streaming_tumbling", """
SELECT strftime(time_bucket(INTERVAL '1 hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total
FROM events GROUP BY ALL""")
def streaming_tumbling(spark, sf_dir):
    root = place(spark, "tumbling")
    jobs.run_to_log(jobs.windowed_metrics(stream(spark, sf_dir, "events"), "ts", ["event_type"], "1 hour"), root, "update")
    out = jobs.latest_rows(jobs.read_log(spark, root), ["window_start", "event_type"])
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n",
                      F.round("total", 4).alias("total"))


@query("streaming_streak", STREAK_SQL)
def streaming_streak(spark, sf_dir):
    e = stream(spark, sf_dir, "events").select(
        "event_id", "user_id", "ts", (F.col("event_type") == "error").alias("miss"), (F.col("event_type") == "purchase").alias("reset"))
    root = place(spark, "streak")
    with state_store(spark):
        jobs.run_to_log(jobs.streaks(e, "user_id"), root)
    return jobs.read_log(spark, root).select("event_id", "streak", "escalate")


@query("streaming_memory", """
SELECT conv_id, turn, sha256(coalesce(string_agg(role || ': ' || text, chr(10))
  OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), '')) AS context FROM conversations""")
def streaming_memory(spark, sf_dir):
    root = place(spark, "memory")
    with state_store(spark):
        jobs.run_to_log(jobs.session_memory(stream(spark, sf_dir, "conversations")), root)
    return jobs.read_log(spark, root).select("conv_id", "turn", F.sha2("context", 256).alias("context"))


@query("streaming_dedupe", "SELECT user_id, sha256(event_type || props) AS sha FROM events GROUP BY ALL")
def streaming_dedupe(spark, sf_dir):
    """First uploads of the same bytes per user (the watermark is wider than the data)."""
    e = stream(spark, sf_dir, "events").select("user_id", "ts", F.sha2(F.concat("event_type", "props"), 256).alias("sha"))
    root = place(spark, "dedupe")
    jobs.run_to_log(jobs.first_uploads(e, "ts", ["user_id", "sha"], "60 days"), root)
    return jobs.read_log(spark, root).select("user_id", "sha")


@query("streaming_expiry", """
SELECT event_id FROM events WHERE epoch((SELECT max(ts) FROM events)) - epoch(ts) > 7 * 86400.0""")
def streaming_expiry(spark, sf_dir):
    """Uploads whose timers ran out: those older than seven days by the stream's own clock."""
    root = place(spark, "expiry")
    with state_store(spark):
        jobs.run_to_log(jobs.expired_uploads(stream(spark, sf_dir, "events"), "user_id", "event_id", "ts", 7 * 86400), root)
    return jobs.read_log(spark, root).select(F.col("id").alias("event_id"))


@query("streaming_sessions", """
WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL '30 minutes' THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS sid FROM g),
c AS (SELECT user_id, min(ts) AS a, max(ts) AS b, count(*) AS n FROM s GROUP BY user_id, sid)
SELECT user_id, strftime(a, '%Y-%m-%d %H:%M:%S') AS session_start, n FROM c WHERE b + INTERVAL '30 minutes' <= (SELECT max(ts) FROM events)""")
def streaming_sessions(spark, sf_dir):
    """Session windows of the stream that the watermark has closed."""
    root = place(spark, "sessions")
    jobs.run_to_log(jobs.session_metrics(stream(spark, sf_dir, "events"), "ts", "user_id", "30 minutes", "0 seconds"), root)
    return jobs.read_log(spark, root).select("user_id", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss").alias("session_start"), "n")


@query("streaming_index", f"""
WITH RECURSIVE {CHUNK_SQL} SELECT id, sha256(CASE WHEN slug % 3 = 1 THEN replace(text, 'e', 'E') ELSE text END) AS digest FROM idx WHERE slug % 3 <> 2""")
def streaming_index(spark, sf_dir):
    """Chunk table after three batches over all documents: all added; one third repeated, changed or removed; and old versions come late."""
    root = place(spark, "index")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("slug"), F.col("text").alias("body"))
    third = F.pmod("slug", F.lit(3))
    batches = (
        docs.withColumns({"version": F.lit(1), "removed": F.lit(False)}),
        docs.withColumns({"version": F.lit(2), "removed": third == 2, "body": F.when(third == 1, F.replace("body", F.lit("e"), F.lit("E"))).otherwise(F.col("body"))}),
        docs.filter(third > 0).withColumns({"version": F.lit(1), "removed": F.lit(False)}))
    for rows in batches:
        rows.withColumn("content_hash", F.sha2("body", 256)).write.mode("append").parquet(f"{root}/in")
        pages = jobs.read_stream(spark, f"{root}/in", spark.read.parquet(f"{root}/in").schema, max_files=FILES_A_BATCH)
        with state_store(spark):
            jobs.maintain_index(pages, root, lambda changed: chunk_pages(changed, sep="\n", links=False), removed="removed")
    return jobs.current_chunks(spark, root).select("id", F.sha2("text", 256).alias("digest"))
