"""Structured Streaming forms of the incremental jobs.

Keyed state lives in the RocksDB store, outputs are append-only logs whose rows carry the
batch that wrote them: a batch that is run again overwrites its own directory, so every sink
here is idempotent, and ``latest_rows`` reads the current row per key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from ..functions import fixed_values as fv

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_stream(spark: SparkSession, path: str, schema: T.StructType, name_filter: str | None = None,
                max_files: int | None = None) -> DataFrame:
    """Parquet files as a stream; ``max_files`` bounds what one micro-batch admits."""
    reader = spark.readStream.schema(schema)
    if name_filter:
        reader = reader.option("pathGlobFilter", name_filter)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def run_to_log(stream: DataFrame, root: str, mode: str = "append",
               change: Callable[[DataFrame, int], DataFrame] | None = None) -> StreamingQuery:
    """Run what is available now, writing batch ``n`` to ``root/rows/batch=n`` (rewritten on replay)."""
    def write(batch: DataFrame, number: int) -> None:
        rows = change(batch, number) if change else batch
        rows.write.mode("overwrite").parquet(f"{root}/rows/batch={number}")

    query = (stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/checkpoint")
             .trigger(availableNow=True).foreachBatch(write).start())
    query.awaitTermination()
    return query


def read_log(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/rows")


def latest_rows(log: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The row of the last batch per key."""
    rest = [c for c in log.columns if c not in keys]
    picked = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r"))
    return picked.select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest if c != "batch"])


# --------------------------------------------------------------------- aggregates
def windowed_metrics(stream: DataFrame, time: str, keys: Sequence[str], window: str = "5 minutes",
                     late: str = "10 minutes", value: str = "value") -> DataFrame:
    """Count, sum and approximate percentiles per window and key; rows later than the watermark are dropped."""
    timed = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    out = timed.groupBy(F.window(time, window).alias("w"), *keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"),
        F.percentile_approx(value, [0.5, 0.95], 1000).alias("p"))
    return out.select(F.col("w.start").alias("window_start"), *keys, "n", "total",
                      F.col("p")[0].alias("p50"), F.col("p")[1].alias("p95"))


def session_metrics(stream: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Activity per session window; a session is emitted once the watermark has passed its end."""
    timed = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    out = timed.groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return out.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def first_uploads(stream: DataFrame, time: str, keys: Sequence[str], late: str = "1 day") -> DataFrame:
    """Rows whose bytes were not seen in the session within the watermark."""
    timed = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return timed.dropDuplicatesWithinWatermark(list(keys))


# -------------------------------------------------------------------- keyed state
def _ordered(rows: Iterator[pd.DataFrame], order: Sequence[str]) -> pd.DataFrame:
    """One key's rows of a micro-batch in order; admission control bounds the batch."""
    return pd.concat(list(rows), ignore_index=True).sort_values(list(order), kind="stable")


class SessionMemory(StatefulProcessor):
    """Keeps the last turns of each session and answers each turn with what came before it."""

    def __init__(self, size: int = fv.MEMORY_TURNS, ttl_seconds: int | None = None):
        self.size, self.ttl_seconds = size, ttl_seconds

    def init(self, handle) -> None:
        schema = T.StructType([T.StructField("line", T.StringType())])
        ttl = None if self.ttl_seconds is None else self.ttl_seconds * 1000
        self.turns = handle.getListState("turns", schema, ttl)

    def handleInputRows(self, key, rows, timerValues):
        kept = [row[0] for row in self.turns.get()] if self.turns.exists() else []
        frame = _ordered(rows, ["turn"])
        contexts = []
        for role, text in zip(frame["role"], frame["text"]):
            contexts.append("\n".join(kept))
            kept = (kept + [f"{role}: {text}"])[-self.size:]
        self.turns.put([(line,) for line in kept])
        yield pd.DataFrame({"conv_id": key[0], "turn": frame["turn"].to_numpy(), "context": contexts})

    def close(self) -> None:
        pass


def session_memory(stream: DataFrame, size: int = fv.MEMORY_TURNS, ttl_seconds: int | None = None) -> DataFrame:
    """(conv_id, turn, context) for a stream of turns; a time to live replaces a bound on session count."""
    out = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()),
                        T.StructField("context", T.StringType())])
    return stream.groupBy("conv_id").transformWithStateInPandas(
        SessionMemory(size, ttl_seconds), out, "Append", "ProcessingTime" if ttl_seconds else "None")


class StreakCounter(StatefulProcessor):
    """Counts unanswered turns in a row; every (cap + 1)-th escalates and starts again."""

    def __init__(self, cap: int = fv.STREAK_CAP):
        self.cap = cap

    def init(self, handle) -> None:
        self.count = handle.getValueState("count", T.StructType([T.StructField("n", T.IntegerType())]))

    def handleInputRows(self, key, rows, timerValues):
        n = self.count.get()[0] if self.count.exists() else 0
        frame = _ordered(rows, ["ts", "event_id"])
        streak, escalate = [], []
        for miss, reset in zip(frame["miss"], frame["reset"]):
            n = 0 if reset else (n + 1) % (self.cap + 1) if miss else n
            streak.append(n)
            escalate.append(bool(miss and n == 0))
        self.count.update((n,))
        yield pd.DataFrame({"event_id": frame["event_id"].to_numpy(), "streak": streak, "escalate": escalate})

    def close(self) -> None:
        pass


def streaks(stream: DataFrame, key: str, cap: int = fv.STREAK_CAP) -> DataFrame:
    """(event_id, streak, escalate) for a stream with ts, event_id, miss and reset columns."""
    out = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("streak", T.LongType()),
                        T.StructField("escalate", T.BooleanType())])
    return stream.groupBy(key).transformWithStateInPandas(StreakCounter(cap), out, "Append", "None")


# ------------------------------------------------------------------------ expiry
class ExpiryTimer(StatefulProcessor):
    """Holds a key's uploads until the watermark has passed their time to live, then emits and forgets them.

    A timer per key stands at the earliest time that is still held; when it fires everything due is emitted at once.
    """

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle) -> None:
        self.handle = handle
        # A list takes a frame of uploads in one call; a map would take one call an upload.
        self.due = handle.getListState("due", T.StructType([T.StructField("id", T.LongType()), T.StructField("at", T.LongType())]))
        self.next = handle.getValueState("next", T.StructType([T.StructField("at", T.LongType())]))

    def _wait_for(self, at: int | None) -> None:
        if self.next.exists():
            if self.next.get()[0] == at:
                return
            self.handle.deleteTimer(self.next.get()[0])
            self.next.clear()
        if at is not None:
            self.handle.registerTimer(at)
            self.next.update((at,))

    def handleInputRows(self, key, rows, timerValues):
        first = self.next.get()[0] if self.next.exists() else None
        for frame in rows:
            at = (frame["ms"].astype("int64") + self.ttl_ms + 1).tolist()  # timers fire at their time; an upload must be older than it
            self.due.appendList(list(zip(frame["id"].tolist(), at)))
            first = min(at) if first is None else min(first, min(at))
        self._wait_for(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = timerValues.getCurrentWatermarkInMs()
        held = {row[0]: row[1] for row in self.due.get()}  # of an upload that came again, the last time
        gone = [ident for ident, at in held.items() if at <= now]
        left = [(ident, at) for ident, at in held.items() if at > now]
        if left:
            self.due.put(left)
        else:
            self.due.clear()
        self.next.clear()  # the timer that fired is gone
        self._wait_for(min((at for _, at in left), default=None))
        yield pd.DataFrame({"id": pd.Series(gone, dtype="int64")})

    def close(self) -> None:
        pass


def expired_uploads(stream: DataFrame, key: str, ident: str, time: str, ttl_seconds: int, late: str = "0 seconds") -> DataFrame:
    """Ids of uploads that are strictly older than the time to live by the watermark, each once.

    The clock is the newest row less ``late``; rows without a time never expire.
    """
    timed = stream.withColumn("event_time", F.col(time).cast("timestamp")).filter(F.col("event_time").isNotNull()).withWatermark("event_time", late)
    rows = timed.select(F.col(key).alias("key"), F.col(ident).cast("long").alias("id"), F.unix_millis("event_time").alias("ms"), "event_time")
    return rows.groupBy("key").transformWithStateInPandas(ExpiryTimer(ttl_seconds * 1000), T.StructType([T.StructField("id", T.LongType())]), "Append", "EventTime")


# ---------------------------------------------------------------- index upkeep
#: Groups of pages whose hashes and versions are one state each; a call to the state store costs more than many rows of state.
PAGE_GROUPS = 1024


class PageVersions(StatefulProcessor):
    """Keeps the content hashes and versions of a group of pages, and passes on the newest row of each that is new, changed or removed."""

    def __init__(self, version: str, removed: str | None):
        self.version, self.removed = version, removed

    def init(self, handle) -> None:
        self.stored = handle.getListState("stored", T.StructType([
            T.StructField("page", T.StringType()), T.StructField("hash", T.StringType()), T.StructField("version", T.LongType())]))

    def handleInputRows(self, key, rows, timerValues):
        frame = pd.concat(list(rows), ignore_index=True).sort_values([self.version, "content_hash"], kind="stable")
        frame = frame.drop_duplicates("index_page", keep="last")
        known = {page: (hash_, version) for page, hash_, version in self.stored.get()} if self.stored.exists() else {}
        gone = frame[self.removed].tolist() if self.removed else [False] * len(frame)
        actions, moved = [], False
        for page, hash_, version, out in zip(frame["index_page"], frame["content_hash"], map(int, frame[self.version]), gone):
            before = known.get(page)
            action = None
            if before is None or version >= before[1]:
                if out:
                    action = "removed" if before is not None and before[0] is not None else None
                elif before is None or before[0] != hash_:
                    action = "added" if before is None or before[0] is None else "updated"
                # The version of a removed page stays, so that an older one that comes late does not return.
                known[page] = (None if out else hash_, version)
                moved |= known[page] != before
            actions.append(action)
        if moved:
            self.stored.put([(page, hash_, version) for page, (hash_, version) in known.items()])
        changed = frame.assign(action=actions).drop(columns=["index_page", "index_group"])
        yield changed[changed["action"].notna()]

    def close(self) -> None:
        pass


def page_changes(pages: DataFrame, version: str = "version", removed: str | None = None, groups: int = PAGE_GROUPS) -> DataFrame:
    """The pages of a stream that are new, changed or removed against the stored hashes, with an ``action``.

    ``groups`` is fixed for the life of a stream's checkpoint.
    """
    # Names with a leading underscore are lost on the way to a frame.  A frame holds many pages, and integers beside a null would become floats in it; so all but the version go as text.
    whole = [f for f in pages.schema.fields if isinstance(f.dataType, T.IntegralType) and f.name != version]
    text = pages.withColumns({"index_page": F.col("slug").cast("string"), "index_group": F.pmod(F.xxhash64("slug"), F.lit(groups)),
                              **{f.name: F.col(f"`{f.name}`").cast("string") for f in whole}})
    out = T.StructType([*[T.StructField(f.name, T.StringType()) if f in whole else f for f in pages.schema.fields], T.StructField("action", T.StringType())])
    changed = text.groupBy("index_group").transformWithStateInPandas(PageVersions(version, removed), out, "Append", "None")
    return changed.withColumns({f.name: F.col(f"`{f.name}`").cast(f.dataType) for f in whole})


def maintain_index(pages: DataFrame, root: str, make_chunks: Callable[[DataFrame], DataFrame],
                   version: str = "version", removed: str | None = None) -> StreamingQuery:
    """Keep a chunk table current from a stream of (slug, content_hash, body, version, ...) pages.

    Of several versions of a page the one with the largest ``version`` counts, late older ones are passed over, and a page whose
    ``removed`` column is true leaves the index.  Stored hashes are state per group of slugs, so a batch reads the state of its own groups
    and not the log.  A batch writes what changed to ``root/pages`` and the chunks made from it to ``root/rows``; replaying it overwrites both.
    """
    spark = pages.sparkSession

    def change(batch: DataFrame, number: int) -> DataFrame:
        folder = f"{root}/pages/batch={number}"
        batch.write.mode("overwrite").parquet(folder)
        changed = spark.read.schema(batch.schema).parquet(folder)
        return make_chunks(changed.filter("action <> 'removed'").drop("action"))

    return run_to_log(page_changes(pages, version, removed), root, change=change)


def current_chunks(spark: SparkSession, root: str) -> DataFrame:
    """The chunks of each page's latest version; removed pages and those that became empty have none."""
    latest = latest_rows(spark.read.parquet(f"{root}/pages").select("slug", "action", "batch", F.col("batch").alias("of")), ["slug"])
    kept = latest.filter("action <> 'removed'").select("slug", F.col("of").alias("batch"))
    return read_log(spark, root).join(kept, ["slug", "batch"])
