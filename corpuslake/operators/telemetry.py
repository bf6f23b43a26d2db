"""Request telemetry and session analytics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sequences as sq
from ..functions.order_stats import exact_quantiles


def _present(value: Column) -> Column:
    return F.coalesce(value, F.lit("")) != ""


def rollup(traces: DataFrame, keys: Sequence[str] = (), approximate: bool = False) -> DataFrame:
    """Roll-up per key (or overall): counts, latency percentiles, tokens, rates and cost.

    Nulls are "not measured" and stay out of percentiles, means and rates; an empty string is
    not an error.  Percentiles interpolate; ``approximate`` trades them for one pass.
    """
    keys = list(keys)
    n = F.count(F.lit(1))
    known = F.count("is_grounded")
    measures = [
        n.alias("count"),
        F.coalesce(F.sum("total_tokens"), F.lit(0)).cast("long").alias("total_tokens"),
        F.avg("total_tokens").alias("avg_tokens"),
        F.coalesce(F.try_divide(F.count_if(_present(F.col("error"))).cast("double"), n), F.lit(0.0)).alias("error_rate"),
        F.try_divide(F.count_if("is_grounded").cast("double"), known).alias("grounded_rate"),
        F.avg("confidence").alias("mean_confidence"),
        F.coalesce(F.try_divide(F.count_if(_present(F.col("guardrail_reason"))).cast("double"), n), F.lit(0.0)).alias("intercept_rate"),
        F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("total_cost_usd")]
    if approximate:
        measures += [F.percentile_approx("latency_ms", q, 10000).cast("double").alias(name)
                     for name, q in (("latency_p50", 0.5), ("latency_p95", 0.95))]
        return traces.groupBy(*keys).agg(*measures)
    totals = traces.groupBy(*keys).agg(*measures)
    marks = exact_quantiles(traces, keys, "latency_ms", {"latency_p50": (0.5, "linear"), "latency_p95": (0.95, "linear")})
    return totals.join(marks, keys, "left") if keys else totals.crossJoin(marks)


def usage_totals(calls: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Token sums per request; a missing count is 0, a request without any usage is null."""
    names = ("prompt_tokens", "completion_tokens", "total_tokens")
    seen = F.count_if(F.coalesce(*names).isNotNull()) > 0
    return calls.groupBy(*keys).agg(*[
        F.when(seen, F.sum(F.coalesce(c, F.lit(0)))).cast("long").alias(c) for c in names])


def recent(traces: DataFrame, limit: int = 50, order: Sequence[str] = ("ts",)) -> DataFrame:
    """The most recent rows, newest first (a top-k report)."""
    return traces.orderBy(*[F.col(c).desc() for c in order]).limit(limit)


# ---------------------------------------------------------------------- sessions
def session_calls(traces: DataFrame) -> DataFrame:
    """(session_id, at, tool) of every tool call, ``at`` ordering calls inside a session.

    Records without a session are dropped; a null time sorts first.
    """
    kept = traces.filter(_present(F.col("session_id")))
    calls = kept.select("session_id", F.coalesce("ts", F.lit("")).alias("ts"), "record_id",
                        F.posexplode("tool_calls").alias("n", "tool"))
    return calls.select("session_id", F.struct("ts", "record_id", "n").alias("at"), "tool")


def session_facts(traces: DataFrame, terminal: str, estimate: str, briefs: Sequence[str]) -> DataFrame:
    """Per session the first time each step happened and the first error.

    Only minima are kept, so a session of any length is reduced map side and no session is
    ever gathered in one place.  ``traces`` needs a ``record_id`` to break equal times.
    """
    kept = traces.filter(_present(F.col("session_id")))
    error_at = F.struct(F.coalesce("ts", F.lit("")).alias("ts"), "record_id", "error")
    errors = kept.groupBy("session_id").agg(
        F.min(F.when(_present(F.col("error")), error_at)).getField("error").alias("first_error"),
        F.count(F.lit(1)).alias("records"))
    at, tool = F.col("at"), F.col("tool")
    steps = session_calls(traces).groupBy("session_id").agg(
        F.min(F.when(tool == terminal, at)).alias("terminal_at"),
        F.min(F.when(tool == estimate, at)).alias("estimate_at"),
        F.min(F.when(tool.isin(*briefs), at)).alias("brief_at"),
        F.count(F.lit(1)).alias("calls"))
    return errors.join(steps, "session_id", "left")


def _earlier(a: str, b: str) -> Column:
    return F.coalesce(F.col(a) < F.col(b), F.lit(False))


def trajectory(facts: DataFrame) -> DataFrame:
    """(session_id, passed, reason) of sessions that reached the terminal tool."""
    reason = (F.when(F.col("first_error").isNotNull(), F.concat(F.lit("errored: "), "first_error"))
              .when(~_earlier("estimate_at", "terminal_at"), F.lit("no estimate before"))
              .when(~_earlier("brief_at", "terminal_at"), F.lit("not grounded in the brief"))
              .otherwise(F.lit("ok")))
    scored = facts.filter(F.col("terminal_at").isNotNull()).select("session_id", reason.alias("reason"))
    return scored.withColumn("passed", F.col("reason") == "ok")


def completion(facts: DataFrame) -> DataFrame:
    """(session_id, passed, reason): the terminal tool ran and no record failed."""
    reason = F.when(F.col("first_error").isNotNull(), F.concat(F.lit("errored: "), "first_error")).otherwise(F.lit("ok"))
    scored = facts.filter(F.col("terminal_at").isNotNull()).select("session_id", reason.alias("reason"))
    return scored.withColumn("passed", F.col("reason") == "ok")


def stalled(facts: DataFrame) -> DataFrame:
    """Sessions that opened the brief and never reached the terminal tool."""
    return facts.filter(F.col("brief_at").isNotNull() & F.col("terminal_at").isNull()).select("session_id").orderBy("session_id")


# ---------------------------------------------------------------------- sessions
def sessions(events: DataFrame, key: str, time: str, gap_seconds: int, sums: dict[str, Column], block_seconds: int = 3600) -> DataFrame:
    """``(key, session_start, session_end, n, *sums)``: rows of a key at most ``gap_seconds`` apart are one session.

    Rows are merged to sessions inside (key, block of time); only those few are then joined across blocks, by
    block-wise carries, so a key that holds a third of the rows is spread over its blocks.  Rows without a time are in no session.
    """
    timed = events.filter(F.col(time).isNotNull()).withColumns({"__us": F.unix_micros(F.col(time).cast("timestamp")), **{f"__{n}": v for n, v in sums.items()}})
    timed = timed.withColumn("__part", F.floor(F.col("__us") / (block_seconds * 1_000_000)))
    inside = Window.partitionBy(key, "__part").orderBy("__us")
    apart = lambda before: F.when(F.col("__us") - before <= gap_seconds * 1_000_000, 0).otherwise(1)
    local = timed.withColumn("__fresh", apart(F.lag("__us").over(inside))).withColumn("__local", F.sum("__fresh").over(inside))
    # Session bounds go on as row times; the last row of one is what the next is measured against.
    local = local.groupBy(key, "__part", "__local").agg(F.min("__us").alias("__us"), F.max("__us").alias("__end"), F.count(F.lit(1)).alias("n"),
                                                        *[F.sum(f"__{n}").alias(n) for n in sums])
    part = F.floor(F.col("__us") / (block_seconds * 64_000_000))
    chained = sq.last_earlier(local, [key], ["__us"], part, F.col("__end"), "__before").withColumn("__fresh", apart(F.col("__before")))
    numbered = sq.running_sums(chained, [key], ["__us"], part, {"__session": F.col("__fresh")})
    merged = numbered.groupBy(key, "__session").agg(F.min("__us").alias("a"), F.max("__end").alias("b"), F.sum("n").alias("n"), *[F.sum(n).alias(n) for n in sums])
    return merged.select(key, F.timestamp_micros("a").alias("session_start"), F.timestamp_micros("b").alias("session_end"), "n", *sums)


# ---------------------------------------------------------------------- lifetime
def expired(rows: DataFrame, age_seconds: Column, ttl_seconds: float) -> DataFrame:
    """Rows strictly older than the time to live, by an age against a supplied clock."""
    return rows.filter(age_seconds > ttl_seconds)


def first_uploads(uploads: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first upload of the same bytes in a session, and how often they came again."""
    keys, order = list(keys), list(order)
    rest = [c for c in uploads.columns if c not in keys and c not in order]
    first = uploads.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("r"), F.count(F.lit(1)).alias("copies"))
    return first.select(*keys, "copies", "r.*")


def resolve_ids(requests: DataFrame, records: DataFrame, session: str = "session_id") -> DataFrame:
    """Requested ids found inside their own session, in request order; unknown ids are dropped."""
    kept = [c for c in requests.columns if c != "ids"]
    asked = requests.select(*kept, F.posexplode("ids").alias("pos", "id"))
    return asked.join(records, [session, "id"])
