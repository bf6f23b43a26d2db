"""Telemetry, sessions and keyed state over the events table read as request traces."""

from pyspark.sql import functions as F

from ..functions.money import estimate_cost
from ..operators import dialogue, documents, evals, telemetry
from .base import query, r6, table

BRIEF, ESTIMATE, TERMINAL = "view", "click", "purchase"


def events(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.withColumn("k", F.get_json_object("props", "$.k").cast("long"))


def traces(spark, sf_dir):
    """Events as trace records: the type is the path and the tool, value the latency, k the tokens."""
    e, kind = events(spark, sf_dir), F.col("event_type")
    day = F.date_format("ts", "yyyy-MM-dd")
    return e.select(
        F.col("event_id").alias("record_id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"),
        F.concat_ws("/", F.col("user_id").cast("string"), day).alias("session_id"), kind.alias("path"),
        F.col("value").alias("latency_ms"), F.col("k").alias("total_tokens"),
        F.when(kind != "error", F.array(kind)).otherwise(F.array().cast("array<string>")).alias("tool_calls"),
        F.when(kind == "error", F.lit("failed")).otherwise(F.lit("")).alias("error"),
        F.when(kind == "purchase", True).when(kind == "error", False).alias("is_grounded"),
        F.when(kind.isin("purchase", "signup"), F.col("k") / 100).alias("confidence"),
        F.when(kind == "signup", F.lit("greeting")).alias("guardrail_reason"),
        estimate_cost(F.col("k"), F.when(kind != "view", F.col("k") * 2)).alias("cost_usd"))


TRACE_SQL = """
e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
t AS (SELECT event_id, ts, user_id, user_id || '/' || strftime(ts, '%Y-%m-%d') AS session_id, event_type AS path, value AS latency, k,
             event_type = 'error' AS is_error,
             CASE WHEN event_type = 'purchase' THEN 1.0 WHEN event_type = 'error' THEN 0.0 END AS grounded,
             CASE WHEN event_type IN ('purchase', 'signup') THEN k / 100.0 END AS confidence,
             event_type = 'signup' AS intercepted,
             k / 1000.0 * 0.00008 + CASE WHEN event_type <> 'view' THEN k * 2 ELSE 0 END / 1000.0 * 0.00009 AS cost FROM e)"""

_MEASURES = """count(*) AS "count", round(quantile_cont(latency, 0.5), 6) AS latency_p50,
       round(quantile_cont(latency, 0.95), 6) AS latency_p95, CAST(sum(k) AS BIGINT) AS total_tokens,
       round(avg(k), 6) AS avg_tokens, round(avg(is_error::INT), 6) AS error_rate,
       round(coalesce(avg(grounded), -1), 6) AS grounded_rate, round(coalesce(avg(confidence), -1), 6) AS mean_confidence,
       round(avg(intercepted::INT), 6) AS intercept_rate, round(sum(cost), 6) AS total_cost_usd"""


def _rounded(df):
    plain = ("path", "count", "total_tokens")
    return df.select(*[F.col(c) if c in plain else r6(F.coalesce(F.col(c), F.lit(-1.0))).alias(c) for c in df.columns])


@query("telemetry_rollup", f"WITH {TRACE_SQL} SELECT {_MEASURES} FROM t")
def telemetry_rollup(spark, sf_dir):
    return _rounded(telemetry.rollup(traces(spark, sf_dir)))


@query("telemetry_by_type", f"WITH {TRACE_SQL} SELECT path, {_MEASURES} FROM t GROUP BY path")
def telemetry_by_type(spark, sf_dir):
    return _rounded(telemetry.rollup(traces(spark, sf_dir), ["path"]))


FACT_SQL = f"""{TRACE_SQL},
f AS (SELECT session_id, bool_or(is_error) AS failed,
             min((ts, event_id)) FILTER (WHERE path = '{TERMINAL}') AS terminal_at,
             min((ts, event_id)) FILTER (WHERE path = '{ESTIMATE}') AS estimate_at,
             min((ts, event_id)) FILTER (WHERE path = '{BRIEF}') AS brief_at FROM t GROUP BY session_id)"""


def facts(spark, sf_dir):
    return telemetry.session_facts(traces(spark, sf_dir), TERMINAL, ESTIMATE, [BRIEF])


@query("session_trajectory", f"""
WITH {FACT_SQL}
SELECT session_id, reason, reason = 'ok' AS passed FROM (
  SELECT session_id, CASE WHEN failed THEN 'errored: failed'
    WHEN estimate_at IS NULL OR estimate_at > terminal_at THEN 'no estimate before'
    WHEN brief_at IS NULL OR brief_at > terminal_at THEN 'not grounded in the brief' ELSE 'ok' END AS reason
  FROM f WHERE terminal_at IS NOT NULL)""")
def session_trajectory(spark, sf_dir):
    return telemetry.trajectory(facts(spark, sf_dir))


@query("session_completion", f"""
WITH {FACT_SQL}
SELECT session_id, CASE WHEN failed THEN 'errored: failed' ELSE 'ok' END AS reason, NOT failed AS passed
FROM f WHERE terminal_at IS NOT NULL""")
def session_completion(spark, sf_dir):
    return telemetry.completion(facts(spark, sf_dir))


@query("stalled_sessions", f"WITH {FACT_SQL} SELECT session_id FROM f WHERE brief_at IS NOT NULL AND terminal_at IS NULL")
def stalled_sessions(spark, sf_dir):
    return telemetry.stalled(facts(spark, sf_dir))


STREAK_SQL = """
WITH e AS (SELECT event_id, user_id, ts, event_type = 'error' AS miss, event_type = 'purchase' AS reset FROM events),
r AS (SELECT *, sum(reset::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM e),
n AS (SELECT *, sum(miss::INT) OVER (PARTITION BY user_id, run ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS c FROM r)
SELECT event_id, CAST(c % 4 AS BIGINT) AS streak, miss AND c % 4 = 0 AS escalate FROM n"""


@query("streak_escalation", STREAK_SQL)
def streak_escalation(spark, sf_dir):
    """Errors count as unanswered turns, purchases as definite answers; users are the sessions."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    hour = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 86400)
    out = dialogue.streaks(e, ["user_id"], ["ts", "event_id"], hour,
                           F.col("event_type") == "error", F.col("event_type") == "purchase")
    return out.select("event_id", F.col("streak").cast("long").alias("streak"), "escalate")


@query("recent_traces", "SELECT event_id, event_type, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def recent_traces(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "value", "ts")
    return telemetry.recent(e, 50, ("ts", "event_id")).drop("ts")


@query("tumbling_metrics", """
SELECT strftime(time_bucket(INTERVAL '1 hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type,
       count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def tumbling_metrics(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n", "total")


@query("session_windows", """
WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL '30 minutes' THEN 0 ELSE 1 END AS fresh
           FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS sid FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, count(*) AS n, round(sum(value), 4) AS total
FROM s GROUP BY user_id, sid""")
def session_windows(spark, sf_dir):
    out = telemetry.sessions(table(spark, sf_dir, "events"), "user_id", "ts", 1800, {"total": F.col("value")})
    return out.select("user_id", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss").alias("session_start"), "n", F.round("total", 4).alias("total"))


@query("usage_totals", f"""
WITH {TRACE_SQL}
SELECT session_id, CASE WHEN seen THEN p ELSE -1 END AS prompt_tokens, CASE WHEN seen THEN c ELSE -1 END AS completion_tokens,
       CASE WHEN seen THEN p + c ELSE -1 END AS total_tokens
FROM (SELECT session_id, bool_or(path <> 'error') AS seen,
             CAST(sum(CASE WHEN path IN ('view', 'click') THEN k ELSE 0 END) AS BIGINT) AS p,
             CAST(sum(CASE WHEN path IN ('purchase', 'signup') THEN 2 * k ELSE 0 END) AS BIGINT) AS c FROM t GROUP BY session_id)""")
def usage_totals(spark, sf_dir):
    t, path = traces(spark, sf_dir), F.col("path")
    calls = t.select("session_id", F.when(path.isin("view", "click"), F.col("total_tokens")).alias("prompt_tokens"),
                     F.when(path.isin("purchase", "signup"), 2 * F.col("total_tokens")).alias("completion_tokens"))
    calls = calls.withColumn("total_tokens", F.coalesce("prompt_tokens", "completion_tokens"))
    out = telemetry.usage_totals(calls, ["session_id"])
    return out.select("session_id", *[F.coalesce(c, F.lit(-1)).alias(c) for c in out.columns[1:]])


@query("ablation_summary", f"""
WITH {TRACE_SQL},
r AS (SELECT path AS variant, path NOT IN ('view', 'click') AS uses_schema, latency < 20 AS off_scope, k, latency FROM t),
f AS (SELECT variant, NOT uses_schema OR k >= 10 AS valid,
             CASE WHEN uses_schema THEN k >= 10 AND (latency >= 15) <> off_scope
                  ELSE NOT off_scope OR latency < 5 END AS refusal,
             CASE WHEN uses_schema AND k >= 10 THEN k / 100.0 ELSE 0 END AS confidence FROM r)
SELECT variant, count(*) AS runs, round(avg(valid::INT), 6) AS json_valid_rate, round(avg(refusal::INT), 6) AS refusal_correct_rate,
       round(avg(confidence), 6) AS avg_confidence FROM f GROUP BY variant""")
def ablation_summary(spark, sf_dir):
    """Replies written from each event: JSON (fenced or bare) for schema variants, prose otherwise."""
    e = events(spark, sf_dir)
    body = F.to_json(F.struct(F.col("event_type").alias("answer"), (F.col("value") >= 15).alias("is_grounded"),
                              (F.col("k") / 100).alias("confidence")))
    raw = (F.when(F.col("event_type").isin("view", "click"),
                  F.when(F.col("value") < 5, F.lit("Sorry, I cannot say.")).otherwise(F.lit("The answer is yes.")))
           .when(F.col("k") < 10, F.lit('{"answer": 7}'))
           .when(F.col("k") < 50, F.concat(F.lit("Here {you} go:\n```json\n"), body, F.lit("\n```"))).otherwise(body))
    runs = e.select(F.col("event_type").alias("variant"), raw.alias("raw"),
                    (~F.col("event_type").isin("view", "click")).alias("uses_schema"),
                    (F.col("value") < 20).alias("out_of_scope"))
    out = evals.ablation_summary(evals.ablation_flags(dialogue.recover_answers(runs, "raw")))
    return out.select("variant", "runs", *[r6(F.col(c)).alias(c) for c in ("json_valid_rate", "refusal_correct_rate", "avg_confidence")])


@query("ttl_sweep", """
SELECT event_id FROM events WHERE epoch((SELECT max(ts) FROM events)) - epoch(ts) > 7 * 86400.0""")
def ttl_sweep(spark, sf_dir):
    """Rows older than seven days against a supplied clock (here the newest row)."""
    e = table(spark, sf_dir, "events").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    clock = e.agg(F.max("us").alias("now"))
    aged = e.crossJoin(F.broadcast(clock))
    return telemetry.expired(aged, (F.col("now") - F.col("us")) / 1e6, 7 * 86400).select("event_id")


@query("upload_dedupe", """
SELECT user_id, sha256(event_type || props) AS sha, count(*) AS copies, arg_min(event_id, (ts, event_id)) AS event_id
FROM events GROUP BY ALL""")
def upload_dedupe(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(
        "user_id", F.sha2(F.concat("event_type", "props"), 256).alias("sha"), "ts", "event_id")
    return telemetry.first_uploads(e, ["user_id", "sha"], ["ts", "event_id"]).drop("ts")


@query("repeat_calls", """
SELECT event_id, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE), event_type, props ORDER BY ts, event_id) > 1 AS repeated
FROM events""")
def repeat_calls(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("turn", F.to_date("ts"))
    return dialogue.repeated_calls(e, ["user_id", "turn", "event_type", "props"], ["ts", "event_id"]).select("event_id", "repeated")


@query("least_confident", f"""
WITH {TRACE_SQL}
SELECT user_id AS turn_id, arg_min(event_id, (coalesce(confidence, 1.0), event_id)) AS event_id,
       round(coalesce(arg_min(coalesce(confidence, 1.0), (coalesce(confidence, 1.0), event_id)), 1.0), 6) AS confidence
FROM t GROUP BY user_id""")
def least_confident(spark, sf_dir):
    e = events(spark, sf_dir)
    rows = e.select(F.col("user_id").alias("turn_id"), "event_id",
                    F.when(F.col("event_type").isin("purchase", "signup"), F.col("k") / 100).alias("confidence"))
    out = dialogue.least_confident(rows, "turn_id", "event_id")
    return out.withColumn("confidence", r6(F.coalesce("confidence", F.lit(1.0))))


@query("requirements_merge", """
WITH e AS (SELECT user_id AS doc, event_id AS g, event_type AS kind, json_extract_string(props, '$.k') AS k, props FROM events),
feat AS (SELECT doc, v, lower(v) AS key, g, pos FROM (
    SELECT doc, g, unnest([upper(kind) || ' flow', kind || '  ' || k]) AS v0, unnest([0, 1]) AS pos FROM e), LATERAL (SELECT trim(v0) AS v)),
feat1 AS (SELECT doc, arg_min(v, (g, pos)) AS v, min((g, pos)) AS place FROM (SELECT *, regexp_replace(key, '\\s+', ' ', 'g') AS nk FROM feat) GROUP BY doc, nk),
cons AS (SELECT doc, arg_min(props, g) AS v, min(g) AS place FROM e GROUP BY doc, lower(props)),
notes AS (SELECT doc, arg_min('saw ' || kind || repeat('!', k::INT + 150), g) AS v, min(g) AS place FROM e GROUP BY doc, kind, k),
attr AS (SELECT doc, kind, arg_max(k, g) AS k FROM e GROUP BY doc, kind),
sc AS (SELECT doc, max(CASE kind WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 END) AS c,
              max(CASE kind WHEN 'view' THEN 0 WHEN 'error' THEN 2 WHEN 'signup' THEN NULL ELSE 1 END) AS p FROM e GROUP BY doc)
SELECT sc.doc, (SELECT string_agg(v, '|' ORDER BY place) FROM feat1 WHERE feat1.doc = sc.doc) AS features,
       (SELECT string_agg(v, '|' ORDER BY place) FROM cons WHERE cons.doc = sc.doc) AS constraints,
       (SELECT sha256(string_agg(v, '|' ORDER BY place)) FROM notes WHERE notes.doc = sc.doc) AS notes,
       (SELECT string_agg(kind || '=' || k, '|' ORDER BY kind) FROM attr WHERE attr.doc = sc.doc) AS attributes,
       CASE coalesce(c, 1) WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS complexity,
       CASE coalesce(p, 1) WHEN 0 THEN 'easy' WHEN 1 THEN 'standard' ELSE 'hard' END AS project_category
FROM sc""")
def requirements_merge(spark, sf_dir):
    """Every event is one extracted group of its user's brief."""
    e, kind = events(spark, sf_dir), F.col("event_type")
    k = F.col("k").cast("string")
    none = F.array().cast("array<string>")
    groups = e.select(
        F.col("user_id").alias("doc"), F.col("event_id").alias("group"), none.alias("target_platform"), none.alias("tech_stack"),
        F.array(F.concat(F.upper(kind), F.lit(" flow")), F.concat(kind, F.lit("  "), k)).alias("features"),
        F.array(F.col("props"), F.lit(" ")).alias("constraints"),
        F.when(kind == "view", "low").when(kind == "click", " Medium").when(kind == "purchase", "HIGH").otherwise("moderate").alias("complexity"),
        F.when(kind == "view", "Simple").when(kind == "error", "complex").when(kind == "signup", "").otherwise("other").alias("project_category"),
        F.create_map(kind, k).alias("category_attributes"),
        F.array(F.concat(F.lit("saw "), kind, F.expr("repeat('!', int(k) + 150)"))).alias("extraction_notes"))
    out = documents.merge_requirements(groups)
    entries = F.transform(F.map_entries("category_attributes"), lambda a: F.concat_ws("=", a["key"], a["value"]))
    return out.select("doc", F.array_join("features", "|").alias("features"), F.array_join("constraints", "|").alias("constraints"),
                      F.sha2(F.array_join("extraction_notes", "|"), 256).alias("notes"),
                      F.array_join(entries, "|").alias("attributes"), "complexity", "project_category")
