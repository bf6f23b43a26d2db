"""The evaluation layers of the other queries in one gated table."""

from pyspark.sql import functions as F

from ..operators import evals, policy, telemetry
from .base import query, r6, table
from .document_queries import JUDGE_SQL, POLICY_SQL, docs, judged
from .pricing_queries import AUDIT_SQL, printed_quotes
from .telemetry_queries import FACT_SQL, facts


@query("eval_layer_table", f"""
WITH layer AS (
  SELECT 'unit' AS layer, 'guardrails/deterministic' AS name, count(*) AS total, count(*) FILTER (WHERE outcome = expected) AS passed
  FROM (SELECT CASE WHEN toxic = 1 THEN 'block' ELSE 'allow' END AS expected, outcome FROM labels JOIN ({POLICY_SQL} SELECT doc_id, outcome FROM p) USING (doc_id))
  UNION ALL SELECT 'cost', 'cost/quote-arithmetic', count(*), count(*) FILTER (WHERE reasons = '') FROM (WITH {AUDIT_SQL} SELECT reasons FROM audit)
  UNION ALL SELECT 'trajectory', 'trajectory/proposal-path', count(*), count(*) FILTER (WHERE NOT failed AND estimate_at < terminal_at AND brief_at < terminal_at)
  FROM (WITH {FACT_SQL} SELECT * FROM f WHERE terminal_at IS NOT NULL)
  UNION ALL SELECT 'e2e', 'e2e/proposal-chain', count(*), count(*) FILTER (WHERE NOT failed) FROM (WITH {FACT_SQL} SELECT * FROM f WHERE terminal_at IS NOT NULL)
  UNION ALL SELECT 'judge', 'judge/proposal-quality', count(score), count(*) FILTER (WHERE score >= 3) FROM (WITH {JUDGE_SQL} SELECT * FROM s)),
s AS (SELECT *, (total - passed) || ' failed' AS detail, round(coalesce(passed / nullif(total, 0), 0), 6) AS pass_rate,
  CASE name WHEN 'guardrails/deterministic' THEN 0.6 WHEN 'cost/quote-arithmetic' THEN 0.875 WHEN 'judge/proposal-quality' THEN 0.75 ELSE 0.8 END::DOUBLE AS floor FROM layer),
t AS (SELECT *, CASE WHEN total = 0 THEN 'SKIP' WHEN passed / total < floor THEN 'FAIL' ELSE 'ok' END AS status FROM s)
SELECT layer, name, total, passed, detail, pass_rate, floor, status, (SELECT bool_and(status <> 'FAIL') FROM t) AS gate FROM t""")
def eval_layer_table(spark, sf_dir):
    """Policy, quote, trajectory and completion layers over the tables; the judge layer counts the replies with a score."""
    known = facts(spark, sf_dir)
    got = policy.input_policy(docs(spark, sf_dir), "text").select("doc_id", "outcome")
    expected = F.when(F.col("toxic") == 1, F.lit("block")).otherwise(F.lit("allow"))
    cases = table(spark, sf_dir, "labels").join(got, "doc_id")
    registry = evals.LayerRegistry()
    registry.add("guardrails", lambda s: evals.layer_row(cases, "unit", "guardrails/deterministic", F.col("outcome") == expected))
    registry.add("cost", lambda s: evals.layer_row(evals.quote_audit(*printed_quotes(s, sf_dir)), "cost", "cost/quote-arithmetic", F.col("ok")))
    registry.add("trajectory", lambda s: evals.layer_row(telemetry.trajectory(known), "trajectory", "trajectory/proposal-path", F.col("passed")))
    registry.add("e2e", lambda s: evals.layer_row(telemetry.completion(known), "e2e", "e2e/proposal-chain", F.col("passed")))
    registry.add("judge", lambda s: evals.layer_row(judged(s, sf_dir).filter("score IS NOT NULL"), "judge", "judge/proposal-quality", F.col("score") >= 3))
    out = registry.run(spark)
    return out.select("layer", "name", "total", "passed", "detail", r6(F.col("pass_rate")).alias("pass_rate"), "floor", "status", "gate")
