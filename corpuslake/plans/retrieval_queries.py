"""Vector retrieval and retrieval evaluation over the embeddings table."""

from pyspark.sql import functions as F

from ..operators import evals, policy, vector_index
from ..operators.retrieval import exact_topk
from ..session import cut_lineage
from .base import query, r6, table

K = 5


def vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


def cases(spark, sf_dir):
    """Every vector asks for its own label; labels from 5 up stand for unanswerable questions."""
    v = vectors(spark, sf_dir)
    known = F.col("label") < 5
    return v.select(
        "id", F.when(known, F.lit("retrieve")).otherwise(F.lit("abstain")).alias("expect"),
        F.when(known, F.col("label").cast("string")).alias("slug"),
        F.when(F.col("label") > 0, F.when(F.col("label") % 2 == 0, F.lit("even")).otherwise(F.lit("odd"))).alias("axis"),
        F.when(F.col("id") > 0, F.col("id") - 1).alias("paraphrase_of"))


def hits(spark, sf_dir, k=K):
    v = vectors(spark, sf_dir)
    top = exact_topk(v, v, k, exclude_same_id=True)
    slugs = v.select("id", F.col("label").cast("string").alias("slug"))
    return top.join(slugs, "id").select(F.col("query_id").alias("case_id"), "rank", "slug", "score")


def results(spark, sf_dir, k=K):
    return evals.case_results(cases(spark, sf_dir), hits(spark, sf_dir, k))


TOP_SQL = """
v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS vec, label FROM embeddings),
pairs AS (SELECT a.id AS query_id, b.id, b.label,
                 round(list_inner_product(a.vec, b.vec)
                       / sqrt(list_inner_product(a.vec, a.vec) * list_inner_product(b.vec, b.vec)), 9) AS score
          FROM v a JOIN v b ON a.id <> b.id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS rank FROM pairs)"""

RESULT_SQL = f"""{TOP_SQL},
cases AS (SELECT id, CASE WHEN label < 5 THEN 'retrieve' ELSE 'abstain' END AS expect,
                 CASE WHEN label < 5 THEN label END AS gold,
                 CASE WHEN label = 0 THEN 'untagged' WHEN label % 2 = 0 THEN 'even' ELSE 'odd' END AS axis FROM v),
results AS (SELECT c.id, c.expect, c.axis,
                   min(r.rank) FILTER (WHERE r.label = c.gold) AS rank,
                   arg_min(r.score, r.rank) FILTER (WHERE r.label = c.gold) AS gold_score,
                   arg_min(r.score, r.rank) AS top1_score
            FROM cases c LEFT JOIN ranked r ON r.query_id = c.id AND r.rank < {K} GROUP BY ALL)"""


@query("topk_cosine", f"""
WITH {TOP_SQL}
SELECT query_id, id AS hit_id, CAST(rank AS BIGINT) AS rank, round(score, 6) AS score FROM ranked WHERE rank < {K}""")
def topk_cosine(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return exact_topk(v, v, K, exclude_same_id=True).select(
        "query_id", F.col("id").alias("hit_id"), F.col("rank").cast("long").alias("rank"), r6(F.col("score")).alias("score"))


@query("hit_rate_mrr", f"""
WITH {RESULT_SQL}
SELECT coalesce(axis, 'all') AS axis, count(*) AS cases,
       round(avg(CASE WHEN rank IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END), 6) AS hit_rate,
       round(avg(CASE WHEN rank IS NOT NULL THEN 1.0::DOUBLE / (rank + 1) ELSE 0 END), 6) AS mrr
FROM results WHERE expect = 'retrieve' GROUP BY ROLLUP (axis)""")
def hit_rate_mrr(spark, sf_dir):
    rows = evals.answerable(results(spark, sf_dir)).withColumn("axis", F.coalesce("axis", F.lit("untagged")))
    hit = evals.is_hit(K)
    return rows.rollup("axis").agg(
        F.count(F.lit(1)).alias("cases"), r6(F.avg(hit.cast("double"))).alias("hit_rate"),
        r6(F.avg(F.when(hit, F.lit(1.0) / (F.col("rank") + 1)).otherwise(0.0))).alias("mrr")).withColumn(
        "axis", F.coalesce("axis", F.lit("all")))


@query("score_separation", f"""
WITH {RESULT_SQL},
g AS (SELECT gold_score AS s, row_number() OVER (ORDER BY gold_score) - 1 AS i, count(*) OVER () AS n
      FROM results WHERE expect = 'retrieve' AND rank IS NOT NULL),
a AS (SELECT top1_score AS s, row_number() OVER (ORDER BY top1_score) - 1 AS i, count(*) OVER () AS n
      FROM results WHERE expect = 'abstain'),
gm AS (SELECT quantile_cont(s, 0.5) AS m FROM g)
SELECT round((SELECT min(s) FROM g), 6) AS gold_min,
       round((SELECT s FROM g WHERE i = least(CAST(floor(0.25 * n) AS BIGINT), n - 1)), 6) AS gold_p25,
       round((SELECT m FROM gm), 6) AS gold_median,
       round((SELECT quantile_cont(s, 0.5) FROM a), 6) AS abstain_median,
       round((SELECT s FROM a WHERE i = least(CAST(floor(0.75 * n) AS BIGINT), n - 1)), 6) AS abstain_p75,
       round((SELECT max(s) FROM a), 6) AS abstain_max,
       (SELECT count(*) FROM a, gm WHERE a.s > gm.m) AS overlap_count,
       (SELECT count(*) FROM a) AS abstain_total, (SELECT count(*) FROM g) AS gold_total""")
def score_separation(spark, sf_dir):
    # One small row per case, read by six branches below.
    out = evals.separation(cut_lineage(results(spark, sf_dir)), K)
    return out.select(*[r6(F.col(c)).alias(c) if c.split("_")[-1] in ("min", "p25", "median", "p75", "max") else F.col(c)
                        for c in out.columns])


@query("baseline_diff", f"""
WITH {RESULT_SQL}
SELECT id, coalesce(CASE WHEN rank < 3 THEN rank END, -1)::BIGINT AS rank_before, coalesce(rank, -1)::BIGINT AS rank_after,
       coalesce(rank >= 3, false) AS rank_changed
FROM results""")
def baseline_diff(spark, sf_dir):
    """Current results at depth 5 against a baseline taken at depth 3 of the same hits."""
    now = cut_lineage(results(spark, sf_dir))
    shallow = F.col("rank") < 3
    before = now.select("id", F.when(shallow, F.col("rank")).alias("rank"), F.when(shallow, F.col("gold_score")).alias("gold_score"))
    return evals.diff_baseline(now, before).select(
        "id", F.coalesce("rank_before", F.lit(-1)).cast("long").alias("rank_before"),
        F.coalesce("rank_after", F.lit(-1)).cast("long").alias("rank_after"), "rank_changed")


@query("paraphrase_divergence", f"""
WITH {RESULT_SQL}
SELECT b.id AS base, t.id AS twin FROM results t JOIN results b ON b.id = t.id - 1
WHERE (t.rank IS NULL) <> (b.rank IS NULL)""")
def paraphrase_divergence(spark, sf_dir):
    return evals.divergent_pairs(cut_lineage(results(spark, sf_dir)), cases(spark, sf_dir), K)


@query("grounding_check", """
WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS vec, label FROM embeddings),
best AS (SELECT a.id, max(round(list_inner_product(a.vec, b.vec)
                / sqrt(list_inner_product(a.vec, a.vec) * list_inner_product(b.vec, b.vec)), 9)) AS s
         FROM v a JOIN v b ON a.label = b.label AND a.id <> b.id GROUP BY a.id)
SELECT v.id, round(greatest(coalesce(best.s, 0), 0), 6) AS similarity,
       CASE WHEN best.s IS NULL OR best.s >= 0.6 THEN 'allow' ELSE 'escalate' END AS action
FROM v LEFT JOIN best USING (id)""")
def grounding_check(spark, sf_dir):
    """Every vector as an answer, the other vectors of its label as its sources."""
    v = vectors(spark, sf_dir)
    out = policy.grounding_check(v, v, match_on="label", exclude_same_id=True)
    return out.select("id", r6(F.coalesce("similarity", F.lit(0.0))).alias("similarity"), "action")


ASK = "id % 100 = 0"


@query("cell_recall", f"""
SELECT count(*) AS queries, CAST(count(*) * least({K}, (SELECT count(*) - 1 FROM embeddings)) AS BIGINT) AS wanted, true AS recall_reached
FROM embeddings WHERE vec_id % 100 = 0""")
def cell_recall(spark, sf_dir):
    """Whether the cell index finds nine of ten exact neighbours, over every hundredth vector against all."""
    v = vectors(spark, sf_dir)
    asks = v.filter(ASK)
    found = vector_index.topk_by_cells(asks, v, vector_index.fit_cells(v, K), K, exclude_same_id=True)
    row = vector_index.recall_at(found, exact_topk(asks, v, K, exclude_same_id=True))
    return row.select("queries", "wanted", (F.col("found") >= 0.9 * F.col("wanted")).alias("recall_reached"))


@query("cell_topk")
def cell_topk(spark, sf_dir):
    """The nearest vectors of every hundredth vector, by the cell index (approximate, so without an SQL form)."""
    v = vectors(spark, sf_dir)
    return vector_index.topk_by_cells(v.filter(ASK), v, vector_index.fit_cells(v, K), K, exclude_same_id=True).select(
        "query_id", F.col("id").alias("hit_id"), F.col("rank").cast("long").alias("rank"), r6(F.col("score")).alias("score"))
