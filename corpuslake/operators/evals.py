"""Retrieval and quality evaluation over logged or computed results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions import text as tx
from ..functions.exprs import unnest
from ..functions.order_stats import exact_quantiles


def ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole), F.lit(0.0))


# ------------------------------------------------------------------- retrieval
def case_results(cases: DataFrame, hits: DataFrame) -> DataFrame:
    """One row per case: rank and score of the first gold hit, score of the top hit.

    ``hits`` has (case_id, rank, slug, score).  The hits of a case are reduced map side, so
    the join carries two small structs per case and not the hit list.
    """
    gold = cases.select(F.col("id").alias("case_id"), F.col("slug").alias("gold_slug"))
    tagged = hits.join(gold, "case_id")
    mine = F.col("slug").eqNullSafe(F.col("gold_slug")) & F.col("gold_slug").isNotNull()
    found = tagged.groupBy("case_id").agg(
        F.min(F.when(mine, F.struct("rank", "score"))).alias("gold"),
        F.min(F.struct("rank", "score")).alias("top"))
    return cases.join(found.withColumnRenamed("case_id", "id"), "id", "left").select(
        "id", "expect", "axis", F.col("gold.rank").alias("rank"),
        F.col("gold.score").alias("gold_score"), F.col("top.score").alias("top1_score"))


def is_hit(k: int) -> Column:
    return F.coalesce(F.col("rank") < k, F.lit(False))


def answerable(results: DataFrame) -> DataFrame:
    return results.filter(F.col("expect") == "retrieve")


def hit_rate(results: DataFrame, k: int = 5) -> DataFrame:
    """(axis, cases, hit_rate): one row per axis and the total under a null axis."""
    rows = answerable(results).withColumn("axis", F.coalesce("axis", F.lit("untagged")))
    return rows.rollup("axis").agg(
        F.count(F.lit(1)).alias("cases"),
        F.coalesce(F.avg(is_hit(k).cast("double")), F.lit(0.0)).alias("hit_rate"))


def mrr(results: DataFrame, k: int = 5) -> DataFrame:
    """One row: mean reciprocal rank over answerable cases, a miss counts 0."""
    reciprocal = F.when(is_hit(k), F.lit(1.0) / (F.col("rank") + 1)).otherwise(0.0)
    return answerable(results).agg(F.coalesce(F.avg(reciprocal), F.lit(0.0)).alias("mrr"))


def divergent_pairs(results: DataFrame, cases: DataFrame, k: int = 5) -> DataFrame:
    """(base, twin) paraphrase pairs of which exactly one side hits."""
    hits = results.select("id", is_hit(k).alias("hit"))
    pairs = cases.filter(F.coalesce(F.col("paraphrase_of").cast("string"), F.lit("")) != "").select(
        F.col("id").alias("twin"), F.col("paraphrase_of").alias("base"))
    both = (pairs.join(hits.withColumnsRenamed({"id": "twin", "hit": "twin_hit"}), "twin")
            .join(hits.withColumnsRenamed({"id": "base", "hit": "base_hit"}), "base"))
    return both.filter("base_hit <> twin_hit").select("base", "twin")


def separation(results: DataFrame, k: int = 5) -> DataFrame:
    """One row comparing gold scores of hit cases with top scores of unanswerable ones.

    Quartiles are nearest-rank (a score some case had), medians interpolate.
    """
    gold = answerable(results).filter(is_hit(k) & F.col("gold_score").isNotNull()).select(
        F.col("gold_score").alias("score"))
    abstain = results.filter((F.col("expect") == "abstain") & F.col("top1_score").isNotNull()).select(
        F.col("top1_score").alias("score"))
    g = exact_quantiles(gold, [], "score", {"gold_p25": (0.25, "nearest"), "gold_median": (0.5, "linear")})
    a = exact_quantiles(abstain, [], "score", {"abstain_median": (0.5, "linear"), "abstain_p75": (0.75, "nearest")})
    gold_side = gold.agg(F.min("score").alias("gold_min"), F.count("score").alias("gold_total")).crossJoin(g)
    over = abstain.crossJoin(F.broadcast(g.select("gold_median"))).agg(
        F.count_if(F.col("score") > F.col("gold_median")).alias("overlap_count"),
        F.max("score").alias("abstain_max"), F.count("score").alias("abstain_total"))
    return gold_side.crossJoin(a).crossJoin(over).select(
        "gold_min", "gold_p25", "gold_median", "abstain_median", "abstain_p75", "abstain_max",
        "overlap_count", "abstain_total", "gold_total")


def staleness(baseline_model: Column, model: Column, baseline_print: Column, fingerprint: Column) -> Column:
    """Why a baseline cannot be compared, or null: the model is looked at first."""
    return (F.when(~baseline_model.eqNullSafe(model), F.concat(
        F.lit("embedding model changed: baseline="), F.coalesce(baseline_model, F.lit("none")), F.lit(" now="), model))
        .when(~baseline_print.eqNullSafe(fingerprint), F.concat(
            F.lit("corpus changed: baseline="), F.coalesce(baseline_print, F.lit("none")), F.lit(" now="), fingerprint)))


def diff_baseline(results: DataFrame, baseline: DataFrame) -> DataFrame:
    """Rank and score before and after per current case; cases that left the set are ignored."""
    before = baseline.select("id", F.col("rank").alias("rank_before"), F.col("gold_score").alias("score_before"))
    return results.join(before, "id", "left").select(
        "id", "rank_before", F.col("rank").alias("rank_after"), "score_before",
        F.col("gold_score").alias("score_after"),
        (~F.col("rank_before").eqNullSafe(F.col("rank"))).alias("rank_changed"))


# ------------------------------------------------------------------------ claims
def claim_grounding(claims: DataFrame, value: str = "value", brief_words: str = "brief_words") -> DataFrame:
    """Claims that say something, with a ``grounded`` flag: one content word shared with the brief."""
    said = claims.filter(tx.strip(F.coalesce(F.col(value), F.lit(""))) != "")
    shared = F.arrays_overlap(tx.content_words(F.col(value)), F.coalesce(
        F.col(brief_words), F.array().cast("array<string>")))
    return said.withColumn("grounded", F.coalesce(shared, F.lit(False)))


def explode_claims(cases: DataFrame, fields=fv.CLAIM_FIELDS) -> DataFrame:
    """(file, brief_words, field, value) rows of the claim lists of extraction cases."""
    lists = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"requirements.{f}").alias("values")) for f in fields])
    rows = cases.select("file", "brief_words", F.explode(lists).alias("l"))
    return unnest(rows, ["file", "brief_words", F.col("l.field").alias("field")], F.col("l.values")).drop("pos")


def claim_summary(flagged: DataFrame, keys: list[str]) -> DataFrame:
    out = flagged.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), F.count_if("grounded").alias("grounded"))
    return out.withColumn("rate", ratio(F.col("grounded"), F.col("total")))


def page_recall(truth_words: Column, read_words: Column) -> Column:
    """Share of the truth's content words present in the transcription."""
    return ratio(F.size(F.array_intersect(truth_words, read_words)), F.size(truth_words))


# ------------------------------------------------------------------------ quotes
def quote_audit(quotes: DataFrame, items: DataFrame) -> DataFrame:
    """(quote_id, ok, reasons): line sum, tax, total, declared currency and symbol of each quote.

    ``quotes`` prints subtotal, tax_rate, tax, total, currency_code, symbol, declared_currency
    and ``error``; ``items`` has quantity and unit_price.  An unbuildable quote fails.
    """
    def cents(c: Column) -> Column:
        return F.round(c.cast("decimal(38,8)"), 2).cast("decimal(28,2)")

    sums = items.groupBy("quote_id").agg(F.sum(cents(F.col("quantity") * F.col("unit_price"))).alias("line_sum"))
    q = quotes.join(sums, "quote_id", "left").withColumn("line_sum", F.coalesce(F.col("line_sum"), F.lit(0)).cast("decimal(28,2)"))
    symbols = F.create_map(*[F.lit(x) for pair in fv.CURRENCY_SYMBOLS for x in pair])
    expected = F.try_element_at(symbols, F.col("currency_code"))
    declared = F.coalesce("declared_currency", F.lit(""))
    reasons = F.array_compact(F.array(
        F.when(F.col("line_sum") != F.col("subtotal"), F.lit("subtotal")),
        F.when(cents(F.col("subtotal") * F.col("tax_rate") / 100) != F.col("tax"), F.lit("tax")),
        F.when(cents(F.col("subtotal") + F.col("tax")) != F.col("total"), F.lit("total")),
        F.when((declared != "") & (declared != F.col("currency_code")), F.lit("currency")),
        F.when(expected.isNotNull() & (expected != F.col("symbol")), F.lit("symbol"))))
    broken = F.col("subtotal").isNull()
    reasons = F.when(broken, F.array(F.coalesce("error", F.lit("quote could not be built")))).otherwise(reasons)
    return q.select("quote_id", reasons.alias("reasons")).withColumn("ok", F.size("reasons") == 0)


# ------------------------------------------------------------------------ layers
def layer_row(df: DataFrame, layer: str, name: str, passed: Column, detail: Column | None = None,
              scored: Column | None = None) -> DataFrame:
    """One layer result from scored rows; a layer without rows is skipped."""
    scored = F.lit(True) if scored is None else scored
    out = df.agg(F.count_if(scored).alias("total"), F.count_if(scored & passed).alias("passed"))
    note = detail if detail is not None else F.concat((F.col("total") - F.col("passed")).cast("string"), F.lit(" failed"))
    return out.select(F.lit(layer).alias("layer"), F.lit(name).alias("name"), "total", "passed",
                      note.alias("detail"), (F.col("total") == 0).alias("skipped"))


def layer_table(layers: list[DataFrame], floors=fv.LAYER_FLOORS) -> DataFrame:
    """Union of layer results with pass rate, floor and status; ``gate`` is the overall verdict."""
    rows = layers[0]
    for more in layers[1:]:
        rows = rows.unionByName(more)
    limits = F.create_map(*[F.lit(x) for pair in floors for x in pair])
    rows = rows.withColumn("pass_rate", ratio(F.col("passed"), F.col("total")))
    rows = rows.withColumn("floor", F.coalesce(F.try_element_at(limits, F.col("name")), F.lit(1.0)))
    rows = rows.withColumn("status", F.when(F.col("skipped"), F.lit("SKIP"))
                           .when(F.col("pass_rate") < F.col("floor"), F.lit("FAIL")).otherwise(F.lit("ok")))
    # One row per layer: a window over this handful keeps the layers from being computed twice.
    return rows.withColumn("gate", F.bool_and(F.col("status") != "FAIL").over(Window.partitionBy(F.lit(0))))


class LayerRegistry:
    """Named evaluation layers, each a callable from a session to a one-row layer result."""

    def __init__(self, floors=fv.LAYER_FLOORS):
        self.floors, self.layers = dict(floors), {}

    def add(self, name: str, layer: Callable[[SparkSession], DataFrame], floor: float | None = None) -> None:
        self.layers[name] = layer
        if floor is not None:
            self.floors[name] = floor

    def run(self, spark: SparkSession) -> DataFrame:
        return layer_table([make(spark) for make in self.layers.values()], tuple(self.floors.items()))


def mentions_refusal(reply: Column) -> Column:
    return tx.contains_any(F.lower(reply), fv.REFUSAL_PHRASES)


def ablation_flags(runs: DataFrame) -> DataFrame:
    """Add json_valid, refusal_correct and confidence to logged runs of prompt variants.

    ``runs`` has uses_schema, out_of_scope, raw, and the recovered answer in ``parsed`` (null
    when the reply is not a valid answer).  Free-text variants count as valid JSON.
    """
    valid = F.col("parsed").isNotNull()
    schema_ok = F.coalesce(valid & (F.col("parsed.is_grounded") != F.col("out_of_scope")), F.lit(False))
    free_ok = ~F.col("out_of_scope") | mentions_refusal(F.col("raw"))
    return runs.withColumns({
        "json_valid": ~F.col("uses_schema") | valid,
        "refusal_correct": F.when(F.col("uses_schema"), schema_ok).otherwise(free_ok),
        "confidence": F.when(F.col("uses_schema") & valid, F.col("parsed.confidence")).otherwise(0.0)})


def ablation_summary(flagged: DataFrame, variant: str = "variant") -> DataFrame:
    return flagged.groupBy(variant).agg(
        F.count(F.lit(1)).alias("runs"),
        F.avg(F.col("json_valid").cast("double")).alias("json_valid_rate"),
        F.avg(F.col("refusal_correct").cast("double")).alias("refusal_correct_rate"),
        F.avg("confidence").alias("avg_confidence"))


def judge_summary(verdicts: DataFrame, keys: list[str] | None = None, score: str = "score") -> DataFrame:
    """Passed (score 3 or more), mean, failed and unscored counts; skipped when nothing was scored."""
    value = F.col(score)
    out = verdicts.groupBy(*(keys or [])).agg(
        F.count(value).alias("total"), F.count_if(value >= 3).alias("passed"),
        F.avg(value.cast("double")).alias("mean_score"),
        F.count_if(value < 3).alias("failed"), F.count_if(value.isNull()).alias("unscored"))
    return out.withColumn("skipped", F.col("total") == 0)
