"""Quality rules with thresholds that adapt to each language and source.

Values of three measures fall into buckets of equal ratio, and the counts per (language, source, measure, bucket) are the
quantile sketches: they merge by addition, hold a bounded number of rows, and give the same quantiles in every run.
Fences around the median replace fixed cutoffs.  Everything is DataFrame expressions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslake.session import cut_lineage

_BLANKS = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"
_WINDOW = 5

#: measure -> whether low values are rejected too
MEASURES = {"word_length": True, "symbols_per_word": False, "duplicate_line_share": False}
#: Documents of fewer words fail the base rules and stay out of the sketches.
LEAST_WORDS = 10
#: Values of a bucket differ by at most this ratio.
RATIO = 1.02
#: Bucket of the value 0; all others are far above.
ZERO = -100_000
#: Thousandths of a group beyond its fence's base; the next is used where one coincides with the median.
TAILS = (100, 50, 10, 1, 0)


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def _repeat_count(words: str, grams: str) -> Column:
    """Words in windows of five that occur twice or more, from the window hashes in column ``grams``."""
    pairs = F.array_sort(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def repeated(s):
        def at(x, j):
            near = lambda k: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
            return F.when(near(j - 1) | near(j + 1), x["i"])
        return F.array_sort(F.array_compact(F.transform(s, at)))

    # Covered words: each repeated window adds what the next one does not cover.
    starts = F.aggregate(F.array(pairs), F.array().cast("array<int>"), lambda _, s: repeated(s))
    return F.aggregate(starts, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-_WINDOW).alias("last")),
                       lambda acc, i: F.struct((acc["n"] + F.least(F.lit(_WINDOW), i - acc["last"])).cast("long").alias("n"),
                                               i.cast("int").alias("last")), lambda acc: acc["n"])


def measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with a struct column ``__q`` of counts, and ``__words`` (the words); a null text has no words."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    trimmed = F.btrim(text, F.lit(_BLANKS))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[ \\t\\n\\x0B\\f\\r]+"))
    lines = F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(_BLANKS)) != "")
    out = docs.withColumn("__words", words).withColumn("__lines", lines)
    n, n_lines = F.size("__words").cast("long"), F.size("__lines")
    dup_lines = n_lines - F.size(F.array_distinct("__lines"))
    return out.withColumn("__q", F.struct(
        n.alias("n_words"), F.length(_without(text, _BLANKS)).cast("long").alias("word_chars"),
        (F.length(text) - F.length(_without(text, _SYMBOLS))).cast("long").alias("n_symbols"),
        dup_lines.cast("long").alias("n_dup_lines"), n_lines.cast("long").alias("n_lines"))).drop("__lines")


def _ratios() -> dict[str, Column]:
    q = F.col("__q")
    per_word = lambda c: F.when(q["n_words"] > 0, q[c] / q["n_words"])
    return {"word_length": per_word("word_chars"), "symbols_per_word": per_word("n_symbols"),
            "duplicate_line_share": F.when(q["n_lines"] > 0, q["n_dup_lines"] / q["n_lines"])}


def _edges(bucket: Column) -> tuple[Column, Column]:
    """Lower and upper end of a bucket, a little apart from its values, which rounding may put on the wrong side."""
    zero = bucket == ZERO
    edge = lambda b, wider: F.when(zero, F.lit(0.0)).otherwise(F.pow(F.lit(RATIO), b) * F.lit(wider))
    return edge(bucket, 1 - 1e-9), edge(bucket + 1, 1 + 1e-9)


def _fences(sketch: DataFrame, keys: list[str], spread: float) -> DataFrame:
    """``(*keys, n, low, high)`` from bucket counts: ``spread`` times the distance from the median to a tail, beyond that tail."""
    group = Window.partitionBy(*keys)
    ranked = sketch.withColumn("upto", F.sum("n").over(group.orderBy("bucket"))).withColumn("all", F.sum("n").over(group))
    at_least = lambda share: F.min(F.when(1000 * F.col("upto") >= share * F.col("all"), F.col("bucket")))
    found = ranked.groupBy(*keys).agg(F.max("all").alias("n"), at_least(500).alias("middle"), *[
        at_least(1000 - t).alias(f"up{t}") for t in TAILS], *[
        F.min(F.when(1000 * F.col("upto") > t * F.col("all"), F.col("bucket"))).alias(f"down{t}") for t in TAILS])
    middle = F.col("middle")
    beyond = lambda side: F.coalesce(*[F.when(F.col(f"{side}{t}") != middle, F.col(f"{side}{t}")) for t in TAILS], middle)
    (low, _), (_, high) = _edges(beyond("down")), _edges(beyond("up"))
    middle_low, middle_high = _edges(middle)
    return found.select(*keys, "n", (low - F.lit(spread) * (middle_low - low)).alias("low"), (high + F.lit(spread) * (high - middle_high)).alias("high"))


def thresholds(docs: DataFrame, text_col: str, lang_col: str, source_col: str, spread: float, prior: float) -> DataFrame:
    """``(__lang, __source, __fences)`` per group: its own fences and its language's, weighed by ``n`` and ``prior`` documents."""
    value = lambda v: F.when(v == 0, F.lit(ZERO)).otherwise(F.floor(F.log(v) / F.lit(math.log(RATIO))).cast("int"))
    rows = measures(docs, text_col).filter(F.col("__q.n_words") >= LEAST_WORDS).select(
        F.col(f"`{lang_col}`").alias("__lang"), F.col(f"`{source_col}`").alias("__source"),
        F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), value(v).alias("bucket")) for m, v in _ratios().items()])).alias("m"))
    counted = rows.filter("m.bucket IS NOT NULL").groupBy("__lang", "__source", "m.measure", "m.bucket").agg(F.count(F.lit(1)).alias("n"))
    sketches = cut_lineage(counted)  # two readers; a task run again finds the same fences
    langs = sketches.groupBy("__lang", "measure", "bucket").agg(F.sum("n").alias("n"))
    own = _fences(sketches, ["__lang", "__source", "measure"], spread).alias("g")
    whole = _fences(langs, ["__lang", "measure"], spread).alias("l")
    both = own.join(whole, F.col("g.__lang").eqNullSafe(F.col("l.__lang")) & (F.col("g.measure") == F.col("l.measure")))
    weight = F.col("g.n") / (F.col("g.n") + F.lit(float(prior)))
    mixed = lambda c: (weight * F.col(f"g.{c}") + (1 - weight) * F.col(f"l.{c}")).alias(c)
    each = both.select(F.col("g.__lang").alias("__lang"), "__source", F.col("g.measure").alias("measure"), mixed("low"), mixed("high"))
    fence = lambda m: F.max(F.when(F.col("measure") == m, F.struct(
        (F.col("low") if MEASURES[m] else F.lit(float("-inf"))).alias("low"), "high"))).alias(m)
    wide = each.groupBy("__lang", "__source").agg(*[fence(m) for m in MEASURES])
    return wide.select("__lang", "__source", F.struct(*MEASURES).alias("__fences"))


def _judged(docs: DataFrame, text_col: str, lang_col: str, source_col: str, spread: float, prior: float) -> DataFrame:
    """``docs`` with the counts and verdicts in the struct ``__verdict``."""
    fences = thresholds(docs, text_col, lang_col, source_col, spread, prior)
    words = F.col("__words")
    grams = F.when(F.size(words) > _WINDOW, F.transform(F.sequence(F.lit(0), F.size(words) - _WINDOW),
                   lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(_WINDOW)]))).otherwise(F.array().cast("array<bigint>"))
    rows = measures(docs, text_col).withColumn("__grams", grams)
    repeats = F.when(F.size(F.array_distinct("__grams")) < F.size("__grams"), _repeat_count("__words", "__grams")).otherwise(F.lit(0).cast("long"))
    # A generator keeps filters on the counts above their computation, which would else be copied into every use.
    counted = rows.withColumn("__repeats", repeats).withColumn("__m", F.explode_outer(F.array(F.struct("__q", "__repeats"))))
    rows = counted.drop("__grams", "__words", "__q", "__repeats").withColumn("__q", F.col("__m.__q"))
    matched = (F.col(f"`{lang_col}`").eqNullSafe(F.col("__lang")) & F.col(f"`{source_col}`").eqNullSafe(F.col("__source")))
    rows = rows.join(fences, matched, "left")
    q, n, repeated = F.col("__q"), F.col("__q.n_words"), F.col("__m.__repeats")
    failed = (n < LEAST_WORDS) | (100 * repeated > 20 * n)
    kept = ~failed
    for m, v in _ratios().items():
        kept = kept & F.coalesce(v.between(F.col("__fences")[m]["low"], F.col("__fences")[m]["high"]), F.lit(True))
    verdict = F.struct(n.alias("n_words"), q["word_chars"].alias("word_chars"), q["n_symbols"].alias("n_symbols"), q["n_dup_lines"].alias("n_dup_lines"),
                       repeated.alias("n_repeat_words"), failed.alias("base_failed"), kept.alias("kept"))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns], verdict.alias("__verdict"))


def quality_rules(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
                  spread: float = 3.0, prior: float = 50.0) -> DataFrame:
    """``docs`` with ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept`` added.

    A document fails the base rules with fewer than 10 words, or with more than a fifth of its words in repeated
    5-word windows.  Otherwise it is kept unless a measure lies beyond its group's fence.  A fence starts at the
    quantile 0.9 (0.1 for low values; 0.95, 0.99, 0.999 or the extreme where that is the median) and lies ``spread`` times
    that quantile's distance from the median further out, so at most a tenth of a sketch lies beyond its own
    fence.  Every group's fence is averaged with its language's, with weights of its documents and of ``prior`` ones.
    Defined cases: a null or empty text has no words and fails the base rules; null languages and sources form groups
    of their own; a group without documents of 10 words has no fences; repeated rows count as often as they occur; an empty table
    gives no rows; columns of the same names as the added ones are replaced.
    """
    rows = _judged(docs, text_col, lang_col, source_col, spread, prior)
    added = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns if c not in added], *[F.col("__verdict")[c].alias(c) for c in added])


def drop_low_quality(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
                     spread: float = 3.0, prior: float = 50.0) -> DataFrame:
    """The rows of ``docs`` that ``quality_rules`` keeps, with their own columns, whatever these are called."""
    return _judged(docs, text_col, lang_col, source_col, spread, prior).filter("__verdict.kept").drop("__verdict")
