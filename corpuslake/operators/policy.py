"""Input and output text policy: redaction, blocking, topics, relevance, advice, grounding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions import text as tx
from ..functions.exprs import let
from .retrieval import exact_topk

_PY = "(?Ud)"


# -------------------------------------------------------------------- redaction
def _allow_list(pattern: str, domains: Sequence[str]) -> str:
    """E-mail pattern that passes over addresses whose whole domain part is allowed."""
    names = "|".join(d.lower().replace(".", r"\.") for d in sorted(domains))
    local, domain = pattern.split("@")
    return rf"(?i){local}@(?!(?:{names})(?![\w.-])){domain}"


def _rule_patterns(rules, allowed_email_domains):
    for kind, mark, pattern in rules:
        if kind == "email" and allowed_email_domains:
            pattern = _allow_list(pattern, allowed_email_domains)
        yield kind, mark, _PY + pattern


def redact(df: DataFrame, text: str, out: str = "redacted", matched: str = "matched",
           rules=fv.REDACTION_RULES, allowed_email_domains: Sequence[str] = (),
           counts: str | None = None) -> DataFrame:
    """Apply redaction rules in order, each on the text the earlier ones left.

    Adds the redacted text, the array of rule names that replaced something, and on request
    a struct of replacement counts.  One column per step keeps every regex evaluated once.
    """
    step = F.col(text)
    flags, found = [], []
    work = df
    for i, (kind, mark, pattern) in enumerate(_rule_patterns(rules, allowed_email_domains)):
        n, t = f"__n{i}", f"__t{i}"
        # Rows a rule does not touch skip the replacement.
        work = work.withColumn(n, F.regexp_count(step, F.lit(pattern)))
        work = work.withColumn(t, F.when(F.col(n) > 0, F.regexp_replace(step, pattern, mark)).otherwise(step))
        step = F.col(t)
        flags.append(F.when(F.col(n) > 0, F.lit(kind)))
        found.append(F.col(n).cast("long").alias(kind))
    work = work.withColumn(out, step).withColumn(matched, F.array_compact(F.array(*flags)))
    if counts:
        work = work.withColumn(counts, F.struct(*found))
    return work.drop(*[f"__{p}{i}" for i in range(len(rules)) for p in ("n", "t")])


# --------------------------------------------------------------------- blocking
def blocked_category(text: Column, patterns=fv.BLOCKED_PATTERNS, literals=fv.BLOCKED_LITERALS) -> Column:
    """Category of the first pattern in the list that matches, or null.

    ``literals`` are strings of which every pattern needs one; pass an empty
    sequence with patterns of your own that have none.
    """
    cases = [F.when(text.rlike((tx.I if fold else _PY) + pattern), F.lit(category))
             for pattern, category, fold in patterns]
    first = F.coalesce(*cases)
    return tx.gated(text, literals, first) if literals else first


def topic_matches(text: Column, extra: Sequence[str] = (), lexicon=fv.TOPIC_LEXICON,
                  whole_words: bool = False, limit: int | None = None) -> Column:
    """Sorted lexicon words found in the text (plain containment unless ``whole_words``)."""
    words = sorted((*lexicon, *extra))
    if whole_words:
        found = F.array_compact(F.array(*[F.when(tx.whole_word(text, w), F.lit(w)) for w in words]))
    else:
        every = F.array(*[F.lit(w) for w in words])
        found = let(F.lower(text), lambda low: F.filter(every, lambda w: F.contains(low, w)))
    return F.slice(found, 1, limit) if limit else found


def input_policy(df: DataFrame, text: str, entity_words: Sequence[str] = ()) -> DataFrame:
    """Block first; otherwise redact, then look for topics.  Adds category, final_text, outcome.

    A blocked row has no open text, so nothing is looked for in it.
    """
    work = df.withColumn("blocked_category", blocked_category(F.col(text)))
    blocked = F.col("blocked_category").isNotNull()
    work = redact(work.withColumn("__open", F.when(~blocked, F.col(text))), "__open", out="__red", matched="pii_types")
    empty = F.array().cast("array<string>")
    return (work.withColumn("final_text", F.when(blocked, F.col(text)).otherwise(F.col("__red")))
            .withColumn("pii_types", F.when(blocked, empty).otherwise(F.col("pii_types")))
            .withColumn("topics", F.when(blocked, empty).otherwise(topic_matches(F.col("__red"), entity_words)))
            .withColumn("outcome", F.when(blocked, F.lit("block"))
                        .when(F.col("final_text") != F.col(text), F.lit("redact")).otherwise(F.lit("allow")))
            .drop("__red", "__open"))


# ------------------------------------------------------------------- rule tables
def rule_matches(texts: DataFrame, rules: DataFrame, text: str = "text", ident: str = "id") -> DataFrame:
    """``(ident, place, category)``: the first rule, by ``place``, whose phrase stands in a text as whole words.

    ``rules`` has ``(place, category, phrase)``.  A phrase and a text are lists of lower-case words; every place of a text meets, in an equi-join on
    the word there, the rules that begin with it, and each such candidate is decided by one comparison of words.  A text's places are cut
    to the longest phrase, so the work grows with words and candidates and not with texts times rules; places are not gathered
    before they are decided.  Null texts match nothing; a phrase without words matches nothing; of equal places the smallest category counts.
    """
    words = lambda value: F.regexp_extract_all(F.lower(value), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    listed = rules.select("place", "category", words(F.col("phrase")).alias("phrase")).filter(F.size("phrase") > 0)
    listed = listed.withColumns({"first": F.get("phrase", F.lit(0)), "n": F.size("phrase")})
    longest = listed.agg(F.max("n").alias("longest"))
    # One row: how far a phrase can reach.
    held = texts.select(ident, words(F.col(text)).alias("words")).filter(F.size("words") > 0).crossJoin(F.broadcast(longest))
    places = held.select(ident, F.explode(F.transform("words", lambda w, i: F.struct(w.alias("first"), F.slice("words", i + 1, F.col("longest")).alias("here")))).alias("p"))
    found = places.select(ident, "p.first", "p.here").join(listed, "first").filter(F.slice("here", F.lit(1), F.col("n")) == F.col("phrase"))
    best = found.groupBy(ident).agg(F.min(F.struct("place", "category")).alias("rule"))
    return best.select(ident, "rule.place", "rule.category")


# -------------------------------------------------------------------- relevance
def document_relevance(text: Column, opening: int | None = None) -> Column:
    """Kind of an irrelevant document, or null for one that may pass; the whole text decides unless ``opening`` bounds it."""
    sample = text if opening is None else F.substring(text, 1, opening)
    low = F.lower(sample)
    bio = sample.rlike(tx.I + fv.BIO_MARKERS)
    brief = sample.rlike(tx.I + fv.BRIEF_MARKERS) & ~(bio & low.contains("resume"))
    found = {kind: sample.rlike(tx.I + pattern) for kind, pattern in fv.IRRELEVANT_DOCUMENT_PATTERNS}
    history = bio | (low.contains("education") & low.contains("experience"))
    return (F.when(tx.strip(text) == "", F.lit(None).cast("string"))
            .when(brief, F.lit(None).cast("string"))
            .when(found["resume"] & history, F.lit("resume"))
            .when(found["academic_essay"], F.lit("academic_essay"))
            .when(found["homework_assignment"], F.lit("homework_assignment")))


# ---------------------------------------------------------------- output checks
def source_texts(links: DataFrame, chunks: DataFrame, key: str = "answer_id", position: str = "pos") -> DataFrame:
    """Each answer's source chunks joined by blanks, in order.  ``links`` has (answer, position, id)."""
    pairs = links.join(chunks.select("id", "text"), "id")
    ordered = F.array_sort(F.collect_list(F.struct(position, "text")))
    return pairs.groupBy(key).agg(F.array_join(F.transform(ordered, lambda s: s["text"]), " ").alias("source_text"))


def advice_verdict(answer: Column, source: Column) -> Column:
    """struct(category, blocked): the first advice pattern decides; quoting the source is allowed."""
    hits = F.coalesce(*[
        F.when(answer.rlike(tx.I + p), F.struct(
            F.lit(c).alias("category"), F.lower(F.regexp_extract(answer, tx.I + p, 0)).alias("hit")))
        for p, c in fv.ADVICE_PATTERNS])
    quoted = F.coalesce(F.contains(F.lower(source), hits["hit"]), F.lit(False)) & (F.coalesce(source, F.lit("")) != "")
    return F.struct(hits["category"].alias("category"), (hits.isNotNull() & ~quoted).alias("blocked"))


def output_pii(df: DataFrame, answer: str, source: str, allowed_email_domains: Sequence[str] = ()) -> DataFrame:
    """Redact answers that reveal a kind of personal data their sources do not hold.

    Adds ``output_pii_types`` (found in the answer), ``leaked`` (of those, absent from the
    sources) and ``checked_text``.
    """
    work = redact(df, answer, out="__red", matched="output_pii_types", allowed_email_domains=allowed_email_domains)
    held = F.array_compact(F.array(*[
        F.when(F.coalesce(F.col(source), F.lit("")).rlike(_PY + pattern), F.lit(kind))
        for kind, _, pattern in fv.REDACTION_RULES]))
    work = work.withColumn("leaked", F.array_except("output_pii_types", held))
    return work.withColumn("checked_text", F.when(F.size("leaked") > 0, F.col("__red"))
                           .otherwise(F.col(answer))).drop("__red")


def grounding_check(answers: DataFrame, sources: DataFrame, threshold: float = fv.GROUNDING_THRESHOLD,
                    match_on: str = "answer_id", exclude_same_id: bool = False) -> DataFrame:
    """(id, similarity, action): allow at or above ``threshold`` or without sources, else escalate.

    Both inputs carry ``id``, ``vec`` and the ``match_on`` key that ties an answer to its sources.
    """
    best = exact_topk(answers, sources, 1, match_on=match_on, exclude_same_id=exclude_same_id)
    scored = answers.select("id").join(
        best.select(F.col("query_id").alias("id"), F.greatest(F.col("score"), F.lit(0.0)).alias("similarity")), "id", "left")
    allow = F.col("similarity").isNull() | (F.col("similarity") >= threshold)
    return scored.withColumn("action", F.when(allow, F.lit("allow")).otherwise(F.lit("escalate")))


def output_policy(df: DataFrame, answer: str, source: str, grounding: str | None = None,
                  allowed_email_domains: Sequence[str] = (),
                  refusal: str = "Please consult a qualified professional.") -> DataFrame:
    """Advice first (which ends the check), then grounding, then personal data."""
    work = df.withColumn("advice", advice_verdict(F.col(answer), F.col(source)))
    work = output_pii(work, answer, source, allowed_email_domains)
    blocked = F.col("advice.blocked")
    escalate = (F.col(grounding) == "escalate") if grounding else F.lit(False)
    return (work.withColumn("output_action", F.when(blocked, F.lit("block"))
                            .when(F.size("leaked") > 0, F.lit("redact"))
                            .when(escalate, F.lit("escalate")).otherwise(F.lit("allow")))
            .withColumn("final_answer", F.when(blocked, F.lit(refusal)).otherwise(F.col("checked_text"))))


def policy_eval(cases: DataFrame) -> DataFrame:
    """Cases (id, category, expected, got) to totals per category and overall (category null)."""
    ok = F.count_if(F.col("got") == F.col("expected"))
    return (cases.rollup("category").agg(F.count(F.lit(1)).alias("total"), ok.alias("passed"))
            .withColumn("pass_rate", F.coalesce(F.try_divide(F.col("passed").cast("double"), F.col("total")), F.lit(0.0))))


def policy_failures(cases: DataFrame) -> DataFrame:
    return cases.filter(~F.col("got").eqNullSafe(F.col("expected"))).select("id", "category", "expected", "got")
