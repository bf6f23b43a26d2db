"""Text policy and document work over documents, benchmark, labels and conversations."""

from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions import text as tx
from ..functions.exprs import unnest
from ..operators import documents, evals, policy
from ..operators.crawl import keep_first
from .base import NOT_WORD, bounded, query, r6, re2, sql_any, sql_list, sql_match, sql_text, table

W = r"\p{L}\p{N}_"


def docs(spark, sf_dir, *columns):
    return table(spark, sf_dir, "documents").select("doc_id", "text", *columns)


# --------------------------------------------------------------------- redaction
SQL_RULES = (
    ("ssn", "[SSN]", r"\b\d{3}-\d{2}-\d{4}\b"),
    ("credit_card", "[CREDIT_CARD]", r"\b(?:\d{4}[-\s]?){3}\d{4}\b"),
    ("email", "[EMAIL]", rf"[{W}.+-]+@[{W}-]+\.[{W}.-]+"),
    ("phone", "[PHONE]", r"\+?\d(?:[\s.\-()]?\d){6,}"),
)


def redact_ctes(source: str, text: str, keep: str = "*") -> str:
    """CTEs r0..r4: the text after each rule and the number of matches it replaced."""
    parts = [f"r0 AS (SELECT {keep}, {text} AS t0 FROM {source})"]
    for i, (kind, mark, pattern) in enumerate(SQL_RULES):
        parts.append(
            f"r{i + 1} AS (SELECT *, len(regexp_extract_all(t{i}, {sql_text(pattern)})) AS n_{kind}, "
            f"regexp_replace(t{i}, {sql_text(pattern)}, {sql_text(mark)}, 'g') AS t{i + 1} FROM r{i})")
    return ",\n".join(parts)


MATCHED_SQL = "array_to_string(list_filter([" + ", ".join(
    f"CASE WHEN n_{k} > 0 THEN '{k}' END" for k, _, _ in SQL_RULES) + "], lambda x: x IS NOT NULL), ',')"


@query("redact_pii", f"""
WITH {redact_ctes("documents", "text", "doc_id")}
SELECT doc_id, sha256(t4) AS redacted, {MATCHED_SQL} AS matched FROM r4""")
def redact_pii(spark, sf_dir):
    out = policy.redact(docs(spark, sf_dir), "text")
    return out.select("doc_id", F.sha2("redacted", 256).alias("redacted"), F.array_join("matched", ",").alias("matched"))


@query("pii_counts_by_source", f"""
WITH {redact_ctes("documents", "text", "source")}
SELECT source, count(*) AS docs, {", ".join(f"CAST(sum(n_{k}) AS BIGINT) AS {k}" for k, _, _ in SQL_RULES)} FROM r4 GROUP BY source""")
def pii_counts_by_source(spark, sf_dir):
    out = policy.redact(docs(spark, sf_dir, "source"), "text", counts="found")
    return out.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), *[
        F.sum(f"found.{k}").alias(k) for k, _, _ in fv.REDACTION_RULES])


# ---------------------------------------------------------------------- blocking
def blocked_sql(column: str) -> str:
    return "CASE " + " ".join(f"WHEN {sql_match(column, p, fold)} THEN '{c}'" for p, c, fold in fv.BLOCKED_PATTERNS) + " END"


@query("blocked_category", f"""
SELECT coalesce({blocked_sql("text")}, 'none') AS category, count(*) AS texts
FROM (SELECT text FROM documents UNION ALL SELECT text FROM conversations) GROUP BY 1""")
def blocked_category(spark, sf_dir):
    texts = docs(spark, sf_dir).select("text").unionByName(table(spark, sf_dir, "conversations").select("text"))
    kind = F.coalesce(policy.blocked_category(F.col("text")), F.lit("none"))
    return texts.groupBy(kind.alias("category")).agg(F.count(F.lit(1)).alias("texts"))


POLICY_SQL = f"""
WITH b AS (SELECT doc_id, text, {blocked_sql("text")} AS category FROM documents),
{redact_ctes("b", "text", "doc_id, text, category")},
p AS (SELECT doc_id, CASE WHEN category IS NOT NULL THEN 'block' WHEN t4 <> text THEN 'redact' ELSE 'allow' END AS outcome,
             CASE WHEN category IS NOT NULL THEN text ELSE t4 END AS final_text,
             CASE WHEN category IS NOT NULL THEN ''
                  ELSE array_to_string(list_filter({sql_list(sorted(fv.TOPIC_LEXICON))}, lambda w: contains(lower(t4), w)), ',') END AS topics
      FROM r4)"""


@query("policy_outcome", f"{POLICY_SQL} SELECT doc_id, outcome, sha256(final_text) AS final_text, topics FROM p")
def policy_outcome(spark, sf_dir):
    out = policy.input_policy(docs(spark, sf_dir), "text")
    return out.select("doc_id", "outcome", F.sha2("final_text", 256).alias("final_text"), F.array_join("topics", ",").alias("topics"))


@query("policy_eval", f"""
{POLICY_SQL}
SELECT coalesce(category, 'all') AS category, count(*) AS total, count(*) FILTER (WHERE outcome = expected) AS passed,
       round(avg((outcome = expected)::INT), 6) AS pass_rate
FROM (SELECT CASE WHEN quality = 1 THEN 'good' ELSE 'poor' END AS category,
             CASE WHEN toxic = 1 THEN 'block' ELSE 'allow' END AS expected, outcome FROM labels JOIN p USING (doc_id))
GROUP BY ROLLUP (category)""")
def policy_eval(spark, sf_dir):
    """Labelled documents as policy cases: toxic ones should be blocked."""
    got = policy.input_policy(docs(spark, sf_dir), "text").select(F.col("doc_id").alias("id"), F.col("outcome").alias("got"))
    cases = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, F.lit("good")).otherwise(F.lit("poor")).alias("category"),
        F.when(F.col("toxic") == 1, F.lit("block")).otherwise(F.lit("allow")).alias("expected"))
    out = policy.policy_eval(cases.join(got, "id"))
    return out.select(F.coalesce("category", F.lit("all")).alias("category"), "total", "passed", r6(F.col("pass_rate")).alias("pass_rate"))


# --------------------------------------------------------------------- currency
def _declares(name: str) -> str:
    noun = fv.DECLARING_NOUN
    return rf"(?i){noun}[^.\n]{{0,24}}?(?:\bin\b|\bto\b|:|=|\()\s*{name}"


TOKEN = r"\$|" + bounded("USD|dollars?|us dollars?")


def currency_sql(column: str) -> str:
    def count(pattern: str) -> str:
        return f"len(regexp_extract_all({column}, {sql_text(pattern)}))"

    php, usd = count(_declares(fv.PESO_NAME)), count(_declares(fv.DOLLAR_NAME))
    pesos = f"({count('(?i)' + fv.PESO_STRONG)} + {count('(?i)' + fv.PESO_AMOUNT)})"
    dollars = count("(?i)" + fv.DOLLAR_AMOUNT)
    return (f"CASE WHEN {php} + {usd} > 0 THEN CASE WHEN {php} >= {usd} THEN 'PHP' ELSE 'USD' END "
            f"WHEN {pesos} > 0 AND {pesos} >= {dollars} THEN 'PHP' WHEN {dollars} > 0 THEN 'USD' "
            f"WHEN {sql_match(column, TOKEN)} THEN 'USD' END")


PRICED_SQL = """(SELECT 'doc/' || doc_id AS id, text FROM documents
 UNION ALL SELECT 'page/' || page_id, html FROM pages
 UNION ALL SELECT 'order/' || o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'Total price in PHP: ' || CAST(o_totalprice AS BIGINT)
   WHEN 'O' THEN 'We pay $' || CAST(o_totalprice AS BIGINT) || ' or PHP ' || CAST(o_totalprice AS BIGINT) || ', no ' || o_orderpriority
   ELSE 'About ' || CAST(o_totalprice AS BIGINT) || ' dollars, stack PHP 8.2' END FROM orders)"""


@query("currency_detect", f"SELECT id, coalesce({currency_sql('text')}, 'none') AS currency FROM {PRICED_SQL}")
def currency_detect(spark, sf_dir):
    """Documents, pages and a price sentence per order."""
    d = docs(spark, sf_dir).select(F.concat(F.lit("doc/"), "doc_id").alias("id"), "text")
    p = table(spark, sf_dir, "pages").select(F.concat(F.lit("page/"), "page_id").alias("id"), F.col("html").alias("text"))
    amount = F.round("o_totalprice").cast("long").cast("string")
    said = (F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("Total price in PHP: "), amount))
            .when(F.col("o_orderstatus") == "O", F.concat(F.lit("We pay $"), amount, F.lit(" or PHP "), amount, F.lit(", no "), "o_orderpriority"))
            .otherwise(F.concat(F.lit("About "), amount, F.lit(" dollars, stack PHP 8.2"))))
    o = table(spark, sf_dir, "orders").select(F.concat(F.lit("order/"), "o_orderkey").alias("id"), said.alias("text"))
    every = d.unionByName(p).unionByName(o)
    return every.select("id", F.coalesce(tx.declared_currency(F.col("text")), F.lit("none")).alias("currency"))


# ------------------------------------------------------------------ content words
def words_sql(column: str) -> str:
    return (f"list_filter(list_transform(regexp_extract_all({column}, {sql_text(fv.CONTENT_WORD)}), lambda x: lower(x)), "
            f"lambda x: NOT list_contains({sql_list(fv.STOP_WORDS)}, x))")


@query("content_words", f"""
SELECT doc_id, CAST(len(w) AS BIGINT) AS words, sha256(array_to_string(list_sort(w), ' ')) AS digest
FROM (SELECT doc_id, list_distinct({words_sql("text")}) AS w FROM documents)""")
def content_words(spark, sf_dir):
    out = docs(spark, sf_dir).select("doc_id", tx.content_words(F.col("text")).alias("w"))
    return out.select("doc_id", F.size("w").cast("long").alias("words"),
                      F.sha2(F.array_join(F.sort_array("w"), " "), 256).alias("digest"))


@query("novelty_vs_benchmark", f"""
WITH v AS (SELECT DISTINCT unnest({words_sql("text")}) AS w FROM benchmark),
d AS (SELECT doc_id, unnest(list_distinct({words_sql("text")})) AS w FROM documents)
SELECT x.doc_id, count(d.w) AS words, count(d.w) FILTER (WHERE v.w IS NULL) AS novel_words,
       round(coalesce(count(d.w) FILTER (WHERE v.w IS NULL) / nullif(count(d.w), 0), 0), 6) AS novelty
FROM documents x LEFT JOIN d USING (doc_id) LEFT JOIN v USING (w) GROUP BY x.doc_id""")
def novelty_vs_benchmark(spark, sf_dir):
    """Share of each document's content words that the benchmark never uses.

    The vocabulary is distinct words, so the join adds no rows; AQE broadcasts it when its
    measured size allows and otherwise splits the partitions of very common words.
    """
    vocabulary = unnest(table(spark, sf_dir, "benchmark"), [], tx.content_words(F.col("text")), "w").select(
        "w").distinct().withColumn("known", F.lit(1))
    d = docs(spark, sf_dir).select("doc_id", F.explode_outer(tx.content_words(F.col("text"))).alias("w"))
    out = d.join(vocabulary, "w", "left").groupBy("doc_id").agg(
        F.count("w").alias("words"), F.count_if(F.col("w").isNotNull() & F.col("known").isNull()).alias("novel_words"))
    return out.withColumn("novelty", r6(evals.ratio(F.col("novel_words"), F.col("words"))))


@query("echo_gate", f"""
WITH x AS (SELECT conv_id, turn, text, last_value(CASE WHEN role = 'user' AND text <> '' THEN text END IGNORE NULLS) OVER
             (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS base, role FROM conversations),
w AS (SELECT conv_id, turn, coalesce(base, '') AS base, list_distinct({words_sql("text")}) AS r, {words_sql("coalesce(base, '')")} AS b
      FROM x WHERE role = 'assistant'),
n AS (SELECT *, len(list_filter(r, lambda q: NOT list_contains(b, q))) AS novel FROM w)
SELECT conv_id, turn, CAST(novel AS BIGINT) AS novel_words, round(CASE WHEN len(r) = 0 THEN 0 ELSE novel / len(r) END, 6) AS novelty,
       length(trim(base)) >= 200 AND (CASE WHEN len(r) = 0 THEN 0 ELSE novel / len(r) END) < 0.1 AND novel < 3 AS echo FROM n""")
def echo_gate(spark, sf_dir):
    """Assistant replies that only repeat the user's latest text."""
    from ..operators.dialogue import last_user_turn

    c = last_user_turn(table(spark, sf_dir, "conversations")).filter(F.col("role") == "assistant")
    base = F.coalesce("last_user_text", F.lit(""))
    c = c.withColumns({"base": base, "r": tx.content_words(F.col("text")), "b": tx.content_words(base)})
    c = c.withColumns({"novel_words": F.size(tx.novel_words(F.col("r"), F.col("b"))), "share": tx.novelty(F.col("r"), F.col("b"))})
    return c.select("conv_id", "turn", F.col("novel_words").cast("long").alias("novel_words"), r6(F.col("share")).alias("novelty"),
                    tx.is_echo(F.col("base"), F.col("share"), F.col("novel_words")).alias("echo"))


@query("claim_grounding", f"""
WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS claim, {words_sql("string_split(text, chr(10))[1]")} AS brief FROM documents),
g AS (SELECT source, len(list_intersect({words_sql("claim")}, brief)) > 0 AS grounded FROM l WHERE trim(claim) <> '')
SELECT source AS file, count(*) AS total, count(*) FILTER (WHERE grounded) AS grounded, round(avg(grounded::INT), 6) AS rate
FROM g GROUP BY source""")
def claim_grounding(spark, sf_dir):
    """Every line of a document as a claim against its opening line."""
    lines = F.split("text", "\n")
    d = docs(spark, sf_dir, "source").select(
        "source", tx.content_words(F.element_at(lines, 1)).alias("brief_words"), lines.alias("lines"))
    d = unnest(d, ["source", "brief_words"], F.col("lines"))
    out = evals.claim_summary(evals.claim_grounding(d), ["source"])
    return out.select(F.col("source").alias("file"), "total", "grounded", r6(F.col("rate")).alias("rate"))


@query("page_recall", f"""
WITH w AS (SELECT i.item_id, list_distinct({words_sql("i.text")}) AS truth, {words_sql("d.text")} AS got
           FROM benchmark i JOIN documents d ON d.doc_id = i.item_id)
SELECT item_id, round(CASE WHEN len(truth) = 0 THEN 0 ELSE len(list_intersect(truth, got)) / len(truth) END, 6) AS recall FROM w""")
def page_recall(spark, sf_dir):
    """Benchmark passages as truth, the document of the same number as the transcription."""
    truth = table(spark, sf_dir, "benchmark").select("item_id", tx.content_words(F.col("text")).alias("truth"))
    read = docs(spark, sf_dir).select(F.col("doc_id").alias("item_id"), "text")
    both = truth.join(read, "item_id").withColumn("got", tx.content_words(F.col("text")))
    return both.select("item_id", r6(evals.page_recall(F.col("truth"), F.col("got"))).alias("recall"))


# ------------------------------------------------------------------- text passes
LEAD = fv.RESTATEMENT


@query("sentence_dedupe", f"""
WITH s AS (SELECT doc_id, generate_subscripts(p, 1) AS pos, unnest(p) AS s FROM (
    SELECT doc_id, string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS p FROM documents)),
k AS (SELECT *, trim(regexp_replace(lower(regexp_replace(trim(trim(trim(s, ' ' || chr(10)), '<>'), ' ' || chr(10)), {sql_text("(?i)" + LEAD)}, '')),
             '[^a-z0-9 ]+', '', 'g')) AS key FROM s),
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, key ORDER BY pos) AS n FROM k WHERE key <> '')
SELECT d.doc_id, coalesce(count(f.s), 0) AS sentences,
       sha256(coalesce(string_agg(regexp_replace(trim(s, ' ' || chr(10)), {sql_text("(?i)" + LEAD)}, ''), ' ' ORDER BY pos), '')) AS digest
FROM documents d LEFT JOIN f ON f.doc_id = d.doc_id AND n = 1 GROUP BY d.doc_id""")
def sentence_dedupe(spark, sf_dir):
    d = docs(spark, sf_dir)
    parts = F.split("text", rf"(?<=[.!?]){tx.SPACE}+")
    entries = F.transform(parts, lambda s, i: F.struct(
        tx.sentence_key(s).alias("key"), i.alias("pos"), F.regexp_replace(tx.strip(s), tx.I + LEAD, "").alias("text")))
    d = d.withColumn("kept", tx.keep_first_by_key(F.filter(entries, lambda e: e["key"] != ""), ["text"]))
    return d.select("doc_id", F.size("kept").cast("long").alias("sentences"),
                    F.sha2(F.array_join(F.transform("kept", lambda e: e["text"]), " "), 256).alias("digest"))


@query("text_metrics_share", """
WITH m AS (SELECT doc_id, lang, CASE WHEN text = '' THEN 0 ELSE len(string_split(text, chr(10))) - (right(text, 1) = chr(10))::INT END AS lines,
                  len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS words, length(text) AS characters,
                  length(text) // 4 AS tokens FROM documents)
SELECT doc_id, CAST(lines AS BIGINT) AS lines, CAST(words AS BIGINT) AS words, CAST(characters AS BIGINT) AS characters,
       round(CASE WHEN words = 0 THEN 0 ELSE tokens / words END, 6) AS tokens_per_word,
       round(tokens * 100.0 / (SELECT sum(tokens) FROM m), 6) AS share_pct FROM m""")
def text_metrics_share(spark, sf_dir):
    d = docs(spark, sf_dir).withColumn("tokens", documents.rough_tokens(F.col("text")))
    m = documents.token_shares(documents.text_metrics(d).drop("text"))
    return m.select("doc_id", *[F.col(c).cast("long").alias(c) for c in ("lines", "words", "characters")],
                    r6(F.col("tokens_per_word")).alias("tokens_per_word"), r6(F.col("share_pct")).alias("share_pct"))


@query("token_summary", """
SELECT lang, count(*) AS total_files, CAST(sum(words) AS BIGINT) AS total_words, CAST(sum(characters) AS BIGINT) AS total_characters,
       CAST(sum(tokens) AS BIGINT) AS total_tokens, round(sum(tokens) / sum(words), 6) AS avg_tokens_per_word
FROM (SELECT lang, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS words, length(text) AS characters,
             length(text) // 4 AS tokens FROM documents) GROUP BY lang""")
def token_summary(spark, sf_dir):
    d = docs(spark, sf_dir, "lang").withColumn("tokens", documents.rough_tokens(F.col("text")))
    out = documents.token_summary(documents.text_metrics(d), ["lang"])
    return out.select("lang", "total_files", *[F.col(c).cast("long").alias(c) for c in ("total_words", "total_characters", "total_tokens")],
                      r6(F.col("avg_tokens_per_word")).alias("avg_tokens_per_word"))


MARKED_SQL = "'# ' || replace(text, chr(10), chr(10) || '## ')"


@query("heading_clamp", f"""
SELECT doc_id, sha256(regexp_replace(regexp_replace({MARKED_SQL}, '(?m)^##?$', '###', 'g'), '(?m)^##?(\\s)', '###\\1', 'g')) AS digest
FROM documents""")
def heading_clamp(spark, sf_dir):
    """Documents with every line made a shallow heading."""
    marked = F.concat(F.lit("# "), F.replace("text", F.lit("\n"), F.lit("\n## ")))
    return docs(spark, sf_dir).select("doc_id", F.sha2(tx.clamp_headings(marked), 256).alias("digest"))


LINES_SQL = """
l AS (SELECT doc_id, generate_subscripts(p, 1) - 1 AS pos, unnest(p) AS line FROM (
        SELECT doc_id, string_split(text, chr(10)) AS p FROM documents))"""


def paged(spark, sf_dir):
    """Documents with a page heading before each line."""
    lines = F.transform(F.split("text", "\n"), lambda t, i: F.concat(F.lit("## Page "), (i + 1).cast("string"), F.lit("\n"), t))
    return docs(spark, sf_dir).select(F.col("doc_id").alias("doc"), F.array_join(lines, "\n").alias("text"))


@query("page_groups", f"""
WITH {LINES_SQL}
SELECT doc_id AS doc, CAST(pos // 5 AS BIGINT) AS "group", CAST(min(pos) + 1 AS BIGINT) AS first_page, CAST(max(pos) + 1 AS BIGINT) AS last_page,
       sha256(string_agg(trim('## Page ' || (pos + 1) || chr(10) || line, ' ' || chr(10) || chr(9) || chr(13)), chr(10) || chr(10) ORDER BY pos)) AS digest
FROM l GROUP BY doc_id, pos // 5""")
def page_groups(spark, sf_dir):
    out = documents.group_pages(documents.split_pages(paged(spark, sf_dir)))
    return out.select("doc", "group", F.col("first_page").cast("long").alias("first_page"),
                      F.col("last_page").cast("long").alias("last_page"), F.sha2("text", 256).alias("digest"))


def unusable_sql(column: str) -> str:
    refusal = bounded(fv.REFUSAL.removeprefix(r"\b(").removesuffix(r")\b"))
    return (f"CASE WHEN trim({column}, ' ' || chr(9) || chr(10) || chr(13)) = '' THEN 'empty response' WHEN {sql_match(column, refusal)} THEN 'refusal' "
            f"WHEN length(trim({column}, ' ' || chr(9) || chr(10) || chr(13))) < 20 THEN 'response too short to be a transcription' END")


@query("page_accounting", f"""
WITH {LINES_SQL}, p AS (SELECT *, {unusable_sql("line")} IS NOT NULL AS failed, regexp_matches(line, '[0-9]') AS vision FROM l)
SELECT doc_id AS doc, count(*) FILTER (WHERE NOT failed) AS pages_parsed,
       coalesce(string_agg(CASE WHEN failed THEN CAST(pos + 1 AS VARCHAR) END, ',' ORDER BY pos), '') AS pages_failed,
       count(*) FILTER (WHERE vision) AS pages_via_vision, CAST(sum(length(line)) AS BIGINT) AS total_tokens FROM p GROUP BY doc_id""")
def page_accounting(spark, sf_dir):
    """Each line as a page; unusable lines failed, lines with digits came through vision."""
    lines = unnest(docs(spark, sf_dir), [F.col("doc_id").alias("doc")], F.split("text", "\n"), "line")
    n = F.length("line")
    pages = lines.select("doc", (F.col("pos") + 1).alias("page"), tx.unusable_reason(F.col("line")).isNotNull().alias("failed"),
                         F.when(F.col("line").rlike("[0-9]"), F.lit("vision")).otherwise(F.lit("text")).alias("source"),
                         F.lit(None).cast("int").alias("pages_total"),
                         F.struct(F.lit(None).cast("int").alias("prompt_tokens"), n.alias("completion_tokens"), n.alias("total_tokens")).alias("usage"))
    out = documents.page_accounting(pages)
    return out.select("doc", "pages_parsed", F.array_join(F.transform("pages_failed", lambda p: p.cast("string")), ",").alias("pages_failed"),
                      "pages_via_vision", "total_tokens")


@query("unusable_replies", f"""
SELECT coalesce({unusable_sql("text")}, 'usable') AS reason, count(*) AS replies FROM conversations GROUP BY 1""")
def unusable_replies(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    reason = F.coalesce(tx.unusable_reason(F.col("text")), F.lit("usable"))
    return c.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("replies"))


@query("keyword_excerpts")
def keyword_excerpts(spark, sf_dir):
    """Excerpts around the most frequent word of each document's language, over whole texts."""
    needle = F.create_map(*[F.lit(x) for pair in (("en", "the"), ("fr", "elle"), ("de", "und"), ("es", "para")) for x in pair])
    d = paged(spark, sf_dir).join(docs(spark, sf_dir, "lang").select(F.col("doc_id").alias("doc"), "lang"), "doc")
    d = d.withColumn("needle", F.coalesce(F.try_element_at(needle, F.col("lang")), F.lit("a")))
    out = documents.excerpts(d, "text", "needle")
    return out.select("doc", "excerpt", "start", "end", "page_label", F.sha2("excerpt_text", 256).alias("digest"))


@query("name_suggestions", r"""
WITH t AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
c AS (SELECT doc_id, pos, trim(trim(trim(string_split(regexp_replace(line, '[*_`~#]', '', 'g'), '|')[1], ' ' || chr(9)), '.,;:'), ' ' || chr(9)) AS name,
             regexp_matches(line, '[^ \t]') AS filled FROM t),
g AS (SELECT * FROM c WHERE filled AND length(name) BETWEEN 2 AND 80 AND regexp_matches(name, '\p{L}')
      AND lower(name) NOT IN ('tbd', 'tba', 'n/a', 'na', 'none', 'unknown', 'xxx', 'todo', 'client', 'customer', 'project', 'insert name here'))
SELECT d.doc_id, coalesce(arg_min(g.name, g.pos), '') AS client_name FROM documents d LEFT JOIN g USING (doc_id) GROUP BY d.doc_id""")
def name_suggestions(spark, sf_dir):
    """Documents whose lines carry a client label; the first usable value is suggested."""
    labelled = F.concat(F.lit("Client: "), F.replace("text", F.lit("\n"), F.lit("\nClient: ")))
    return docs(spark, sf_dir).select("doc_id", F.coalesce(tx.suggest_client(labelled), F.lit("")).alias("client_name"))


# ------------------------------------------------------------ relevance and dedupe
def relevance_sql(column: str) -> str:
    sample = column
    low = f"lower({sample})"
    bio = sql_match(sample, fv.BIO_MARKERS)
    patterns = dict(fv.IRRELEVANT_DOCUMENT_PATTERNS)
    return (f"CASE WHEN trim({column}) = '' THEN NULL WHEN {sql_match(sample, fv.BRIEF_MARKERS)} AND NOT ({bio} AND contains({low}, 'resume')) THEN NULL "
            f"WHEN {sql_match(sample, patterns['resume'])} AND ({bio} OR (contains({low}, 'education') AND contains({low}, 'experience'))) THEN 'resume' "
            f"WHEN {sql_match(sample, patterns['academic_essay'])} THEN 'academic_essay' "
            f"WHEN {sql_match(sample, patterns['homework_assignment'])} THEN 'homework_assignment' END")


FLAVOUR_SQL = """CASE source WHEN 'src1' THEN 'Work experience. Education. ' WHEN 'src2' THEN 'Scope of work: ' WHEN 'src3' THEN 'Homework #2 '
 WHEN 'src4' THEN 'Term paper, student id 7. ' ELSE '' END || text"""


@query("doc_relevance", f"""
SELECT doc_id, coalesce({relevance_sql("t")}, 'pass') AS verdict FROM (SELECT doc_id, {FLAVOUR_SQL} AS t FROM documents)""")
def doc_relevance(spark, sf_dir):
    """Documents, each behind an opening that depends on its source."""
    source = F.col("source")
    opening = (F.when(source == "src1", "Work experience. Education. ").when(source == "src2", "Scope of work: ")
               .when(source == "src3", "Homework #2 ").when(source == "src4", "Term paper, student id 7. ").otherwise(""))
    d = docs(spark, sf_dir, "source").withColumn("t", F.concat(opening, "text"))
    return d.select("doc_id", F.coalesce(policy.document_relevance(F.col("t")), F.lit("pass")).alias("verdict"))


@query("dedupe_keep_first", """
SELECT doc_id, source, copies FROM (
  SELECT doc_id, source, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS n, count(*) OVER (PARTITION BY sha256(text)) AS copies
  FROM documents) WHERE n = 1""")
def dedupe_keep_first(spark, sf_dir):
    d = docs(spark, sf_dir, "source").withColumn("sha", F.sha2("text", 256)).drop("text")
    first = keep_first(d, ["sha"], ["doc_id"])
    return first.join(d.groupBy("sha").agg(F.count(F.lit(1)).alias("copies")), "sha").select("doc_id", "source", "copies")


JUDGE_SQL = """s AS (SELECT source, CASE WHEN quality = 1 AND toxic = 0 THEN 5 WHEN quality = 1 THEN 3 WHEN toxic = 0 THEN 2 END AS score
           FROM documents JOIN labels USING (doc_id))"""


@query("judge_summary", f"""
WITH {JUDGE_SQL}
SELECT source, count(score) AS total, count(*) FILTER (WHERE score >= 3) AS passed, round(coalesce(avg(score), -1), 6) AS mean_score,
       count(*) FILTER (WHERE score < 3) AS failed, count(*) FILTER (WHERE score IS NULL) AS unscored, count(score) = 0 AS skipped
FROM s GROUP BY source""")
def judge_summary(spark, sf_dir):
    """The judge's scores summarised per source."""
    out = evals.judge_summary(judged(spark, sf_dir), ["source"])
    return out.withColumn("mean_score", r6(F.coalesce("mean_score", F.lit(-1.0))))


def judged(spark, sf_dir):
    """Judge replies written from the labels, with the score recovered from their JSON."""
    from ..operators.dialogue import recover_verdicts

    good, toxic = F.col("quality") == 1, F.col("toxic") == 1
    raw = (F.when(good & ~toxic, F.lit('Fine {really}.\n{"score": 5, "rationale": "a {b} c"}'))
           .when(good, F.lit('{"score": 1} then {"score": 3, "rationale": "ok"}'))
           .when(~toxic, F.lit('```json\n{"rationale": "weak", "score": 2}\n```')).otherwise(F.lit('{"score": true}')))
    rows = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    return recover_verdicts(rows.withColumn("raw", raw), "raw").withColumn("score", F.col("verdict.score"))
