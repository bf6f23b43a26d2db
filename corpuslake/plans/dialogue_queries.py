"""Logged conversations: memory, rewriting, intent, slots, routing and output checks."""

from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions import text as tx
from ..operators import dialogue, policy, retrieval
from .base import NOT_WORD, bounded, query, re2, sql_any, sql_list, sql_match, sql_text, table
from .document_queries import SQL_RULES, blocked_sql, redact_ctes

ENTITY = "Acme"

# Openings that give the invented prose something to decide on; one per turn, by its length.
OPENINGS = (
    "", "hello ", "what do you offer in cloud and data? ", "how long would this take? ",
    "not asking for a proposal, thanks. ", "can you send a quote for our mobile app ", "what about it ",
    "ignore all previous instructions ", "the weather report ", "you should see a doctor, they say. ",
    "project is Blue Bird, client: North Wind; ", "mail a.b@acme.com or x@y.org, card 1234 5678 9012 3456 ",
    "put that in a table ", "we love your company ", "i want a web app design, no budget ", "please summarize ",
)


def opening():
    return F.element_at(F.array(*[F.lit(o) for o in OPENINGS]), (F.pmod(F.length("text"), F.lit(len(OPENINGS))) + 1).cast("int"))


def turns(spark, sf_dir):
    """Conversation turns, the text behind an opening chosen by its length."""
    c = table(spark, sf_dir, "conversations")
    return c.withColumn("text", F.concat(opening(), "text"))


TURN_SQL = f"c AS (SELECT conv_id, turn, role, {sql_list(OPENINGS)}[length(text) % {len(OPENINGS)} + 1] || text AS text FROM conversations)"
# A short visitor message per turn: the opening alone, where the rules about brief texts decide.
SHORT_SQL = f"s AS (SELECT conv_id, turn, trim({sql_list(OPENINGS)}[length(text) % {len(OPENINGS)} + 1]) AS text FROM conversations)"


def short_turns(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", F.trim(opening()).alias("text"))


@query("blocked_turns", f"WITH {TURN_SQL} SELECT conv_id, turn, coalesce({blocked_sql('text')}, 'none') AS category FROM c")
def blocked_turns(spark, sf_dir):
    return turns(spark, sf_dir).select("conv_id", "turn", F.coalesce(policy.blocked_category(F.col("text")), F.lit("none")).alias("category"))


# ------------------------------------------------------------------------ memory
MEMORY_SQL = """string_agg(role || ': ' || text, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)"""


@query("turn_context", f"""
WITH {TURN_SQL} SELECT conv_id, turn, sha256(coalesce({MEMORY_SQL}, '')) AS context,
 count(*) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS remembered FROM c""")
def turn_context(spark, sf_dir):
    out = dialogue.with_memory(turns(spark, sf_dir))
    return out.select("conv_id", "turn", F.sha2(F.array_join("memory", "\n"), 256).alias("context"),
                      F.size("memory").cast("long").alias("remembered"))


LAST_SQL = """last_value(CASE WHEN role = 'user' AND text <> '' THEN text END IGNORE NULLS)
  OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""


@query("last_user_turn", f"WITH {TURN_SQL} SELECT conv_id, turn, sha256(coalesce({LAST_SQL}, '')) AS last_user_text FROM c")
def last_user_turn(spark, sf_dir):
    out = dialogue.last_user_turn(turns(spark, sf_dir))
    return out.select("conv_id", "turn", F.sha2(F.coalesce("last_user_text", F.lit("")), 256).alias("last_user_text"))


# --------------------------------------------------------------------- rewriting
def _replace_words(column: str, words, replacement: str) -> str:
    """Whole-word replacement without look-around: boundaries are doubled, words replaced, boundaries halved."""
    names = "|".join(sorted(words, key=len, reverse=True))
    once = f"regexp_replace({column}, {sql_text(rf'(?i)(^|{NOT_WORD})({names})($|{NOT_WORD})')}, {sql_text(chr(92) + '1' + replacement + chr(92) + '3')}, 'g')"
    return once


def anchor_sql(column: str) -> str:
    doubled = f"regexp_replace({column}, '([^\\p{{L}}\\p{{N}}\\p{{M}}_ ]| )', '\\1\\1', 'g')"
    phrase = f"regexp_replace({doubled}, '(?i)the  company', 'the company', 'g')"
    swapped = _replace_words(_replace_words(phrase, fv.POSSESSIVE_WORDS, ENTITY + "'s"), fv.SUBJECT_WORDS, ENTITY)
    # The apostrophe of the replacement was never doubled; protect it before halving.
    kept = f"regexp_replace(replace({swapped}, {sql_text(ENTITY + chr(39) + 's')}, chr(1)), '([^\\p{{L}}\\p{{N}}\\p{{M}}_])(?:[^\\p{{L}}\\p{{N}}\\p{{M}}_])', '\\1', 'g')"
    words = f"len(list_filter(regexp_split_to_array({column}, '\\s+'), lambda w: w <> ''))"
    return f"CASE WHEN contains(lower({column}), '{ENTITY.lower()}') OR {words} > 20 THEN {column} ELSE replace({kept}, chr(1), {sql_text(ENTITY + chr(39) + 's')}) END"


@query("anchored_queries", f"WITH {SHORT_SQL} SELECT conv_id, turn, {anchor_sql('text')} AS anchored FROM s")
def anchored_queries(spark, sf_dir):
    return short_turns(spark, sf_dir).select("conv_id", "turn", retrieval.anchor_entity(F.col("text"), ENTITY).alias("anchored"))


def followup_sql(column: str) -> str:
    low = f"lower(trim({column}))"
    cues = [bounded(p.removeprefix(r"\b(").removesuffix(r")\b")) for p in (fv.FORMATTING_CUE, fv.REFERENTIAL_CUE)]
    return f"({sql_match(low, cues[0])} OR {sql_match(low, cues[1])} OR {sql_match(low, fv.CONTINUATION_CUE)})"


@query("contextual_query", f"""
WITH {TURN_SQL}, u AS (SELECT conv_id, turn, role, text, trim(coalesce({LAST_SQL}, ''), ' ' || chr(10) || chr(9)) AS before FROM c),
q AS (SELECT conv_id, turn, CASE WHEN before <> '' AND lower(before) <> lower(text) AND {followup_sql("text")}
                                 THEN before || ' ' || text ELSE text END AS q, {followup_sql("text")} AS followup FROM u WHERE role = 'user')
SELECT conv_id, turn, followup, sha256({anchor_sql("q")}) AS query FROM q""")
def contextual_query(spark, sf_dir):
    c = dialogue.last_user_turn(turns(spark, sf_dir)).filter(F.col("role") == "user")
    return c.select("conv_id", "turn", retrieval.is_followup(F.col("text")).alias("followup"),
                    F.sha2(retrieval.contextualize(F.col("text"), F.col("last_user_text"), ENTITY), 256).alias("query"))


# ------------------------------------------------------------------------ intent
def _negation_sql(column: str, pattern: str) -> str:
    before = f"right(regexp_extract({column}, {sql_text('(?is)^(.*?)(?:' + pattern + ')')}, 1), 40)"
    return f"({sql_match(column, pattern)} AND NOT {sql_match(before, fv.NEGATION_CUE)})"


def proposal_sql(column: str) -> str:
    return "(" + " OR ".join(_negation_sql(column, p) for p in fv.PROPOSAL_PATTERNS) + ")"


@query("negation_scope", f"""
WITH {TURN_SQL}
SELECT conv_id, turn, {proposal_sql("lower(text)")} AS requests,
       ({" OR ".join(sql_match("text", p) for p in fv.PROPOSAL_PATTERNS)}) AND NOT {proposal_sql("lower(text)")} AS only_negated FROM c""")
def negation_scope(spark, sf_dir):
    low = F.lower("text")
    return turns(spark, sf_dir).select("conv_id", "turn", dialogue.requests_proposal(low).alias("requests"),
                                       dialogue.only_negated_proposals(low).alias("only_negated"))


def intent_sql(text: str, checked: str) -> str:
    clean = f"trim({text}, '!.,?;:')"
    starters = "^(?:" + "|".join(fv.QUESTION_STARTERS) + ")"
    polite = f"trim(regexp_replace({text}, '^(?:please |kindly |can you please |could you please |would you please )', ''))"
    rules = [
        (f"{text} = ''", "needs_clarification|0.95"),
        (f"list_contains({sql_list(fv.GREETINGS)}, {clean}) OR regexp_matches({text}, '^(?:hello |hi |hey |thank)')", "greeting|0.95"),
        (f"list_contains({sql_list(fv.VAGUE_PHRASES)}, {clean})", "needs_clarification|0.95"),
        (sql_any(text, fv.HARMFUL_KEYWORDS), "harmful|0.9"),
        (proposal_sql(text), "request_proposal|0.85"),
        (sql_any(text, fv.OFF_TOPIC_KEYWORDS), "off_topic|0.95"),
        (sql_match(text, fv.DOCUMENT_REFERENCE), "ask|0.8"),
        (sql_any(checked, fv.DOMAIN_KEYWORDS), "ask|0.8"),
        (f"length({text}) < 5", "needs_clarification|0.55"),
        (f"contains({text}, '?') OR regexp_matches({text}, '{starters}') OR regexp_matches({polite}, '{starters}')", "ask|0.7"),
    ]
    return "CASE " + " ".join(f"WHEN {c} THEN '{v}'" for c, v in rules) + " ELSE 'ask|0.5' END"


def _label(text_col, context=None):
    i = dialogue.intent(text_col, context)
    return F.concat_ws("|", i["intent"], F.format_string("%s", i["confidence"].cast("string")))


@query("intent_tagging", f"""
WITH {TURN_SQL}, m AS (SELECT *, lower({MEMORY_SQL}) AS mem, lower(trim(text, ' ' || chr(10) || chr(9))) AS low FROM c)
SELECT conv_id, turn, {intent_sql("low", "low || ' ' || coalesce(mem, '')")} AS intent FROM m WHERE role = 'user'""")
def intent_tagging(spark, sf_dir):
    c = dialogue.with_memory(turns(spark, sf_dir)).filter(F.col("role") == "user")
    return c.select("conv_id", "turn", _label(F.col("text"), F.array_join("memory", "\n")).alias("intent"))


@query("intent_short", f"""
WITH {SHORT_SQL}, m AS (SELECT conv_id, turn, lower(text) AS low FROM s)
SELECT conv_id, turn, {intent_sql("low", "low")} AS intent FROM m""")
def intent_short(spark, sf_dir):
    return short_turns(spark, sf_dir).select("conv_id", "turn", _label(F.col("text")).alias("intent"))


# ------------------------------------------------------------------------- slots
def label_sql(column: str, patterns) -> str:
    return "CASE " + " ".join(f"WHEN {sql_match(column, p)} THEN {sql_text(v)}" for p, v in patterns) + " END"


# An invented project catalogue.
CATALOGUE = ((r"thunder|storm", "Weather Desk"), (r"wh(?:at|en)\b", "Question Board"), (r"the\s+th", "Harbour Map"))
SLOT_SQL = ", ".join(f"{label_sql('text', p)} AS {n}" for n, p in (
    ("project_name", CATALOGUE), ("topic", fv.TOPIC_PATTERNS), ("service_type", fv.SERVICE_PATTERNS)))


@query("slot_backfill", f"""
WITH {TURN_SQL}, o AS (SELECT conv_id, turn, {SLOT_SQL} FROM c),
b AS (SELECT a.conv_id, a.turn, a.project_name, a.topic, a.service_type,
        arg_min(m.project_name, m.turn) FILTER (WHERE m.project_name IS NOT NULL) AS p2,
        arg_min(m.topic, m.turn) FILTER (WHERE m.topic IS NOT NULL) AS t2,
        arg_min(m.service_type, m.turn) FILTER (WHERE m.service_type IS NOT NULL) AS s2
      FROM o a LEFT JOIN o m ON m.conv_id = a.conv_id AND m.turn < a.turn AND m.turn >= a.turn - 6 GROUP BY ALL)
SELECT conv_id, turn, coalesce(project_name, p2, '') AS project_name, coalesce(topic, t2, '') AS topic,
       coalesce(service_type, s2, '') AS service_type, coalesce(topic, t2) IS NULL AS missing_topic FROM b""")
def slot_backfill(spark, sf_dir):
    c = turns(spark, sf_dir).withColumn("slots", dialogue.slots(F.col("text"), CATALOGUE))
    out = dialogue.backfill_slots(dialogue.with_memory(c, value=F.col("slots"), name="memory_slots"))
    return out.select("conv_id", "turn", *[F.coalesce(f"filled.{n}", F.lit("")).alias(n) for n in ("project_name", "topic", "service_type")],
                      (F.size("missing") > 0).alias("missing_topic"))


def _specific_sql(column: str) -> str:
    question = rf"^{fv.POLITENESS_PREFIX}(?:{fv.QUESTION_VERBS})\b"
    return f"(contains({column}, '?') OR {sql_match(column, question)} OR {sql_match(column, fv.SPECIFIC_REQUEST)})"


@query("turn_route", f"""
WITH {SHORT_SQL}, i AS (SELECT conv_id, turn, text, string_split({intent_sql("lower(text)", "lower(text)")}, '|') AS v,
                              {_specific_sql("text")} AS ask, {label_sql("text", fv.TOPIC_PATTERNS)} IS NULL AS lacking FROM s),
r AS (SELECT *, CASE WHEN v[2]::DOUBLE < 0.7 AND NOT ask THEN 'needs_clarification' ELSE v[1] END AS route_intent FROM i)
SELECT conv_id, turn, route_intent, CASE WHEN route_intent IN ('harmful', 'off_topic') THEN 'reject' WHEN route_intent = 'greeting' THEN 'greet'
  WHEN route_intent = 'needs_clarification' THEN 'clarify' WHEN lacking AND NOT ask AND route_intent = 'ask' THEN 'clarify_slot' ELSE 'retrieve' END AS route,
  regexp_matches(text, {sql_text('(?i)' + fv.RESOURCE_PATTERN)}) OR v[1] = 'request_proposal' AS tools FROM r""")
def turn_route(spark, sf_dir):
    s = short_turns(spark, sf_dir).withColumn("intent", dialogue.intent(F.col("text")))
    lacking = dialogue.first_label(F.col("text"), fv.TOPIC_PATTERNS).isNull()
    s = s.withColumn("missing", F.when(lacking, F.array(F.lit("topic"))).otherwise(F.array().cast("array<string>")))
    out = dialogue.route(s, "text")
    tools = dialogue.wants_tools(F.col("text"), F.lit(False), F.col("intent.intent"))
    return out.select("conv_id", "turn", "route_intent", "route", tools.alias("tools"))


@query("engagement_names", f"""
WITH {SHORT_SQL}
SELECT conv_id, turn, CASE WHEN contains(text, 'client:') THEN 'North Wind' WHEN text = '' OR turn % 2 = 1 THEN ''
         ELSE CASE WHEN length(n) BETWEEN 2 AND 80 AND regexp_matches(n, '\\p{{L}}') THEN n ELSE '' END END AS client,
       CASE WHEN contains(text, 'client:') THEN 'Blue Bird' WHEN text = '' OR turn % 2 = 0 THEN ''
         ELSE CASE WHEN length(n) BETWEEN 2 AND 80 AND regexp_matches(n, '\\p{{L}}') THEN n ELSE '' END END AS project
FROM (SELECT *, trim(trim(trim(trim(text), '"'''), '.,;:')) AS n FROM s)""")
def engagement_names(spark, sf_dir):
    """Replies to a naming question: even turns were asked for the client, odd ones for the project."""
    s = short_turns(spark, sf_dir)
    asked = F.when(F.col("turn") % 2 == 0, F.lit("client")).otherwise(F.lit("project"))
    names = dialogue.engagement_names(F.col("text"), asked)
    return s.select("conv_id", "turn", F.coalesce(names["client"], F.lit("")).alias("client"),
                    F.coalesce(names["project"], F.lit("")).alias("project"))


# ------------------------------------------------------------------ output checks
def advice_case(value: str) -> str:
    arms = []
    for p, c in fv.ADVICE_PATTERNS:
        hit = f"lower(regexp_extract(text, {sql_text('(?i)' + re2(p))}))"
        out = {"category": f"'{c}'", "hit": hit}[value]
        arms.append(f"WHEN {sql_match('text', p)} THEN {out}")
    return "CASE " + " ".join(arms) + " END"


ANSWER_SQL = f"""{TURN_SQL}, x AS (SELECT conv_id, turn, role, text, coalesce({LAST_SQL}, '') AS source FROM c),
a AS (SELECT *, {advice_case("category")} AS category, {advice_case("hit")} AS hit FROM x WHERE role = 'assistant')"""


def answers(spark, sf_dir):
    """Assistant replies with the user's latest text as their source."""
    c = dialogue.last_user_turn(turns(spark, sf_dir)).filter(F.col("role") == "assistant")
    return c.withColumn("source", F.coalesce("last_user_text", F.lit("")))


@query("advice_check", f"""
WITH {ANSWER_SQL} SELECT conv_id, turn, coalesce(category, 'none') AS category,
 category IS NOT NULL AND NOT (source <> '' AND contains(lower(source), hit)) AS blocked FROM a""")
def advice_check(spark, sf_dir):
    v = policy.advice_verdict(F.col("text"), F.col("source"))
    return answers(spark, sf_dir).select("conv_id", "turn", F.coalesce(v["category"], F.lit("none")).alias("category"), v["blocked"].alias("blocked"))


def _held(kind_index: int) -> str:
    return f"regexp_matches(source, {sql_text(SQL_RULES[kind_index][2])})"


# The allow-listed domain is looked at on the whole match, which may end in a full stop.
_MAIL = SQL_RULES[2][2]
OUTPUT_SQL = f"""{ANSWER_SQL},
k AS (SELECT *, regexp_extract_all(text, {sql_text(_MAIL)}) AS mails FROM a),
h AS (SELECT * REPLACE (list_reduce(list_concat([text], list_filter(mails, lambda m: lower(string_split(m, '@')[-1]) = 'acme.com')),
        lambda acc, m: replace(acc, m, replace(m, '@', chr(2)))) AS text), text AS original FROM k),
{redact_ctes("h", "text", "conv_id, turn, source, original, category, hit")},
o AS (SELECT *, replace(t4, chr(2), '@') AS red,
   list_filter([{", ".join(f"CASE WHEN n_{k} > 0 AND NOT {_held(i)} THEN '{k}' END" for i, (k, _, _) in enumerate(SQL_RULES))}], lambda x: x IS NOT NULL) AS leaked FROM r4)"""


@query("output_pii", f"""
WITH {OUTPUT_SQL} SELECT conv_id, turn, array_to_string(leaked, ',') AS leaked,
  sha256(CASE WHEN len(leaked) > 0 THEN red ELSE original END) AS checked_text FROM o""")
def output_pii(spark, sf_dir):
    out = policy.output_pii(answers(spark, sf_dir), "text", "source", ["acme.com"])
    return out.select("conv_id", "turn", F.array_join("leaked", ",").alias("leaked"), F.sha2("checked_text", 256).alias("checked_text"))


@query("output_policy", f"""
WITH {OUTPUT_SQL}
SELECT conv_id, turn, CASE WHEN category IS NOT NULL AND NOT (source <> '' AND contains(lower(source), hit)) THEN 'block'
   WHEN len(leaked) > 0 THEN 'redact' ELSE 'allow' END AS output_action,
  sha256(CASE WHEN category IS NOT NULL AND NOT (source <> '' AND contains(lower(source), hit)) THEN 'Please consult a qualified professional.'
   WHEN len(leaked) > 0 THEN red ELSE original END) AS final_answer FROM o""")
def output_policy(spark, sf_dir):
    out = policy.output_policy(answers(spark, sf_dir), "text", "source", allowed_email_domains=["acme.com"])
    return out.select("conv_id", "turn", "output_action", F.sha2("final_answer", 256).alias("final_answer"))


@query("query_expansion", f"""
WITH {SHORT_SQL}, x AS (SELECT string_agg(w, ' ' ORDER BY w) AS extra FROM (
  SELECT DISTINCT replace(source || '_' || lang, '_', ' ') AS w FROM documents WHERE contains(text, 'office') OR contains(text, 'under')))
SELECT conv_id, turn, CASE WHEN coalesce(extra, '') = '' THEN text ELSE text || ' ' || extra END AS query FROM s, x""")
def query_expansion(spark, sf_dir):
    """Visitor messages widened by the pages that mention a word (documents named by source and language)."""
    pages = table(spark, sf_dir, "documents").select(F.concat("source", F.lit("_"), "lang").alias("slug"), F.regexp_replace("text", "office", "under").alias("text"))
    asks = short_turns(spark, sf_dir).withColumnRenamed("text", "query")
    return retrieval.expand_by_text(asks, pages, "under").select("conv_id", "turn", "query")


# -------------------------------------------------------------------- transcripts
@query("transcript_steps", f"""
WITH {SHORT_SQL}
SELECT conv_id, turn, CASE WHEN turn % 2 = 0 AND text <> '' THEN 'action' WHEN turn % 2 = 1 AND text <> '' THEN 'answer' ELSE 'malformed' END AS kind,
  'weigh ' || turn AS thoughts, CASE WHEN turn % 2 = 0 AND text <> '' THEN 'search' ELSE '' END AS tool,
  CASE WHEN turn % 2 = 0 AND text <> '' THEN text ELSE '' END AS tool_input, CASE WHEN turn % 2 = 1 THEN text ELSE '' END AS answer FROM s""")
def transcript_steps(spark, sf_dir):
    """Logged assistant steps written from each message and parsed back."""
    s = short_turns(spark, sf_dir)
    thought = F.concat(F.lit("Thought: weigh "), F.col("turn").cast("string"), F.lit(" \n"))
    act = F.when(F.col("text") == "", F.lit("Action: search")).otherwise(
        F.concat(F.lit("  Action: search(\""), "text", F.lit("\")\nAnswer: later")))
    raw = F.concat(thought, F.when(F.col("turn") % 2 == 0, act).otherwise(F.concat(F.lit("Answer: "), "text")))
    s = s.withColumn("step", dialogue.parse_step(raw))
    return s.select("conv_id", "turn", "step.kind", F.array_join("step.thoughts", ";").alias("thoughts"),
                    *[F.coalesce(f"step.{c}", F.lit("")).alias(c) for c in ("tool", "tool_input", "answer")])


@query("reasoning_split", f"""
WITH {SHORT_SQL}
SELECT conv_id, turn, '{{"a": ' || turn || '}}' AS body, CASE WHEN contains(text, '{{') THEN '' ELSE text END AS reasoning FROM s""")
def reasoning_split(spark, sf_dir):
    s = short_turns(spark, sf_dir)
    body = F.concat(F.lit('{"a": '), F.col("turn").cast("string"), F.lit("}"))
    raw = F.concat(F.lit("Reasoning: "), "text", F.lit("\nJSON Output:\n```json\n"), body, F.lit("\n```"))
    s = s.withColumn("p", dialogue.split_reasoning(raw))
    return s.select("conv_id", "turn", "p.body", F.coalesce("p.reasoning", F.lit("")).alias("reasoning"))


@query("citation_dedupe", f"""
WITH {TURN_SQL}, k AS (SELECT conv_id AS answer_id, turn AS pos, role, rtrim('http://x/' || role || repeat('/', turn::INT % 3), '/') AS u FROM c)
SELECT answer_id, min(pos) AS pos, u AS url FROM k GROUP BY answer_id, u""")
def citation_dedupe(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("answer_id"), F.col("turn").alias("pos"),
        F.concat(F.lit(" http://x/"), "role", F.expr("repeat('/', int(turn) % 3)"), F.lit(" ")).alias("url"), F.col("role").alias("title"))
    out = dialogue.dedupe_citations(c)
    return out.select("answer_id", "pos", F.rtrim(F.trim("url"), F.lit("/")).alias("url"))


@query("rule_table", r"""
WITH b AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM benchmark),
r AS (SELECT item_id AS place, 'item ' || item_id AS category, ' ' || array_to_string(w[1:3], ' ') || ' ' AS phrase FROM b WHERE len(w) >= 3),
t AS (SELECT doc_id, ' ' || array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), ' ') || ' ' AS words FROM documents)
SELECT t.doc_id, min(place) AS place, arg_min(category, place) AS category FROM t JOIN r ON contains(t.words, r.phrase) GROUP BY t.doc_id""")
def rule_table(spark, sf_dir):
    """The first of a table of rules, the opening words of every benchmark item, that each document breaks."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    items = table(spark, sf_dir, "benchmark").select("item_id", words.alias("w")).filter(F.size("w") >= 3)
    rules = items.select(F.col("item_id").alias("place"), F.concat(F.lit("item "), F.col("item_id").cast("string")).alias("category"),
                         F.array_join(F.slice("w", 1, 3), " ").alias("phrase"))
    return policy.rule_matches(table(spark, sf_dir, "documents"), rules, ident="doc_id")
