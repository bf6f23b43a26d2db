import math
import random
import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from corpuslake.functions import fixed_values as fv
from corpuslake.operators import documents, evals, pricing, telemetry

CASE = "id string, expect string, slug string, axis string, paraphrase_of string"
RESULT = "id string, expect string, axis string, rank int, gold_score double, top1_score double"
TRACE = "record_id int, ts string, session_id string, path string, latency_ms int, total_tokens int, tool_calls array<string>, error string, is_grounded boolean, confidence double, guardrail_reason string, cost_usd double"


def test_case_results(spark):
    cases = spark.createDataFrame([("a", "retrieve", "s", None, None), ("b", "retrieve", "s", "x", "a"), ("c", "abstain", None, None, None), ("d", "retrieve", "s", None, None)], CASE)
    hits = spark.createDataFrame([("a", 0, "z", 0.9), ("a", 1, "s", 0.8), ("a", 2, "s", 0.7), ("b", 0, "z", 0.5), ("c", 0, "s", 0.6)], "case_id string, rank int, slug string, score double")
    got = {r.id: (r.rank, r.gold_score, r.top1_score) for r in evals.case_results(cases, hits).collect()}
    assert got == {"a": (1, 0.8, 0.9), "b": (None, None, 0.5), "c": (None, None, 0.6), "d": (None, None, None)}
    results = evals.case_results(cases, hits)
    assert [tuple(r) for r in evals.divergent_pairs(results, cases).collect()] == [("a", "b")]


def test_metrics(spark):
    rows = [("a", "retrieve", "n", 0, 0.9, 0.9), ("b", "retrieve", None, 4, 0.7, 0.9), ("c", "retrieve", "n", 5, 0.6, 0.9), ("d", "retrieve", None, None, None, 0.5), ("e", "abstain", None, None, None, 0.95)]
    df = spark.createDataFrame(rows, RESULT)
    assert {r.axis: (r.cases, r.hit_rate) for r in evals.hit_rate(df).collect()} == {"n": (2, 0.5), "untagged": (2, 0.5), None: (4, 0.5)}
    assert math.isclose(evals.mrr(df).first().mrr, (1 + 0.2) / 4)
    assert evals.mrr(df.filter("false")).first().mrr == 0.0
    sep = evals.separation(df).first()
    assert (sep.gold_min, sep.gold_p25, sep.gold_median, sep.overlap_count, sep.gold_total, sep.abstain_total, sep.abstain_max) == (0.7, 0.7, 0.8, 1, 2, 1, 0.95)
    empty = evals.separation(df.filter("false")).first()
    assert empty.gold_median is None and empty.overlap_count == 0 and empty.gold_total == 0


def test_baseline(spark):
    now = spark.createDataFrame([("a", "retrieve", None, 1, 0.5, 0.5), ("new", "retrieve", None, None, None, 0.5)], RESULT)
    old = spark.createDataFrame([("a", 0, 0.6), ("dropped", 0, 0.1)], "id string, rank int, gold_score double")
    got = {r.id: (r.rank_before, r.rank_after, r.rank_changed) for r in evals.diff_baseline(now, old).collect()}
    assert got == {"a": (0, 1, True), "new": (None, None, False)}
    rows = spark.createDataFrame([("m", "m", "1", "1"), ("m", "n", "1", "2"), ("m", "m", "1", "2"), (None, "m", "1", "1")], "a string, b string, c string, d string")
    why = [r[0] for r in rows.select(evals.staleness(F.col("a"), F.col("b"), F.col("c"), F.col("d"))).collect()]
    assert why[0] is None and "model" in why[1] and "corpus" in why[2] and "none" in why[3]


def test_claims(spark):
    case = spark.createDataFrame([("f", ["mobile", "pci"], (["Mobile", " "], ["PCI-DSS", "ai"], None, ["mobile app"]))],
                                 "file string, brief_words array<string>, requirements struct<target_platform:array<string>,features:array<string>,constraints:array<string>,tech_stack:array<string>>")
    flagged = evals.claim_grounding(evals.explode_claims(case))
    assert {r.value: r.grounded for r in flagged.collect()} == {"Mobile": True, "PCI-DSS": False, "ai": False, "mobile app": True}
    assert tuple(evals.claim_summary(flagged, ["file"]).first()) == ("f", 4, 2, 0.5)


def test_quote_audit(spark):
    D = Decimal
    q = [("ok", D("10.01"), D("12"), D("1.20"), D("11.21"), "USD", "$", None, None), ("sub", D("10.00"), D("12"), D("1.20"), D("11.20"), "USD", "$", None, None),
         ("tax", D("10.01"), D("12"), D("1.21"), D("11.22"), "USD", "$", "USD", None), ("sum", D("10.01"), D("12"), D("1.20"), D("11.20"), "USD", "$", "", None),
         ("cur", D("10.01"), D("12"), D("1.20"), D("11.21"), "PHP", "₱", "USD", None), ("sym", D("10.01"), D("12"), D("1.20"), D("11.21"), "PHP", "$", "PHP", None),
         ("eur", D("10.01"), D("12"), D("1.20"), D("11.21"), "EUR", "$", None, None), ("bad", None, None, None, None, None, None, None, "nothing priced"), ("none", D("0.00"), D("0"), D("0.00"), D("0.00"), "USD", "$", None, None)]
    quotes = spark.createDataFrame(q, "quote_id string, subtotal decimal(18,2), tax_rate decimal(6,2), tax decimal(18,2), total decimal(18,2), currency_code string, symbol string, declared_currency string, error string")
    items = spark.createDataFrame([(i[0], D("3"), D("3.335")) for i in q if i[0] not in ("bad", "none")], "quote_id string, quantity decimal(10,2), unit_price decimal(10,3)")
    got = {r.quote_id: (r.ok, r.reasons) for r in evals.quote_audit(quotes, items).collect()}
    assert got["ok"] == (True, []) and got["none"] == (True, []) and got["eur"] == (True, []) and got["bad"] == (False, ["nothing priced"])
    assert {k: v[1] for k, v in got.items() if k in ("sub", "tax", "sum", "cur", "sym")} == {"sub": ["subtotal"], "tax": ["tax"], "sum": ["total"], "cur": ["currency"], "sym": ["symbol"]}


def test_layer_table(spark):
    rows = spark.createDataFrame([(True,), (True,), (False,)], "ok boolean")
    registry = evals.LayerRegistry()
    registry.add("a", lambda s: evals.layer_row(rows, "unit", "guardrails/deterministic", F.col("ok")))
    registry.add("b", lambda s: evals.layer_row(rows, "x", "unlisted", F.col("ok")))
    registry.add("c", lambda s: evals.layer_row(rows.filter("false"), "x", "judge/proposal-quality", F.col("ok")))
    got = {r.name: (r.total, r.passed, r.floor, r.status, r.gate) for r in registry.run(spark).collect()}
    assert got == {"guardrails/deterministic": (3, 2, 0.6, "ok", False), "unlisted": (3, 2, 1.0, "FAIL", False), "judge/proposal-quality": (0, 0, 0.75, "SKIP", False)}
    registry.add("b", registry.layers["b"])
    registry.floors["unlisted"] = 0.5
    assert all(r.gate for r in registry.run(spark).collect())


def test_judge_and_ablation(spark):
    v = spark.createDataFrame([("a", 5), ("a", 2), ("a", None), ("b", None)], "k string, score int")
    got = {r.k: (r.total, r.passed, r.mean_score, r.failed, r.unscored, r.skipped) for r in evals.judge_summary(v, ["k"]).collect()}
    assert got == {"a": (2, 1, 3.5, 1, 1, False), "b": (0, 0, None, 0, 1, True)}
    runs = spark.createDataFrame([("free", False, True, "Sorry, no", None), ("free", False, True, "sure", None), ("free", False, False, "sure", None),
                                  ("json", True, True, "x", ("A", [], False, 0.9)), ("json", True, False, "x", None)],
                                 "variant string, uses_schema boolean, out_of_scope boolean, raw string, parsed struct<answer:string,citations:array<string>,is_grounded:boolean,confidence:double>")
    got = {r.variant: (r.runs, round(r.json_valid_rate, 3), round(r.refusal_correct_rate, 3), r.avg_confidence) for r in evals.ablation_summary(evals.ablation_flags(runs)).collect()}
    assert got == {"free": (3, 1.0, 0.667, 0.0), "json": (2, 0.5, 0.5, 0.45)}


# -------------------------------------------------------------------- telemetry
def trace(i, ts, sid, tools=(), error=None, **more):
    base = dict(path="p", latency_ms=None, total_tokens=None, is_grounded=None, confidence=None, guardrail_reason=None, cost_usd=None) | more
    return (i, ts, sid, base["path"], base["latency_ms"], base["total_tokens"], list(tools), error, base["is_grounded"], base["confidence"], base["guardrail_reason"], base["cost_usd"])


def test_rollup(spark):
    rows = [trace(1, "1", "s", latency_ms=10, total_tokens=5, is_grounded=False, confidence=0.5, cost_usd=0.1), trace(2, "2", "s", latency_ms=20, is_grounded=True, error=""), trace(3, "3", "s", error="x", guardrail_reason="g")]
    row = telemetry.rollup(spark.createDataFrame(rows, TRACE)).first()
    assert (row["count"], row.latency_p50, row.latency_p95, row.total_tokens, row.avg_tokens, round(row.error_rate, 4), row.grounded_rate, row.mean_confidence, round(row.intercept_rate, 4), row.total_cost_usd) == (
        3, 15.0, 19.5, 5, 5.0, 0.3333, 0.5, 0.5, 0.3333, 0.1)
    none = telemetry.rollup(spark.createDataFrame([], TRACE)).first()
    assert (none["count"], none.latency_p50, none.total_tokens, none.avg_tokens, none.error_rate, none.grounded_rate, none.total_cost_usd) == (0, None, 0, None, 0.0, None, 0.0)
    near = telemetry.rollup(spark.createDataFrame(rows, TRACE), ["path"], approximate=True).first()
    assert near["count"] == 3 and near.latency_p50 in (10.0, 20.0)


def test_sessions(spark):
    rows = [trace(1, "2", "ok", ["est"]), trace(2, "1", "ok", ["read"]), trace(3, "3", "ok", ["pdf"]), trace(4, "1", "noest", ["read", "pdf", "est"]), trace(5, "1", "err", ["read", "est", "pdf"], "boom"),
            trace(6, "1", "nobrief", ["est", "pdf", "read"]), trace(7, "1", "stall", ["read", "est"]), trace(8, "1", "chat", ["search"]), trace(9, None, None, ["pdf"]), trace(10, "1", "", ["pdf"]), trace(11, "1", "quiet")]
    facts = telemetry.session_facts(spark.createDataFrame(rows, TRACE), "pdf", "est", ["read", "extract"])
    assert {r.session_id: r.reason for r in telemetry.trajectory(facts).collect()} == {"ok": "ok", "noest": "no estimate before", "err": "errored: boom", "nobrief": "not grounded in the brief"}
    assert {r.session_id: r.passed for r in telemetry.completion(facts).collect()} == {"ok": True, "noest": True, "err": False, "nobrief": True}
    assert [r.session_id for r in telemetry.stalled(facts).collect()] == ["stall"]


def test_usage_ttl_uploads_and_ids(spark):
    calls = spark.createDataFrame([("a", 1, None, 1), ("a", 2, 3, 5), ("b", None, None, None)], "k string, prompt_tokens int, completion_tokens int, total_tokens int")
    assert {r.k: tuple(r)[1:] for r in telemetry.usage_totals(calls, ["k"]).collect()} == {"a": (3, 3, 6), "b": (None, None, None)}
    ages = spark.createDataFrame([(10.0,), (10.1,)], "age double")
    assert [r.age for r in telemetry.expired(ages, F.col("age"), 10.0).collect()] == [10.1]
    ups = spark.createDataFrame([("s", "h", 2, "late"), ("s", "h", 1, "early"), ("t", "h", 3, "other")], "session_id string, sha string, ts int, name string")
    assert {(r.session_id, r.name, r.copies) for r in telemetry.first_uploads(ups, ["session_id", "sha"], ["ts"]).collect()} == {("s", "early", 2), ("t", "other", 1)}
    asked = spark.createDataFrame([("s", ["b", "zz", "a"])], "session_id string, ids array<string>")
    recs = spark.createDataFrame([("s", "a"), ("s", "b"), ("t", "zz")], "session_id string, id string")
    assert [r.id for r in telemetry.resolve_ids(asked, recs).orderBy("pos").collect()] == ["b", "a"]
    assert [r.ts for r in telemetry.recent(spark.createDataFrame([("1",), ("3",), ("2",)], "ts string"), 2).collect()] == ["3", "2"]


# -------------------------------------------------------------------- documents
def test_pages(spark):
    docs = spark.createDataFrame([("a", "---\nx: 1\n---\nintro\n## Page 1\none\n## Page 12  \ntwo\n### Page 3\n"), ("b", " plain "), ("c", " "), ("d", "## Page x")], "doc string, text string")
    got = sorted((r.doc, r.pos, r.page, r.block) for r in documents.split_pages(docs).collect())
    assert got == [("a", 0, 1, "## Page 1\none"), ("a", 1, 12, "## Page 12  \ntwo\n### Page 3"), ("b", 0, 1, "plain"), ("d", 0, 1, "## Page x")]
    pages = spark.createDataFrame([("a", i, i + 1, f"b{i}") for i in range(7)], "doc string, pos int, page int, block string")
    groups = documents.group_pages(pages).orderBy("group").collect()
    assert [(g.first_page, g.last_page, g.text) for g in groups] == [(1, 5, "b0\n\nb1\n\nb2\n\nb3\n\nb4"), (6, 7, "b5\n\nb6")]
    rows = [("a", 1, False, "vision", 3, (1, None, 1)), ("a", 2, True, "text", 3, None), ("b", 1, None, "text", 1, (2, 2, 4))]
    acc = {r.doc: r for r in documents.page_accounting(spark.createDataFrame(rows, "doc string, page int, failed boolean, source string, pages_total int, usage struct<prompt_tokens:int,completion_tokens:int,total_tokens:int>")).collect()}
    assert (acc["a"].pages_parsed, acc["a"].pages_failed, acc["a"].truncated, acc["a"].pages_via_vision, acc["a"].total_tokens) == (1, [2], True, 1, 1)
    assert (acc["b"].pages_parsed, acc["b"].pages_failed, acc["b"].truncated) == (1, [], False)


def test_figures(spark):
    cases = [("text\n> **Figure:** A map. A map.\nFigure: <the map of x>\nx\nFigure: This figure shows a map. New one.\nFigure 3: caption", "text\n> **Figure:** A map.\n> **Figure:** the map of x\nx\n> **Figure:** New one.\nFigure 3: caption"),
             ("no figures\n", "no figures\n"), ("**Figure 1:** Only.\n", "> **Figure:** Only."), ("Figure:", "Figure:")]
    df = spark.createDataFrame(cases, "t string, want string").withColumn("got", documents.normalize_figures(F.col("t")))
    assert [(r.t, r.got) for r in df.collect()] == cases


def test_excerpts(spark):
    body = "a" * 400 + "Key" + "b" * 1100 + "\n## Page 2\n" + "c" * 300 + "KEY" + "d" * 5000 + "key end"
    docs = spark.createDataFrame([("x", body, "key"), ("y", "nothing", "key"), ("z", "key", ""), ("ß", "ß" * 50 + "key", "KEY")], "doc string, text string, needle string")
    got = [(r.doc, r.excerpt, r.start, r.end, r.page_label) for r in documents.excerpts(docs, "text", "needle").orderBy("doc", "excerpt").collect()]
    first, second, third = 400, body.index("KEY"), body.index("key end")
    assert got[:2] == [("x", 0, first - 350, second + 1400, "start of document"), ("x", 1, third - 350, len(body), "Page 2")]
    assert got[2] == ("ß", 0, 0, 53, "start of document") and len(got) == 3


def test_requirements_merge(spark):
    rows = [("d", 1, ["Web"], ["SSO ", "Reports"], [], ["Java"], "low", "simple", {"a": "1", "b": "1"}, ["n" * 201] + [f"note {i}" for i in range(9)]),
            ("d", 2, ["web", "iOS"], ["sso", "  "], None, None, "High ", "hard", {"a": "2"}, ["note 1"]), ("e", 1, None, None, None, None, "moderate", None, None, None)]
    df = spark.createDataFrame(rows, "doc string, group int, target_platform array<string>, features array<string>, constraints array<string>, tech_stack array<string>, complexity string, project_category string, category_attributes map<string,string>, extraction_notes array<string>")
    own = spark.createDataFrame([("d", 0, "page 7 failed")], "doc string, pos int, note string")
    got = {r.doc: r for r in documents.merge_requirements(df, own, max_notes=8, note_chars=200).collect()}
    d, e = got["d"], got["e"]
    assert (d.target_platform, d.features, d.constraints, d.tech_stack, d.complexity, d.project_category, d.category_attributes) == (["Web", "iOS"], ["SSO", "Reports"], [], ["Java"], "high", "hard", {"a": "2", "b": "1"})
    assert len(d.extraction_notes) == 8 and d.extraction_notes[:2] == ["page 7 failed", "n" * 200]
    assert (e.features, e.complexity, e.project_category, e.extraction_notes) == ([], "medium", "standard", [])


def test_token_metrics(spark):
    files = spark.createDataFrame([("a", "one two\nthree", 6), ("b", "", 0), ("c", "x", 2)], "f string, text string, tokens int")
    m = documents.text_metrics(files)
    assert {r.f: (r.lines, r.words, r.tokens_per_word, r.share_pct) for r in documents.token_shares(m).collect()} == {"a": (2, 3, 2.0, 75.0), "b": (0, 0, 0.0, 0.0), "c": (1, 1, 2.0, 25.0)}
    assert documents.token_summary(m).first().avg_tokens_per_word == 2.0
    zero = documents.token_shares(m.withColumn("tokens", F.lit(0))).collect()
    assert {r.share_pct for r in zero} == {0.0}


# ---------------------------------------------------------------------- pricing
def test_estimate(spark):
    df = spark.createDataFrame([(["Email form"], ["web"], "low", None), (["AI chat", "data lake", "cloud storage"], [], "high", None), (["x"] * 4, None, "hard", 6.04)],
                               "features array<string>, target_platform array<string>, complexity string, timeline_weeks double")
    rows = pricing.estimate(df, F.lit("USD")).collect()
    assert [r.weeks for r in rows] == [round((4 + 1.3) * 0.8, 1), round((4 + 3.9) * 1.2, 1), 6.0]
    assert [[i.role.split()[-1] for i in r["items"]][4:] for r in rows] == [[], ["Engineer", "(Annual)", "Specialist"], []]
    want = sum(round(rows[0].weeks * w * float(r), 2) for w, r in zip((15, 30, 15, 10), (41.62, 34.85, 21.65, 24.5)))
    assert math.isclose(rows[0].total_cost, round(want, 2), abs_tol=0.011)
    php = pricing.estimate(df, F.lit("PHP")).first()
    assert php["items"][0].rate == 2496.9


def plain_phases(names, weeks, complexity):
    """Straight reading of the phase rules, for comparison."""
    cap = dict(fv.PHASE_CAPS).get((complexity or "standard").strip().lower(), 6)
    if len(names) <= 2 and weeks <= 4.0:
        return [(round(weeks * 0.5, 1), 2)] * 2
    size = max(1, math.ceil(len(names) / max(1, cap - 2)))
    groups = [names[i:i + size] for i in range(0, len(names), size)]
    each, edge = round(max(0.5, max(1.0, weeks * 0.7) / len(groups)), 1), round(max(0.5, weeks * 0.15), 1)
    return [(edge, 2)] + [(each, min(4, len(g))) for g in groups] + [(edge, 3)]


def test_phases(spark):
    random.seed(2)
    rows = [([f"feature {j}" for j in range(random.randint(1, 25))], round(random.uniform(0.3, 30), 1), random.choice(["easy", "Hard ", "medium", None, "odd"])) for _ in range(60)]
    df = spark.createDataFrame(rows, "f array<string>, w double, c string").withColumn("p", pricing.build_phases(F.col("f"), F.col("w"), F.col("c")))
    for r in df.collect():
        assert [(p.duration_weeks, len(p.milestones)) for p in r.p] == plain_phases(r.f, r.w, r.c)
        assert [int(re.match(r"Phase (\d+)", p.phase_name).group(1)) for p in r.p] == list(range(1, len(r.p) + 1))
    custom = spark.createDataFrame([([(f"p{i}", 0.1 * i, [f"m{i}"]) for i in range(6)],)], "p array<struct<phase_name:string,duration_weeks:double,milestones:array<string>>>")
    got = custom.select(pricing.clamp_phases(F.col("p"), F.lit(4)).alias("p")).first().p
    assert [(p.phase_name, round(p.duration_weeks, 1), p.milestones) for p in got] == [("p0", 0.0, ["m0"]), ("p1", 0.6, ["m1", "m2", "m3"]), ("p4", 0.4, ["m4"]), ("p5", 0.5, ["m5"])]
    assert len(custom.select(pricing.clamp_phases(F.col("p"), F.lit(1)).alias("p")).first().p) == 2


def test_clean_features(spark):
    cases = [(['scope_input="Login, Search; SSO and  Reports\nx"'], ["Login", "Search", "SSO", "Reports"]), (["ab", None, ""], ["Core Platform Features"]), (["Sandbox", "Sandbox"], ["Sandbox"]),
             (["word " * 12], [("word " * 10).strip()]), (["y" * 60], ["y" * 50])]
    df = spark.createDataFrame(cases, "f array<string>, want array<string>").withColumn("got", pricing.clean_features(F.col("f")))
    assert all(r.got == r.want for r in df.collect())


def test_titles(spark):
    cases = [("plain contact form", "Software Services — Custom Software Development"), ("ai chat", "Artificial Intelligence — AI/ML Engineering & Model Solutions"), ("etl", "Data Services — Data Engineering & Analytics Platform"),
             ("aws", "Cloud Services — Cloud Architecture & DevOps Infrastructure"), ("aws web", "Software Services — Full-Stack Web Application"), ("qa testing", "Quality Assurance — Software Testing & Automation"),
             ("qa web", "Software Services — Full-Stack Web Application"), ("cart ios portal", "Software Services — E-Commerce Web & Mobile Platform"), ("checkout", "Software Services — E-Commerce Web Application"),
             ("cms", "Software Services — Custom Website & CMS"), ("cms microservices", "Software Services — Custom Software Development"), ("android", "Software Services — Mobile Application (iOS/Android)"),
             ("web mobile", "Software Services — Web & Mobile Application Platform"), (None, "Software Services — Full-Stack Web Application")]
    df = spark.createDataFrame(cases, "t string, want string").withColumn("got", pricing.project_title(F.col("t")))
    assert [(r.t, r.got) for r in df.collect()] == cases
    assert spark.range(1).select(pricing.project_title(F.lit("ai"), F.lit(" Mine ")), pricing.project_title(F.lit("x"), F.lit("Proposal"))).first()[:] == ("Mine", cases[0][1])


def test_quotes(spark):
    D = Decimal
    heads = [("usd", "USD", D("9"), ""), ("undeclared", None, D("5"), "a total of PHP 1,379,994.00"), ("silent", None, D("7.005"), "done"), ("empty", "USD", D("0"), ""), ("fixed", "PHP", D("100"), "x")]
    roles = [("usd", "Dev", 10.0, 600.0), ("usd", "Idle", 0.0, 5.0), ("usd", "Cloud License", 1.0, 0.335), ("undeclared", "Dev", 2.0, 2987.0), ("fixed", "Free", 3.0, 0.0)]
    out = pricing.quotes(spark.createDataFrame(heads, "quote_id string, currency_code string, total_cost decimal(18,3), summary string"),
                         spark.createDataFrame(roles, "quote_id string, role string, hours double, rate double"), F.lit("USD"), F.lit("12").cast("decimal(6,2)"))
    got = {r.quote_id: (r.line_count, str(r.subtotal), str(r.tax), str(r.total), r.error) for r in out.collect()}
    assert got == {"usd": (2, "6000.34", "720.04", "6720.38", None), "undeclared": (1, "99.56", "11.95", "111.51", None), "silent": (1, "7.01", "0.84", "7.85", None),
                   "empty": (0, "None", "None", "None", "nothing priced"), "fixed": (1, "1.67", "0.20", "1.87", None)}


def test_quote_currency(spark):
    cases = [("₱", "PHP", None, None, None, "PHP"), ("$", "USD", "in PHP", None, None, "PHP") , ("$", "USD", "x", "₱5", None, "PHP"), (None, None, None, None, "total of PHP 5,000", "PHP"), ("$", "USD", "x", "y", "z", "USD")]
    cases[1] = ("$", "USD", "amounts in PHP", None, None, "PHP")
    df = spark.createDataFrame(cases, "s string, c string, a string, b string, d string, want string")
    rows = df.withColumn("got", pricing.quote_currency(*[F.col(x) for x in "scabd"])).collect()
    assert [r.got for r in rows] == [c[-1] for c in cases]


def test_phase_calendar_and_titles(spark):
    rows = [("q", 1, 1.5), ("q", 2, -1.0), ("q", 3, 0.2), ("q", 4, 2.0)]
    df = spark.createDataFrame(rows, "quote_id string, phase int, duration_weeks double").withColumn("start_date", F.lit("2026-01-01").cast("date"))
    got = [(str(r.phase_start), str(r.phase_end)) for r in pricing.phase_calendar(df).orderBy("phase").collect()]
    assert got == [("2026-01-01", "2026-01-11"), ("2026-01-11", "2026-01-11"), ("2026-01-11", "2026-01-12"), ("2026-01-12", "2026-01-26")]
    assert spark.range(1).select(pricing.phase_title(F.lit(" Phase 2: Build")), pricing.phase_title(F.lit("Phase 3: "))).first()[:] == ("Build", "Phase 3:")


def test_website_price(spark):
    cols = "pages int, style string, animation string, responsive string, design_revisions int, maintenance int, training boolean, speed int, google_analytics boolean, search_console boolean"
    rows = [(8, "mid", "basic", "fluid", 1, 0, False, 0, False, False), (200, "adv", "adv", "custom", 3, 3, True, 2, True, True), (1, "basic", "none", "fluid", 0, 0, False, 0, False, False), (0, "mid", "basic", "fluid", 1, 0, False, 0, False, False), (8, "nope", "basic", "fluid", 1, 9, False, 0, False, False)]
    out = pricing.website_price(spark.createDataFrame(rows, cols)).collect()
    assert [(r.subtotal, r.low, r.high, r.usd_low, r.usd_high) for r in out[:1]] == [(231000, 208000, 266000, 3700, 4750)]
    assert out[1].subtotal == 350000 + 1200000 + 90000 + 40000 + 24000 + 100000 + 8000 + 35000 + 10000 and out[2].subtotal == 66000 and len(out[2]["items"]) == 2
    assert (out[3].problem, out[4].problem, out[3].subtotal) == ("pages", "style", None)


def test_excerpts_without_a_bound(spark):
    """Against a plain scan; a bound keeps the first windows."""
    import random

    rnd = random.Random(8)
    texts = ["".join(rnd.choice(["aa", "Aa.", "b" * 300, "## Page 3\n", "\n## Page 12\n", "é"]) for _ in range(rnd.randint(1, 60))) for _ in range(30)]
    want = {}
    for doc, text in enumerate(texts):
        low, spans, resume = text.lower(), [], 0
        for at in range(len(text) - 1):
            if low[at:at + 2] == "aa" and at >= resume:
                resume = min(len(text), at + 1400)
                if spans and max(0, at - 350) <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], resume)
                else:
                    spans.append([max(0, at - 350), resume])
        want[doc] = spans
    docs = spark.createDataFrame(list(enumerate(texts)), "doc int, text string").withColumn("needle", F.lit("AA"))
    got = {}
    for r in documents.excerpts(docs, "text", "needle").orderBy("doc", "excerpt").collect():
        got.setdefault(r.doc, []).append([r.start, r.end])
    assert got == {d: s for d, s in want.items() if s}
    assert documents.excerpts(docs, "text", "needle", limit=1).count() == len(got)
