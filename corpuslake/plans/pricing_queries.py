"""Estimates, quotes, phases and prices over the order and part tables."""

from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions import money as mn
from ..functions.exprs import unnest
from ..operators import evals, pricing
from .base import query, r6, sql_list, sql_text, table

DEC = "decimal(18,2)"


# ------------------------------------------------------------------------ quotes
QUOTE_SQL = """
item AS (SELECT l_orderkey AS quote_id, CAST(l_quantity AS DECIMAL(18,2)) AS quantity,
                round(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))), 2) AS unit_price FROM lineitem),
sums AS (SELECT quote_id, sum(round(quantity * unit_price, 2)) AS s FROM item GROUP BY quote_id),
q AS (SELECT o_orderkey AS quote_id, o_orderstatus AS st, o_orderpriority AS pr, coalesce(s, 0) AS s,
             CASE WHEN o_orderstatus = 'P' THEN s + 0.01 WHEN s IS NULL AND o_orderstatus = 'O' THEN NULL ELSE coalesce(s, 0) END AS subtotal
      FROM orders LEFT JOIN sums ON quote_id = o_orderkey)"""


def printed_quotes(spark, sf_dir):
    """Orders as printed quotes, some of them wrong, with their lines."""
    li = table(spark, sf_dir, "lineitem")
    price = F.round(F.col("l_extendedprice").cast(DEC) * (F.lit(1) - F.col("l_discount").cast("decimal(4,2)")), 2)
    items = li.select(F.col("l_orderkey").alias("quote_id"), F.col("l_quantity").cast(DEC).alias("quantity"), price.cast(DEC).alias("unit_price"))
    sums = items.groupBy("quote_id").agg(F.sum(mn.money(F.col("quantity") * F.col("unit_price"))).cast("decimal(28,2)").alias("s"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("quote_id"), F.col("o_orderstatus").alias("st"), F.col("o_orderpriority").alias("pr"))
    q = o.join(sums, "quote_id", "left")
    zero = F.lit(0).cast("decimal(28,2)")
    subtotal = (F.when(F.col("st") == "P", F.col("s") + F.lit("0.01").cast("decimal(4,2)"))
                .when(F.col("s").isNull() & (F.col("st") == "O"), F.lit(None)).otherwise(F.coalesce("s", zero))).cast("decimal(28,2)")
    q = q.withColumn("subtotal", subtotal)
    tax = F.round(F.col("subtotal") * F.lit(12) / 100, 2).cast("decimal(28,2)")
    cent = F.lit("0.01").cast("decimal(4,2)")
    q = q.withColumn("tax", F.when(F.col("pr") == "1-URGENT", tax + cent).otherwise(tax).cast("decimal(28,2)"))
    q = q.withColumn("total", F.when(F.col("pr") == "2-HIGH", F.col("subtotal")).otherwise(F.col("subtotal") + F.col("tax")).cast("decimal(28,2)"))
    code = F.when(F.col("st") == "F", "PHP").otherwise(F.when(F.col("pr") == "5-LOW", "EUR").otherwise("USD"))
    q = q.withColumns({"currency_code": code, "tax_rate": F.lit(12).cast("decimal(6,2)"), "error": F.lit(None).cast("string"),
                       "symbol": F.when(F.col("pr") == "3-MEDIUM", "₱").otherwise("$"),
                       "declared_currency": F.when(F.col("pr") == "4-NOT SPECIFIED", F.lit(None)).otherwise("USD")})
    return q, items


AUDIT_SQL = f"""{QUOTE_SQL},
t AS (SELECT *, CASE WHEN pr = '1-URGENT' THEN round(subtotal * 12 * 0.01, 2) + 0.01 ELSE round(subtotal * 12 * 0.01, 2) END AS tax,
             CASE WHEN st = 'F' THEN 'PHP' WHEN pr = '5-LOW' THEN 'EUR' ELSE 'USD' END AS code, CASE WHEN pr = '3-MEDIUM' THEN '₱' ELSE '$' END AS symbol FROM q),
audit AS (SELECT quote_id, CASE WHEN subtotal IS NULL THEN 'quote could not be built' ELSE array_to_string(list_filter([
   CASE WHEN s <> subtotal THEN 'subtotal' END, CASE WHEN round(subtotal * 12 * 0.01, 2) <> tax THEN 'tax' END,
   CASE WHEN subtotal + tax <> CASE WHEN pr = '2-HIGH' THEN subtotal ELSE subtotal + tax END THEN 'total' END,
   CASE WHEN pr <> '4-NOT SPECIFIED' AND code <> 'USD' THEN 'currency' END,
   CASE WHEN (code = 'USD' AND symbol <> '$') OR (code = 'PHP' AND symbol <> '₱') THEN 'symbol' END], lambda x: x IS NOT NULL), ',') END AS reasons FROM t)"""


@query("quote_audit", f"WITH {AUDIT_SQL} SELECT quote_id, reasons, reasons = '' AS ok FROM audit")
def quote_audit(spark, sf_dir):
    out = evals.quote_audit(*printed_quotes(spark, sf_dir))
    return out.select("quote_id", F.array_join("reasons", ",").alias("reasons"), "ok")


TOTAL_SQL = """
role AS (SELECT l_orderkey AS quote_id, l_returnflag || CASE WHEN l_linestatus = 'O' THEN ' License' ELSE ' engineer' END AS role,
                CAST(l_quantity AS DECIMAL(18,2)) AS hours, CAST(l_discount AS DECIMAL(4,2)) * 1000 AS rate FROM lineitem),
head AS (SELECT o_orderkey AS quote_id, CASE WHEN left(o_orderpriority, 1) IN ('1', '2') THEN 'USD' ELSE 'PHP' END AS target,
                CASE WHEN o_orderstatus = 'F' THEN 'PHP' WHEN o_orderstatus = 'O' THEN 'USD'
                     ELSE CASE WHEN left(o_orderpriority, 1) IN ('1', '2') THEN 'USD' ELSE 'PHP' END END AS source,
                CAST(round(CAST(o_totalprice AS DECIMAL(18,2)) * 100) AS BIGINT) AS total_cents FROM orders),
line AS (SELECT role.*, source, target, CASE WHEN source = target THEN CAST(rate * 100 AS BIGINT) WHEN source = 'PHP' THEN (2 * CAST(rate * 100 AS BIGINT) + 60) // 120
                ELSE CAST(rate * 100 AS BIGINT) * 60 END AS price_cents FROM role JOIN head USING (quote_id) WHERE hours > 0 AND rate > 0),
sums AS (SELECT quote_id, count(*) AS n, sum(CAST(hours AS BIGINT) * price_cents) AS cents FROM line GROUP BY quote_id),
tot AS (SELECT head.quote_id, target, coalesce(n, 1) AS n, coalesce(cents, CASE WHEN source = target THEN total_cents WHEN source = 'PHP' THEN (2 * total_cents + 60) // 120
                 ELSE total_cents * 60 END) AS cents FROM head LEFT JOIN sums USING (quote_id))"""


@query("quote_totals", f"""
WITH {TOTAL_SQL}
SELECT quote_id, target AS currency_code, CASE target WHEN 'PHP' THEN '₱' ELSE '$' END AS symbol, n AS line_count,
       CAST(cents / 100.0 AS DOUBLE) AS subtotal, CAST(((cents * 12 + 50) // 100) / 100.0 AS DOUBLE) AS tax,
       CAST((cents + (cents * 12 + 50) // 100) / 100.0 AS DOUBLE) AS total FROM tot""")
def quote_totals(spark, sf_dir):
    """Order lines as priced roles; the estimate's currency is declared, named in its summary or silent."""
    li = table(spark, sf_dir, "lineitem")
    roles = li.select(F.col("l_orderkey").alias("quote_id"),
                      F.concat("l_returnflag", F.when(F.col("l_linestatus") == "O", " License").otherwise(" engineer")).alias("role"),
                      F.col("l_quantity").cast(DEC).alias("hours"), (F.col("l_discount").cast("decimal(4,2)") * 1000).cast(DEC).alias("rate"))
    o = table(spark, sf_dir, "orders")
    heads = o.select(F.col("o_orderkey").alias("quote_id"), F.when(F.col("o_orderstatus") == "F", "PHP").alias("currency_code"),
                     F.col("o_totalprice").cast(DEC).alias("total_cost"), F.left("o_orderpriority", F.lit(1)).alias("p"),
                     F.when(F.col("o_orderstatus") == "O", F.lit("A total of USD 12,000.00")).otherwise("No amount named").alias("summary"))
    target = F.when(F.col("p").isin("1", "2"), F.lit("USD")).otherwise(F.lit("PHP"))
    out = pricing.quotes(heads, roles, target, F.lit(12).cast("decimal(6,2)"))
    return out.select("quote_id", "currency_code", "symbol", "line_count", *[F.col(c).cast("double").alias(c) for c in ("subtotal", "tax", "total")])


@query("currency_conversion", """
WITH c AS (SELECT c_custkey, CAST(round(CAST(c_acctbal AS DECIMAL(18,2)) * 100) AS BIGINT) AS cents FROM customer)
SELECT c_custkey, CAST(cents * 60 / 100.0 AS DOUBLE) AS to_php, CAST(sign(cents) * ((2 * abs(cents) + 60) // 120) / 100.0 AS DOUBLE) AS to_usd,
       CASE WHEN cents < 0 THEN '$-' ELSE '$' END || format('{:,}', abs(cents) // 100) || '.' || lpad(CAST(abs(cents) % 100 AS VARCHAR), 2, '0') AS shown FROM c""")
def currency_conversion(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    amount = F.col("c_acctbal").cast(DEC)
    return c.select("c_custkey", mn.convert_currency(amount, F.lit("$"), F.lit("pesos")).cast("double").alias("to_php"),
                    mn.convert_currency(amount, F.lit("₱"), F.lit("us dollars")).cast("double").alias("to_usd"),
                    mn.format_money(amount, "$").alias("shown"))


# --------------------------------------------------------------------- estimates
SCOPES = (("ECONOMY", "cloud storage backups"), ("PROMO", "AI models"), ("STANDARD", "data pipelines"), ("MEDIUM", "security audits"),
          ("LARGE", "google workspace"), ("SMALL", "emails and domains"))


def projects(spark, sf_dir):
    """Parts as project briefs: the type gives the scope, the size the timeline and complexity."""
    scope = F.create_map(*[F.lit(x) for pair in SCOPES for x in pair])
    p = table(spark, sf_dir, "part")
    size = F.col("p_size")
    return p.select("p_partkey", F.array("p_name", F.try_element_at(scope, F.col("p_type"))).alias("features"), F.array("p_brand").alias("target_platform"),
                    F.when(size < 20, "low").when(size < 35, "medium").otherwise("high").alias("complexity"),
                    F.when(size >= 10, size / 4.0).alias("timeline_weeks"), "p_retailprice")


def _round2(table_name: str, column: str, source: str) -> str:
    """CTEs rounding a double to two decimals by its exact value, ties to even (Dekker product)."""
    return f"""{table_name}_a AS (SELECT *, {column} * 100.0::DOUBLE AS p_, {column} * 134217729.0::DOUBLE AS c_ FROM {source}),
{table_name}_b AS (SELECT *, c_ - (c_ - {column}) AS hi_, floor(p_) AS lo_ FROM {table_name}_a),
{table_name}_c AS (SELECT *, (hi_ * 100.0::DOUBLE - p_) + ({column} - hi_) * 100.0::DOUBLE AS rest_, p_ - lo_ AS half_ FROM {table_name}_b),
{table_name} AS (SELECT * EXCLUDE (p_, c_, hi_, lo_, rest_, half_), (lo_ + CASE WHEN half_ > 0.5 OR (half_ = 0.5 AND (rest_ > 0 OR (rest_ = 0 AND lo_ % 2 = 1)))
   THEN 1 ELSE 0 END) / 100.0::DOUBLE AS cost FROM {table_name}_c)"""


_ROLES = " UNION ALL ".join(
    [f"SELECT {i} AS n, 'base' AS code, {sql_text(r)} AS role, {dict(fv.ROLE_RATES)[r]} AS php, {float(w)}::DOUBLE AS weekly, 0.0::DOUBLE AS least"
     for i, (r, w) in enumerate(fv.BASE_STAFFING)]
    + [f"SELECT {10 + i}, '{code}', {sql_text(role)}, {php}, {0.0 if weekly is None else weekly}::DOUBLE, {least}::DOUBLE"
       for i, (code, role, php, least, weekly, _) in enumerate(fv.ADD_ONS)])


def _has(column: str, keys) -> str:
    body = "|".join(k.replace(" ", r"\s+") for k in keys)
    return rf"regexp_matches({column}, '(?i)(?:^|[^\p{{L}}\p{{N}}_])(?:{body})(?:e?s)?(?:$|[^\p{{L}}\p{{N}}_])')"


_KEYS = {code: keys for code, _, _, _, _, keys in fv.ADD_ONS}
ESTIMATE_SQL = f"""
brief AS (SELECT p_partkey, p_name || ' ' || CASE p_type {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SCOPES)} END || ' ' || p_brand AS text,
                 CASE WHEN p_size >= 10 THEN round_even(p_size / 4.0::DOUBLE * 10, 0) / 10.0::DOUBLE
                      ELSE round((4.0::DOUBLE + 2 * 1.3::DOUBLE) * 0.8::DOUBLE, 1) END AS weeks FROM part),
flag AS (SELECT *, {", ".join(f"{_has('lower(text)', k)} AS has_{c}" for c, k in _KEYS.items())} FROM brief),
roles AS ({_ROLES}),
item AS (SELECT p_partkey, weeks, n, role, CASE WHEN code = 'base' THEN weeks * weekly WHEN weekly = 0 THEN 1.0::DOUBLE
                ELSE greatest(least, round_even(weeks * weekly * 10, 0) / 10.0::DOUBLE) END AS hours,
                ((2 * CAST(php * 100 AS BIGINT) + 60) // 120) / 100.0::DOUBLE AS rate
         FROM flag, roles WHERE code = 'base' OR (code = 'cloud' AND has_cloud) OR (code = 'storage' AND has_cloud AND has_storage) OR (code = 'ai' AND has_ai)
           OR (code = 'data' AND has_data AND NOT has_ai) OR (code = 'security' AND has_security) OR (code = 'workspace' AND has_workspace)),
raw AS (SELECT *, hours * rate AS x FROM item),
{_round2("priced", "x", "raw")}"""


@query("rate_card_estimate", f"""
WITH {ESTIMATE_SQL}
SELECT p_partkey, any_value(weeks) AS weeks, count(*) AS items, round(sum(cost), 2) AS total_cost FROM priced GROUP BY p_partkey""")
def rate_card_estimate(spark, sf_dir):
    out = pricing.estimate(projects(spark, sf_dir), F.lit("USD"))
    return out.select("p_partkey", "weeks", F.size("items").cast("long").alias("items"), F.round("total_cost", 2).alias("total_cost"))


@query("keyword_costings", f"WITH {ESTIMATE_SQL} SELECT p_partkey, role, hours, rate, cost FROM priced WHERE n >= 10")
def keyword_costings(spark, sf_dir):
    """Add-on line items by whole-word keys, the base roles left out."""
    out = pricing.estimate(projects(spark, sf_dir), F.lit("USD"))
    rows = unnest(out, ["p_partkey"], F.col("items"), "i").filter(F.col("pos") >= len(fv.BASE_STAFFING))
    return rows.select("p_partkey", "i.role", "i.hours", "i.rate", "i.cost")


@query("role_rates", f"""
WITH r AS (SELECT s_suppkey, CASE s_nationkey % 4 WHEN 0 THEN 'Solution Architect' WHEN 1 THEN 'UI/UX Designer' WHEN 2 THEN 'QA Automation Manager' ELSE s_name END AS role,
                  CASE WHEN s_acctbal > 0 THEN 'USD' ELSE 'PHP' END AS target FROM supplier),
c AS (SELECT *, CAST(100 * coalesce(CASE role {" ".join(f"WHEN {sql_text(r)} THEN {v}" for r, v in fv.ROLE_RATES)} END, {fv.DEFAULT_ROLE_RATE}) AS BIGINT) AS cents FROM r)
SELECT s_suppkey, role, CAST(CASE target WHEN 'PHP' THEN cents ELSE (2 * cents + 60) // 120 END / 100.0 AS DOUBLE) AS hourly_rate FROM c""")
def role_rates(spark, sf_dir):
    """Suppliers as contractors: known roles take the card's rate, others the default."""
    kind = F.col("s_nationkey") % 4
    s = table(spark, sf_dir, "supplier").select(
        "s_suppkey", F.when(kind == 0, "Solution Architect").when(kind == 1, "UI/UX Designer").when(kind == 2, "QA Automation Manager")
        .otherwise(F.col("s_name")).alias("role"), F.when(F.col("s_acctbal") > 0, "USD").otherwise("PHP").alias("target"))
    out = pricing.with_rates(s, pricing.rate_card(spark), F.col("target"))
    return out.select("s_suppkey", "role", F.col("hourly_rate").cast("double").alias("hourly_rate"))


@query("phase_calendar", """
WITH p AS (SELECT o_orderkey AS quote_id, l_linenumber, l_partkey, l_suppkey, l_extendedprice, o_orderdate::DATE AS d,
                  CAST(floor(greatest(0, (l_quantity - 5) / 10.0::DOUBLE) * 7) AS INT) AS days FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
s AS (SELECT *, CAST(sum(days) OVER (PARTITION BY quote_id ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS UNBOUNDED PRECEDING) AS INT) AS until FROM p)
SELECT quote_id, l_linenumber, l_partkey, l_suppkey, strftime(d + (until - days), '%Y-%m-%d') AS phase_start, strftime(d + until, '%Y-%m-%d') AS phase_end FROM s""")
def phase_calendar(spark, sf_dir):
    """Order lines as phases of tenths of weeks, chained from the order date."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("start_date"))
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
                                                  ((F.col("l_quantity") - 5) / 10.0).alias("duration_weeks"))
    phases = li.join(o, li.l_orderkey == o.o_orderkey).withColumnRenamed("o_orderkey", "quote_id")
    out = pricing.phase_calendar(phases, order=("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    return out.select("quote_id", "l_linenumber", "l_partkey", "l_suppkey", F.date_format("phase_start", "yyyy-MM-dd").alias("phase_start"),
                      F.date_format("phase_end", "yyyy-MM-dd").alias("phase_end"))


@query("project_phases")
def project_phases(spark, sf_dir):
    """Phase plans of part briefs, checked against a plain implementation in the tests."""
    p = projects(spark, sf_dir).withColumn("names", pricing.clean_features(F.concat("features", "target_platform")))
    p = p.withColumn("weeks", F.coalesce(mn.float_round(F.col("timeline_weeks"), 1), F.lit(3.0)))
    p = p.withColumn("phases", pricing.build_phases(F.col("names"), F.col("weeks"), F.col("complexity")))
    rows = unnest(p, ["p_partkey"], F.col("phases"), "x", "phase")
    return rows.select("p_partkey", "phase", "x.phase_name", "x.duration_weeks", F.array_join("x.milestones", "; ").alias("milestones"))


def _title_sql(column: str) -> str:
    has = {name: _has(column, keys) for name, keys in fv.TITLE_KEYS}
    online = f"({has['web']} OR {has['mobile']})"
    both = f"({has['web']} AND {has['mobile']})"
    rules = ((has["ai"], "Artificial Intelligence — AI/ML Engineering & Model Solutions"),
             (f"{has['data']} AND NOT {online}", "Data Services — Data Engineering & Analytics Platform"),
             (f"{has['cloud']} AND NOT {online}", "Cloud Services — Cloud Architecture & DevOps Infrastructure"),
             (f"{has['qa']} AND NOT {has['not_qa']}", "Quality Assurance — Software Testing & Automation"),
             (f"{has['shop']} AND {both}", "Software Services — E-Commerce Web & Mobile Platform"),
             (has["shop"], "Software Services — E-Commerce Web Application"),
             (f"{has['site']} AND NOT {has['not_site']}", "Software Services — Custom Website & CMS"),
             (both, "Software Services — Web & Mobile Application Platform"),
             (has["mobile"], "Software Services — Mobile Application (iOS/Android)"), (has["web"], "Software Services — Full-Stack Web Application"))
    return "CASE " + " ".join(f"WHEN {c} THEN '{t}'" for c, t in rules) + " ELSE 'Software Services — Custom Software Development' END"


_WORDS = ("web portals", "iOS app", "checkout carts", "email domain", "analytics", "kubernetes", "cms site", "QA testing", "ml", "dashboards")


@query("project_titles", f"""
WITH t AS (SELECT p_partkey, lower({sql_list(_WORDS)}[p_size % 10 + 1] || ' ' || {sql_list(_WORDS)}[p_partkey % 10 + 1] || ' ' || p_name) AS text FROM part)
SELECT p_partkey, {_title_sql("text")} AS title FROM t""")
def project_titles(spark, sf_dir):
    words = F.array(*[F.lit(w) for w in _WORDS])
    p = table(spark, sf_dir, "part")
    text = F.lower(F.concat_ws(" ", F.element_at(words, (F.col("p_size") % 10 + 1).cast("int")),
                               F.element_at(words, (F.col("p_partkey") % 10 + 1).cast("int")), "p_name"))
    return p.select("p_partkey", pricing.project_title(text).alias("title"))


@query("website_price", """
WITH o AS (SELECT p_partkey, p_size + 1 AS pages, CASE p_type WHEN 'ECONOMY' THEN 60000 WHEN 'LARGE' THEN 350000 ELSE 150000 END AS style,
                  CASE WHEN p_size < 10 THEN 0 WHEN p_size < 30 THEN 25000 ELSE 90000 END AS motion, CASE WHEN p_type = 'PROMO' THEN 40000 ELSE 0 END AS layout,
                  p_size % 4 AS rounds, [0, 30000, 55000, 100000][p_partkey % 4 + 1] AS care, (p_type = 'SMALL')::INT * 8000 AS training,
                  [0, 15000, 35000][p_partkey % 3 + 1] AS speed, (p_size > 25)::INT * 6000 AS ga, (p_size > 40)::INT * 4000 AS sc FROM part),
s AS (SELECT *, style + pages * 6000 + motion + layout + rounds * 8000 + care + training + speed + ga + sc AS sub FROM o),
r AS (SELECT *, CAST(round_even(sub * 0.9::DOUBLE / 1000, 0) * 1000 AS BIGINT) AS low, CAST(round_even(sub * 1.15::DOUBLE / 1000, 0) * 1000 AS BIGINT) AS high FROM s)
SELECT p_partkey, CAST(sub AS BIGINT) AS subtotal, low, high, CAST(round_even(low / 56.0::DOUBLE / 50, 0) * 50 AS BIGINT) AS usd_low,
       CAST(round_even(high / 56.0::DOUBLE / 50, 0) * 50 AS BIGINT) AS usd_high,
       CAST(2 + (motion > 0)::INT + (layout > 0)::INT + (rounds > 0)::INT + (care > 0)::INT + (training > 0)::INT + (speed > 0)::INT + (ga > 0)::INT + (sc > 0)::INT AS BIGINT) AS items FROM r""")
def website_price(spark, sf_dir):
    """Parts as website briefs."""
    size, kind = F.col("p_size"), F.col("p_type")
    o = table(spark, sf_dir, "part").select(
        "p_partkey", (size + 1).alias("pages"), F.when(kind == "ECONOMY", "basic").when(kind == "LARGE", "adv").otherwise("mid").alias("style"),
        F.when(size < 10, "none").when(size < 30, "basic").otherwise("adv").alias("animation"),
        F.when(kind == "PROMO", "custom").otherwise("fluid").alias("responsive"), (size % 4).alias("design_revisions"),
        (F.col("p_partkey") % 4).cast("int").alias("maintenance"), (kind == "SMALL").alias("training"), (F.col("p_partkey") % 3).cast("int").alias("speed"),
        (size > 25).alias("google_analytics"), (size > 40).alias("search_console"))
    out = pricing.website_price(o)
    return out.select("p_partkey", "subtotal", "low", "high", "usd_low", "usd_high", F.size("items").cast("long").alias("items"))
