"""Rate cards, estimates, quotes, phases and website prices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions import money as mn
from ..functions import sequences as sq
from ..functions import text as tx
from ..functions.exprs import let

RATE = "decimal(18,2)"


def rate_card(spark: SparkSession, rates=fv.ROLE_RATES) -> DataFrame:
    rows = spark.createDataFrame(list(rates), "role string, rate string")
    return rows.select("role", F.col("rate").cast(RATE).alias("rate"))


def with_rates(rows: DataFrame, card: DataFrame, target: Column, role: str = "role",
               default: str = fv.DEFAULT_ROLE_RATE, pesos_per_dollar: float = fv.PESOS_PER_DOLLAR) -> DataFrame:
    """Add ``hourly_rate`` in the target currency; an unknown role gets the default rate.

    The card is a list somebody maintains by hand; the join is left to the optimizer, which
    broadcasts it on its measured size.
    """
    joined = rows.join(card.withColumnRenamed("role", role), role, "left")
    php = F.coalesce("rate", F.lit(default).cast(RATE))
    return joined.withColumn("hourly_rate", mn.convert_currency(php, F.lit("PHP"), target, pesos_per_dollar)).drop("rate")


# ---------------------------------------------------------------------- estimate
def estimate_weeks(given: Column, features: Column, complexity: Column) -> Column:
    """Given weeks, or a base plus a share per feature, scaled by complexity; one decimal."""
    factor = F.when(complexity.isin("high", "complex"), 1.2).when(complexity.isin("low", "simple"), 0.8).otherwise(1.0)
    count = F.greatest(F.lit(1), features).cast("double")
    return F.when(given > 0, mn.float_round(given, 1)).otherwise(
        mn.float_round((F.lit(4.0) + count * 1.3) * factor, 1))


def _item(role: str, hours: Column, rate: Column) -> Column:
    return let(F.struct(hours.alias("hours"), rate.alias("rate")), lambda v: F.struct(
        F.lit(role).alias("role"), v["hours"].alias("hours"), v["rate"].alias("rate"),
        mn.float_round(v["hours"] * v["rate"], 2).alias("cost")))


def add_on_items(text: Column, weeks: Column, target: Column, pesos_per_dollar: float = fv.PESOS_PER_DOLLAR) -> Column:
    """Array of add-on line items whose keys occur in the text as whole words."""
    asked = {code: tx.has_any_word(text, keys) for code, _, _, _, _, keys in fv.ADD_ONS}
    asked["storage"] = asked["storage"] & asked["cloud"]
    asked["data"] = asked["data"] & ~asked["ai"]
    items = []
    for code, role, php, least, weekly, _ in fv.ADD_ONS:
        rate = mn.convert_currency(F.lit(php), F.lit("PHP"), target, pesos_per_dollar).cast("double")
        hours = F.lit(float(least)) if weekly is None else F.greatest(
            F.lit(float(least)), mn.float_round(weeks * float(weekly), 1))
        items.append(F.when(asked[code], _item(role, hours, rate)))
    return F.array_compact(F.array(*items))


def base_items(weeks: Column, target: Column, pesos_per_dollar: float = fv.PESOS_PER_DOLLAR) -> Column:
    """Array of the four base roles' line items."""
    card = dict(fv.ROLE_RATES)
    items = []
    for role, weekly in fv.BASE_STAFFING:
        rate = mn.convert_currency(F.lit(card[role]), F.lit("PHP"), target, pesos_per_dollar).cast("double")
        hours = weeks * float(weekly)
        items.append(_item(role, hours, rate))
    return F.array(*items)


def estimate(projects: DataFrame, target: Column, features: str = "features", platforms: str = "target_platform",
             complexity: str = "complexity", given_weeks: str = "timeline_weeks") -> DataFrame:
    """Add weeks, line items and total cost of each project (row local, nothing shuffled)."""
    text = F.lower(F.array_join(F.concat(F.coalesce(F.col(features), F.array().cast("array<string>")),
                                         F.coalesce(F.col(platforms), F.array().cast("array<string>"))), " "))
    count = F.size(F.coalesce(F.col(features), F.array().cast("array<string>")))
    out = projects.withColumn("weeks", estimate_weeks(F.col(given_weeks), count, F.col(complexity)))
    out = out.withColumn("__text", text)
    out = out.withColumn("items", F.concat(base_items(F.col("weeks"), target),
                                           add_on_items(F.col("__text"), F.col("weeks"), target)))
    total = F.aggregate("items", F.lit(0.0), lambda acc, i: acc + i["cost"])
    return out.withColumn("total_cost", mn.float_round(total, 2)).drop("__text")


def clean_features(features: Column) -> Column:
    """Readable feature names: argument prefix and quotes removed, lists split, long names cut at a word."""
    kept = F.filter(features, lambda f: f.isNotNull() & (f != ""))
    named = F.transform(kept, lambda f: F.btrim(F.regexp_replace(
        tx.strip(f), r"(?i)^(?:scope_input|features|input_data)\s*=\s*[\"']?", ""), F.lit("\"' ")))
    parts = F.flatten(F.transform(named, lambda f: F.split(f, r"(?i)[,;\n\r]+|\band\b")))
    bare = F.filter(F.transform(parts, lambda p: F.btrim(p, F.lit(" .-\t\"'"))), lambda p: F.length(p) >= 3)
    short = F.transform(bare, lambda p: F.when(F.length(p) > 50, _cut_at_word(p, 50)).otherwise(p))
    distinct = F.array_distinct(short)
    return F.when(F.size(distinct) > 0, distinct).otherwise(F.array(F.lit("Core Platform Features")))


def _cut_at_word(text: Column, size: int) -> Column:
    head = F.regexp_replace(F.left(text, F.lit(size)), r"(?s)^(.*) .*$", "$1")
    return F.rtrim(head, F.lit(" ,;-&."))


def _phase(name: Column, weeks: Column, milestones: Column) -> Column:
    return F.struct(name.alias("phase_name"), weeks.alias("duration_weeks"), milestones.alias("milestones"))


def phase_cap(complexity: Column) -> Column:
    caps = F.create_map(*[F.lit(x) for pair in fv.PHASE_CAPS for x in pair])
    return F.coalesce(F.try_element_at(caps, F.lower(tx.strip(F.coalesce(complexity, F.lit("standard"))))), F.lit(6))


def clamp_phases(phases: Column, cap: Column) -> Column:
    """Fold phases 2, 3, ... together until ``cap`` remain (never below two)."""
    def fold(v: Column) -> Column:
        every, merges = v["phases"], v["merges"]
        folded = F.slice(every, F.lit(2), merges + 1)
        weeks = F.aggregate(folded, F.lit(0.0), lambda acc, p: mn.float_round(acc + p["duration_weeks"], 1))
        merged = _phase(F.get(every, F.lit(1))["phase_name"], weeks,
                        F.flatten(F.transform(folded, lambda p: p["milestones"])))
        rest = F.slice(every, merges + 3, F.greatest(F.size(every), F.lit(1)))
        return F.when(merges > 0, F.concat(F.slice(every, 1, 1), F.array(merged), rest)).otherwise(every)

    def measured(every: Column) -> Column:
        return F.struct(every.alias("phases"), F.greatest(F.lit(0), F.least(
            F.size(every) - cap, F.size(every) - 2)).alias("merges"))

    return let(let(phases, measured), fold)


def _quick_phases(features: Column, weeks: Column) -> Column:
    def both(half: Column) -> Column:
        return F.array(
            _phase(F.lit("Phase 1: Discovery & Rapid Implementation"), half, F.array(
                F.lit("Architecture & Specs"),
                F.concat(F.lit("Core Deliverables: "), F.array_join(F.slice(features, 1, 2), ", ")))),
            _phase(F.lit("Phase 2: QA, Acceptance & Deployment"), half, F.array(
                F.lit("End-to-End Testing"), F.lit("Production Launch & Handoff"))))

    return let(mn.float_round(weeks * 0.5, 1), both)


def _full_phases(chunks: Column, weeks: Column) -> Column:
    def development(chunk: Column, i: Column, each: Column) -> Column:
        title = let(F.array_join(F.slice(chunk, 1, 2), " & "),
                       lambda t: F.when(F.length(t) > 45, _cut_at_word(t, 45)).otherwise(t))
        return _phase(F.concat(F.lit("Phase "), (i + 2).cast("string"), F.lit(": Development — "), title), each,
                      F.transform(F.slice(chunk, 1, 4), lambda f: F.concat(F.lit("Deliverable: "), f)))

    def build(v: Column) -> Column:
        edge, each, parts = v["edge"], v["each"], v["chunks"]
        first = _phase(F.lit("Phase 1: Discovery, Strategy & System Architecture"), edge, F.array(
            F.lit("Technical Architecture Specification"), F.lit("UI/UX Wireframes & Project Roadmap")))
        last = _phase(F.concat(F.lit("Phase "), (F.size(parts) + 2).cast("string"),
                               F.lit(": QA, Security Audit & Production Launch")), edge, F.array(
            F.lit("End-to-End QA Regression Testing"), F.lit("Security Audit & Performance Optimization"),
            F.lit("Production Deployment & Handoff")))
        return F.concat(F.array(first), F.transform(parts, lambda c, i: development(c, i, each)), F.array(last))

    def sized(parts: Column) -> Column:
        each = F.greatest(F.lit(0.5), F.greatest(F.lit(1.0), weeks * 0.7) / F.greatest(F.lit(1), F.size(parts)))
        return F.struct(parts.alias("chunks"), mn.float_round(each, 1).alias("each"),
                        mn.float_round(F.greatest(F.lit(0.5), weeks * 0.15), 1).alias("edge"))

    return let(let(chunks, sized), build)


def build_phases(features: Column, weeks: Column, complexity: Column) -> Column:
    """Phase array of a project from its cleaned feature names, weeks and complexity."""
    def plan(v: Column) -> Column:
        names, span, cap = v["features"], v["weeks"], v["cap"]
        step = F.greatest(F.lit(1), F.ceil(F.size(names) / F.greatest(F.lit(1), cap - 2))).cast("int")
        chunks = let(step, lambda n: F.transform(
            F.sequence(F.lit(1), F.size(names), n), lambda a: F.slice(names, a, n)))
        full = clamp_phases(_full_phases(chunks, span), cap)
        return F.when((F.size(names) <= 2) & (span <= 4.0), _quick_phases(names, span)).otherwise(full)

    return let(F.struct(features.alias("features"), weeks.alias("weeks"), phase_cap(complexity).alias("cap")), plan)


def project_title(text: Column, given: Column | None = None,
                  generic: tuple[str, ...] = ("Project Proposal", "Proposal")) -> Column:
    """Title from the service categories named in platforms, features and stack."""
    has = {name: tx.has_any_word(text, keys) for name, keys in fv.TITLE_KEYS}
    qa = has["qa"] & ~has["not_qa"]
    site = has["site"] & ~has["not_site"]
    online = has["web"] | has["mobile"]
    both = has["web"] & has["mobile"]
    title = (F.when(text.isNull(), F.lit("Software Services — Full-Stack Web Application"))
             .when(has["ai"], F.lit("Artificial Intelligence — AI/ML Engineering & Model Solutions"))
             .when(has["data"] & ~online, F.lit("Data Services — Data Engineering & Analytics Platform"))
             .when(has["cloud"] & ~online, F.lit("Cloud Services — Cloud Architecture & DevOps Infrastructure"))
             .when(qa, F.lit("Quality Assurance — Software Testing & Automation"))
             .when(has["shop"] & both, F.lit("Software Services — E-Commerce Web & Mobile Platform"))
             .when(has["shop"], F.lit("Software Services — E-Commerce Web Application"))
             .when(site, F.lit("Software Services — Custom Website & CMS"))
             .when(both, F.lit("Software Services — Web & Mobile Application Platform"))
             .when(has["mobile"], F.lit("Software Services — Mobile Application (iOS/Android)"))
             .when(has["web"], F.lit("Software Services — Full-Stack Web Application"))
             .otherwise(F.lit("Software Services — Custom Software Development")))
    if given is None:
        return title
    name = tx.strip(F.coalesce(given, F.lit("")))
    return F.when((name != "") & ~name.isin(*generic), name).otherwise(title)


# ------------------------------------------------------------------------ quotes
def quote_currency(symbol: Column, code: Column, source_text: Column, requirement_text: Column,
                   estimate_text: Column) -> Column:
    """Currency of a quote: explicit and not dollars, else the first text that names pesos."""
    def peso(text: Column) -> Column:
        return tx.detect_currency(F.coalesce(text, F.lit(""))) == "PHP"

    joined = F.concat_ws(" ", requirement_text, estimate_text)
    return (F.when((F.coalesce(symbol, F.lit("")) != "") & (symbol != "$"), code)
            .when(peso(source_text) | peso(requirement_text) | peso(joined), F.lit("PHP"))
            .otherwise(F.lit("USD")))


def source_currency(declared: Column, summary: Column, target: Column) -> Column:
    """Currency an estimate is in: declared, else named in its summary, else the quote's own."""
    said = F.when(F.coalesce(declared, F.lit("")) != "", mn.normalize_currency(declared))
    return F.coalesce(said, tx.declared_currency(summary), mn.normalize_currency(target))


def quote_items(roles: DataFrame, source: Column, target: Column) -> DataFrame:
    """Priced role rows (quote_id, role, hours, rate) as line items in the target currency."""
    kept = roles.filter((F.col("hours") > 0) & (F.col("rate") > 0))
    low = F.lower("role")
    price = F.when(source == target, mn.money(F.col("rate"))).otherwise(
        mn.convert_currency(F.col("rate"), source, target))
    items = kept.withColumns({
        "unit": F.when(low.contains("license") | low.contains("add-on"), F.lit("license")).otherwise(F.lit("hrs")),
        "quantity": mn.money(F.col("hours")), "unit_price": price})
    return items.withColumn("line_total", mn.money(F.col("quantity") * F.col("unit_price")))


def quotes(estimates: DataFrame, roles: DataFrame, target: Column, tax_rate: Column) -> DataFrame:
    """Quote rows with derived money; every step is rounded to cents, half up.

    ``estimates`` has (quote_id, currency_code, total_cost, summary).  Without a priced role a
    positive total becomes one fixed-scope line; with neither the row carries an error.
    """
    heads = estimates.withColumn("target", target).withColumn(
        "source", source_currency(F.col("currency_code"), F.col("summary"), F.col("target")))
    lines = quote_items(roles.join(heads.select("quote_id", "source", "target"), "quote_id"),
                        F.col("source"), F.col("target"))
    sums = lines.groupBy("quote_id").agg(F.sum("line_total").cast(mn.MONEY).alias("lines_total"),
                                         F.count(F.lit(1)).alias("line_count"))
    fixed = F.when(F.col("total_cost") > 0, F.when(F.col("source") == F.col("target"), mn.money(F.col("total_cost")))
                   .otherwise(mn.convert_currency(F.col("total_cost"), F.col("source"), F.col("target"))))
    out = heads.join(sums, "quote_id", "left").withColumn("subtotal", F.coalesce("lines_total", fixed))
    out = out.withColumn("tax", mn.money(F.col("subtotal") * tax_rate / 100))
    return out.select(
        "quote_id", F.col("target").alias("currency_code"),
        F.when(F.col("target") == "PHP", F.lit("₱")).otherwise(F.lit("$")).alias("symbol"),
        F.coalesce("line_count", F.when(fixed.isNotNull(), F.lit(1)).otherwise(F.lit(0))).cast("long").alias("line_count"),
        "subtotal", "tax", mn.money(F.col("subtotal") + F.col("tax")).alias("total"),
        F.when(F.col("subtotal").isNull(), F.lit("nothing priced")).alias("error"))


def phase_calendar(phases: DataFrame, key: str = "quote_id", order: Sequence[str] = ("phase",),
                   weeks: str = "duration_weeks", start: str = "start_date") -> DataFrame:
    """Add start and end dates: each phase begins where the previous one ended.

    Days are whole per phase (a fractional week truncates) and negative durations count as
    nothing.  The first ``order`` column is numeric.
    """
    days = F.floor(F.greatest(F.lit(0.0), F.col(weeks).cast("double")) * 7).cast("int")
    summed = sq.running_sums(phases.withColumn("__days", days), [key], list(order),
                             F.floor(F.col(order[0]) / 4096), {"__until": F.col("__days")})
    return (summed.withColumn("phase_start", F.date_add(F.col(start), (F.col("__until") - F.col("__days")).cast("int")))
            .withColumn("phase_end", F.date_add(F.col(start), F.col("__until").cast("int")))
            .drop("__days", "__until"))


def phase_title(name: Column) -> Column:
    """Phase name without its leading number."""
    bare = tx.strip(F.regexp_replace(name, r"(?i)^\s*(phase\s*\d+\s*[:.\-–]\s*)", ""))
    return F.when(bare == "", tx.strip(name)).otherwise(bare)


# ----------------------------------------------------------------- website price
def _price(table, value: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table for x in pair]), value)


def round_to(value: Column, step: int) -> Column:
    """Nearest multiple of ``step``, ties to even."""
    return (F.rint(value / step) * step).cast("long")


def website_price(options: DataFrame) -> DataFrame:
    """Add items (zero amounts left out), subtotal, range and coarse dollar range; ``problem`` names a bad option."""
    pages, rounds = F.col("pages"), F.col("design_revisions")
    style, motion, layout = (_price(t, F.col(c)) for t, c in (
        (fv.SITE_STYLE, "style"), (fv.SITE_ANIMATION, "animation"), (fv.SITE_RESPONSIVE, "responsive")))
    care = F.get(F.array(*[F.lit(x) for x in fv.SITE_MAINTENANCE]), F.col("maintenance"))
    speed = F.get(F.array(*[F.lit(x) for x in fv.SITE_SPEED]), F.col("speed"))
    problem = (F.when(style.isNull(), F.lit("style")).when(motion.isNull(), F.lit("animation"))
               .when(layout.isNull(), F.lit("responsive")).when(~pages.between(1, 200), F.lit("pages"))
               .when(~rounds.between(0, 3), F.lit("design_revisions")).when(care.isNull(), F.lit("maintenance"))
               .when(speed.isNull(), F.lit("speed")))

    def flag(column: str, amount: int) -> Column:
        return F.when(F.col(column), amount).otherwise(0)

    amounts = [("design base", style), ("pages", pages * fv.SITE_PER_PAGE), ("animation", motion),
               ("per-device design", layout), ("design revisions", rounds * fv.SITE_PER_REVISION),
               ("maintenance", care), ("training", flag("training", fv.SITE_TRAINING)), ("speed", speed),
               ("analytics", flag("google_analytics", fv.SITE_ANALYTICS)),
               ("search console", flag("search_console", fv.SITE_SEARCH_CONSOLE))]
    items = F.filter(F.array(*[F.struct(F.lit(n).alias("label"), a.cast("long").alias("amount")) for n, a in amounts]),
                     lambda i: i["amount"] > 0)
    out = options.withColumn("problem", problem).withColumn("items", F.when(problem.isNull(), items))
    out = out.withColumn("subtotal", F.aggregate("items", F.lit(0).cast("long"), lambda acc, i: acc + i["amount"]))
    out = out.withColumns({"low": round_to(F.col("subtotal") * fv.SITE_LOW, fv.SITE_ROUNDING),
                           "high": round_to(F.col("subtotal") * fv.SITE_HIGH, fv.SITE_ROUNDING)})
    return out.withColumns({f"usd_{c}": round_to(F.col(c) / fv.SITE_PESOS_PER_DOLLAR, fv.SITE_USD_ROUNDING)
                            for c in ("low", "high")})
