"""Transcribed documents: pages, figures, excerpts, requirement merging and text sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions import sequences as sq
from ..functions import text as tx
from ..functions.exprs import unnest

LIST_FIELDS = ("target_platform", "features", "constraints", "tech_stack")


# ------------------------------------------------------------------------- pages
def split_pages(docs: DataFrame, text: str = "text") -> DataFrame:
    """(…, pos, page, block) rows: a transcription cut at its page headings.

    A text without headings is one block numbered 1; an empty one gives no rows.
    """
    body = F.regexp_replace(F.col(text), r"(?s)\A---\n.*?\n---\n", "")
    parts = F.filter(F.split(body, r"(?m)(?=^## Page \d+[ \t]*$)"), lambda p: p.rlike(r"(?m)\A## Page \d+[ \t]*$"))
    whole = F.when(tx.strip(body) != "", F.array(tx.strip(body))).otherwise(F.array().cast("array<string>"))
    kept = [c for c in docs.columns if c != text]
    rows = docs.select(*kept, F.when(F.size(parts) > 0, parts).otherwise(whole).alias("__b"))
    rows = unnest(rows, kept, F.col("__b"), "block")
    number = F.regexp_extract("block", r"\A## Page (\d+)", 1)
    return rows.select(*kept, "pos", F.when(number == "", 1).otherwise(number.try_cast("int")).alias("page"),
                       tx.strip(F.col("block")).alias("block"))


def rough_tokens(text: Column) -> Column:
    return F.floor(F.length(text) / fv.CHARS_PER_TOKEN)


def group_pages(pages: DataFrame, size: int = fv.GROUP_PAGES, key: str = "doc", order: str = "pos") -> DataFrame:
    """Runs of ``size`` pages per document: (first_page, last_page, text).  ``order`` is numeric."""
    placed = sq.positions(pages, [key], [order], F.floor(F.col(order) / 4096), "__n")
    run = F.floor(F.col("__n") / size).alias("group")
    items = F.array_sort(F.collect_list(F.struct("__n", "page", "block")))
    grouped = placed.groupBy(key, run).agg(items.alias("i"))
    return grouped.select(key, "group", F.col("i")[0]["page"].alias("first_page"),
                          F.element_at("i", -1)["page"].alias("last_page"),
                          F.array_join(F.transform("i", lambda p: p["block"]), "\n\n").alias("text"))


def needs_grouping(body: Column, pages: Column, budget: int) -> Column:
    """Whether a document is extracted in page groups instead of one pass."""
    return (rough_tokens(body) >= budget) & (pages > 1)


def page_accounting(pages: DataFrame, key: str = "doc") -> DataFrame:
    """Per document: parsed, failed pages, vision pages, truncation and token sums."""
    failed = F.coalesce("failed", F.lit(False))
    out = pages.groupBy(key).agg(
        F.count(F.lit(1)).alias("seen"), F.count_if(failed).alias("failed_count"),
        F.sort_array(F.collect_list(F.when(failed, F.col("page")))).alias("pages_failed"),
        F.count_if(F.col("source") == "vision").alias("pages_via_vision"),
        F.max("pages_total").alias("pages_total"),
        *[F.coalesce(F.sum(f"usage.{k}"), F.lit(0)).cast("long").alias(k)
          for k in ("prompt_tokens", "completion_tokens", "total_tokens")])
    return out.withColumns({"pages_parsed": F.col("seen") - F.col("failed_count"),
                            "truncated": F.col("seen") < F.col("pages_total")})


# ----------------------------------------------------------------------- figures
def normalize_figures(text: Column) -> Column:
    """Rewrite figure lines: one block per line, template brackets removed, repeated sentences dropped.

    Other lines stay as they are.  Repeats are found over the whole page.
    """
    mark = tx.I + fv.FIGURE_MARK
    lines = F.split(text, r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]")
    lines = F.when(text.rlike(r"(?:\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ])\z"),
                   F.slice(lines, 1, F.greatest(F.size(lines) - 1, F.lit(0)))).otherwise(lines)

    def payloads(line: Column) -> Column:
        parts = F.split(line, mark)
        return F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))),
                           lambda p: tx.strip(F.ltrim(tx.strip(p), F.lit(">"))))

    def unbracket(p: Column) -> Column:
        return F.when(p.rlike(r"(?s)^<[^<>]*>\z"), tx.strip(F.substr(p, F.lit(2), F.length(p) - 2))).otherwise(p)

    def entry(line: Column, at: Column, part: Column, key: Column, shown: Column) -> Column:
        return F.struct(key.alias("key"), at.alias("pos"), line.alias("line"), part.alias("part"), shown.alias("shown"))

    def line_entries(line: Column, i: Column) -> Column:
        figure = line.rlike(tx.I + fv.FIGURE_LINE)
        told = F.flatten(F.transform(payloads(line), lambda p, j: F.transform(
            F.split(unbracket(p), rf"(?<=[.!?]){tx.SPACE}+"), lambda s, n: entry(
                i, F.struct(i.alias("line"), j.alias("part"), n.alias("n")), j, tx.sentence_key(s),
                F.regexp_replace(tx.strip(s), tx.I + fv.RESTATEMENT, "")))))
        told = F.filter(told, lambda e: e["key"] != "")
        plain = F.array(entry(i, F.struct(i.alias("line"), F.lit(-1).alias("part"), F.lit(0).alias("n")), F.lit(-1), F.concat(F.lit("\x00"), i.cast("string")), line))
        return F.when(figure, told).otherwise(plain)

    kept = tx.keep_first_by_key(F.flatten(F.transform(lines, line_entries)), ["line", "part", "shown"])
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(-1).alias("line"), F.lit(-2).alias("part"))

    def step(acc: Column, e: Column) -> Column:
        plain = e["part"] == -1
        same = (acc["line"] == e["line"]) & (acc["part"] == e["part"])
        size = F.size(acc["out"])
        longer = F.concat(F.slice(acc["out"], 1, F.greatest(size - 1, F.lit(0))),
                          F.array(F.concat_ws(" ", F.get(acc["out"], size - 1), e["shown"])))
        fresh = F.concat(acc["out"], F.array(F.concat(F.lit("> **Figure:** "), e["shown"])))
        out = F.when(plain, F.concat(acc["out"], F.array(e["shown"]))).when(same, longer).otherwise(fresh)
        return F.struct(out.alias("out"), e["line"].alias("line"), e["part"].alias("part"))

    rewritten = F.aggregate(kept, start, step, lambda acc: F.array_join(acc["out"], "\n"))
    some = F.exists(lines, lambda line: line.rlike(tx.I + fv.FIGURE_LINE)
                    & F.exists(payloads(line), lambda p: p != ""))
    return F.when(some, rewritten).otherwise(text)


# ---------------------------------------------------------------------- excerpts
_PAGE_MARK = r"(?m)^## Page (\d+)"


def _excerpt_spans(text: Column, needle: Column, limit: int | None) -> Column:
    """Array of struct(start, end, hit): windows around the hits of ``needle``, each search going on behind the last window.

    The text is split in front of every hit, so the lengths of the parts are the places of the hits; a fold over the
    parts passes over hits inside the last window and lengthens a window that the next one touches.
    """
    quoted = F.concat(F.lit("(?iu)(?=\\Q"), F.replace(needle, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E)"))
    n, window = F.length(text), fv.EXCERPT_WINDOW
    begins = F.lower(F.left(text, F.length(needle))) == F.lower(needle)
    parts = F.transform(F.split(text, quoted), lambda p, i: F.struct(F.length(p).alias("n"), ((i > 0) | begins).alias("hit")))

    def step(acc: Column, part: Column) -> Column:
        at, spans = acc["at"], acc["spans"]
        low, high = F.greatest(F.lit(0), at - window // 4), F.least(n, at + window)
        last = F.get(spans, F.size(spans) - 1)
        touches = F.coalesce(low <= last["end"], F.lit(False))
        longer = F.concat(F.slice(spans, 1, F.size(spans) - 1), F.array(F.struct(
            last["start"].alias("start"), F.greatest(last["end"], high).alias("end"), last["hit"].alias("hit"))))
        added = F.concat(spans, F.array(F.struct(low.alias("start"), high.alias("end"), at.alias("hit"))))
        counts = part["hit"] & (at >= acc["resume"])
        if limit is not None:
            counts = counts & (F.size(spans) < limit)
        return F.struct((at + part["n"]).alias("at"), F.when(counts, high).otherwise(acc["resume"]).alias("resume"),
                        F.when(counts & touches, longer).when(counts, added).otherwise(spans).alias("spans"))

    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("resume"),
                     F.array().cast("array<struct<start:int,end:int,hit:int>>").alias("spans"))
    return F.when(F.length(needle) > 0, F.aggregate(parts, start, step, lambda acc: acc["spans"]))


def excerpts(docs: DataFrame, text: str, needle: str, limit: int | None = None) -> DataFrame:
    """Windows around the hits of a search word, overlaps merged, labelled with the page of the first hit; at most ``limit`` a document."""
    hay = F.when(F.lower(F.col(text)).contains(F.lower(F.col(needle))), F.col(text))
    rows = docs.withColumn("__s", _excerpt_spans(hay, F.col(needle), limit))
    rows = unnest(rows, docs.columns, F.col("__s"), "span", "excerpt")
    # The last page heading up to the line of the hit.
    behind = F.substr(F.col(text), F.col("span.hit") + 1, F.length(F.col(text)))
    upto = F.concat(F.left(F.col(text), F.col("span.hit")), F.substring_index(behind, "\n", 1))
    pages = F.regexp_extract_all(upto, F.lit(_PAGE_MARK), F.lit(1))
    label = F.when(F.size(pages) > 0, F.concat(F.lit("Page "), F.get(pages, F.size(pages) - 1))).otherwise(F.lit("start of document"))
    return rows.select(
        *docs.columns, "excerpt", F.col("span.start").alias("start"), F.col("span.end").alias("end"),
        label.alias("page_label"),
        tx.strip(F.substr(F.col(text), F.col("span.start") + 1, F.col("span.end") - F.col("span.start"))).alias("excerpt_text"))


# ------------------------------------------------------------------ requirements
def merge_key(value: Column) -> Column:
    """Case- and white-space-insensitive comparison key."""
    return F.lower(F.array_join(tx.words(value), " "))


def complexity_category(value: Column) -> Column:
    label = F.lower(tx.strip(value))
    return (F.when(label.isin("easy", "low", "simple"), F.lit("easy"))
            .when(label.isin("hard", "high", "complex"), F.lit("hard")).otherwise(F.lit("standard")))


def ordered_union(values: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """Distinct values per key as an array, first spelling and first position kept."""
    named = values.withColumn("__k", merge_key(F.col(value))).filter(F.col("__k") != "")
    first = named.groupBy(*keys, "__k").agg(F.min(F.struct(*order, tx.strip(F.col(value)).alias("v"))).alias("f"))
    lists = first.groupBy(*keys).agg(F.array_sort(F.collect_list("f")).alias("l"))
    return lists.select(*keys, F.transform("l", lambda e: e["v"]).alias(value))


def merge_requirements(groups: DataFrame, own_notes: DataFrame | None = None, max_notes: int | None = None,
                       note_chars: int | None = None) -> DataFrame:
    """Merge the requirement groups of each document.

    Lists are ordered unions, complexity and category take the maximum, attributes let the
    last group win, and notes are bounded only by ``max_notes`` and ``note_chars``, this pipeline's own ones (``own_notes``: doc, pos,
    note) first.
    """
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("l")) for f in LIST_FIELDS])
    flat = groups.select("doc", "group", F.explode(fields).alias("f"))
    flat = unnest(flat, ["doc", "group", F.col("f.field").alias("field")], F.col("f.l"))
    unions = ordered_union(flat, ["doc", "field"], "value", ["group", "pos"])
    lists = unions.groupBy("doc").agg(*[
        F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in LIST_FIELDS])

    rank = {"low": 0, "medium": 1, "high": 2}
    level = F.create_map(*[F.lit(x) for pair in rank.items() for x in pair])
    category = complexity_category(F.col("project_category"))
    category_rank = F.when(category == "easy", 0).when(category == "hard", 2).otherwise(1)
    scalars = groups.groupBy("doc").agg(
        F.max(F.try_element_at(level, F.lower(tx.strip(F.col("complexity"))))).alias("c"),
        F.max(F.when(F.coalesce("project_category", F.lit("")) != "", category_rank)).alias("g"))
    scalars = scalars.select(
        "doc", F.element_at(F.array(*[F.lit(n) for n in rank]), F.coalesce("c", F.lit(1)) + 1).alias("complexity"),
        F.element_at(F.array(F.lit("easy"), F.lit("standard"), F.lit("hard")),
                     F.coalesce("g", F.lit(1)) + 1).alias("project_category"))

    attributes = groups.select("doc", "group", F.explode("category_attributes").alias("k", "v"))
    attributes = attributes.groupBy("doc", "k").agg(F.max_by("v", "group").alias("v"))
    attributes = attributes.groupBy("doc").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("category_attributes"))

    notes = groups.select("doc", F.lit(1).alias("src"), "group", F.posexplode("extraction_notes").alias("pos", "note"))
    if own_notes is not None:
        notes = own_notes.select("doc", F.lit(0).alias("src"), F.lit(0).alias("group"), "pos", "note").unionByName(notes)
    named = notes.withColumn("__k", merge_key(F.col("note"))).filter(F.col("__k") != "")
    first = named.groupBy("doc", "__k").agg(F.min(F.struct("src", "group", "pos", tx.strip(F.col("note")).alias("v"))).alias("f"))
    ranked = first.withColumn("n", F.row_number().over(Window.partitionBy("doc").orderBy("f")))
    kept = (ranked if max_notes is None else ranked.filter(F.col("n") <= max_notes)).groupBy("doc").agg(F.array_sort(F.collect_list("f")).alias("l"))
    kept = kept.select("doc", F.transform("l", lambda e: e["v"] if note_chars is None else F.left(e["v"], F.lit(note_chars))).alias("extraction_notes"))

    out = scalars
    for part in (lists, attributes, kept):
        out = out.join(part, "doc", "left")
    none = F.array().cast("array<string>")
    return out.withColumns({c: F.coalesce(c, none) for c in (*LIST_FIELDS, "extraction_notes")})


# -------------------------------------------------------------------- text sizes
def text_metrics(files: DataFrame, text: str = "text", tokens: str = "tokens") -> DataFrame:
    """Add lines, words, characters and tokens per word."""
    out = files.withColumns({"lines": tx.line_count(F.col(text)), "words": tx.word_count(F.col(text)),
                             "characters": F.length(text)})
    return out.withColumn("tokens_per_word", F.coalesce(F.try_divide(
        F.col(tokens).cast("double"), F.nullif(F.col("words"), F.lit(0))), F.lit(0.0)))


def token_shares(files: DataFrame, tokens: str = "tokens") -> DataFrame:
    """Add each file's share of all tokens, in percent (a join with a one-row total, not a global window)."""
    total = files.agg(F.sum(tokens).alias("__total"))
    share = F.coalesce(F.try_divide(F.col(tokens).cast("double"), F.nullif(F.col("__total"), F.lit(0))), F.lit(0.0)) * 100
    return files.crossJoin(F.broadcast(total)).withColumn("share_pct", share).drop("__total")


def token_summary(metrics: DataFrame, keys: list[str] | None = None, tokens: str = "tokens") -> DataFrame:
    out = metrics.groupBy(*(keys or [])).agg(
        F.count(F.lit(1)).alias("total_files"), F.sum("lines").alias("total_lines"),
        F.sum("words").alias("total_words"), F.sum("characters").alias("total_characters"),
        F.sum(tokens).alias("total_tokens"))
    return out.withColumn("avg_tokens_per_word", F.coalesce(F.try_divide(
        F.col("total_tokens").cast("double"), F.nullif(F.col("total_words"), F.lit(0))), F.lit(0.0)))
