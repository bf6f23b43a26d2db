"""Crawl planning, page extraction, manifest and index maintenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions import text as tx
from ..sources.schemas import MANIFEST_COLUMNS
from .pages import extract_pages


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the first in ``order``.

    An aggregate, not a window: copies of one key are reduced before the shuffle, so a key
    that holds a third of the table costs no more than any other.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    first = F.min_by(F.struct(*order, *rest), F.struct(*order)) if rest else F.min(F.struct(*order))
    picked = df.groupBy(*keys).agg(first.alias("__row"))
    return picked.select(*[F.col(c) if c in keys else F.col(f"__row.{c}").alias(c) for c in df.columns])


def filter_refs(refs: DataFrame, host: str, skip: str = "/wp-content/", every: bool = False) -> DataFrame:
    """Sitemap references of one host without uploads, the first of each url or, with ``every``, all of them."""
    wanted = refs.filter(F.col("url").contains(host) & ~F.col("url").contains(skip))
    return wanted if every else keep_first(wanted, ["url"], ["pos"])


def union_sitemaps(parts: list[DataFrame], host: str) -> DataFrame:
    """References of several child sitemaps, child order first."""
    out = None
    for child, part in enumerate(parts):
        tagged = part.withColumn("pos", F.struct(F.lit(child).alias("child"), F.col("pos").alias("n")))
        out = tagged if out is None else out.unionByName(tagged)
    return filter_refs(out, host)


def recrawl_condition(force: bool = False) -> Column:
    """Whether a reference joined with its previous row must be fetched."""
    seen = F.col("prev_status").isNotNull() | F.col("prev_lastmod").isNotNull() | F.col("prev_seen")
    empty = (F.coalesce("lastmod", F.lit("")) == "") | (F.coalesce("prev_lastmod", F.lit("")) == "")
    good = F.coalesce(F.col("prev_status").isin("ok", "skipped"), F.lit(False))
    return F.lit(force) | ~F.coalesce(seen, F.lit(False)) | ~good | empty | (F.col("lastmod") != F.col("prev_lastmod"))


def crawl_plan(refs: DataFrame, previous: DataFrame, force: bool = False, limit: int | None = None) -> DataFrame:
    """References with a ``recrawl`` flag; with ``limit`` only the first selected ones keep it.

    A url that is listed or was stored more than once gives a row per pair, and each row counts towards the limit.
    """
    prior = previous.select("url", F.col("status").alias("prev_status"),
                            F.col("lastmod").alias("prev_lastmod"), F.lit(True).alias("prev_seen"))
    plan = refs.join(prior, "url", "left").withColumn("recrawl", recrawl_condition(force))
    if limit is not None:
        chosen = plan.filter("recrawl").orderBy("pos", "url").limit(limit).groupBy("url", "pos").agg(F.count(F.lit(1)).alias("__chosen"))
        among = Window.partitionBy("url", "pos", "recrawl").orderBy("prev_status", "prev_lastmod")
        plan = (plan.join(chosen, ["url", "pos"], "left").withColumn("__n", F.row_number().over(among))
                .withColumn("recrawl", F.col("recrawl") & F.coalesce(F.col("__n") <= F.col("__chosen"), F.lit(False))).drop("__chosen", "__n"))
    return plan.drop("prev_seen")


def carried_rows(previous: DataFrame, plan: DataFrame) -> DataFrame:
    """Previous rows not fetched this run."""
    return previous.join(plan.filter("recrawl").select("url"), "url", "left_anti")


def removed_rows(previous: DataFrame, refs: DataFrame) -> DataFrame:
    """Previous rows that left the sitemap."""
    return previous.join(refs.select("url"), "url", "left_anti")


def skipped_rows(previous: DataFrame, plan: DataFrame) -> DataFrame:
    """Previous rows still in the sitemap and not fetched."""
    return carried_rows(previous, plan).join(plan.select("url"), "url", "left_semi")


def clean_pages(raw: DataFrame, title_suffix: str = "", thin_below: int = fv.THIN_PAGE_CHARS) -> DataFrame:
    """Raw pages (url, html, ...) with title, markdown, length, hash and thin flag."""
    return extract_pages(raw, title_suffix).withColumns({
        "slug": tx.slugify(F.col("url")),
        "text_len": F.length("markdown"),
        "content_hash": F.concat(F.lit("sha256:"), F.sha2(F.col("markdown"), 256)),
        "thin": F.length("markdown") < thin_below})


def manifest(results: DataFrame, carried: DataFrame) -> DataFrame:
    """This run's rows and the carried ones, the latter marked skipped."""
    columns = MANIFEST_COLUMNS
    return results.select(*columns).unionByName(
        carried.withColumn("status", F.lit("skipped")).select(*columns))


def run_report(results: DataFrame, skipped: DataFrame, removed: DataFrame, crawled_at: str,
               last_scrape: str | None) -> DataFrame:
    """One-row run summary.  The scrape time moves only when a page was fetched.

    Failures and thin pages are counted here and listed in full by ``failed_pages`` and
    ``thin_pages``; a list of unbounded length does not belong in one row.
    """
    done = results.agg(
        F.count(F.lit(1)).alias("crawled"),
        F.count_if(F.col("status") == "ok").alias("succeeded"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if((F.col("status") == "ok") & F.col("thin")).alias("thin_content"))
    counts = (skipped.agg(F.count(F.lit(1)).alias("skipped"))
              .crossJoin(removed.agg(F.count(F.lit(1)).alias("removed"))))
    moved = F.when(F.col("succeeded") > 0, F.lit(crawled_at)).otherwise(F.lit(last_scrape))
    return done.crossJoin(counts).withColumns(
        {"run_finished_at": F.lit(crawled_at), "last_successful_scrape": moved})


def failed_pages(results: DataFrame) -> DataFrame:
    return results.filter(F.col("status") == "failed").select("url", "error")


def thin_pages(results: DataFrame) -> DataFrame:
    return results.filter((F.col("status") == "ok") & F.col("thin")).select("url")


def index_diff(pages: DataFrame, stored: DataFrame, missing: DataFrame | None = None,
               force: bool = False, has_chunks: Column | None = None) -> DataFrame:
    """(slug, action): added, updated, skipped or removed.

    ``pages`` has (slug, content_hash), ``stored`` the same for the index, ``missing`` the
    slugs whose file is gone for now and which therefore must stay.  A changed page that
    yields no chunks gets no action; one that leaves the corpus is removed.
    """
    keep_chunks = F.lit(True) if has_chunks is None else has_chunks
    now = pages.select("slug", F.col("content_hash").alias("__now"), keep_chunks.alias("__chunks"),
                       F.lit(True).alias("__page"))
    old = stored.groupBy("slug").agg(F.max("content_hash").alias("__old")).withColumn("__stored", F.lit(True))
    both = now.join(old, "slug", "full_outer")
    if missing is not None:
        both = both.join(missing.select("slug").distinct().withColumn("__safe", F.lit(True)), "slug", "left")
    else:
        both = both.withColumn("__safe", F.lit(None).cast("boolean"))
    same = F.lit(not force) & F.col("__stored").isNotNull() & F.col("__now").eqNullSafe(F.col("__old"))
    action = (F.when(F.col("__page").isNull() & F.col("__safe").isNull(), F.lit("removed"))
              .when(F.col("__page").isNull(), F.lit(None))
              .when(same, F.lit("skipped"))
              .when(~F.col("__chunks"), F.lit(None))
              .when(F.col("__stored").isNull(), F.lit("added"))
              .otherwise(F.lit("updated")))
    return both.select("slug", action.alias("action")).filter(F.col("action").isNotNull())


def fingerprint_lines(rows: DataFrame, hash_present: Column | None = None) -> DataFrame:
    """``slug:hash`` lines.  A null hash prints None; a hash key that was absent prints nothing."""
    shown = F.coalesce("content_hash", F.lit("None"))
    if hash_present is not None:
        shown = F.when(hash_present, shown).otherwise(F.lit(""))
    return rows.select(F.concat_ws(":", "slug", shown).alias("line"))


def fingerprint(lines: DataFrame) -> DataFrame:
    """One row (n, fingerprint), of one form at every size.

    Lines are hashed and equal ones counted.  The hashes are combined in order in three fixed levels: within the first
    five hex digits, within the first three, and all; the groups are even whatever the slugs look like.
    """
    hashed = lines.groupBy("line").agg(F.count(F.lit(1)).alias("n")).withColumn("h", F.sha2("line", 256))
    level = hashed.select(F.substring("h", 1, 5).alias("prefix"), F.concat_ws(":", "h", "n").alias("digest"), "n")

    def combined(digest: str) -> Column:
        return F.sha2(F.array_join(F.sort_array(F.collect_list(digest)), "\n"), 256)

    for digits in (3, 0):
        level = level.groupBy("prefix").agg(combined("digest").alias("digest"), F.sum("n").alias("n"))
        level = level.withColumn("digest", F.concat_ws(":", "prefix", "digest")).withColumn("prefix", F.substring("prefix", 1, digits))
    return level.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n"), F.substring(combined("digest"), 1, 16).alias("fingerprint"))


def corpus_fingerprint(rows: DataFrame) -> str:
    """Fingerprint text of a manifest, ``n:hash16``."""
    row = fingerprint(fingerprint_lines(rows)).first()
    return f"{row['n']}:{row['fingerprint']}"
