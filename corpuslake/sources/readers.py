"""Readers: every input becomes a DataFrame with an explicit schema."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions import text as tx
from . import schemas
from .file_heads import FileHeads

PRESENT = ("ok", "skipped")


def _missing(error: AnalysisException) -> bool:
    return "PATH_NOT_FOUND" in str(error)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Manifest rows of pages that are present (status ok or skipped)."""
    rows = spark.read.schema(schemas.MANIFEST).json(path)
    return rows.filter(F.col("status").isin(*PRESENT))


def _line_order() -> Column:
    """Place of a row in its input: file, start of the block read, row within it."""
    return F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"),
                    F.monotonically_increasing_id().alias("n"))


def read_previous(spark: SparkSession, path: str) -> DataFrame:
    """The previous manifest, last line per url; empty when there is none.

    Lines are ordered by (file, block start, row in block), so "last" does not depend on
    how the file is split over tasks.
    """
    try:
        lines = spark.read.text(path)
    except AnalysisException as error:
        if not _missing(error):
            raise
        return spark.createDataFrame([], schemas.MANIFEST)
    numbered = lines.select(
        F.from_json("value", schemas.MANIFEST).alias("row"),
        _line_order().alias("line"))
    kept = numbered.filter(F.col("row.url") != "")
    return kept.groupBy(F.col("row.url")).agg(F.max_by("row", "line").alias("row")).select("row.*")


def read_sitemap(spark: SparkSession, paths, require_nonempty: bool = False) -> DataFrame:
    """(url, lastmod, pos) of sitemap url sets; entries without a location are dropped.

    ``pos`` orders entries by file and place in the file.
    """
    refs = (spark.read.format("xml").option("rowTag", "url")
            .schema("loc string, lastmod string").load(paths if isinstance(paths, str) else ",".join(paths)))
    loc = tx.strip(F.col("loc"))
    refs = refs.select(loc.alias("url"), tx.strip(F.col("lastmod")).alias("lastmod"),
                       _line_order().alias("pos"))
    refs = refs.filter(F.col("url").isNotNull() & (F.col("url") != ""))
    if require_nonempty and refs.isEmpty():
        raise ValueError("sitemap holds no usable location")
    return refs


def sitemap_locations(xml: Column) -> Column:
    """Locations in a sitemap index held in a text column."""
    found = F.xpath(xml, F.lit("//*[local-name()='sitemap']/*[local-name()='loc']/text()"))
    return F.filter(F.transform(found, tx.strip), lambda loc: loc != "")


def read_page_files(spark: SparkSession, path: str) -> DataFrame:
    """(slug, body) of Markdown page files, front matter removed."""
    files = spark.read.text(path, wholetext=True)
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.md$", 1)
    return files.select(F.try_url_decode(name).alias("slug"), tx.strip_front_matter(F.col("value")).alias("body"))


def load_corpus(manifest: DataFrame, files: DataFrame, min_chars: int = fv.MIN_BODY_CHARS) -> DataFrame:
    """Pages with a body of at least ``min_chars`` characters once trimmed."""
    page = manifest.select("slug", "url", "title", "content_hash").join(files, "slug")
    return page.filter(F.length(tx.strip(F.col("body"))) >= min_chars)


def missing_files(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Slugs listed in the manifest without a page file."""
    return manifest.join(files, "slug", "left_anti").select("slug")


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    """Trace records; corrupt lines are skipped and tool_calls is never null."""
    rows = spark.read.schema(schemas.TRACE).option("mode", "DROPMALFORMED").json(path)
    return rows.withColumn("tool_calls", F.coalesce("tool_calls", F.array().cast("array<string>")))


def recent_records(traces: DataFrame, limit: int | None = None) -> DataFrame:
    """All records oldest first, or the most recent ``limit`` of them, still oldest first."""
    kept = traces if limit is None else traces.orderBy(F.col("ts").desc_nulls_last()).limit(limit)
    return kept.orderBy(F.col("ts").asc_nulls_first())


def read_cases(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Evaluation cases; an absent file is an empty set."""
    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException as error:
        if not _missing(error):
            raise
        return spark.createDataFrame([], schema)


def read_rate_card(spark: SparkSession, path: str) -> DataFrame:
    """(role, rate) rows of an hourly rate card in CSV."""
    return spark.read.option("header", "true").schema("role string, rate decimal(18,2)").csv(path)


def file_inventory(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, kind) of a document drop folder; only the leading bytes decide the kind, and only they are read."""
    spark.dataSource.register(FileHeads)
    files = spark.read.format(FileHeads.name()).load(path)
    return files.select("path", "length", tx.sniff_kind(F.col("head")).alias("kind"))


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """Gold cases with their raw text, so that bad lines can be reported (see ``gold_problems``)."""
    # A gold set is written by hand, so each file is read whole and its lines are counted within it.
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("line", "raw"))
    lines = lines.filter(tx.strip(F.col("raw")) != "")
    parsed = lines.withColumn("case", F.from_json("raw", schemas.GOLD))
    bad = F.try_parse_json("raw").isNull()
    return parsed.select("line", bad.alias("corrupt"), "case.*")


def gold_problems(cases: DataFrame, known_slugs: DataFrame | None = None) -> DataFrame:
    """(id, problem) rows of a gold set; an empty result means the set is valid."""
    valid = cases.filter(~F.col("corrupt"))

    def rule(condition: Column, label: str, rows: DataFrame = valid) -> DataFrame:
        return rows.filter(condition).select(F.coalesce("id", F.lit("")).alias("id"), F.lit(label).alias("problem"))

    has_id = F.coalesce(F.col("id"), F.lit("")) != ""
    has_slug = F.coalesce(F.col("slug"), F.lit("")) != ""
    expect = F.coalesce(F.col("expect"), F.lit(""))
    repeated = valid.filter(has_id).groupBy("id").count().filter("count > 1")
    ids = valid.filter(has_id).select(F.col("id").alias("paraphrase_of")).distinct()
    dangling = valid.filter(F.coalesce("paraphrase_of", F.lit("")) != "").join(ids, "paraphrase_of", "left_anti")
    found = [
        cases.filter("corrupt").select(F.lit("").alias("id"),
                                       F.concat(F.lit("line "), F.col("line") + 1, F.lit(" is not JSON")).alias("problem")),
        rule(~has_id, "missing id"),
        repeated.select("id", F.lit("duplicate id").alias("problem")),
        rule(~expect.isin("retrieve", "abstain"), "unknown expect"),
        rule((expect == "retrieve") & ~has_slug, "retrieve without slug"),
        rule((expect == "abstain") & has_slug, "abstain with slug"),
        rule(F.lit(True), "paraphrase_of is not a case", dangling),
    ]
    if known_slugs is not None:
        unknown = valid.filter(has_slug).join(known_slugs.select("slug").distinct(), "slug", "left_anti")
        found.append(rule(F.lit(True), "slug not in the corpus", unknown))
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out


def require_valid_gold(cases: DataFrame, known_slugs: DataFrame | None = None) -> DataFrame:
    """The cases, or an error naming the first problems."""
    problems = gold_problems(cases, known_slugs).limit(20).collect()
    if problems:
        raise ValueError("; ".join(f"{p['id']}: {p['problem']}" for p in problems))
    return cases.drop("corrupt", "line")
