"""Text functions as column expressions (JVM side unless stated)."""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import fixed_values as fv
from .exprs import let

# Python-like matching in Java: Unicode classes and case folding.
I = "(?iUd)"
IM = "(?imUd)"
# White space as Python's str methods see it, as a character list and as a regex class.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
SPACE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def strip(value: Column) -> Column:
    """Trim all Unicode white space at both ends."""
    return F.btrim(value, F.lit(SPACES))


def any_of(words: Iterable[str]) -> str:
    """Pattern for plain containment of any word (list order decides between equal starts)."""
    return "(?:" + "|".join(re.escape(w) for w in words) + ")"


def fold(value: Column) -> Column:
    """Lower case as case-insensitive matching sees it (long s and dotless i included)."""
    return F.lower(F.translate(value, "\u0130\u017f\u0131", "isi"))


def gated(value: Column, literals: Iterable[str], result: Column) -> Column:
    """``result`` for texts that hold one of the literals, null for the rest.

    Every pattern behind ``result`` needs one of the literals, so most texts are settled by
    plain substring scans and never meet the regular expressions.  A literal with capitals
    is looked for as it stands, the others in the folded text.
    """
    def any_literal(low: Column) -> Column:
        hit = F.lit(False)
        for literal in literals:
            hit = hit | F.contains(low if literal == literal.lower() else value, F.lit(literal))
        return hit

    return F.when(let(fold(value), any_literal), result)


def contains_any(value: Column, words: Iterable[str]) -> Column:
    return value.rlike(any_of(words))


def prefix_before(value: Column, pattern: str) -> Column:
    """Text before the first match of ``pattern`` (null when there is no match)."""
    return F.when(value.rlike(I + pattern), F.regexp_extract(value, f"(?isUd)^(.*?)(?:{pattern})", 1))


def whole_word(value: Column, key: str) -> Column:
    """True when ``key`` occurs as a whole word or phrase, plural allowed."""
    body = r"\s+".join(re.escape(part) for part in key.split())
    return value.rlike(rf"{I}(?<!\w){body}(?:e?s)?(?!\w)")


def has_any_word(value: Column, keys: Iterable[str]) -> Column:
    """Whole-word test for several keys in one pass."""
    bodies = "|".join(r"\s+".join(re.escape(p) for p in key.split()) for key in keys)
    return value.rlike(rf"{I}(?<!\w)(?:{bodies})(?:e?s)?(?!\w)")


@F.pandas_udf(T.StringType())
def _unescape(values: pd.Series) -> pd.Series:
    return values.map(html.unescape, na_action="ignore")


def unescape(value: Column) -> Column:
    """Character references decoded; only rows that hold an ampersand cross to Python."""
    return F.coalesce(_unescape(F.when(value.contains("&"), value)), value)


def html_to_text(value: Column, limit: int | None = None) -> Column:
    """Drop script and style blocks and tags, unescape entities, collapse white space."""
    text = F.regexp_replace(value, r"(?is)<(script|style)\b[^>]*>.*?</\1>", " ")
    text = F.regexp_replace(text, r"(?s)<[^>]+>", " ")
    text = strip(F.regexp_replace(unescape(text), rf"{SPACE}+", " "))
    return F.substring(text, 1, limit) if limit else text


def words(value: Column) -> Column:
    """White-space separated words; an empty text has none."""
    return F.filter(F.split(value, rf"{SPACE}+"), lambda w: w != "")


def word_count(value: Column) -> Column:
    return F.size(words(value))


def line_count(value: Column) -> Column:
    """Number of lines; a final line break does not open another line."""
    breaks = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x85\\u2028\\u2029]"
    ends = F.regexp_count(value, F.lit(breaks))
    closed = value.rlike(f"(?s)(?:{breaks})\\z")
    return F.when(value == "", 0).otherwise(ends + F.when(closed, 0).otherwise(1))


def content_words(value: Column) -> Column:
    """Distinct lower-cased words and numbers without stop words, in first-seen order."""
    found = F.regexp_extract_all(value, F.lit(fv.CONTENT_WORD), F.lit(0))
    kept = F.transform(found, F.lower)
    return F.array_except(kept, F.array(*[F.lit(w) for w in fv.STOP_WORDS]))


def novel_words(reply_words: Column, baseline_words: Column) -> Column:
    return F.array_except(reply_words, baseline_words)


def novelty(reply_words: Column, baseline_words: Column) -> Column:
    """Share of the reply's words missing from the baseline; an empty reply scores 0."""
    total = F.size(reply_words)
    return F.when(total == 0, F.lit(0.0)).otherwise(
        F.size(novel_words(reply_words, baseline_words)) / total)


def is_echo(baseline: Column, share: Column, count: Column,
            min_chars: int = fv.ECHO_MIN_BASELINE_CHARS, min_share: float = fv.ECHO_MIN_NOVELTY,
            min_words: int = fv.ECHO_MIN_NOVEL_WORDS) -> Column:
    """A reply that only repeats a long baseline."""
    return (F.length(strip(baseline)) >= min_chars) & (share < min_share) & (count < min_words)


def unusable_reason(value: Column) -> Column:
    """Why a reply cannot be used, or null."""
    text = strip(F.coalesce(value, F.lit("")))
    return (F.when(text == "", F.lit("empty response"))
            .when(text.rlike(I + fv.REFUSAL), F.lit("refusal"))
            .when((F.length(text) < fv.MIN_PAGE_CHARS) & (text != fv.BLANK_PAGE_MARK),
                  F.lit("response too short to be a transcription")))


def clamp_headings(value: Column) -> Column:
    """Level 1 and 2 headings become level 3."""
    return F.regexp_replace(value, "(?m)" + fv.SHALLOW_HEADING, "###")


def sentence_key(sentence: Column) -> Column:
    """Comparison key of a sentence: restating lead-in removed, alphanumerics only."""
    body = strip(F.btrim(strip(sentence), F.lit("<>")))
    body = F.regexp_replace(body, I + fv.RESTATEMENT, "")
    return strip(F.regexp_replace(F.lower(body), "[^a-z0-9 ]+", ""))


def keep_first_by_key(entries: Column, fields: Sequence[str]) -> Column:
    """Of an array of struct(key, pos, ...), the first entry per key as struct(pos, *fields) in position order.

    Sort by (key, pos), keep entries whose predecessor has another key, sort back: the
    cost is n log n inside the row and nothing is shuffled.
    """
    def firsts(ordered: Column) -> Column:
        kept = F.filter(ordered, lambda e, i: (i == 0) | (e["key"] != F.get(ordered, i - 1)["key"]))
        return F.transform(kept, lambda e: F.struct(e["pos"].alias("pos"), *[e[f].alias(f) for f in fields]))

    return F.array_sort(let(F.array_sort(entries), firsts))


def dedupe_sentences(value: Column, text_pattern: str = rf"(?<=[.!?]){SPACE}+") -> Column:
    """Drop sentences already seen in the same text; kept ones lose a restating lead-in."""
    parts = F.split(value, text_pattern)
    entries = F.transform(parts, lambda s, i: F.struct(
        sentence_key(s).alias("key"), i.alias("pos"),
        F.regexp_replace(strip(s), I + fv.RESTATEMENT, "").alias("text")))
    kept = keep_first_by_key(F.filter(entries, lambda e: e["key"] != ""), ["text"])
    return F.array_join(F.transform(kept, lambda e: e["text"]), " ")


def _declared(name: str) -> Column | str:
    return rf"{I}{fv.DECLARING_NOUN}[^.\n]{{0,24}}?{fv.DECLARING_CONNECTOR}{name}"


def declared_currency(value: Column) -> Column:
    """PHP, USD or null: declarations first, then amounts, then any dollar token."""
    def count(pattern: str) -> Column:
        return F.regexp_count(value, F.lit(pattern))

    peso_said, dollar_said = count(_declared(fv.PESO_NAME)), count(_declared(fv.DOLLAR_NAME))
    peso_amounts = count(I + fv.PESO_STRONG) + count(I + fv.PESO_AMOUNT)
    dollar_amounts = count(I + fv.DOLLAR_AMOUNT)
    def decide(n: Column) -> Column:
        return (F.when(n["php_said"] + n["usd_said"] > 0,
                       F.when(n["php_said"] >= n["usd_said"], F.lit("PHP")).otherwise(F.lit("USD")))
                .when((n["php"] > 0) & (n["php"] >= n["usd"]), F.lit("PHP"))
                .when(n["usd"] > 0, F.lit("USD"))
                .when(value.rlike(I + fv.DOLLAR_TOKEN), F.lit("USD")))

    counts = F.struct(peso_said.alias("php_said"), dollar_said.alias("usd_said"),
                      peso_amounts.alias("php"), dollar_amounts.alias("usd"))
    return gated(value, fv.CURRENCY_LITERALS, let(counts, decide))


def detect_currency(value: Column) -> Column:
    """Like :func:`declared_currency`, with silence read as USD."""
    return F.coalesce(declared_currency(value), F.lit("USD"))


def _clean_name(value: Column) -> Column:
    text = F.regexp_replace(value, r"\[([^\]]*)\]\([^)]*\)", "$1")
    text = F.regexp_replace(text, r"[*_`~#]", "")
    text = F.element_at(F.split(text, r"\|"), 1)
    return strip(F.btrim(strip(text), F.lit(".,;:")))


def _suggest(value: Column, labels: str) -> Column:
    pattern = rf"{IM}^[ \t>*_#|-]*(?:{labels})[ \t]*[:–-][ \t]*(.+)$"
    names = F.transform(F.regexp_extract_all(value, F.lit(pattern), F.lit(1)), _clean_name)
    usable = F.filter(names, lambda n: (F.length(n).between(2, 80))
                      & ~F.lower(n).isin(*fv.NAME_PLACEHOLDERS) & n.rlike(r"\p{L}"))
    return F.get(usable, F.lit(0))


def suggest_client(value: Column) -> Column:
    """First plausible client name on a labelled line, or null."""
    return _suggest(value, fv.CLIENT_LABELS)


def suggest_project(value: Column) -> Column:
    """First plausible project name on a labelled line, or null."""
    return _suggest(value, fv.PROJECT_LABELS)


def strip_front_matter(value: Column) -> Column:
    """Drop a leading ``---`` block.  An unterminated block stays; a bare closing fence leaves nothing."""
    fence = F.position(F.lit("\n---"), value, F.lit(4))
    line_end = F.position(F.lit("\n"), value, fence + 1)
    rest = F.when(line_end > 0, F.substr(value, line_end + 1)).otherwise(F.lit(""))
    return F.when(value.startswith("---") & (fence > 0), rest).otherwise(value)


def sniff_kind(content: Column) -> Column:
    """File kind by leading bytes: pdf, image, zip or null."""
    def starts(signature: str) -> Column:
        size = len(signature) // 2
        return F.hex(F.substring(content, 1, size)) == signature

    image = starts(fv.MAGIC_IMAGES[0])
    for magic in fv.MAGIC_IMAGES[1:]:
        image = image | starts(magic)
    webp = starts("52494646") & (F.hex(F.substring(content, 9, 4)) == "57454250")
    return (F.when(starts(fv.MAGIC_PDF), F.lit("pdf")).when(image | webp, F.lit("image"))
            .when(starts(fv.MAGIC_ZIP), F.lit("zip")))


def slugify(url: Column) -> Column:
    """Page slug: URL path without outer slashes, inner ones doubled to underscores."""
    path = F.btrim(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), F.lit("/"))
    return F.when(path == "", F.lit("index")).otherwise(F.replace(path, F.lit("/"), F.lit("__")))


def document_links(value: Column) -> Column:
    """Array of struct(pos, label, url) for Markdown links to PDF documents, first per url."""
    pattern = I + fv.DOCUMENT_LINK
    labels = F.regexp_extract_all(value, F.lit(pattern), F.lit(1))
    urls = F.regexp_extract_all(value, F.lit(pattern), F.lit(2))
    entries = F.zip_with(labels, urls, lambda l, u: F.struct(l.alias("label"), u.alias("url")))
    keyed = F.transform(entries, lambda e, i: F.struct(
        e["url"].alias("key"), i.alias("pos"), e["label"].alias("label"), e["url"].alias("url")))
    return F.transform(keep_first_by_key(keyed, ["label", "url"]), lambda e: F.struct(
        e["pos"].alias("pos"),
        F.when(F.btrim(e["label"], F.lit(" *_")) == "", e["url"])
        .otherwise(F.btrim(e["label"], F.lit(" *_"))).alias("label"),
        e["url"].alias("url")))
