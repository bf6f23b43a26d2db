"""Raw pages to title and Markdown, as a scan of tag tokens with running depths.

A page becomes one row per tag, with the text that follows it.  Windows over a page find each element's end (the next tag of its name at its
depth), so chrome, the content root, the heading and the lists are intervals of positions, and the Markdown is one aggregate over
the pieces that stand outside the chrome.  The pages are shuffled once.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions import text as tx
from ..functions.exprs import let, unnest

_VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr", "page")
_BLOCK = ("p", "div", "section", "article", "main", "header", "footer", "nav", "aside", "ul", "ol", "table", "blockquote", "figure", "form", "dl", "dt", "dd", "address", "figcaption",
          "details", "summary", "fieldset", "body")
_TABLE = ("table", "thead", "tbody", "tfoot", "tr")
_LISTS, _CELLS, _HEADINGS = ("ul", "ol"), ("td", "th"), ("h1", "h2", "h3", "h4", "h5", "h6")
_MARKED = {"b": "bold", "strong": "bold", "i": "italic", "em": "italic", "code": "code"}

#: What is no mark-up of the page: comments, declarations, and elements whose content is not parsed.
_UNREAD = r"(?is)<!--.*?(?:-->|\z)|<(script|style|textarea|iframe|xmp|noembed|noframes)\b[^>]*+>.*?(?:</\1\s*+>|\z)|<[!?][^>]*+>"
#: Whole chrome elements that hold neither another of their name nor a heading or title: they go before the page is cut into tags.
_PLAIN_CHROME = rf"(?i)<({'|'.join(t for t in fv.CHROME_TAGS if t != 'script' and t != 'style')})\b[^>]*+>[^<]*+(?:<(?!/?(?:\1|h1|title)\b)[^<]*+)*+</\1\s*+>"
_BARE_SIGN = r"<(?!/?[A-Za-z])"
_TAG = r"""(?:</?[A-Za-z][^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+)*+>|</?[A-Za-z][^>]*+>)"""

#: Characters of html that one task of the windows holds, whatever the size of the table.
_TASK_CHARS = 8 << 20

# Stand-ins for mark-up until the pieces are joined: noncharacters, which no text holds.
_BREAK, _QUOTE, _LINE, _ROW, _HASH, _OPEN, _CLOSE, *_PAIRS = (chr(code) for code in range(0xFDD0, 0xFDDD))
_ON, _OFF = dict(zip(("bold", "italic", "code"), _PAIRS[:3])), dict(zip(("bold", "italic", "code"), _PAIRS[3:]))
_SIGN = {"bold": "**", "italic": "*", "code": "`"}


def _attribute(name: str) -> Column:
    value = F.regexp_extract("markup", rf"""(?is)[\s"']{name}\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", 1)
    return F.btrim(value, F.lit("\"'"))


def _chrome() -> Column:
    """Whether a start tag opens chrome; attributes are looked at where a tag has some."""
    classes, ident = _attribute("class"), _attribute("id")
    named = F.arrays_overlap(F.split(classes, r"\s+"), F.array(*[F.lit(c) for c in fv.CHROME_CLASSES]))
    for part in fv.CHROME_CLASS_PARTS:
        named = named | classes.contains(part)
    for part in fv.CHROME_ID_PARTS:
        named = named | ident.contains(part)
    bears = (F.length("markup") > F.length("tag") + 2) & F.lower("markup").rlike(r"[\s\"'](?:class|id)\s*=")
    return F.col("tag").isin(*fv.CHROME_TAGS, "title", "template") | (bears & named)


def _page() -> Window:
    return Window.partitionBy("__page")


def _so_far(through: int = 0):
    return _page().orderBy("pos").rowsBetween(Window.unboundedPreceding, through)


def _later():
    return _page().orderBy(F.col("pos").desc()).rowsBetween(Window.unboundedPreceding, -1)


def _one(flag: Column) -> Column:
    return flag.cast("int")


def _tasks(raw: DataFrame, html: str) -> int:
    """As many tasks as the pages need, so that what one of them sorts does not grow with the table."""
    chars = raw.agg(F.sum(F.length(F.col(html)))).first()[0] or 0
    return max(int(raw.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-chars // _TASK_CHARS))


def page_tags(raw: DataFrame, html: str = "html") -> DataFrame:
    """One row per tag of a page: ``__page, pos, tag, close, markup, text, mate, end, matched, row``.

    ``text`` follows the tag; ``end`` is the position of the element's end tag, or, where it has none, of the end tag that closes it:
    the nearest one around it, for a paragraph also the next block.  ``row`` holds the page's own columns at position 0.
    """
    read = F.regexp_replace(F.coalesce(F.col(html), F.lit("")), _UNREAD, "")
    read = F.regexp_replace(F.regexp_replace(read, _PLAIN_CHROME, ""), _BARE_SIGN, "&lt;")
    found = F.regexp_extract_all(read, F.lit(rf"{_TAG}[^<]*+"), F.lit(0))
    lead = F.regexp_extract(read, "^[^<]*+", 0)
    own = F.struct(*[F.col(f"`{c}`") for c in raw.columns])
    first = F.array(F.struct(F.concat(F.lit("<page>"), lead).alias("token"), own.alias("row")))
    # The page's columns ride in one element, so they are not copied to every tag.
    rest = F.transform(found, lambda t: F.struct(t.alias("token"), F.lit(None).cast(raw.schema).alias("row")))
    pages = raw.select(F.monotonically_increasing_id().alias("__page"), F.concat(first, rest).alias("tokens")).repartition(_tasks(raw, html), "__page")
    tags = unnest(pages, ["__page"], F.col("tokens"), "t").select("__page", "pos", "t.token", "t.row", F.regexp_extract("t.token", f"^{_TAG}", 0).alias("markup"))
    tags = tags.select("__page", "pos", "row", "markup", F.expr("substring(token, length(markup) + 1)").alias("text"), F.col("markup").startswith("</").alias("close"),
                       F.lower(F.regexp_extract("markup", r"^</?([A-Za-z][^\s/>]*)", 1)).alias("tag"))
    tags = tags.withColumn("void", F.col("tag").isin(*_VOID) | (~F.col("close") & F.col("markup").endswith("/>")))
    step = F.when(F.col("void"), 0).when(F.col("close"), -1).otherwise(1)
    same = Window.partitionBy("__page", "tag").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    tags = tags.withColumns({"chars": F.coalesce(F.sum(F.length(tx.strip(F.col("text")))).over(_so_far(-1)), F.lit(0)), "count": F.sum(step).over(same)})
    # Tags of one name at one depth alternate: a start tag's end tag is the next of them, if that is one.
    level = F.when(F.col("close"), F.col("count") + 1).otherwise(F.col("count"))
    peers = Window.partitionBy("__page", "tag", "void", "level").orderBy("pos")
    about = F.struct("pos", "close", "chars", F.when(F.col("tag") == "a", F.col("markup")).alias("markup"))
    tags = tags.withColumn("level", level).withColumns({"after": F.lead(about).over(peers), "before": F.lag(about).over(peers)})
    opened, closed = ~F.col("void") & ~F.col("close") & F.coalesce("after.close", F.lit(False)), F.col("close") & F.coalesce(~F.col("before.close"), F.lit(False))
    tags = tags.withColumns({"opened": opened, "closed": closed, "mate": F.when(opened, F.col("after")).when(closed, F.col("before"))}).drop("after", "before", "count", "level")
    tags = tags.withColumn("depth", F.sum(_one(F.col("opened")) - _one(F.col("closed"))).over(_so_far()) + _one(F.col("closed")))
    around = Window.partitionBy("__page", "depth").orderBy(F.col("pos").desc()).rowsBetween(Window.unboundedPreceding, -1)
    enclosing = F.coalesce(F.last(F.when(F.col("closed"), F.col("pos")), True).over(around), F.max("pos").over(_page()) + 1)
    block = F.last(F.when(~F.col("close") & F.col("tag").isin(*_BLOCK, *_HEADINGS), F.col("pos")), True).over(_later())
    unclosed = F.when(F.col("tag") == "p", F.least(enclosing, F.coalesce(block, enclosing))).otherwise(enclosing)
    return tags.withColumn("end", F.when(F.col("void") | F.col("close"), F.col("pos")).when(F.col("opened"), F.col("mate.pos")).otherwise(unclosed))


def _placed(tags: DataFrame) -> DataFrame:
    """Tags with what lies in chrome or outside the content left out, and where the heading and the title are."""
    start = ~F.col("close")
    # A column of its own, so that it is looked for once.
    tags = tags.withColumn("part", start & _chrome())
    part = F.col("part")
    tags = tags.withColumns({"text_until": F.coalesce(F.max(F.when(part, F.col("end"))).over(_so_far()), F.lit(-1)),
                             "tag_until": F.coalesce(F.max(F.when(part, F.col("end") + _one(F.col("opened") | F.col("void")))).over(_so_far()), F.lit(-1))})
    shown = start & (F.col("tag_until") <= F.col("pos"))
    element = lambda name, where: F.min(F.when(where & (F.col("tag") == name), F.struct("pos", "end"))).over(_page())
    articles = F.count_if(shown & (F.col("tag") == "article")).over(_page())
    root = F.coalesce(element("main", shown), F.when(articles == 1, element("article", shown)), element("body", shown))
    tags = tags.withColumns({"root": root, "h1": element("h1", start), "title": element("title", start)})
    inside = F.col("root").isNotNull() & (F.col("root.pos") <= F.col("pos"))
    within = lambda e: (F.col(f"{e}.pos") <= F.col("pos")) & (F.col("pos") < F.col(f"{e}.end"))
    named = lambda e: F.when(within(e), tx.strip(F.col("text")))
    placed = tags.withColumns({
        "show_text": inside & (F.col("pos") < F.col("root.end")) & (F.col("text_until") <= F.col("pos")),
        "show_tag": inside & (F.col("pos") <= F.col("root.end")) & (F.col("tag_until") <= F.col("pos")), "h1": named("h1"), "title": named("title")})
    # Most tags of a page are not of its content; they have served to find it.
    return placed.drop("root", "text_until", "tag_until", "part").filter(F.col("show_text") | F.col("show_tag") | (F.col("pos") == 0) | F.col("h1").isNotNull() | F.col("title").isNotNull())


def _static_marks() -> Column:
    """What a tag stands for whatever is around it, by its name, with a slash before that of an end tag."""
    marks = {name: _BREAK for tag in (*_BLOCK, *_LISTS, "pre") for name in (tag, "/" + tag)}
    marks |= {name: f"{_BREAK}{_HASH * int(name[1])} " for name in _HEADINGS} | {"/" + name: _BREAK for name in _HEADINGS}
    marks |= {"br": _LINE, "hr": f"{_BREAK}---{_BREAK}", "tr": _ROW + "|", "td": " ", "th": " ", "/td": " |", "/th": " |"}
    return F.create_map(*[F.lit(part) for pair in marks.items() for part in pair])


def _pair_marks() -> Column:
    """What the tags of a whole pair stand for."""
    marks = {name: _ON[kind] for name, kind in _MARKED.items()} | {"/" + name: _OFF[kind] for name, kind in _MARKED.items()}
    marks |= {"pre": f"{_BREAK}```\n", "/pre": f"{_ROW}```{_BREAK}"}
    return F.create_map(*[F.lit(part) for pair in marks.items() for part in pair])


def _pieces(tags: DataFrame) -> DataFrame:
    """The Markdown that each shown tag and text stands for, with stand-ins for breaks and paired marks."""
    tag, shown = F.col("tag"), F.col("show_tag")
    opened, closed, start = F.col("opened") & shown, F.col("closed") & shown, ~F.col("close") & shown
    nesting = lambda names: F.sum(F.when(tag.isin(*names), _one(opened) - _one(closed)).otherwise(0)).over(_so_far())
    counted = lambda names: F.sum(_one(start & tag.isin(*names))).over(_so_far())
    tags = tags.withColumns({"quotes": nesting(["blockquote"]), "pres": nesting(["pre"]), "lists": nesting(_LISTS), "cells": counted(_CELLS), "rows": counted(["tr"])})
    by_list = Window.partitionBy("__page", "lists").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    tags = tags.withColumns({
        "row_start": F.last(F.when(start & (tag == "tr"), F.col("cells")), True).over(_so_far()),
        "table_start": F.last(F.when(start & (tag == "table"), F.col("rows")), True).over(_so_far()),
        "list": F.last(F.when(opened & tag.isin(*_LISTS), F.struct("pos", "tag")), True).over(by_list), "items": F.sum(_one(start & (tag == "li"))).over(by_list)})
    before = F.last(F.when(opened & tag.isin(*_LISTS), F.col("items")), True).over(by_list)
    tags = tags.withColumns({"item": F.col("items") - F.coalesce(before, F.lit(0)), "name": F.concat(F.when(F.col("close"), "/").otherwise(""), tag)})
    item = F.concat(F.lit(_ROW), F.repeat(F.lit("  "), F.greatest(F.col("lists") - 1, F.lit(0))),
                    F.when(F.col("list.tag") == "ol", F.concat(F.col("item").cast("string"), F.lit(". "))).otherwise("* "))
    # The first row of a table is followed by a rule of as many cells.
    first_row = F.col("rows") - F.coalesce("table_start", F.lit(0)) == 1
    rule = F.concat(F.lit(_ROW + "|"), F.repeat(F.lit(" --- |"), F.col("cells") - F.coalesce("row_start", F.lit(0))))
    # ``chars`` counts the text before a tag, so the two of a pair differ by the label.
    link = F.when((tag == "a") & (F.col("opened") | F.col("closed")) & (F.col("mate.chars") != F.col("chars")),
                  F.btrim(F.regexp_extract(F.when(F.col("close"), F.col("mate.markup")).otherwise(F.col("markup")), r"""(?is)[\s"']href\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", 1), F.lit("\"'")))
    tags = tags.withColumn("href", link)
    piece = (F.when((tag == "li") & start, item).when((tag == "tr") & closed & first_row, rule)
             .when(F.col("href") != "", F.when(F.col("close"), F.concat(F.lit(_CLOSE + "("), F.col("href"), F.lit(")"))).otherwise(_OPEN))
             .when((tag == "img") & start, F.concat(F.lit("!["), _attribute("alt"), F.lit("]("), _attribute("src"), F.lit(")")))
             .when(tag.isin(*_LISTS) & (F.col("lists") + _one(closed) > 1), "").when(tag.isin(*_BLOCK) & ~tag.isin(*_LISTS) & (F.col("lists") > 0), " ")
             .otherwise(F.coalesce(F.when(F.col("opened") | F.col("closed"), _pair_marks()[F.col("name")]), _static_marks()[F.col("name")], F.lit(""))))
    quoted = F.replace(F.col("piece"), F.lit(_BREAK), F.concat(F.lit(_BREAK), F.repeat(F.lit(_QUOTE), F.col("quotes"))))
    tags = tags.withColumn("piece", F.when(shown, piece).otherwise("")).withColumn("piece", F.when(F.col("quotes") > 0, quoted).otherwise(F.col("piece")))
    between = (tag.isin(*_TABLE) | (tag.isin(*_CELLS) & F.col("close"))) & (F.trim("text") == "")
    text = F.when(~F.col("show_text") | between, "").when(F.col("pres") > 0, F.col("text")).otherwise(F.regexp_replace("text", r"\s+", " "))
    return tags.withColumn("piece", F.concat("piece", text))


def _finished(text: Column) -> Column:
    """Joined pieces as Markdown: stand-ins replaced, white space moved out of marks, at most one blank line."""
    for kind, sign in _SIGN.items():
        text = let(text, lambda t: F.when(t.contains(_ON[kind]), F.regexp_replace(F.regexp_replace(F.regexp_replace(  # noqa: B023
            t, rf"{_ON[kind]}(\s*+){_OFF[kind]}", "$1"), rf"{_ON[kind]}(\s*+)", "$1" + sign), rf"(\s*+){_OFF[kind]}", sign + "$1")).otherwise(t))  # noqa: B023
    text = F.regexp_replace(F.regexp_replace(text, rf"{_OPEN}\s*+", "["), rf"\s*+{_CLOSE}", "]")
    text = F.regexp_replace(text, rf"{_HASH}++[ {_LINE}]*+(?={_BREAK}|\z)", "")
    text = F.regexp_replace(text, rf"[ {_LINE}{_BREAK}{_QUOTE}]*{_BREAK}({_QUOTE}*+) *+", "\n\n$1")
    text = F.regexp_replace(text, rf"[ {_LINE}]*+{_ROW}( *+)(\* |[0-9]++\. |) *+", "\n$1$2")
    text = F.replace(F.translate(F.regexp_replace(text, rf"{_LINE} *+", "  \n"), _HASH, "#"), F.lit(_QUOTE), F.lit("> "))
    return tx.strip(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def extract_pages(raw: DataFrame, title_suffix: str = "", html: str = "html") -> DataFrame:
    """``raw`` with ``title`` and ``markdown`` of each page; a page without html has neither.

    The title is the first heading's text, read before chrome is dropped, else the title element's without the suffix.  The
    content is the first ``main``, else the only ``article``, else the body; a page without a body has none.
    """
    joined = lambda name: F.array_join(F.transform(F.sort_array(F.collect_list(
        F.when(F.col(name) != "", F.struct("pos", F.col(name).alias("part"))))), lambda p: p["part"]), "")
    pages = _pieces(_placed(page_tags(raw, html))).groupBy("__page").agg(
        F.first("row", True).alias("row"), joined("h1").alias("h1"), joined("title").alias("named"), joined("piece").alias("markdown"))
    named = tx.strip(F.regexp_replace(tx.unescape(F.col("named")), f"{re.escape(title_suffix)}\\z", "")) if title_suffix else tx.strip(tx.unescape(F.col("named")))
    title = F.when(F.col("h1") != "", tx.unescape(F.col("h1"))).otherwise(named)
    pages = pages.select(*[F.col(f"row.`{c}`") for c in raw.columns if c not in ("title", "markdown")], title.alias("title"), _finished(F.col("markdown")).alias("markdown"))
    there = F.col(f"`{html}`").isNotNull()
    return pages.withColumns({"title": F.when(there, F.col("title")), "markdown": F.when(there, tx.unescape(F.col("markdown")))})
