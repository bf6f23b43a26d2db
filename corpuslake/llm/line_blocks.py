"""Main text of web pages by the distribution of text over line blocks.

Mark-up is stripped into lines, one per block of the page; a change of container leaves a blank line, as it does in page
sources.  Text lengths are summed over windows of ``WINDOW`` lines.  Text begins at a surge, where the sum passes a threshold, runs back
and on over every window that still holds text, and ends at a dive, where the sum falls to zero.  Lines of menus, forms, adverts, notices
and the like weigh nothing and are never text; where a page marks its article, other lines weigh nothing either.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_batch

#: Lines a window spans, and the most text that a surge must show (less on pages with little text).
WINDOW, SURGE = 3, 86

# Elements by their part in a page, and words that name such parts in class, id and role.
_RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_HEADING = {"h1", "h2", "h3", "h4", "h5", "h6", "hgroup"}
_CHROME = set("nav header footer aside form button select option datalist dialog menu template noscript object svg canvas audio video".split())
_CONTAINER = set("html body div section article main nav header footer aside form ul ol dl table tbody thead tfoot fieldset details figure".split())
_BLOCK = _CONTAINER | _HEADING | set("p li dt dd tr td th caption pre blockquote address figcaption legend summary center hr br head title "
                                     "option button dialog menu search".split())
_CLOSED_BY = {"p": _BLOCK - {"br"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"},
              "option": {"option"}}
_PART = set("ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert "
            "newsletter subscribe subscription signup login popup modal overlay paywall sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs footer "
            "masthead topbar toolbar comment comments reply replies respond disqus discussion share sharing social related recommended recommendations teaser "
            "widget widgets pagination pager skip contentinfo complementary search searchbox form".split())
_ABOUT = {"no", "not", "has", "have", "with", "without"}
_HEADERS = {("header",), ("site", "header"), ("page", "header")}
_NEVER = _HEADING | set("html body main a b i em strong".split())
_MAIN_ROLE = re.compile(r"""\brole\s*=\s*["']?main\b|\bitemprop\s*=\s*["']?articlebody\b""", re.I)
_NAMES = re.compile(r"""\b(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*"[^"]*"|=\s*'[^']*'|[^>])*+)>|<[!?][^>]*(?:>|\Z)""", re.S)


def _is_chrome(tag: str, attributes: str, in_article: bool) -> bool:
    """Whether an element is a part of the page beside the text, by its name or by the names that it bears."""
    if tag in _CHROME and not (tag == "header" and in_article):
        return True
    if not attributes or tag in _NEVER:
        return False
    if _HIDDEN.search(attributes):
        return True
    for match in _NAMES.findall(attributes):
        for name in next(filter(None, match), "").split():
            words = [w for w in re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", name).lower()) if w]
            if words and words[0] not in _ABOUT and (not _PART.isdisjoint(words) or not in_article and tuple(words) in _HEADERS):
                return True
    return False


def page_lines(html: str) -> tuple[list[str], list[bool], list[bool]]:
    """The page's lines, and for each whether it is chrome and whether it lies in a marked article."""
    lines, chrome, article = [], [], []
    stack: list[tuple[str, bool, bool]] = []  # tag, begins chrome, begins an article
    open_tags: Counter[str] = Counter()
    hidden = inside = 0
    text: list[str] = []

    def end_line(blank: bool) -> None:
        joined = " ".join(unescape("".join(text)).split())
        text.clear()
        for line in [joined] * bool(joined) + [""] * blank:
            lines.append(line)
            chrome.append(hidden > 0)
            article.append(inside > 0)

    def pop() -> None:
        nonlocal hidden, inside
        tag, was_hidden, was_article = stack.pop()
        open_tags[tag] -= 1
        hidden -= was_hidden
        inside -= was_article

    at, raw = 0, None
    while at < len(html):
        if raw:
            end = re.compile(rf"</{raw}\b[^>]*(?:>|\Z)", re.I).search(html, at)
            at, raw = (end.end() if end else len(html)), None
            continue
        found = _TOKEN.search(html, at)
        text.append(html[at:found.start() if found else len(html)])
        if not found:
            break
        at = found.end()
        closing, tag, attributes = found.group(1), (found.group(2) or "").lower(), found.group(3) or ""
        if not tag:
            continue
        if tag in _BLOCK:
            end_line(tag in _CONTAINER)
        if closing:
            left = open_tags[tag]
            while left and open_tags[tag] == left:
                pop()
            continue
        if tag in _RAW:
            raw = tag
            continue
        while stack and tag in _CLOSED_BY.get(stack[-1][0], ()):
            pop()
        if tag in _VOID:
            continue
        marked = tag in ("article", "main") or bool(attributes and _MAIN_ROLE.search(attributes))
        part = _is_chrome(tag, attributes, inside > 0)
        stack.append((tag, part, marked and not part))
        open_tags[tag] += 1
        hidden += part
        inside += marked and not part
    end_line(False)
    return lines, chrome, article


def main_text(html: str, window: int = WINDOW, surge: int = SURGE) -> str:
    """Lines between surges and dives of the windows' sums, joined by one space."""
    lines, chrome, article = page_lines(html)
    if not lines:
        return ""
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    text = (sizes > 0) & ~np.array(chrome)
    marked = text & np.array(article)
    if marked.any():
        text, surge = marked, 1
    sums = np.convolve(np.where(text, sizes, 0), np.ones(window, np.int64))  # window i ends at line i
    filled = np.concatenate([[False], sums > 0, [False]])
    edges = np.flatnonzero(filled[1:] != filled[:-1])
    least = min(surge, max(1, int(sums.max()) // 2))
    keep = np.zeros(len(lines) + window, bool)
    for begin, dive in zip(edges[::2], edges[1::2]):
        if sums[begin:dive].max() >= least:
            keep[begin:dive] = True
    return " ".join(line for line, k, t in zip(lines, keep, text) if k and t)


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(id_col, url_col, text, n_chars)``: the main text of every page.

    Defined cases: null or empty html has empty text; repeated pages and null ids or urls are kept as they are; unclosed and
    misnested tags are closed by what holds them; an unterminated comment or script runs to the end; an empty table gives no
    rows; other columns are ignored.
    """
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url"), F.coalesce(F.col(f"`{html_col}`"), F.lit("")).alias("html"))
    kind = rows.schema["page_id"].dataType.simpleString()

    def extract(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(html) for html in batch.column("html").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                                          ["page_id", "url", "text", "n_chars"])

    found = rows.mapInArrow(per_batch(extract), f"page_id {kind}, url string, text string, n_chars long")
    return found.withColumnsRenamed({"page_id": id_col, "url": url_col})
