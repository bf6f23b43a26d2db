"""Personal data in plain and disguised form, with offsets into the source text.

Transducers rewrite a text and keep, for every output character, the source range it came from: look-alike letters
and foreign digits become ASCII, invisible characters vanish, spelled digits become digits, and ``at``/``dot``
disguises become signs.  Identifiers found in the rewritten text are mapped back to source ranges.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

KINDS = ("email", "ip", "card", "phone")

# The identifier patterns.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

# Letters of other scripts that look like Latin ones, and signs that look like ASCII signs.
_LOOKALIKES = dict(zip("АВЕЅІЈКМНОРСТУХаеорсухіјѕԁԛԝһӏ", "ABESIJKMHOPCTYXaeopcyxijsdqwhl")) | dict(
    zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονα", "ABEZHIKMNOPTYXova")) | dict(
    zip("․。｡‧‐‑‒–—−﹣＋﹢＠﹫（）", "....------" + "-++@@()"))
_INVISIBLE = "­᠎​‌‍‎‏⁠﻿"
_WIDE_SPACES = "              　"
_DIGIT_WORDS = {w: str(d) for d, w in enumerate("zero one two three four five six seven eight nine".split())} | {"oh": "0"}

# Tokens are looked for in the lower-cased text; bare words are held against what stands around them in ``_words``.
_TOKEN = re.compile(
    r"[\[({<]\s*(?:(?P<at>at)|(?P<dot>dot|punkt|point|punto))\s*[\])}>]\s*"
    rf"|\b(?:(?P<bare_at>at)|(?P<bare_dot>dot)|(?P<plus>plus)|(?P<digit>{'|'.join(_DIGIT_WORDS)}))\b")
_BLANKS = re.compile(r"\s+")
_AFTER_PLUS = re.compile(rf"[0-9]|(?:{'|'.join(_DIGIT_WORDS)})\b")
_WORD = re.compile(r"\w")
_LABEL = re.compile(r"[a-z0-9-]+")
_DOT = re.compile(r"(?P<real>\.)|(?P<bracketed>\s*[\[({<]\s*(?:dot|punkt|point|punto)\s*[\])}>]\s*)|\s+(?P<bare>dot)\s+")
_MARKED = re.compile(r"[a-z][0-9]*[._+][a-z]")

# Last labels of domains (all country codes and common others), and words that show prose around a bare "at" or "dot".
_COUNTRIES = """ac ad ae af ag ai al am ao aq ar as at au aw ax az ba bb bd be bf bg bh bi bj bm bn bo br bs bt bv bw by bz ca cc cd cf cg ch ci ck cl
    cm cn co cr cu cv cw cx cy cz de dj dk dm do dz ec ee eg er es et eu fi fj fk fm fo fr ga gb gd ge gf gg gh gi gl gm gn gp gq gr gs gt gu gw gy hk hm
    hn hr ht hu id ie il im in io iq ir is it je jm jo jp ke kg kh ki km kn kp kr kw ky kz la lb lc li lk lr ls lt lu lv ly ma mc md me mg mh mk ml mm mn
    mo mp mq mr ms mt mu mv mw mx my mz na nc ne nf ng ni nl no np nr nu nz om pa pe pf pg ph pk pl pm pn pr ps pt pw py qa re ro rs ru rw sa sb sc sd se
    sg sh si sj sk sl sm sn so sr ss st su sv sx sy sz tc td tf tg th tj tk tl tm tn to tr tt tv tw tz ua ug uk us uy uz va vc ve vg vi vn vu wf ws ye yt
    za zm zw"""
_SURE_LABELS = frozenset("""com org net edu gov info biz dev app io ai co me us uk eu de fr es it nl pt ch at be ca au jp cn in ru br
    example test""".split())
_LAST_LABELS = _SURE_LABELS | frozenset(_COUNTRIES.split()) | frozenset("mil int name pro xyz online site tech cloud email invalid localhost".split())
_PROSE = frozenset("""a an the this that these those each every any some one my your his her its our their which what all both and or but then
    than for from with of on if when while where he she they we you i was were are has had have will would can could not now here there""".split())


def _char_map() -> dict[int, str]:
    table = {ord(c): v for c, v in _LOOKALIKES.items()} | {ord(c): "" for c in _INVISIBLE} | {ord(c): " " for c in _WIDE_SPACES}
    table |= {c: chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
    for c in (*range(0x660, 0x11000), *range(0x1D7CE, 0x1D800)):
        if (d := unicodedata.decimal(chr(c), None)) is not None:
            table[c] = str(d)
    return table


_CHARS = _char_map()
_LATIN_TRIGGERS = tuple(chr(c) for c in _CHARS if c < 256)
_TRIGGER = re.compile("[" + "".join(map(re.escape, map(chr, _CHARS))) + "]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Grows each ``@`` to both sides, so long runs of letters cost one pass."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def plain_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind index, end)`` of undisguised identifiers, in order."""
    out = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(int(p[-4:]) <= 255 and len(p.lstrip("0")) <= 3 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(out)


class Rewritten:
    """A text with ranges replaced, and the source range of every character; each new character stands for its whole range."""

    def __init__(self, source: str | Rewritten, changes: Iterable[tuple[int, int, str]]):
        self.source = source if isinstance(source, Rewritten) else None
        old = source.text if isinstance(source, Rewritten) else source
        # Pieces by their start in the new text: copied ones as (start in the old text, 0), new ones as their old range.
        self.marks: list[int] = []
        self.ranges: list[tuple[int, int]] = []
        parts, at, size = [], 0, 0
        for a, b, new in (*changes, (len(old), len(old), "")):
            for piece, was in ((old[at:a], (at, 0)), (new, (a, b))):
                if piece:
                    self.marks.append(size)
                    self.ranges.append(was)
                    parts.append(piece)
                    size += len(piece)
            at = b
        self.text = "".join(parts)

    def start(self, i: int) -> int:
        """Where the source range of character ``i`` starts."""
        k = bisect_right(self.marks, i) - 1
        a, b = self.ranges[k]
        a = a if b else a + i - self.marks[k]
        return self.source.start(a) if self.source else a

    def end(self, i: int) -> int:
        """Where the source range of character ``i`` ends."""
        k = bisect_right(self.marks, i) - 1
        a, b = self.ranges[k]
        last = b - 1 if b else a + i - self.marks[k]
        return self.source.end(last) if self.source else last + 1


def _characters(text: str) -> Iterator[tuple[int, int, str]]:
    for m in _TRIGGER.finditer(text):
        yield m.start(), m.end(), _CHARS[ord(m[0])]


def _lowered(text: str) -> str:
    """Lower case of the same length, with the letters that Unicode pairs with ``i`` and ``s``."""
    if not text.isascii():
        text = text.replace("\u0130", "i").replace("\u0131", "i").replace("\u017f", "s")
    return text.lower()


def _sign_ahead(low: str, m: re.Match, done: int) -> tuple[int, int]:
    """Range of an at or dot word with the blanks around it, from ``done`` on."""
    (a, b), blanks = m.span(), _BLANKS.match(low, m.end())
    while a > done and low[a - 1].isspace():
        a -= 1
    return a, blanks.end() if blanks else b


def _is_mail(form: str, marked: bool, prose: bool, dots: list[re.Match], forms: set[str], labels: list[str], n: int) -> bool:
    """Whether a bare sign counts in an address of ``n`` dots whose at-sign is ``form`` and whose dots are ``forms``: real, bracketed or bare."""
    last = labels[n]
    if dots[n - 1].lastgroup == "bare" and last in _PROSE:
        return False
    if form != "bare" or "bracketed" in forms:
        return True
    known = last in _LAST_LABELS and (marked or labels[0] not in _PROSE) or last.split("-")[0] in _SURE_LABELS
    if "bare" not in forms:
        # A plain domain after "at" mostly names a place.
        return marked and known and labels[0] != "www"
    return known or last.isalpha() and len(last) > 1 and last not in _DIGIT_WORDS and not prose and (marked or n > 1)


def _mail_signs(low: str, tokens: list[re.Match]) -> set[int]:
    """Where the bare ``at`` and ``dot`` words of addresses stand, in any mixture with real and bracketed signs.

    A candidate is a local part, a sign, and labels with dots between; it is judged as a whole, and the longest that passes is taken.
    """
    found: set[int] = set()
    kinds = {m.lastgroup for m in tokens}
    if "bare_at" not in kinds and "bare_dot" not in kinds:
        return found
    ats = [(*_sign_ahead(low, m, 0), m.start(), "bracketed" if m.lastgroup == "at" else "bare") for m in tokens if m.lastgroup in ("at", "bare_at")]
    if "bare_dot" in kinds:
        at = low.find("@")
        while at >= 0:
            ats.append((at, at + 1, at, "real"))
            at = low.find("@", at + 1)
    for a, b, word, form in ats:
        # A bare sign has blanks on both sides.
        if a == 0 or low[a - 1] not in _LOCAL or form == "bare" and (a == word or b == word + 2):
            continue
        label, dots, labels, ends = _LABEL.match(low, b), [], [], []
        while label:
            labels.append(label[0])
            ends.append(label.end())
            dot = _DOT.match(low, label.end())
            label = _LABEL.match(low, dot.end()) if dot else None
            if label:
                dots.append(dot)
        start = a
        while start > 0 and low[start - 1] in _LOCAL:
            start -= 1
        marked, prose, forms, taken = _MARKED.search(low, start, a) is not None, bool(labels) and labels[0] in _PROSE, set(), 0
        for n, dot in enumerate(dots, 1):
            forms.add(dot.lastgroup)
            prose = prose or labels[n] in _PROSE
            if not _WORD.match(low, ends[n]) and _is_mail(form, marked, prose, dots, forms, labels, n):
                taken = n
        if taken:
            found.update(d.start("bare") for d in dots[:taken] if d["bare"])
            if form == "bare":
                found.add(word)
    return found


def _words(text: str) -> list[tuple[int, int, str]]:
    """Disguised signs, and spelled digits with what stands between two of them.

    Bare ``at`` counts only in a whole address; bare ``dot`` only there or between digits.
    """
    low = _lowered(text)
    tokens = list(_TOKEN.finditer(low))
    mails = _mail_signs(low, tokens)
    found, digit_end, done = [], -1, 0
    for m in tokens:
        kind, (a, b) = m.lastgroup, m.span()
        if kind == "digit":
            # Digits that follow each other closely grow together.
            if digit_end >= 0 and digit_end < a <= digit_end + 2 and not text[digit_end:a].strip(" ,-\t\n"):
                found.append((digit_end, a, ""))
            found.append((a, b, _DIGIT_WORDS[m["digit"]]))
            digit_end = done = b
        elif kind == "plus":
            blanks = _BLANKS.match(low, b)
            if blanks and _AFTER_PLUS.match(low, blanks.end()):
                done = blanks.end()
                found.append((a, done, "+"))
        else:
            a, b = _sign_ahead(low, m, done)
            if kind in ("bare_at", "bare_dot") and m.start() not in mails:
                near_digits = kind == "bare_dot" and a > 0 and (digit_end == a or text[a - 1].isdigit())
                if not near_digits or a == m.start() or b == m.end() or not _WORD.match(low, b):
                    continue
            found.append((a, b, "@" if kind.endswith("at") else "."))
            done = b
    return found


def _has_lookalikes(text: str) -> bool:
    if text.isascii():
        return False
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return _TRIGGER.search(text) is not None
    return any(c in text for c in _LATIN_TRIGGERS)


def _disguised(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind index, end)`` in the source of what only shows once the text is rewritten."""
    rewritten = Rewritten(text, _characters(text)) if _has_lookalikes(text) else None
    if words := _words(rewritten.text if rewritten else text):
        rewritten = Rewritten(rewritten or text, words)
    if not rewritten:
        return []
    return [(rewritten.start(a), kind, rewritten.end(b - 1)) for a, kind, b in plain_spans(rewritten.text)]


def find(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """``(plain spans, all spans)``; a disguised span is added unless a plain one of its kind holds it."""
    plain = plain_spans(text)
    added = [s for s in _disguised(text) if not any(k == s[1] and a <= s[0] and s[2] <= b for a, k, b in plain)]
    return plain, sorted({*plain, *added})


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Spans replaced by ``[KIND]``; overlapping ones share the first one's label."""
    out, at = [], 0
    groups: list[list[int]] = []
    for a, kind, b in sorted(spans):
        if groups and a < groups[-1][2]:
            groups[-1][2] = max(groups[-1][2], b)
        else:
            groups.append([a, kind, b])
    for a, kind, b in groups:
        out += [text[at:a], f"[{KINDS[kind].upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def pii_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``n_email, n_ip, n_card, n_phone`` and ``base_sha256`` of the plain spans, ``spans`` of all.

    A span is ``kind:start:end`` in code points, end exclusive; spans are joined by commas in order of start.
    Defined cases: a null or empty text has no spans; a null id is kept; repeated rows are judged alike; an empty table
    gives no rows; other columns are ignored.
    """
    kind = dict(docs.dtypes)[id_col]

    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for text in rows.column("text").to_pylist():
            plain, every = find(text or "")
            counts = [sum(k == i for _, k, _ in plain) for i in range(4)]
            out.append((*counts, hashlib.sha256(_joined(plain).encode()).hexdigest(), _joined(every)))
        types = [pa.int64()] * 4 + [pa.string()] * 2
        return pa.RecordBatch.from_arrays([rows.column(id_col), *[pa.array(list(x), t) for x, t in zip(zip(*out), types)]],
                                          [id_col, *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    read = docs.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text_col}`").alias("text"))
    return read.mapInArrow(C.per_batch(batch), f"{id_col} {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact_pii(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every found span of ``text_col`` replaced by its kind; a null text stays null."""
    at = docs.columns.index(text_col)

    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        texts = [None if t is None else redacted(t, find(t)[1]) for t in rows.column(at).to_pylist()]
        return rows.set_column(at, rows.schema.field(at).name, pa.array(texts, rows.schema.field(at).type))

    return docs.mapInArrow(C.per_batch(batch), docs.schema)
