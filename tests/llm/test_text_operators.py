import hashlib
import itertools
import math
import random
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from corpuslake.llm import common as C
from corpuslake.llm import ngram_join, pii
from corpuslake.llm.decontamination import decontamination, proximity_matches
from corpuslake.llm.ngram_join import component_ids, drop_near_duplicates, near_duplicates
from corpuslake.llm.quality_rules import drop_low_quality, quality_rules


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def sequences(words, length):
    return {tuple(words[i:i + min(length, len(words))]) for i in range(max(1, len(words) - length + 1))} if words else set()


def test_decontamination_matches_plain_version(spark, odd_docs, odd_rows):
    items = [(1, " ".join(odd_rows[0][1].split()[:6]) or "w1é"), (2, odd_rows[30][1]), (10, "W3É"), (11, "no such words here"), (12, None), (13, ""),
             (14, odd_rows[30][1]), (None, odd_rows[31][1]), (2, odd_rows[30][1])]
    got = decontamination(odd_docs, spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, did int"), length=5)
    got = C.keyed(odd_docs).drop("text").join(got, ["did", "dn"]).drop("did", "dn").collect()
    words_of = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t))
    asked = [(i, s) for i, t in items for s in sequences(words_of(t), 5)]
    want = []
    for doc, text in odd_rows:
        words, hit, found = words_of(text), set(), set()
        for item, s in asked:
            for a in range(len(words) - len(s) + 1):
                if tuple(words[a:a + len(s)]) == s:
                    hit.update(range(a, a + len(s)))
                    found |= {str(item)} if item is not None else set()
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        want.append((doc, len(words), len(hit), len(found), digest, len(hit) > 0 and 20 * len(hit) >= len(words)))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_decontamination_of_empty_tables(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert decontamination(no_docs, items).collect() == []
    assert all(r["n_hit"] == 0 and not r["contaminated"] for r in decontamination(odd_docs, items.limit(0)).collect())


def test_proximity_allows_gaps(spark):
    docs = spark.createDataFrame([(1, "red green blue"), (2, "red and green and blue"), (3, "blue"), (4, "red x x x x x x blue green")], "doc_id long, text string")
    items = spark.createDataFrame([(9, "red green blue")], "item_id long, text string")
    near = {r["doc_id"]: r["distance"] for r in proximity_matches(docs, items, slop=2).collect()}
    assert near[1] == 0 and near[2] == 1 and 4 not in near and 3 not in near


@pytest.mark.parametrize("elsewhere", [False, True])
def test_proximity_allows_a_replaced_word(spark, elsewhere):
    """The replaced middle word is the window's rarest, and occurs nowhere or only far from the copy."""
    words = [f"k{i}" for i in range(13)]
    copy = " ".join(words[:6] + ["other"] + words[7:])
    rows = [(1, copy), (2, " ".join(words)), (3, copy + " x" * 40), (4, "k0 k1"), (5, "x y z")][0:None if elsewhere else 1]
    docs = spark.createDataFrame(rows + [(6, copy + " x" * 40 + (" k6" if elsewhere else " x")), (7, "x y")], "doc_id long, text string")
    items = spark.createDataFrame([(9, " ".join(words)), (8, "x " + " ".join(f"u{i}" for i in range(11)) + " y")], "item_id long, text string")
    near = {(r["doc_id"], r["item"]): r["distance"] for r in proximity_matches(docs, items).collect()}
    assert near == {(d, "9"): 0 for d in ((1, 2, 3, 6) if elsewhere else (1, 6))}


DISGUISED = {
    "mail bob [at] mail (dot) example (dot) com now": ("email", "bob [at] mail (dot) example (dot) com"),
    "to bob at mail dot example dot com please": ("email", "bob at mail dot example dot com"),
    "mail bob (at) example dot com now": ("email", "bob (at) example dot com"),
    "mail bob at example [dot] com now": ("email", "bob at example [dot] com"),
    "mail bob@example dot com now": ("email", "bob@example dot com"),
    "mail bob@mail.example DOT com. Then": ("email", "bob@mail.example DOT com"),
    "mail bob at mail dot example dot se now": ("email", "bob at mail dot example dot se"),
    "mail bob at example dot se, now": ("email", "bob at example dot se"),
    "mail bob at mail.example dot museum now": ("email", "bob at mail.example dot museum"),
    "mail b.lee at example dot museum now": ("email", "b.lee at example dot museum"),
    "mail b.lee at example.com now": ("email", "b.lee at example.com"),
    "see bоb@mail.example.com": ("email", "bоb@mail.example.com"),
    "user​@mail.example.com": ("email", "user​@mail.example.com"),
    "ring plus one nine eight eight five five five two four eight five ok": ("phone", "plus one nine eight eight five five five two four eight five"),
    "host one nine two dot one six eight dot zero dot one up": ("ip", "one nine two dot one six eight dot zero dot one"),
    "٤٣٨٧٥١٣٠٣٥٢٣٧٢٦٩": ("card", None),
}


def test_disguised_identifiers_map_back_to_the_source(spark):
    for text, (kind, span) in DISGUISED.items():
        plain, every = pii.find(text)
        assert (kind, span or text) in [(pii.KINDS[k], text[a:b]) for a, k, b in every if (a, k, b) not in plain]
    for clean in ("look at this dot now", "one of the two at five, six to zero", "meet me at noon", "x" * 100_000 + "@", "1" * 100_000, "да"):
        assert pii.find(clean)[1] == []


def test_few_disguised_parts_are_enough():
    for text, kind in (("192 dot 168 dot 1 dot 1", "ip"), ("10.0.zero.one", "ip"), ("+1 988 55 five 2485", "phone"), ("4387 5130 3523 726 nine", "card"),
                       ("4387\u00a05130 3523 726 n\u0131ne", "card")):
        assert pii.find(f"see {text} ok")[1] == [(4, pii.KINDS.index(kind), 4 + len(text))], text
    assert pii.find("three of 12 at one dot, plus two" + " " * 100_000 + "(" * 100_000)[1] == []


def test_mixtures_of_disguises_are_found_whole():
    """Any part may be spelled, bracketed or plain, also only one of them."""
    rnd, names = random.Random(5), "zero one two three four five six seven eight nine".split()
    spell = lambda digits, by: by.join(rnd.choice((str.lower, str.upper, str.title))(names[int(d)]) for d in digits)
    for _ in range(3000):
        share = rnd.choice((0, .1, .5, 1))
        if rnd.random() < .5:
            kind, parts = "ip", [str(rnd.randrange(256)) for _ in range(4)]
            text = "".join(rnd.choice((".", " dot ", " DOT\n", "(dot)", " [punkt] ")) * (i > 0) + (spell(p, rnd.choice((" ", "-", ", "))) if rnd.random() < share else p)
                           for i, p in enumerate(parts))
        else:
            kind, digits = "phone", "".join(rnd.choice("123456789") for _ in range(11))
            text = rnd.choice(("+", "plus ")) + "".join(rnd.choice(" -") * (i > 0) + (spell(d, "") if rnd.random() < share else d) for i, d in enumerate(digits))
        assert (4, pii.KINDS.index(kind), 4 + len(text)) in pii.find(f"see {text} ok")[1], text


def test_mixed_signs_of_an_address_are_found_whole():
    """Every mixture of real, bracketed and bare signs, but a bare "at" before a plain domain."""
    ats, dots = ("@", " (at) ", "[at]", " at ", " AT\n"), (".", " (dot) ", "[punkt]", " dot ", "\tDot ")
    for at, one, two in itertools.product(ats, dots, dots):
        if at.strip() == "@" and one == two == "." or at.strip().lower() == "at" and one == two == ".":
            continue
        text = f"bob{at}mail{one}example{two}se"
        assert (4, 0, 4 + len(text)) in pii.find(f"see {text}, ok")[1], text


def test_prose_around_bare_signs_stays():
    for clean in ("look at the dot now", "stare at this dot so that", "look at polka dot dresses", "he was at home dot dot dot", "papers at www.example.com", "hosted at example.com",
                  "version at three dot five dot two", "at", "dot", " at dot ", "look at it. dot com", "a" * 100_000 + " at b dot", "a at b dot " * 20_000, "a at" + " 500 dot" * 50_000):
        assert pii.find(clean)[1] == [], clean[:50]
    assert pii.find("to bob@example.com dot then")[1] == [(3, 0, 18)]


def test_plain_spans_match_the_patterns(spark, no_docs):
    rnd = random.Random(2)
    texts = ["".join(rnd.choice("1234567890 .-+()@ab,é4444") for _ in range(60)) for _ in range(800)] + [
        "4387 5130 3523 7269", "+1 (988) 555-2485", "1.2.3.4.5 256.1.1.1", "a@b@c.d e@f", "", None]
    patterns = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")

    def want(text):
        out = []
        for kind, pattern in enumerate(patterns):
            for m in re.finditer(pattern, text or ""):
                digits = re.sub("[^0-9]", "", m[0])
                if (kind == 0 or kind == 1 and all(int(p) <= 255 for p in m[0].split(".")) or kind == 2 and 12 <= len(digits) <= 19 and pii.luhn(digits)
                        or kind == 3 and 9 <= len(digits) <= 15):
                    out.append((m.start(), kind, m.end()))
        return sorted(out)

    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.pii_spans(docs).collect():
        spans = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in want(texts[r["doc_id"]]))
        assert r["base_sha256"] == hashlib.sha256(spans.encode()).hexdigest()
        assert set(filter(None, spans.split(","))) <= set(r["spans"].split(","))
    redacted = {r["doc_id"]: r["text"] for r in pii.redact_pii(docs).collect()}
    assert redacted[800] == "[CARD]" and redacted[801] == "[PHONE]" and redacted[804] == "" and redacted[805] is None
    assert pii.pii_spans(no_docs).collect() == [] and pii.redact_pii(no_docs).columns == no_docs.columns


def plain_components(rows):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0d]+", lowered(text))
        sets.append(sequences(w, 5))
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 80 * len(a | sets[j]):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return [len(s) for s in sets], [root(i) for i in range(len(rows))]


def near_rows():
    rnd = random.Random(3)
    words, rows = [f"w{i}" for i in range(30)], []
    for i in range(400):
        w = (rnd.choice(rows)[1] or "").split() if rows and rnd.random() < .7 else []
        for _ in range(rnd.choice([0, 1, 1, 2]) if w else 0):
            p = rnd.randrange(len(w))
            w[p:p + 1] = rnd.choice([[rnd.choice(words)], [], [w[p], rnd.choice(words)]])
            if not w:
                break
        w = w or [rnd.choice(words) for _ in range(rnd.choice([0, 1, 3, 5, 6, 7, 8, 9, 10, 12, 14, 18, 25, 40]))]
        rows.append((i, " ".join(w)))
    return rows + [(400, None)]


def test_large_groups_in_blocks_match_plain_version(spark):
    """Near copies of one text in chains, many alike only by a shared passage, with groups far above a block."""
    rnd, rows = random.Random(8), []
    base, passage = [f"b{i}" for i in range(40)], " ".join(f"p{i}" for i in range(6))
    for i in range(120):
        w = list(base) if i % 2 else rnd.choice(rows[1::2])[1].split() if len(rows) > 1 else list(base)
        w[rnd.randrange(len(w))] = f"x{rnd.randrange(6)}"
        rows.append((i, " ".join(w)))
    rows += [(i, f"{passage} y{i % 40} z{i}") for i in range(120, 200)]
    _, roots = plain_components(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = {frozenset(i for i, r in enumerate(roots) if r == root) for root in set(roots)}
    found = defaultdict(set)
    for r in near_duplicates(docs, block=16).collect():
        found[r["component"]].add(r["did"])
    assert set(map(frozenset, found.values())) == want


@pytest.mark.parametrize("count", [1, 2, 400, None])
def test_a_group_names_forests_of_pairs(count):
    """All 300 sets of a group are likely pairs: rows out grow with the sets, and enough forests name every pair."""
    m = 300
    rows = pa.RecordBatch.from_arrays([pa.array([7] * m), pa.array([0] * m), pa.array([0] * m), pa.array([900] * m), pa.array(range(m)), pa.array(range(m)),
                                       pa.array([bytes(128)] * m)], ["gid", "low", "high", "n", "sid", "comp", "sketch"])
    out = pa.Table.from_batches(ngram_join._across(count)(iter([rows.slice(0, 100), rows.slice(100)]))).to_pylist()
    pairs = {(r["a"], r["b"]) for r in out if r["gid"] is None}
    assert len(pairs) == (m * (m - 1) // 2 if count in (400, None) else len([r for r in out if r["gid"] is None])) <= (count or m) * (m - 1)
    assert [r["gid"] for r in out if r["gid"] is not None] == ([] if count in (400, None) else [7])
    near = {0}
    while more := {x for p in pairs if near & set(p) for x in p} - near:
        near |= more
    assert len(near) == m


def test_components_match_plain_version(spark, odd_docs, odd_rows, no_docs):
    rows = near_rows()
    sizes, roots = plain_components(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in component_ids(docs).collect()}
    assert got == {i: (n, c) for i, (n, c) in enumerate(zip(sizes, roots))}
    kept = {r["doc_id"] for r in drop_near_duplicates(docs).collect()}
    assert kept == {i for i, c in enumerate(roots) if i == c}
    # Null and repeated ids, with other columns kept as they are.
    _, roots = plain_components(odd_rows)
    stay = drop_near_duplicates(odd_docs)
    assert stay.columns == odd_docs.columns and stay.count() == len(set(roots))
    assert component_ids(no_docs).collect() == [] and drop_near_duplicates(no_docs).collect() == []


def test_quality_counts_and_verdicts(spark, odd_docs, odd_rows, no_docs):
    got = Counter(tuple(r)[:7] for r in quality_rules(odd_docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect())
    want = Counter()
    for doc, text in odd_rows:
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0d]+", text)
        counts = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
        covered = {i + j for i in range(len(w) - 4) if counts[tuple(w[i:i + 5])] > 1 for j in range(5)}
        lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        want[doc, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered),
             len(w) < 10 or 100 * len(covered) > 20 * len(w)] += 1
    assert got == want
    assert quality_rules(no_docs).collect() == []


def test_quality_thresholds_follow_language_and_source(spark):
    rnd = random.Random(4)
    rows = []
    for i in range(400):
        source, size = ("a", 4) if i % 2 else ("b", 12)
        rows.append((i, " ".join("x" * (size - 1 + rnd.randrange(3)) + str(rnd.randrange(10 ** 6)) for _ in range(30)), "en", source))
    rows += [(1000, rows[0][1], "en", "a"), (1001, rows[1][1] + " ###" * 20, "en", "a"), (1002, rows[1][1], None, None)]
    kept = {r["doc_id"]: r["kept"] for r in quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(kept[i] for i in range(400)) and not kept[1000] and not kept[1001] and kept[1002]
    assert defaultdict(bool, kept)[0]


def plain_verdicts(rows, spread=3.0, prior=50.0):
    """Ids that the rules keep, computed value by value from ``(id, text, lang, source)``."""
    ratio, tails = 1.02, (100, 50, 10, 1, 0)
    facts = {}
    for i, text, lang, source in rows:
        w = re.findall(r"[^\x20\x09-\x0d]+", text or "")
        lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        counts = Counter(tuple(w[k:k + 5]) for k in range(len(w) - 4))
        covered = {k + j for k in range(len(w) - 4) if counts[tuple(w[k:k + 5])] > 1 for j in range(5)}
        failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
        values = (sum(map(len, w)) / len(w), sum(c in "#*$%&|<>" for c in text) / len(w), (len(lines) - len(set(lines))) / len(lines)) if w else None
        facts[i] = lang, source, len(w), failed, values

    def ends(bucket):
        return (0.0, 0.0) if bucket is None else (ratio ** bucket * (1 - 1e-9), ratio ** (bucket + 1) * (1 + 1e-9))

    def fence(values):
        cells = sorted((None if v == 0 else math.floor(math.log(v) / math.log(ratio)) for v in values), key=lambda b: -math.inf if b is None else b)
        n = len(cells)
        up = lambda t: cells[max(0, -(-(1000 - t) * n // 1000) - 1)]
        middle = cells[-(-500 * n // 1000) - 1]
        low = next((c for t in tails if (c := cells[min(n - 1, t * n // 1000)]) != middle), middle)
        high = next((c for t in tails if (c := up(t)) != middle), middle)
        (a, b), low, high = ends(middle), ends(low)[0], ends(high)[1]
        return low - spread * (a - low), high + spread * (high - b), n

    kept = set()
    for i, (lang, source, _, failed, values) in facts.items():
        if failed:
            continue
        ok = True
        for m in range(3):
            low, high, n = fence([f[4][m] for f in facts.values() if f[:2] == (lang, source) and f[2] >= 10])
            all_low, all_high, _ = fence([f[4][m] for f in facts.values() if f[0] == lang and f[2] >= 10])
            share = n / (n + prior)
            ok &= values[m] <= share * high + (1 - share) * all_high
            ok &= m > 0 or values[m] >= share * low + (1 - share) * all_low
        if ok:
            kept.add(i)
    return kept


def graded_rows(symbols_in_a):
    """Three groups of 60 documents: sizes of words differ by source, and a share of the words of source ``a`` bears a symbol."""
    rnd, rows = random.Random(9), []
    for i in range(180):
        source = "abc"[i % 3]
        words = ["x" * rnd.randrange(2, 6 + i % 3) + str(rnd.randrange(10 ** 5)) for _ in range(40)]
        if source == "a":
            words = [w + "#" if rnd.random() < symbols_in_a else w for w in words]
        rows.append((i, " ".join(words[:20]) + "\n" + " ".join(words[20:]) + ("\nsame line\nsame line" if i % 7 == 0 else ""), "en", source))
    marked = lambda i: " ".join(f"{w}#" if k % 4 == 0 else w for k, w in enumerate(rows[i][1].split()))
    rows += [(1000, marked(2), "en", "c"), (1001, marked(3).replace("##", "#"), "en", "a"), (1002, "long" * 300 + rows[4][1], "en", "b"),
             (1003, None, "en", None), (1004, rows[1][1], None, "a"), (1005, "one two", "de", "b"), (1006, rows[1][1], "en", "b"), (1007, "", None, None)]
    return rows


def test_quality_verdicts_match_plain_version_and_move_with_a_group(spark):
    schema = "doc_id long, text string, lang string, source string"
    kept = {}
    for share in (0.02, 0.3):
        rows = graded_rows(share)
        kept[share] = {r["doc_id"] for r in quality_rules(spark.createDataFrame(rows, schema)).filter("kept").collect()}
        assert kept[share] == plain_verdicts(rows)
        assert sum(i in kept[share] for i in range(180)) >= 160
    assert 1001 in kept[0.3] and 1001 not in kept[0.02]
    assert 1002 not in kept[0.02] and 1004 in kept[0.02]


def test_low_quality_rows_leave_with_their_own_columns(spark):
    rows = [(*r, -1, "mine") for r in graded_rows(0.1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words long, kept string")
    out = drop_low_quality(docs)
    assert out.columns == docs.columns
    got = out.collect()
    assert {r["doc_id"] for r in got} == plain_verdicts([r[:4] for r in rows]) and {(r["n_words"], r["kept"]) for r in got} == {(-1, "mine")}


def test_wide_sketches_tell_large_sets_apart():
    rnd = random.Random(9)
    words = [f"w{rnd.randrange(10**6)}" for _ in range(6000)]
    near = words[:3000] + ["other"] + words[3001:6000]
    texts = [" ".join(t).encode() for t in (words, near, [f"v{rnd.randrange(10**6)}" for _ in range(6000)], ["few", "words"])]
    sets = ngram_join.Sets(texts, 5)
    narrow, wide = sets.sketches(), sets.wide_sketches()
    assert [len(w) for w in wide] == [1024, 1024, 1024, 0]
    pairs = [(0, 1), (0, 2), (3, 3)]
    assert ngram_join._may_link(sets.size[0], sets.size[2], *(np.frombuffer(narrow[i], np.uint64) for i in (0, 2)))
    rows = pa.table({"a": [a for a, _ in pairs], "b": [b for _, b in pairs], **{
        f"{name}_{side}": pa.array([values[p[i]] for p in pairs], kind) for i, side in enumerate("ab")
        for name, values, kind in (("n", sets.size.tolist(), pa.int64()), ("k", narrow, pa.binary()), ("w", wide, pa.binary()))}})
    found = pa.Table.from_batches(ngram_join._likely(iter(rows.to_batches()))).to_pylist()
    assert [(r["a"], r["b"]) for r in found] == [(0, 1), (3, 3)]


def test_a_task_of_the_join_holds_little():
    """Blocks of a group, and the sets of a batch of long texts, are taken in small steps."""
    def peak(batches):
        tracemalloc.start()
        rows = sum(b.num_rows for b in batches)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return rows, most / 1e6

    m, rnd = 2048, random.Random(3)
    group = pa.RecordBatch.from_arrays([pa.array([7] * m), pa.array([0] * m), pa.array([0] * m), pa.array([900] * m), pa.array(range(m)), pa.array(range(m)),
                                        pa.array([bytes(128)] * m)], ["gid", "low", "high", "n", "sid", "comp", "sketch"])
    rows, most = peak(ngram_join._across(1)(iter([group])))
    assert rows and most < 40
    words = [f"w{i}" for i in range(5000)]
    texts = [" ".join(rnd.choices(words, k=3000)) for _ in range(400)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(400)), pa.array(range(400)), pa.array(texts)], ["did", "dn", "text"])
    rows, most = peak(ngram_join._members(5)(iter([batch])))
    assert rows == 400 and most < 150
