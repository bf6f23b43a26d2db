import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from corpuslake.llm import prefix_trie as pt
from corpuslake.llm.line_blocks import extract_main_text, main_text, page_lines
from corpuslake.llm.manifest_proofs import manifest, record_digest
from corpuslake.llm.ordering import positions

sha = lambda text: hashlib.sha256(text.encode()).hexdigest()


# ------------------------------------------------------------------ ordering
def test_positions_in_hot_and_tied_groups(spark):
    rows = [("hot", i // 3) for i in range(900)] + [("b", i) for i in range(5)] + [("a", None), ("a", 1)]
    random.Random(2).shuffle(rows)
    out = positions(spark.createDataFrame(rows, "g string, v int").repartition(7), ["g"], ["v"]).collect()
    groups = defaultdict(list)
    for r in out:
        groups[(r.group_no, r.g, r.group_size)].append((r.idx, r.v))
    assert sorted((no, g, n) for no, g, n in groups) == [(0, "a", 2), (1, "b", 5), (2, "hot", 900)]
    for (_, _, n), members in groups.items():
        members.sort()
        assert [i for i, _ in members] == list(range(n))
        values = [(v is not None, v or 0) for _, v in members]
        assert values == sorted(values)


# ------------------------------------------------------------------ manifest
def plain_levels(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i:i + 3])) for i in range(0, len(levels[-1]), 3)])
    return levels


def plain_path(levels, i):
    for level in levels[:-1]:
        run = i // 3 * 3
        yield level[run:i], level[i + 1:run + 3]
        i //= 3


def plain_manifest(rows, damage):
    digest = lambda row: sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))
    groups = defaultdict(list)
    for row in rows:
        groups[row[1]].append((row[0] is not None, row[0] or 0, digest(row), row))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = []
    for name in names:
        groups[name].sort(key=lambda r: r[:3])
        trees.append(plain_levels([r[2] for r in groups[name]]))
    top = plain_levels([t[-1][0] for t in trees])
    out = []
    for at, (name, tree) in enumerate(zip(names, trees)):
        for i, (_, _, leaf, row) in enumerate(groups[name]):
            path = [*plain_path(tree, i), *plain_path(top, at)]
            node = digest(damage(row))
            for before, after in path:
                node = sha("".join([*before, node, *after]))
            proof = sha("".join("".join(b + a) for b, a in path))
            out.append((row[0], leaf, tree[-1][0], top[-1][0], proof, node, node == top[-1][0]))
    return sorted(out, key=str)


FIELDS = "doc_id long, source string, text string"


def forged_rows(spark, rows):
    digest = lambda text: record_digest(F.col("doc_id"), F.col("source"), text)
    forged = F.when((F.col("doc_id") % 2 == 0) & F.col("text").contains("x"), digest(F.replace("text", F.lit("x"), F.lit(""))))
    frame = spark.createDataFrame(rows, FIELDS).withColumns({"root": F.lit(1), "idx": F.lit(2), "tree": F.lit("t"), "segment": F.lit(None)}).repartition(3)
    return manifest(frame, "doc_id", "source", digest(F.col("text")), forged)


def damage(row):
    return (row[0], row[1], row[2].replace("x", "")) if row[0] is not None and row[0] % 2 == 0 and row[2] is not None else row


def many_records():
    rnd = random.Random(5)
    rows = [(i, "hot", rnd.choice(["", "x", "axb", "é", None, "long " * 20000])) for i in range(100)]
    rows += [(i, rnd.choice(["s1", "s2", "", None, "ß", "z"]), "text x") for i in range(40)]
    return rows + [(7, "hot", "same"), (7, "hot", "same"), (None, "hot", "x"), (None, None, None), (1, "lone", "t")]


@pytest.mark.parametrize("rows", [many_records(), [(4, "s", "x")], [(4, None, None)], [(i, str(i), "x") for i in range(5)], [(i, "s", "x") for i in range(9)],
                                  [(i, "s", "x") for i in range(28)]], ids=["many", "one", "null", "lone groups", "nine", "uneven"])
def test_manifest_equals_the_plain_one(spark, rows):
    got = [tuple(r) for r in forged_rows(spark, rows).drop("segment").collect()]
    assert sorted(got, key=str) == plain_manifest(rows, damage)


def test_segments_are_proofs(spark):
    for r in forged_rows(spark, many_records()).collect():
        node = r.leaf
        for s in r.segment:
            node = sha(s.before + node + s.after)
        assert node == r.root


def test_manifest_by_shuffles_alone(spark, monkeypatch):
    monkeypatch.setattr("corpuslake.llm.manifest_proofs.BROADCAST_BYTES", -1)
    rows = many_records()
    got = [tuple(r) for r in forged_rows(spark, rows).drop("segment").collect()]
    assert sorted(got, key=str) == plain_manifest(rows, damage)


def test_manifest_of_nothing(spark):
    out = forged_rows(spark, [])
    assert out.count() == 0 and out.columns == ["doc_id", "leaf", "subroot", "root", "segment", "proof_sha256", "folded_root", "verified"]


# ------------------------------------------------------------------ prefix trie
def plain_rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [t[1:] for t in sorted(turns)] for c, turns in own.items()}
    h = {c: zlib.crc32(str(c).encode()) % 9 for c in own}
    return {c: own.get(c - c % 5, [])[:h[c]] + own[c][h[c]:] for c in own}


def plain_trie(sequences):
    members = defaultdict(set)
    for c, turns in sequences.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].add(c)
    out = []
    for prefix, own in members.items():
        below = [p for p in members if p[:len(prefix)] == prefix]
        childless = [p for p in below if not any(q[:-1] == p for q in members if q)]
        ends = sorted(c for c in own if len(sequences[c]) == len(prefix))
        out.append((min(own), len(prefix), min(members[prefix[:-1]]) if prefix else None, len(own), sum(1 for p in members if p and p[:-1] == prefix), len(childless),
                    sum((len(members[p]) - 1) * len(p[-1][1].encode()) for p in below if p), sha(",".join(map(str, ends)))))
    return sorted(out, key=str)


TURNS = "conv_id long, turn long, role string, text string"


def talk(seed, n, longest):
    rnd = random.Random(seed)
    rows = []
    for c in range(0, n, rnd.choice([1, 1, 2])):
        for t in range(rnd.choice([1, 2, 5, longest])):
            rows.append((c, t, rnd.choice(["user", "bot"]), rnd.choice(["hé", "b", "", None, "ccc"])))
    return rows


ODD = [(None, 1, "user", "x"), (3, None, "user", "null turn"), (3, 0, None, None), (3, 0, "a", "tie"), (3, 0, "a", "tie"), (60, 1, "u", "long " * 30000),
       (61, 1, "u", "long " * 30000), (10**12, 1, "u", "far")]


def same_trie(spark, rows):
    frame = spark.createDataFrame(rows, TURNS).withColumns({"pos": F.lit("p"), "name": F.lit(1), "depth": F.lit(0)}).repartition(3)
    sizes, turns = pt.rebuilt(pt.ordered_turns(frame))
    got = [tuple(r) for r in pt.prefix_trie(sizes, turns, texts=False).collect()]
    assert sorted(got, key=str) == plain_trie(plain_rebuilt(rows))


@pytest.mark.parametrize("rows", [talk(1, 60, 12) + ODD, [(5, 0, "u", "a")], [(c, 0, "u", "same") for c in range(300)]], ids=["odd", "one", "all alike"])
def test_trie_equals_the_plain_one(spark, rows):
    same_trie(spark, rows)


def test_trie_in_short_stretches_and_small_id_blocks(spark, monkeypatch):
    monkeypatch.setattr(pt, "_STRETCH", 1)
    monkeypatch.setattr(pt, "_IDS", 3)
    same_trie(spark, talk(3, 40, 70) + [(c, 0, "u", "same") for c in range(1000, 1040)])


def test_trie_of_nothing_and_with_texts(spark):
    sizes, turns = pt.rebuilt(pt.ordered_turns(spark.createDataFrame([], TURNS)))
    assert pt.prefix_trie(sizes, turns).count() == 0
    sizes = spark.createDataFrame([(1, 2), (2, 0)], "conv_id long, size long")
    turns = spark.createDataFrame([(1, 0, "u", "a"), (1, 1, "b", "c")], "conv_id long, pos long, role string, text string")
    assert sorted((r.depth, r.conv_id, r.text) for r in pt.prefix_trie(sizes, turns).collect()) == [(0, 1, None), (1, 1, "a"), (2, 1, "c")]


# ------------------------------------------------------------------ pages
PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var a = "</p><p>no</p>";</script></head><body class="no-sidebar">
<header><h1>Site</h1><a href="/">Home</a></header><nav><ul><li><a href="/a">A</a></li><li><a href="/b">B</a></li></ul></nav><div id="cookie-notice">We use cookies.</div>
%s<aside class="sidebar"><p>Read this too, it is long enough to look like text and has no links at all in it.</p></aside>
<section class="comments"><article class="comment"><p>First! A reader's remark of some length that is not the article.</p></article></section>
<form><label>Mail</label><input></form><footer>&copy; us</footer></body></html>"""
TEXT = "<h2>Short</h2><p>One &lt;two&gt;\n three<br>four.<p>Be.</p><div class='ad'>Buy!</div><p><b>Un<i>closed.<p>A <a href='x>y'>link</a>, and&nbsp;more words to fill the line &#233;.</p>"
KEPT = "Short One <two> three four. Be. Unclosed. A link, and more words to fill the line é."


@pytest.mark.parametrize("body", [f"<article>{TEXT}</article>", f"<main><div>{TEXT}</div></main>", f'<div role="main">{TEXT}</div>', f'<div class="content">{TEXT}</div>',
                                  f"<article><header>{TEXT}</header></article>"])
def test_article_without_its_surroundings(body):
    assert main_text(PAGE % body) == KEPT


def test_text_by_distribution_alone():
    page = "<div><div>Menu</div></div><div></div><div></div><div>" + "<p>A line of running text, as articles have.</p>" * 6 + "<p>End.</p></div><div></div><div></div><div><div>Imprint</div></div>"
    assert main_text(page) == " ".join(["A line of running text, as articles have."] * 6 + ["End."])
    assert main_text("<p>tiny</p>") == "tiny"


@pytest.mark.parametrize("html,text", [("", ""), ("plain &am words", "plain &am words"), ("<p>a<!-- b", "a"), ("<script>x", ""), ("a < b <p>c", "a < b c"), ("</div></p>x", "x"),
                                       ("<p title='it>x", "x"), ("<nav>n<article><p>y", "")])
def test_broken_markup(html, text):
    assert main_text(html) == text


def test_long_pages_take_linear_time():
    text = "word " * 200000
    assert main_text(f"<article><p>{text}</p></article>") == text.strip()
    many = "<b>" * 30000 + "</i>" * 30000 + "<p>x</p>" * 30000
    assert main_text(many) == " ".join(["x"] * 30000)
    assert len(page_lines("<div>" * 5000)[0]) == 5000


def test_pages_with_odd_rows(spark):
    rows = [(1, "u", None, 5), (None, None, "<p>a</p>", 6), (2, "u", "", 7), (2, "u", "", 7)]
    out = extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text int"))
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(1, "u", "", 0), (None, None, "a", 1), (2, "u", "", 0), (2, "u", "", 0)], key=str)
    assert out.filter("false").count() == 0
