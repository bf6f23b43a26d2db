import hashlib
import random
import re
from collections import Counter

import pytest

from corpuslake.llm import repeats
from corpuslake.llm.substring_dedup import SuffixAutomaton, substring_dedup
from corpuslake.llm.suffix_dedup import decide, suffix_dedup


def plain(rows, length, words):
    tokens = [re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode()) if words else (t or "").encode() for _, t in rows]
    cut = (lambda t, i: tuple(t[i:i + length])) if words else (lambda t, i: t[i:i + length])
    counts = Counter(cut(t, i) for t in tokens for i in range(len(t) - length + 1))
    out = []
    for (doc, _), t in zip(rows, tokens):
        covered = [False] * len(t)
        for i in range(len(t) - length + 1):
            if counts[cut(t, i)] > 1:
                covered[i:i + length] = [True] * length
        kept = [w for w, c in zip(t, covered) if not c]
        spans = sum(c and (i == 0 or not covered[i - 1]) for i, c in enumerate(covered))
        out.append((doc, len(t), sum(covered), spans, hashlib.sha256(b" ".join(kept) if words else bytes(kept)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [1000, 20])
@pytest.mark.parametrize("operator,length,k,words", [(substring_dedup, 12, 4, True), (suffix_dedup, 30, 8, False)])
def test_matches_plain_version(odd_docs, odd_rows, monkeypatch, operator, length, k, words, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    got = [(r["doc_id"], r["n_tokens"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in operator(odd_docs, length, k).collect()]
    assert sorted(got, key=str) == plain(odd_rows, length, words)


def test_empty_table_and_kept_text(spark, no_docs):
    assert substring_dedup(no_docs).collect() == []
    docs = spark.createDataFrame([(1, "a b c d x"), (2, "y a b c d")], "doc_id long, text string")
    assert {r["doc_id"]: bytes(r["kept"]) for r in substring_dedup(docs, 3, 2).collect()} == {1: b"x", 2: b"y"}
    assert {r["doc_id"]: [list(s) for s in r["spans"]] for r in suffix_dedup(docs, 5, 2).collect()} == {1: [[0, 7]], 2: [[2, 9]]}


def test_automaton_counts_occurrences():
    automaton = SuffixAutomaton()
    automaton.add("abcab", 2)
    automaton.add("bca", 1)
    automaton.finish()
    assert list(automaton.matching("ab", 2)) == [(1, 5), (2, 4)]


def test_common_passage_is_not_split_into_all_windows(spark, monkeypatch):
    monkeypatch.setattr(repeats, "HOT", 20)
    rnd = random.Random(5)
    text = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    common = text(400)
    rows = [(i, text(100) + common + text(100)) for i in range(60)] + [(60, "ab" * 200), (61, common[200:] + text(50))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    _, spans = repeats.repeated_spans(repeats.C.keyed(docs), repeats.Unit(False, 80, 16), decide, 1 << 20)
    assert sum(len(r["spans"]) for r in spans.collect()) < 60 * (400 - 80 + 1) // 3
    got = [(r["doc_id"], r["n_tokens"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup(docs, 80, 16).collect()]
    assert sorted(got, key=str) == plain(rows, 80, False)


def test_lone_window_is_not_compared():
    unit = repeats.Unit(False, 4, 2)
    assert repeats._open(unit, [(1, {b"abcd": [1, 7]}), (2, {b"abcde": [2, 7]}), (3, {b"ababa": [1, 7]})]) == {3: {b"ababa": 1}}
    assert list(repeats._settle(unit, {b"abcd": [1, 7]}, None)) == [] and list(repeats._settle(unit, {b"abcd": [2, 7]}, None)) == [(7, [0, 1])]


def test_texts_are_dealt_once_and_pieces_counted_where_read(spark):
    docs = repeats.C.keyed(spark.createDataFrame([(i, "abcdefgh " * 30) for i in range(60)], "doc_id long, text string"))
    unit = repeats.Unit(False, 80, 16)
    out = repeats.removed(docs, unit, decide, 1 << 20)
    plan = re.sub(r"#\d+L?", "", out._jdf.queryExecution().optimizedPlan().toString()).splitlines()
    dealt = [plan[i + 1].strip(" :+-") for i, line in enumerate(plan) if "RepartitionByExpression [did, dn]" in line]
    assert len(dealt) > 1 and len(set(dealt)) == 1  # one exchange, used again
    every = repeats.BitFilter(range(1 << 22))
    batch = docs.coalesce(1).toArrow().combine_chunks().to_batches()[0]
    counted = lambda rows: {(r["key"], r["ctx"]): r["n"] for b in repeats._finer_counts(unit, every)(iter(rows)) for r in b.to_pylist()}
    assert counted([batch]) == {k: batch.num_rows * n for k, n in counted([batch.slice(0, 1)]).items()}
