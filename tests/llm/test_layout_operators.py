import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslake.llm import range_coder
from corpuslake.llm.fixity_audit import fixity_audit
from corpuslake.llm.harmonic_packing import cut, harmonic_packing
from corpuslake.llm.queries import tokenizer_path
from corpuslake.llm.ring_sharding import ring_shards
from corpuslake.llm.token_files import read_token_files, write_token_files
from corpuslake.llm.tokens import Encoder


def library_ids(texts, end):
    encoder = Encoder.of(tokenizer_path())
    return [np.array([*e.ids, end], "<u4").tobytes() for e in encoder.tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]


def test_cached_encoding_equals_the_library():
    rnd = random.Random(1)
    parts = [" ", "\n", "\t", "  ", "a", "B", "é", "1", "'s", "'", "!", ".", "-", "<|endoftext|>", " ", "字", "\x1c", "re", "'ll", "“", "ⅷ", "x", " ", " "]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 30))) for _ in range(3000)] + ["", " ", "\n", "a\n", "\na", " a", "a "]
    assert [t + b"\1\0\0\0" for t in Encoder.of(tokenizer_path()).batch(texts)] == library_ids(texts, 1)


@pytest.mark.parametrize("n", [0, 1, 5, 4096, 4097, 9000])
def test_range_coder_round_trip(n):
    rng = np.random.default_rng(n)
    ids = np.minimum((rng.pareto(0.6, n) * 3).astype(np.int64), 50256)
    assert (range_coder.decode_blocks(range_coder.encode_blocks(ids), n) == ids).all()


def test_damaged_frames_are_refused():
    frame = range_coder.pack_frame([(1, np.arange(50, dtype="<u4").tobytes()), (None, b"")])
    assert range_coder.unpack_frame(frame) == [(1, np.arange(50, dtype="<u4").tobytes()), (None, b"")]
    for at in (3, 30, len(frame) - 9):
        with pytest.raises(ValueError):
            range_coder.unpack_frame(frame[:at] + bytes([frame[at] ^ 1]) + frame[at + 1:])


def test_token_files_read_back(spark, odd_docs, odd_rows, no_docs, tmp_path):
    write_token_files(odd_docs, f"{tmp_path}/a", tokenizer_path(), frame_ids=700)
    got = sorted((tuple(r) for r in read_token_files(spark, f"{tmp_path}/a", with_ids=True).collect()), key=lambda r: r[1])
    assert sorted((d for d, *_ in got), key=lambda d: -1 if d is None else d) == [d for d, *_ in got]
    start = 0
    for doc, at, n, checksum, ids in got:
        assert at == start and n == len(ids) // 4 and checksum == zlib.crc32(ids)
        start += n
    want = sorted(zip([str(d) for d, _ in odd_rows], library_ids([t for _, t in odd_rows], 2)))
    assert sorted((str(d), bytes(i)) for d, _, _, _, i in got) == want
    write_token_files(no_docs, f"{tmp_path}/b", tokenizer_path())
    assert read_token_files(spark, f"{tmp_path}/b").collect() == []


def test_packing_keeps_every_token_once(odd_docs, odd_rows, no_docs):
    rows = harmonic_packing(odd_docs, tokenizer_path(), capacity=64, with_ids=True).collect()
    want = sorted((str(d), i) for (d, _), i in zip(odd_rows, library_ids([t for _, t in odd_rows], 1)))
    sequences, pieces = {}, {}
    for r in rows:
        assert r["ids_crc32"] == zlib.crc32(r["ids"]) and r["length"] == len(r["ids"]) // 4
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        pieces.setdefault((str(r["doc_id"]), r["doc_tokens"], r["start"]), []).append(bytes(r["ids"]))
    for spans in sequences.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end
            end += length
        assert end <= 64
    assert sum(len(i) for _, i in want) == sum(4 * r["length"] for r in rows)
    single = {}
    for (doc, n, start), ids in sorted(pieces.items()):
        single.setdefault(doc, []).append(b"".join(ids))
    once = {d: i for d, i in want if sum(d == x for x, _ in want) == 1}
    assert all(b"".join(single[d]) == i for d, i in once.items())
    assert len(sequences) * 64 < 1.1 * sum(r["length"] for r in rows)
    assert harmonic_packing(no_docs, tokenizer_path()).collect() == []


def test_cut_uses_full_class_lengths():
    for n in range(1, 5000, 7):
        lengths = cut(n, 2048)
        assert sum(lengths) == n and min(lengths) > 0 and sum(2048 // (2048 // x) != x for x in lengths) <= n + 1
        assert all(x == 2048 // (2048 // x) for x in lengths[:-1])


def test_ring_counts_and_slots(odd_docs, odd_rows, no_docs):
    rows = ring_shards(odd_docs, n_shards=7, vnodes=8, slots=64).collect()
    sizes = sorted((str(d), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in odd_rows)
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in rows) == sizes
    shards = {}
    for r in rows:
        shards.setdefault(r["shard"], []).append(r["slot"])
    counts = [len(v) for v in shards.values()]
    assert len(counts) == 7 and max(counts) - min(counts) <= 1 and all(sorted(v) == list(range(len(v))) for v in shards.values())
    assert ring_shards(no_docs).collect() == []


def test_ring_with_slack_moves_few_rows_and_survives_hot_keys(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    at = lambda n: {r["doc_id"]: r["shard"] for r in ring_shards(docs, n, slack=0.25).collect()}
    before, after = at(10), at(11)
    counts = np.bincount(list(before.values()))
    assert counts.max() <= 1.25 * 400 + 1
    assert sum(before[d] != after[d] for d in before) < 0.3 * 4000
    same = docs.withColumn("doc_id", F.when(F.col("doc_id") < 3000, 1).otherwise(F.col("doc_id")))
    assert set(np.bincount([r["shard"] for r in ring_shards(same, 8).collect()])) == {500}


def content(frame):
    return F.coalesce(frame["html"], F.lit(""))


def test_audit_finds_only_what_differs(spark):
    rows = [(i, f"page {i}" * (i % 5)) for i in range(700)] + [(None, "n"), (3, None), (5, "twice"), (5, "twice")]
    schema = "page_id long, html string"
    original = spark.createDataFrame(rows, schema)
    assert fixity_audit(original, original.repartition(5), "page_id", content).collect() == []
    damaged = [(i, h) for i, h in rows if i != 40] + [(900, "new")]
    damaged = [(i, h + "?" if i == 333 else h) for i, h in damaged]
    damaged.remove((5, "twice"))
    got = {r["key"]: r for r in fixity_audit(original, spark.createDataFrame(damaged, schema), "page_id", content).collect()}
    assert {k: r["state"] for k, r in got.items()} == {40: "missing", 900: "extra", 333: "changed", 5: "changed"}
    before = lambda k: sum(len((h or "").encode()) for i, h in rows if (-1 if i is None else i) < k)
    assert got[40]["record_offset"] == before(40) and got[333]["record_offset"] == before(333) and got[900]["record_offset"] is None
    assert got[333]["nodes_read"] < 800 * 2
    empty = original.limit(0)
    assert fixity_audit(empty, empty, "page_id", content).collect() == []
    assert fixity_audit(empty, original, "page_id", content).filter("state = 'extra'").count() == 701
