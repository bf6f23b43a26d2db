"""What a reused worker keeps between tasks and between operators."""

import tracemalloc

import pyarrow as pa

from corpuslake.llm import harmonic_packing, ngram_join
from corpuslake.llm.queries import tokenizer_path
from corpuslake.llm.tokens import Encoder


def rows(texts):
    n = range(len(texts))
    return pa.RecordBatch.from_arrays([pa.array(n, pa.int64()), pa.array(n, pa.int64()), pa.array(n, pa.int64()), pa.array(texts)], ["doc_id", "did", "dn", "text"])


def test_workers_drop_encoded_pieces(monkeypatch):
    monkeypatch.setattr("corpuslake.llm.tokens._CACHE_LIMIT", 8)
    batches = [rows([f"some words of text {i} {i + 1}" for i in range(a, a + 5)]) for a in range(0, 50, 5)]
    packed = harmonic_packing._pieces(tokenizer_path(), 1, 2048, False, "doc_id")
    ids = [len(t) // 4 + 1 for b in batches for t in Encoder(tokenizer_path()).batch(b.column("text").to_pylist())]
    pieces = [n for b in packed(iter(batches)) for n in b.column("length").to_pylist()]
    assert sum(pieces) == sum(ids)
    kept = Encoder.of(tokenizer_path())
    assert kept.words and not kept.older  # a task's end leaves the younger pieces
    for run in (ngram_join._members(5), ngram_join._signatures(5)):
        Encoder.of(tokenizer_path())
        list(run(iter(batches)))
        assert not Encoder._kept  # the near-copy join takes the worker over


def test_near_copies_hold_little_of_a_large_batch():
    """A batch of 4 MB of texts is worked through in small parts."""
    batch = rows([" ".join(f"w{i}x{j}" for j in range(500)) for i in range(1000)])
    size = batch.column("text").nbytes
    for run in (ngram_join._members(5), ngram_join._signatures(5)):
        tracemalloc.start()
        try:
            n = sum(b.num_rows for b in run(iter([batch])))
            peak = tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()
        assert n >= batch.num_rows and peak < 12 * size, peak / size
