import datetime as dt
import random
from unittest import mock

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpuslake.operators import chunking, policy, retrieval, telemetry, vector_index
from corpuslake.sources import file_heads, readers
from corpuslake.streaming import jobs


# ------------------------------------------------------------------ cell index
def vector_rows(spark, n=1200, dim=16, clusters=12, hot=400, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dim)) * 3
    rows = [(i, (centres[i % clusters] + rng.normal(size=dim)).astype(float).tolist()) for i in range(n)]
    rows += [(n + i, [float(i == 0)] + [1.0] * (dim - 1)) for i in range(hot)]  # a hot cell of copies
    return spark.createDataFrame(rows + [(10**9, None)], "id long, vec array<float>").repartition(5)


def test_cells_find_the_neighbours(spark):
    v = vector_rows(spark)
    asks = v.filter("id % 20 = 0 AND id < 1200")
    index = vector_index.fit_cells(v, 5)
    assert index.probes < len(index.centroids)
    assert vector_index.assign_cells(v, index).count() == 1600  # every vector but the null one, once
    exact = retrieval.exact_topk(asks, v.filter("vec IS NOT NULL"), 5, exclude_same_id=True)
    found = vector_index.topk_by_cells(asks, v, index, 5, exclude_same_id=True)
    row = vector_index.recall_at(found, exact).first()
    assert (row.queries, row.wanted) == (60, 300) and row.found >= 270
    everything = vector_index.CellIndex(index.centroids, len(index.centroids))
    assert vector_index.recall_at(vector_index.topk_by_cells(asks, v, everything, 5, exclude_same_id=True), exact).first().found == 300
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_probed_cells_come_in_bounded_frames():
    rng = np.random.default_rng(2)
    frame = pd.DataFrame({"id": np.arange(300), "vec": list(rng.normal(size=(300, 4)).astype(np.float32))})
    parts = list(vector_index._near(frame, rng.normal(size=(900, 4)), 600))
    assert max(map(len, parts)) <= vector_index._FRAME_ROWS
    assert pd.concat(parts).groupby("id")["cell"].nunique().tolist() == [600] * 300


def test_cells_of_few_or_no_vectors(spark):
    v = vector_rows(spark, 3, hot=0)
    assert vector_index.topk_by_cells(v, v, vector_index.fit_cells(v), 5).count() == 9
    none = v.filter("false")
    assert vector_index.topk_by_cells(none, none, vector_index.fit_cells(none), 5).count() == 0


def test_registered_embedder(spark):
    retrieval.register_embedder(spark, lambda: retrieval.hashing_model(64))
    got = spark.sql("SELECT t, embed_text(t) AS v FROM VALUES ('Cloud costs'), ('costs, cloud'), ('other'), (''), (NULL) x(t)").collect()
    vectors = {r.t: np.array(r.v) for r in got}
    assert vectors["Cloud costs"] @ vectors["costs, cloud"] == pytest.approx(1, abs=1e-6) and abs(vectors["Cloud costs"] @ vectors["other"]) < 0.99
    assert not vectors[""].any() and not vectors[None].any()


# ---------------------------------------------------------------- table function
BODIES = ["", "a\n\nb", "x" * 95 + "\n\n\t\u3000y \n\n" + "z " * 60, "\n\n", "é" * 31, " ".join(map(str, range(300))) + "\n\nend", "p." * 9 + "\n\n" + "q." * 9 + "\n\n" + "r." * 9]


@pytest.mark.parametrize("size,overlap", [(30, 7), (30, 0), (1000, 999)])
def test_chunk_function_equals_chunk_pages(spark, size, overlap):
    chunking.register_chunk_function(spark, "cut")
    pages = spark.createDataFrame([(i, b) for i, b in enumerate(BODIES)] + [(99, None)], "slug long, body string")
    pages.createOrReplaceTempView("cut_pages")
    got = spark.sql(f"SELECT p.slug, c.* FROM cut_pages p, LATERAL cut(p.body, {size}, {overlap}) c").collect()
    want = chunking.chunk_pages(pages.filter("body IS NOT NULL"), size, overlap, links=False).select("slug", "chunk_index", "total_chunks", "text").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) > 10


def test_chunk_function_refuses_a_wide_overlap(spark):
    chunking.register_chunk_function(spark, "cut")
    with pytest.raises(Exception, match="overlap must be smaller"):
        spark.sql("SELECT * FROM cut('a', 5, 5)").collect()


# ----------------------------------------------------------------------- sessions
def test_sessions_of_a_hot_user(spark):
    rnd = random.Random(4)
    start = dt.datetime(2024, 1, 1)
    rows = [("hot", start + dt.timedelta(seconds=rnd.randrange(20 * 86400)), 1) for _ in range(3000)]
    rows += [(u, start + dt.timedelta(seconds=s), 2) for u in "ab" for s in (0, 1800, 3600, 5401, 5401, 400000)] + [("n", None, 1)]
    out = telemetry.sessions(spark.createDataFrame(rows, "u string, ts timestamp, v long").repartition(4), "u", "ts", 1800, {"total": F.col("v")}).collect()
    want = []
    for user in ("hot", "a", "b"):
        times = sorted((t, v) for u, t, v in rows if u == user)
        for i, (t, v) in enumerate(times):
            if i == 0 or (t - times[i - 1][0]).total_seconds() > 1800:
                want.append([user, t, t, 0, 0])
            want[-1][2:] = [t, want[-1][3] + 1, want[-1][4] + v]
    assert sorted(map(tuple, out)) == sorted(map(tuple, want))


# --------------------------------------------------------------------- rule tables
def test_rule_tables_equal_patterns(spark):
    rnd = random.Random(6)
    vocabulary = [f"w{i}" for i in range(12)]
    rules = [(i, f"c{i % 7}", " ".join(rnd.choice(vocabulary) for _ in range(rnd.choice([2, 3, 4])))) for i in range(1000)] + [(2000, "e", ""), (-1, "late", "Zeta, ÉTA")]
    texts = [(i, " ".join(rnd.choice(vocabulary) for _ in range(rnd.randrange(9)))) for i in range(80)] + [(90, None), (91, "x zeta  éta."), (92, "zeta étaw")]
    got = {r.id: (r.place, r.category) for r in policy.rule_matches(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(rules, "place long, category string, phrase string")).collect()}
    want = {}
    for i, text in texts:
        hits = [(p, c) for p, c, phrase in rules if phrase and f" {phrase.lower().replace(',', '')} " in f" {' '.join((text or '').lower().replace('.', '').split())} "]
        if hits:
            want[i] = min(hits)
    assert got == want and got[91] == (-1, "late") and 92 not in got


def test_rule_tables_agree_with_blocking(spark):
    phrases = (("alpha", r"\bdrop table\b"), ("beta", r"\bignore all rules\b"))
    texts = spark.createDataFrame([(1, "please Drop Table x"), (2, "ignore all rules, drop table"), (3, "drop tables")], "id long, text string")
    rules = spark.createDataFrame([(0, "alpha", "drop table"), (1, "beta", "ignore all rules")], "place int, category string, phrase string")
    got = {r.id: r.category for r in policy.rule_matches(texts, rules).collect()}
    lists = policy.blocked_category(F.col("text"), [(p, c, True) for c, p in phrases], ())
    assert got == {r.id: r.c for r in texts.select("id", lists.alias("c")).collect() if r.c}


def test_blocked_rows_are_not_redacted(spark):
    df = spark.createDataFrame([("my mail is a@b.org",)], "text string")
    row = policy.input_policy(df.withColumn("text", F.col("text")), "text").first()
    assert (row.outcome, row.pii_types) == ("redact", ["email"])


# ------------------------------------------------------------------------ file heads
def test_heads_are_read_and_nothing_else(spark, tmp_path):
    (tmp_path / "in").mkdir()
    big = tmp_path / "in" / "big.pdf"
    with big.open("wb") as out:
        out.write(b"%PDF-1.7")
        out.truncate(1 << 30)  # a hole: one gigabyte that takes no space
    (tmp_path / "in" / "e.txt").write_bytes(b"")
    (tmp_path / "_SUCCESS").write_bytes(b"PK")
    got = {r.path.rsplit("/", 1)[1]: (r.length, r.kind) for r in readers.file_inventory(spark, str(tmp_path)).collect()}
    assert got == {"big.pdf": (1 << 30, "pdf"), "e.txt": (0, None)}
    reader = file_heads.HeadReader({"path": str(tmp_path), "filesPerPartition": "1"})
    parts = reader.partitions()
    assert [len(p.files) for p in parts] == [1, 1] and [len(next(reader.read(p))[2]) for p in parts] == [16, 0]


# ------------------------------------------------------------------------- streaming
@pytest.fixture
def rocksdb(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.ROCKSDB)


def feed(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
    return jobs.read_stream(spark, str(folder), spark.read.parquet(str(folder)).schema)


def test_timers_emit_each_expired_upload_once(spark, tmp_path, rocksdb):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    schema, data, root = "u string, id long, ts timestamp", tmp_path / "in", str(tmp_path / "out")
    batches = ([("a", 1, at(0)), ("a", 2, at(50)), ("b", 3, at(100)), ("c", 4, None)], [("a", 5, at(160))], [("b", 6, at(200))])
    seen = []
    for rows in batches:
        jobs.run_to_log(jobs.expired_uploads(feed(spark, data, rows, schema), "u", "id", "ts", 100), root)
        seen.append(sorted(r.id for r in jobs.read_log(spark, root).collect()))
    # Strictly older: at 100 the first is exactly as old as its time to live.
    assert seen == [[], [1, 2], [1, 2]]


def test_timers_call_the_state_once_a_frame():
    """A frame of uploads is one call to the state, not one an upload, and what is not due stays."""
    handle = mock.MagicMock()
    for state in (handle.getListState.return_value, handle.getMapState.return_value, handle.getValueState.return_value):
        state.exists.return_value = False
    timer = jobs.ExpiryTimer(1000)
    timer.init(handle)
    list(timer.handleInputRows(("u",), iter([pd.DataFrame({"id": range(500), "ms": range(500)})]), None))
    due = handle.getListState.return_value
    assert len(due.mock_calls) + len(handle.getMapState.return_value.mock_calls) <= 2
    due.get.return_value = iter([(i, i + 1001) for i in range(500)])
    clock = mock.Mock(**{"getCurrentWatermarkInMs.return_value": 1200})
    assert pd.concat(timer.handleExpiredTimer(("u",), clock, None))["id"].tolist() == list(range(200))
    due.put.assert_called_once_with([(i, i + 1001) for i in range(200, 500)])
    handle.registerTimer.assert_called_with(1201)


def test_index_follows_removals_and_late_versions(spark, tmp_path, rocksdb):
    schema, data, root = "slug string, content_hash string, body string, version int, gone boolean", tmp_path / "in", str(tmp_path / "out")
    batches = ([("a", "1", "one", 1, False), ("b", "1", "two", 1, False), ("c", "1", "three", 1, False), ("d", "9", "kept", 1, False)],
               [("a", "2", "", 2, False), ("b", "1", None, 2, True), ("c", "1", "three", 2, False), ("x", "1", None, 1, True)],
               [("b", "0", "old", 1, False), ("c", "3", "new", 3, False)], [("b", "5", "back", 3, False)])
    states = []
    for rows in batches:
        jobs.maintain_index(feed(spark, data, rows, schema), root, lambda p: chunking.chunk_pages(p), removed="gone")
        states.append({r.slug: r.text for r in jobs.current_chunks(spark, root).collect()})
    assert states == [{"a": "one", "b": "two", "c": "three", "d": "kept"}, {"c": "three", "d": "kept"}, {"c": "new", "d": "kept"}, {"b": "back", "c": "new", "d": "kept"}]
    changes = spark.read.parquet(f"{root}/pages").select("batch", "slug", "action").collect()
    assert sorted(map(tuple, changes))[4:] == [(1, "a", "updated"), (1, "b", "removed"), (2, "c", "updated"), (3, "b", "added")]


def test_places_of_texts_are_not_shuffled(spark):
    """Only found rules are gathered; the places of all texts stay in the task that reads them, also where a text repeats itself."""
    texts = spark.createDataFrame([(1, "b c b c b c"), (2, "x y"), (3, None)], "id long, text string")
    rules = spark.sql("SELECT * FROM VALUES (0, 'r', 'c b'), (1, 's', 'b c'), (2, 't', 'x') AS r(place, category, phrase)")
    out = policy.rule_matches(texts, rules)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and ("here#" in line or "first#" in line)]
    assert sorted(map(tuple, out.collect())) == [(1, 0, "r"), (2, 2, "t")]
