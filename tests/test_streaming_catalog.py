import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from corpuslake.plans import load_catalog
from compare import compare, oracle, pandas_rows
from corpuslake.operators.chunking import chunk_pages
from corpuslake.session import checkpoint_dir
from corpuslake.streaming import jobs

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module", autouse=True)
def rocksdb(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.ROCKSDB)


def feed(spark, folder, *batches, schema):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.read.parquet(str(folder)).schema


def test_checkpoint_folder_comes_from_the_session(spark):
    assert checkpoint_dir(spark) == checkpoint_dir(spark)


def test_state_survives_batches(spark, tmp_path):
    data, root = tmp_path / "in", str(tmp_path / "out")
    schema = "conv_id long, turn long, role string, text string"
    kind = feed(spark, data, [(1, 0, "user", "a"), (1, 1, "assistant", "b")], schema=schema)

    def run():
        jobs.run_to_log(jobs.session_memory(jobs.read_stream(spark, str(data), kind), size=2), root)

    run()
    feed(spark, data, [(1, 3, "user", "d"), (1, 2, "user", "c"), (2, 0, "user", "z")], schema=schema)
    run()
    got = {(r.conv_id, r.turn): r.context for r in jobs.read_log(spark, root).collect()}
    assert got == {(1, 0): "", (1, 1): "user: a", (1, 2): "user: a\nassistant: b", (1, 3): "assistant: b\nuser: c", (2, 0): ""}


def test_streak_survives_batches(spark, tmp_path):
    data, root = tmp_path / "in", str(tmp_path / "out")
    schema = "event_id long, user_id long, ts string, miss boolean, reset boolean"
    kind = feed(spark, data, [(i, 7, str(i), True, False) for i in range(3)], schema=schema)
    for batch in ([(3, 7, "3", True, False), (4, 7, "4", True, False)], [(5, 7, "5", False, True), (6, 7, "6", True, False)]):
        jobs.run_to_log(jobs.streaks(jobs.read_stream(spark, str(data), kind), "user_id"), root)
        feed(spark, data, batch, schema=schema)
    jobs.run_to_log(jobs.streaks(jobs.read_stream(spark, str(data), kind), "user_id"), root)
    got = {r.event_id: (r.streak, r.escalate) for r in jobs.read_log(spark, root).collect()}
    assert got == {0: (1, False), 1: (2, False), 2: (3, False), 3: (0, True), 4: (1, False), 5: (0, False), 6: (1, False)}


def test_index_follows_changes_only(spark, tmp_path):
    data, root = tmp_path / "in", str(tmp_path / "out")
    schema = "slug string, content_hash string, body string, version int"
    kind = feed(spark, data, [("a", "9", "old", 1), ("a", "1", "older", 0), ("a", "5", "one", 2), ("b", "1", "two", 1)], schema=schema)

    def run():
        jobs.maintain_index(jobs.read_stream(spark, str(data), kind), root, lambda p: chunk_pages(p))

    run()
    feed(spark, data, [("a", "5", "one", 3), ("b", "2", "three", 2), ("c", "1", "four", 1)], schema=schema)
    run()
    assert {r.slug: r.text for r in jobs.current_chunks(spark, root).collect()} == {"a": "one", "b": "three", "c": "four"}
    assert sorted((r.batch, r.slug) for r in jobs.read_log(spark, root).collect()) == [(0, "a"), (0, "b"), (1, "b"), (1, "c")]


def test_pages_of_a_group_share_one_state():
    import pandas as pd

    class Kept(list):
        calls = 0

        def exists(self):
            Kept.calls += 1
            return bool(self)

        def get(self):
            Kept.calls += 1
            return iter(list(self))

        def put(self, rows):
            Kept.calls += 1
            self[:] = rows

    class Handle:
        def getListState(self, name, schema):
            return Kept()

    def rows(versions, hash_, removed=False):
        return pd.DataFrame([(str(i), v, f"{hash_}{i}", removed, str(i), 1) for i, v in versions],
                            columns=["slug", "version", "content_hash", "removed", "index_page", "index_group"])

    pages = jobs.PageVersions("version", "removed")
    pages.init(Handle())
    run = lambda *frames: {r.slug: r.action for f in pages.handleInputRows((1,), iter(frames), None) for r in f.itertuples()}
    assert run(rows([(i, 1) for i in range(300)], "a"), rows([(i, 2) for i in range(300)], "b")) == {str(i): "added" for i in range(300)}
    assert Kept.calls <= 3
    assert run(rows([(i, 1) for i in range(300)], "a")) == {}
    assert run(rows([(0, 3)], "b"), rows([(1, 3)], "c"), rows([(2, 3)], "b", True)) == {"1": "updated", "2": "removed"}
    assert run(rows([(2, 2)], "b")) == {} and run(rows([(2, 4)], "b")) == {"2": "added"}


def test_index_groups_keep_wide_and_null_values(spark, tmp_path):
    data, root = tmp_path / "in", str(tmp_path / "out")
    schema = "slug long, content_hash string, body string, version int, removed boolean, size long"
    wide = 2 ** 53 + 1
    kind = feed(spark, data, [(wide, "1", "one", 1, False, None), (wide + 1, "2", "two", 1, None, wide), (None, "3", "three", 1, False, 5)], schema=schema)
    changes = jobs.page_changes(jobs.read_stream(spark, str(data), kind), removed="removed", groups=1)
    jobs.run_to_log(changes, root)
    got = {(r.slug, r.body, r.size, r.action) for r in jobs.read_log(spark, root).collect()}
    assert got == {(wide, "one", None, "added"), (wide + 1, "two", wide, "added"), (None, "three", 5, "added")}


def test_windows_drop_late_rows(spark, tmp_path):
    data, root = tmp_path / "in", str(tmp_path / "out")
    schema = "ts timestamp, k string, value double"

    def rows(*times):
        return [(F_time, "k", 1.0) for F_time in times]

    import datetime as dt

    def at(minute):
        return dt.datetime(2024, 1, 1, 10, 0) + dt.timedelta(minutes=minute)

    kind = feed(spark, data, rows(at(1), at(2), at(61)), schema=schema)
    run = lambda: jobs.run_to_log(jobs.windowed_metrics(jobs.read_stream(spark, str(data), kind), "ts", ["k"]), root, "update")
    run()
    feed(spark, data, rows(at(3), at(62)), schema=schema)
    run()
    got = {r.window_start.minute + 60 * (r.window_start.hour - 10): r.n for r in jobs.latest_rows(jobs.read_log(spark, root), ["window_start", "k"]).collect()}
    assert got == {0: 2, 60: 2}


def test_session_windows_and_upload_dedupe(spark, tmp_path):
    import datetime as dt

    base = dt.datetime(2024, 1, 1, 10, 0)
    rows = [(base + dt.timedelta(minutes=m), "u", "h") for m in (0, 10, 100, 500)]
    data = tmp_path / "in"
    kind = feed(spark, data, rows, schema="ts timestamp, u string, sha string")
    jobs.run_to_log(jobs.session_metrics(jobs.read_stream(spark, str(data), kind), "ts", "u"), str(tmp_path / "s"))
    assert sorted(r.n for r in jobs.read_log(spark, str(tmp_path / "s")).collect())[-1] == 2
    jobs.run_to_log(jobs.first_uploads(jobs.read_stream(spark, str(data), kind), "ts", ["u", "sha"]), str(tmp_path / "d"))
    assert jobs.read_log(spark, str(tmp_path / "d")).count() == 1


# ---------------------------------------------------------------------- catalog
def test_entry_and_keys(spark):
    queries, sql = entry.queries(), entry.oracle_sql()
    own, forms = load_catalog()
    assert set(sql) <= set(queries) and set(own) <= set(queries)
    assert set(own) - set(forms) == {"keyword_excerpts", "project_phases", "cell_topk", "retrieval_chain"}
    assert entry.entry(spark).count() == 4


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="test data is not here")
def test_catalog_against_sql(spark):
    """Every query with an SQL form gives the same rows on the smallest tables."""
    con, sql, queries = oracle(SMALL), entry.oracle_sql(), entry.queries()
    problems = {}
    for name, text in sql.items():
        problem = compare(pandas_rows(queries[name](spark, SMALL)), con.execute(text).df())
        if problem:
            problems[name] = problem[:300]
    assert not problems


@pytest.mark.parametrize("name", ["redact_pii", "chunk_documents", "text_metrics_share"])
def test_text_queries_stay_in_the_jvm(spark, name):
    plan = entry.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_scans_read_only_what_they_need(spark):
    plan = entry.queries()["ttl_sweep"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "props" not in plan and "user_id" not in plan
