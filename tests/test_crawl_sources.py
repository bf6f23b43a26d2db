import json

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from compare import compare, pandas_rows
from corpuslake.operators import crawl, pages
from corpuslake.operators.pages import extract_pages
from corpuslake.sources import readers, schemas, writers


def urls(df):
    return sorted(r.url for r in df.collect())


REFS = "url string, lastmod string, pos int"


def test_filter_refs_keeps_first(spark):
    refs = spark.createDataFrame([("http://a.com/x", "1", 0), ("http://b.com/x", "1", 1), ("http://a.com/wp-content/u", "1", 2),
                                  ("http://a.com/x", "2", 3), ("http://a.com/y", None, 4)], REFS)
    assert sorted(map(tuple, crawl.filter_refs(refs, "a.com").collect())) == [("http://a.com/x", "1", 0), ("http://a.com/y", None, 4)]


def test_union_sitemaps_prefers_earlier_child(spark):
    a = spark.createDataFrame([("http://a.com/x", "1", 5)], REFS)
    b = spark.createDataFrame([("http://a.com/x", "2", 0), ("http://a.com/z", "3", 1)], REFS)
    got = {r.url: r.lastmod for r in crawl.union_sitemaps([a, b], "a.com").collect()}
    assert got == {"http://a.com/x": "1", "http://a.com/z": "3"}


@pytest.fixture(scope="module")
def state(spark):
    refs = spark.createDataFrame([("new", "1", 0), ("same", "1", 1), ("changed", "2", 2), ("failed", "1", 3), ("nomod", None, 4),
                                  ("oldnomod", "1", 5), ("skipped", "1", 6), ("empty", "", 7)], REFS)
    prev = spark.createDataFrame([("same", "1", "ok"), ("changed", "1", "ok"), ("failed", "1", "failed"), ("nomod", "1", "ok"),
                                  ("oldnomod", None, "ok"), ("skipped", "1", "skipped"), ("gone", "1", "ok"), ("empty", "1", "ok")],
                                 "url string, lastmod string, status string")
    full = prev.select("url", F.lit("t").alias("title"), F.col("url").alias("slug"), "lastmod", F.lit("c").alias("crawled_at"),
                       F.lit("h").alias("content_hash"), F.lit(1).alias("text_len"), "status", F.lit(None).cast("string").alias("error"))
    return refs, full


def test_crawl_plan(state):
    refs, prev = state
    plan = crawl.crawl_plan(refs, prev)
    assert urls(plan.filter("not recrawl")) == ["same", "skipped"]
    assert crawl.crawl_plan(refs, prev, force=True).filter("not recrawl").count() == 0
    assert urls(crawl.crawl_plan(refs, prev, limit=2).filter("recrawl")) == ["changed", "new"]


def test_carried_removed_skipped_and_manifest(state):
    refs, prev = state
    plan = crawl.crawl_plan(refs, prev)
    carried = crawl.carried_rows(prev, plan)
    assert urls(carried) == ["gone", "same", "skipped"]
    assert urls(crawl.removed_rows(prev, refs)) == ["gone"]
    assert urls(crawl.skipped_rows(prev, plan)) == ["same", "skipped"]
    rows = {r.url: r.status for r in crawl.manifest(prev.filter("url = 'changed'"), carried).collect()}
    assert rows == {"changed": "ok", "gone": "skipped", "same": "skipped", "skipped": "skipped"}


@pytest.mark.parametrize("status,moved", [("ok", "now"), ("failed", "before")])
def test_run_report_moves_only_on_success(spark, status, moved):
    results = spark.createDataFrame([("u", status, True, "boom")], "url string, status string, thin boolean, error string")
    none = results.filter("false")
    row = crawl.run_report(results, none, results, "now", "before").first()
    assert (row.last_successful_scrape, row.crawled, row.removed, row.skipped) == (moved, 1, 1, 0)
    assert row.thin_content == (status == "ok") and crawl.failed_pages(results).count() == (status == "failed")


def test_index_diff(spark):
    pages = spark.createDataFrame([("same", "1", True), ("changed", "2", True), ("new", "1", True), ("blank", "9", False)], "slug string, content_hash string, ok boolean")
    stored = spark.createDataFrame([("same", "1"), ("changed", "1"), ("gone", "1"), ("away", "1"), ("stub", "1")], "slug string, content_hash string")
    missing = spark.createDataFrame([("away",)], "slug string")
    got = dict(map(tuple, crawl.index_diff(pages, stored, missing, has_chunks=F.col("ok")).collect()))
    assert got == {"same": "skipped", "changed": "updated", "new": "added", "gone": "removed", "stub": "removed"}
    forced = dict(map(tuple, crawl.index_diff(pages, stored, missing, force=True).collect()))
    assert forced["same"] == "updated" and forced["blank"] == "added"


def test_fingerprints(spark):
    rows = spark.createDataFrame([("b", "2"), ("a", None), ("É", "3")], "slug string, content_hash string")
    first = crawl.corpus_fingerprint(rows)
    assert first.startswith("3:") and len(first) == 18 and first == crawl.corpus_fingerprint(rows.repartition(3))
    assert first != crawl.corpus_fingerprint(rows.unionByName(rows.limit(1)))
    assert first != crawl.corpus_fingerprint(rows.replace("2", "4")) and crawl.corpus_fingerprint(rows.limit(0)).startswith("0:")
    absent = crawl.fingerprint_lines(rows, F.col("slug") != "a")
    assert "a:" in [r.line for r in absent.collect()]


# ----------------------------------------------------------------------- markup
@pytest.mark.parametrize("markup,title,body", [
    ("<html><head><title>T - Acme</title></head><body><nav>n</nav><main><h2>Hi <b>you</b></h2><p>a<br>b</p></main></body></html>", "T", "## Hi **you**\n\na  \nb"),
    ("<body><header><h1> Top </h1></header><article><p>one</p></article></body>", "Top", "one"),
    ("<body><article>a</article><article>b</article><div class='x et_pb_posts'>no</div><div>c</div></body>", "", "a\n\nb\n\nc"),
    ("<body><div class='cookie-bar'>no</div><p>x <a href='/y'>link</a><ul><li>1<li>2</ul><script>q</script></body>", "", "x [link](/y)\n\n* 1\n* 2"),
    ("<p>no body &amp; text", "", ""),
    ("<body><table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2</td></tr></table><ol><li>x</li></ol></body>", "", "| a | b |\n| --- | --- |\n| 1 | 2 |\n\n1. x"),
    ("<body><div id='my-cookie'>no</div><div class='et_pb_post_x'>yes</div><noscript>n</noscript><form>f</form></body>", "", "yes")])
def test_page_text(spark, markup, title, body):
    assert page_text(spark, markup, " - Acme") == (title, body)


def page_text(spark, markup, suffix=""):
    return tuple(extract_pages(spark.createDataFrame([(markup,)], "html string"), suffix).select("title", "markdown").first())


@pytest.mark.parametrize("markup,body", [
    ("<body><div><nav>a<div>b</div></nav>c</div><header><header>d</header>e</header>f</body>", "c\n\nf"),
    ("<body><div class='share'><p>x<p>y</div><p class=social>z<p>kept</body>", "kept"),
    ("<body><ul><li>a<ul><li>b</li></ul></li><li><p>c</p></li></ul><ol><li>x</li><li>y</li></ol></body>", "* a\n  * b\n* c\n\n1. x\n2. y"),
    ("<body><blockquote><p>a</p><p>b</p></blockquote><pre> x\n  y </pre><hr><h3> </h3><b> bold </b>t<i></i></body>", "> a\n\n> b\n\n```\n x\n  y\n```\n\n---\n\n**bold** t"),
    ("<body><!-- <main>no</main> --><a href=\"/a?b=1&amp;c=2\"> l &lt; m </a><a>n</a><a href=/q></a> 1 < 2 <img src=s alt='A>B'></body>", "[l < m](/a?b=1&c=2)n 1 < 2 ![A>B](s)"),
    ("<body><main>one</main><main>two</main></body>", "one"), ("<body><article>a</article><header><article>b</article></header></body>", "a")])
def test_page_markdown(spark, markup, body):
    assert page_text(spark, markup)[1] == body


def test_pages_keep_their_columns(spark):
    rows = [(1, "<body>a", "x", 5), (1, "<body>a", "x", 5), (None, None, None, None), (2, "", "y", 1), (3, "<body><p>" + "w " * 200000 + "<b>" * 3000, "z", 2)]
    out = extract_pages(spark.createDataFrame(rows, "pos int, html string, tag string, `end` int")).collect()
    assert sorted((r.pos or 0, r.tag, r["end"], None if r.markdown is None else len(r.markdown)) for r in out) == [
        (0, None, None, None), (1, "x", 5, 1), (1, "x", 5, 1), (2, "y", 1, 0), (3, "z", 2, 399999)]


def test_clean_pages(spark):
    raw = spark.createDataFrame([("http://x/a/b", "<body><p>" + "w" * 250 + "</p></body>"), ("http://x/", "<body>thin</body>"), ("http://x/n", None)], "url string, html string")
    got = {r.url: r for r in crawl.clean_pages(raw).collect()}
    assert (got["http://x/a/b"].slug, got["http://x/a/b"].text_len, got["http://x/a/b"].thin) == ("a__b", 250, False)
    assert got["http://x/"].thin and got["http://x/"].content_hash.startswith("sha256:") and got["http://x/n"].markdown is None


# ---------------------------------------------------------------------- sources
def test_manifest_and_previous(spark, tmp_path):
    path = tmp_path / "index.jsonl"
    rows = [{"url": "a", "slug": "a", "status": "ok", "lastmod": "1"}, {"url": "b", "slug": "b", "status": "failed"},
            {"url": "a", "slug": "a", "status": "skipped", "lastmod": "2"}, {"slug": "no-url", "status": "ok"}]
    path.write_text("\n\n".join(json.dumps(r) for r in rows) + "\n")
    assert readers.read_manifest(spark, str(path)).count() == 3
    got = {r.url: r.lastmod for r in readers.read_previous(spark, str(path)).collect()}
    assert got == {"a": "2", "b": None}
    assert readers.read_previous(spark, str(tmp_path / "none.jsonl")).count() == 0


def test_sitemaps(spark, tmp_path):
    path = tmp_path / "urls.xml"
    path.write_text("""<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">
<url><loc> http://a.com/1 </loc><lastmod>2024-01-01</lastmod></url><url><loc></loc></url><url><lastmod>x</lastmod></url><url><loc>http://a.com/2</loc></url></urlset>""")
    got = readers.read_sitemap(spark, str(path)).orderBy("pos").collect()
    assert [(r.url, r.lastmod) for r in got] == [("http://a.com/1", "2024-01-01"), ("http://a.com/2", None)]
    empty = tmp_path / "empty.xml"
    empty.write_text("<urlset></urlset>")
    with pytest.raises(ValueError):
        readers.read_sitemap(spark, str(empty), require_nonempty=True)
    index = spark.createDataFrame([('<sitemapindex xmlns="http://x"><sitemap><loc> a </loc></sitemap><sitemap><loc>b</loc></sitemap></sitemapindex>',)], "x string")
    assert index.select(readers.sitemap_locations(F.col("x"))).first()[0] == ["a", "b"]


def test_corpus_loading(spark, tmp_path):
    pages = tmp_path / "pages"
    pages.mkdir()
    (pages / "long.md").write_text("---\nurl: x\n---\n" + "w" * 100 + "\n")
    (pages / "stub.md").write_text("---\nurl: x\n---\n  " + "w" * 99)
    manifest = spark.createDataFrame([(s, s, s, "h") for s in ("long", "stub", "gone")], "slug string, url string, title string, content_hash string")
    files = readers.read_page_files(spark, str(pages))
    got = readers.load_corpus(manifest, files).collect()
    assert [(r.slug, r.body) for r in got] == [("long", "w" * 100 + "\n")]
    assert [r.slug for r in readers.missing_files(manifest, files).collect()] == ["gone"]


def test_traces_and_recent(spark, tmp_path):
    path = tmp_path / "t.jsonl"
    path.write_text('{"ts": "2", "path": "a", "latency_ms": 5, "tool_calls": ["x"]}\nnot json\n{"ts": "1", "path": "b"}\n{"ts": "3", "path": "c"}\n')
    traces = readers.read_traces(spark, str(path))
    rows = {r.ts: r for r in traces.collect()}
    assert sorted(rows) == ["1", "2", "3"] and rows["1"].tool_calls == [] and rows["1"].latency_ms is None
    assert [r.ts for r in readers.recent_records(traces, 2).collect()] == ["2", "3"]
    assert [r.ts for r in readers.recent_records(traces).collect()] == ["1", "2", "3"]


def test_gold_problems(spark, tmp_path):
    path = tmp_path / "gold.jsonl"
    rows = ['{"id": "ok", "q": "q", "expect": "retrieve", "slug": "s"}', "", "{broken", '{"q": "x", "expect": "abstain"}', '{"id": "ok", "expect": "abstain"}',
            '{"id": "e", "expect": "maybe"}', '{"id": "r", "expect": "retrieve"}', '{"id": "a", "expect": "abstain", "slug": "s"}',
            '{"id": "p", "expect": "abstain", "paraphrase_of": "nobody"}', '{"id": "u", "expect": "retrieve", "slug": "unknown"}']
    path.write_text("\n".join(rows))
    cases = readers.read_gold(spark, str(path))
    known = spark.createDataFrame([("s",)], "slug string")
    got = {(r.id, r.problem) for r in readers.gold_problems(cases, known).collect()}
    assert {p for i, p in got if i == ""} >= {"missing id"} and ("", "line 3 is not JSON") in got
    assert {("ok", "duplicate id"), ("e", "unknown expect"), ("r", "retrieve without slug"), ("a", "abstain with slug"),
            ("p", "paraphrase_of is not a case"), ("u", "slug not in the corpus")} <= got
    with pytest.raises(ValueError):
        readers.require_valid_gold(cases)
    path.write_text(rows[0])
    assert readers.require_valid_gold(readers.read_gold(spark, str(path)), known).count() == 1
    assert readers.read_cases(spark, str(tmp_path / "none"), schemas.POLICY_CASE).count() == 0


def test_publish_flips_the_pointer(spark, tmp_path):
    root = str(tmp_path / "m")
    assert writers.current_version(spark, root).count() == 0
    row = spark.createDataFrame([("u1", "s1", "ok")], "url string, slug string, status string")
    writers.publish_version(row, root)
    writers.publish_version(row.unionByName(row.withColumn("url", F.lit("u2"))), root)
    assert urls(writers.current_version(spark, root)) == ["u1", "u2"]


def test_small_writers(spark, tmp_path):
    page = spark.createDataFrame([("s", "u", "T", "c", None, "h", "body", "<p>")], "slug string, url string, title string, crawled_at string, lastmod string, content_hash string, markdown string, html string")
    writers.write_pages(page, str(tmp_path / "p"), str(tmp_path / "raw"))
    assert spark.read.parquet(str(tmp_path / "p")).first().document == "---\nurl: u\ntitle: T\ncrawled_at: c\nlastmod: \ncontent_hash: h\n---\nbody\n"
    assert spark.read.parquet(str(tmp_path / "raw")).first().html == "<p>"
    traces = spark.createDataFrame([("1",)], "ts string")
    assert writers.append_traces(traces, str(tmp_path / "t")) and writers.append_traces(traces, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2 and not writers.append_traces(traces, str(tmp_path / "t"), enabled=False)
    blocked = tmp_path / "file"
    blocked.write_text("x")
    assert writers.append_traces(traces, str(blocked / "below")) is False
    writers.write_report(spark.createDataFrame([(3, "now")], "crawled int, at string"), str(tmp_path / "report.json"))
    assert json.loads((tmp_path / "report.json").read_text()) == {"crawled": 3, "at": "now"}
    results = spark.createDataFrame([("g1", 0, 0.9, 0.9)], "id string, rank int, gold_score double, top1_score double")
    writers.write_baseline(results, str(tmp_path / "b"), "model", "1:x")
    assert writers.read_baseline(spark, str(tmp_path / "b")).first().embed_model == "model"


def test_upsert_chunks_and_inventory(spark, tmp_path):
    old = spark.createDataFrame([("a#0", "a", "1"), ("a#1", "a", "2"), ("b#0", "b", "3"), ("c#0", "c", "4")], "id string, slug string, text string")
    fresh = spark.createDataFrame([("a#0", "a", "new")], "id string, slug string, text string")
    got = {r.id: r.text for r in writers.upsert_chunks(old, fresh, spark.createDataFrame([("c",)], "slug string")).collect()}
    assert got == {"a#0": "new", "b#0": "3"}
    (tmp_path / "x.txt").write_bytes(b"%PDF-1.4")
    (tmp_path / "y.pdf").write_bytes(b"PK\x03\x04")
    assert {r.path[-5:]: r.kind for r in readers.file_inventory(spark, str(tmp_path)).collect()} == {"x.txt": "pdf", "y.pdf": "zip"}
    (tmp_path / "card.csv").write_text("role,rate\nLead,10.5\n")
    assert str(readers.read_rate_card(spark, str(tmp_path / "card.csv")).first().rate) == "10.50"


def test_pointer_is_replaced_in_one_step(spark, tmp_path):
    """The pointer is never absent between two versions, and its old text stays if the new one cannot be written."""
    root = str(tmp_path / "p")
    first = writers.publish_version(spark.range(1), root, "json")
    second = writers.publish_version(spark.range(2), root, "json")
    assert first != second and (tmp_path / "p" / "CURRENT").read_text() == second
    assert not (tmp_path / "p" / "CURRENT.tmp").exists()


@pytest.mark.parametrize("name", ["crawl_plan", "crawl_plan_limited", "crawl_sets", "manifest_union", "run_report"])
def test_urls_listed_more_than_once(spark, tmp_path, name):
    """Every listing of a url is a row of the plan, as in the SQL form, and counts towards the limit."""
    rows = [(i, f"https://a.example.com/p{i % 9}{'?q=1' if i % 3 == 0 else ''}", "x" * (1490 + 7 * i)) for i in range(40)]
    rows += [(40 + i, f"http://a.example.com/q{i % 4}", "y" * i) for i in range(9)] + [(60 + i, "https://b.example.net/same", "z" * (i + 1)) for i in range(3)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    got = pandas_rows(entry.queries()[name](spark, str(tmp_path)))
    assert compare(got, con.execute(entry.oracle_sql()[name]).df()) is None


def test_tasks_of_pages_grow_with_the_html(spark, monkeypatch):
    """A task's share of the pages is bounded, whatever the number of shuffle partitions."""
    monkeypatch.setattr(pages, "_TASK_CHARS", 500, raising=False)
    raw = spark.createDataFrame([(i, f"<body><h1>t{i}</h1><p>{'x' * 90}</p></body>") for i in range(100)], "page_id long, html string")
    out = extract_pages(raw)
    assert out.rdd.getNumPartitions() >= 20
    assert sorted((r.page_id, r.title) for r in out.collect()) == [(i, f"t{i}") for i in range(100)]
