"""Queries over the driver tables, one per operator, and their SQL forms."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


_OP1_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
h AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 34], ' ')) AS h
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35)),
r AS (SELECT doc_id, i FROM h WHERE h IN (SELECT h FROM h GROUP BY h HAVING count(*) > 1)),
c AS (SELECT DISTINCT doc_id, i + j AS pos FROM r, range(35) t(j)),
k AS (SELECT u.doc_id, u.word, u.pos FROM (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos FROM w) u
      ANTI JOIN c ON u.doc_id = c.doc_id AND u.pos = c.pos),
t AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS kept FROM k GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(t.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t.kept, '')) AS kept_sha256
FROM w LEFT JOIN t USING (doc_id)
"""


@query("op1_substring_dedup", _OP1_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words of its repeated 35-word windows."""
    from .substring_dedup import substring_dedup

    return substring_dedup(C.table(spark, sf_dir), kept_text=False).select(
        "doc_id", F.col("n_tokens").alias("n_words"), "n_removed", "kept_sha256")


@query("op5_suffix_dedup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes of its repeated 400-byte strings."""
    from .suffix_dedup import suffix_dedup

    return suffix_dedup(C.table(spark, sf_dir), kept_text=False).select(
        "doc_id", F.col("n_tokens").alias("n_bytes"), "n_removed", "n_spans", "kept_sha256")


@query("op8_quality_rules")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base rule and adaptive verdict of every document."""
    from .quality_rules import quality_rules

    return quality_rules(C.table(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op10_ring_sharding")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard of 40, of equal row counts."""
    from .ring_sharding import ring_shards

    return ring_shards(C.table(spark, sf_dir)).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def damaged_copy(pages: DataFrame) -> DataFrame:
    """A replica of ``pages`` in which records were lost, doubled or changed, as a digest of their content decides."""
    pages = pages.withColumn("mark", F.substring(F.md5(F.coalesce("html", F.lit("")).cast("binary")), 1, 2))
    mark = F.col("mark")
    html = F.when(mark == "00", F.concat(F.lit("?"), F.col("html"))).when(mark == "01", F.reverse("html")).otherwise(F.col("html"))
    copies = F.when(mark == "02", 0).when(mark == "03", 2).otherwise(1)
    return (pages.withColumn("html", html).withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(1))))
            .filter(F.col("copy") < copies).drop("copy", "mark"))


_OP2_SQL = """
WITH r AS (SELECT page_id, substr(md5(coalesce(html, '')), 1, 2) AS mark, html,
                  strlen('WARC/1.1' || 'WARC-Type: response' || 'WARC-Target-URI: ' || coalesce(url, '')
                         || 'Content-Type: text/html; charset=utf-8' || 'Content-Length: ') + 16
                  + strlen(CAST(strlen(coalesce(html, '')) AS VARCHAR)) + strlen(coalesce(html, '')) AS size FROM pages),
o AS (SELECT *, size + CASE WHEN mark = '00' THEN 1 + strlen(CAST(strlen(coalesce(html, '')) + 1 AS VARCHAR)) - strlen(CAST(strlen(coalesce(html, '')) AS VARCHAR)) ELSE 0 END AS new_size,
             sum(size) OVER (ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r)
SELECT page_id AS key, CASE WHEN mark = '02' THEN 'missing' ELSE 'changed' END AS state,
       CAST(size AS BIGINT) AS original_bytes, CAST(CASE mark WHEN '02' THEN 0 WHEN '03' THEN 2 * size ELSE new_size END AS BIGINT) AS replica_bytes,
       CAST(coalesce(before, 0) AS BIGINT) AS record_offset
FROM o WHERE mark IN ('00', '02', '03') OR mark = '01' AND html <> reverse(html)
"""


@query("op2_fixity_audit", _OP2_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records in which an archive of all pages and its damaged replica differ."""
    from .fixity_audit import fixity_audit, record_bytes

    pages = C.table(spark, sf_dir, "pages")
    return fixity_audit(pages, damaged_copy(pages), "page_id", lambda f: record_bytes(f["url"], f["html"])).drop("nodes_read")


_OP3_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
q AS (SELECT DISTINCT item_id, least(13, len(ws)) AS m, array_to_string(ws[i:i + least(13, len(ws)) - 1], ' ') AS w
      FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
s AS (SELECT DISTINCT m FROM q),
p AS (SELECT doc_id, m, i, array_to_string(ws[i:i + m - 1], ' ') AS w
      FROM (SELECT doc_id, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM d, s WHERE len(ws) >= m)),
h AS (SELECT p.doc_id, p.i, p.m, q.item_id FROM p JOIN q ON p.w = q.w AND p.m = q.m),
c AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM (SELECT DISTINCT doc_id, i, m FROM h), range(13) t(j) WHERE j < m GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(c.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(t.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(t.items, '')) AS items_sha256, coalesce(c.n, 0) > 0 AND 20 * coalesce(c.n, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""


@query("op3_decontamination", _OP3_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside 13-word windows of the benchmark."""
    from .decontamination import decontamination

    docs = C.table(spark, sf_dir)
    found = decontamination(docs, C.table(spark, sf_dir, "benchmark"))
    return C.keyed(docs).drop("text").join(found, ["did", "dn"]).drop("did", "dn")


@query("op4_pii")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain and disguised identifiers of every document."""
    from .pii import pii_spans

    return pii_spans(C.table(spark, sf_dir))


@query("op7_ngram_join")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of near copies of every document."""
    from .ngram_join import component_ids

    return component_ids(C.table(spark, sf_dir))


def _crc32_sql(text: str) -> str:
    """Unsigned CRC-32 of an ASCII text, which the SQL engine does not have."""
    bit = "list_reduce([0, 1, 2, 3, 4, 5, 6, 7], lambda x, j: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(a, b))"
    codes = f"list_transform(string_split({text}, ''), lambda c: CAST(ascii(c) AS BIGINT))"
    return f"xor(4294967295, list_reduce({codes}, lambda a, b: {bit}, CAST(4294967295 AS BIGINT)))"


_OP11_SQL = f"""
WITH o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos,
                  coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
s AS (SELECT conv_id, count(*) AS n, {_crc32_sql('CAST(conv_id AS VARCHAR)')} % 9 AS h FROM o GROUP BY conv_id),
k AS (SELECT s.conv_id, s.h, least(s.h, coalesce(l.n, 0)) AS taken FROM s LEFT JOIN s l ON l.conv_id = s.conv_id - s.conv_id % 5),
r AS (SELECT k.conv_id, o.pos, o.role, o.text FROM k JOIN o ON o.conv_id = k.conv_id - k.conv_id % 5 AND o.pos < k.h
      UNION ALL SELECT k.conv_id, o.pos - k.h + k.taken, o.role, o.text FROM k JOIN o ON o.conv_id = k.conv_id AND o.pos >= k.h),
seq AS (SELECT k.conv_id, coalesce(list(sha256(strlen(r.role) || ':' || r.role || r.text) ORDER BY r.pos) FILTER (r.pos IS NOT NULL), []) AS names,
               coalesce(list(strlen(r.text) ORDER BY r.pos) FILTER (r.pos IS NOT NULL), []) AS sizes
        FROM k LEFT JOIN r USING (conv_id) GROUP BY k.conv_id),
p AS (SELECT conv_id, d, array_to_string(names[1:d], ',') AS prefix, CASE WHEN d > 0 THEN array_to_string(names[1:d - 1], ',') END AS parent,
             d = len(names) AS ended, CASE WHEN d > 0 THEN sizes[d] ELSE 0 END AS bytes
      FROM (SELECT *, unnest(range(0, len(names) + 1)) AS d FROM seq)),
n AS (SELECT d, prefix, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(bytes) AS saved,
             sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ended), '')) AS ends_sha256 FROM p GROUP BY d, prefix),
c AS (SELECT n.*, (SELECT count(*) FROM n m WHERE m.d = n.d + 1 AND m.parent = n.prefix) AS n_children FROM n),
t AS (SELECT a.d, a.prefix, count(*) FILTER (b.n_children = 0) AS n_leaves, sum(b.saved) AS saved_tokens
      FROM c a JOIN c b ON b.d >= a.d AND (a.d = 0 OR b.prefix = a.prefix OR starts_with(b.prefix, a.prefix || ',')) GROUP BY a.d, a.prefix)
SELECT c.conv_id, CAST(c.d AS BIGINT) AS depth, q.conv_id AS parent_conv_id, CAST(c.n_convs AS BIGINT) AS n_convs, CAST(c.n_children AS BIGINT) AS n_children,
       CAST(t.n_leaves AS BIGINT) AS n_leaves, CAST(t.saved_tokens AS BIGINT) AS saved_tokens, c.ends_sha256
FROM c JOIN t USING (d, prefix) LEFT JOIN n q ON q.d = c.d - 1 AND q.prefix = c.parent
"""


@query("op11_prefix_trie", _OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct prefix of the rebuilt conversations, with its totals."""
    from .prefix_trie import ordered_turns, prefix_trie, rebuilt

    sizes, turns = rebuilt(ordered_turns(C.table(spark, sf_dir, "conversations")))
    return prefix_trie(sizes, turns, texts=False)


# The tables' pages hold their text in one article element, without parts of other kinds, and these four references.
_OP12_SQL = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1) AS body FROM pages),
b AS (SELECT page_id, url, regexp_replace(regexp_replace(body, '(?i)</?(?:h1|p|br)>', chr(10), 'g'), '<[^>]*>', '', 'g') AS t FROM a),
c AS (SELECT page_id, url, replace(regexp_replace(replace(replace(replace(t, '&quot;', '"'), '&copy;', chr(169)), '&middot;', chr(183)), '&amp;?', chr(1), 'g'), chr(1), '&') AS t FROM b),
d AS (SELECT page_id, url, trim(regexp_replace(t, '\s+', ' ', 'g')) AS text FROM c)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM d
"""


@query("op12_line_blocks", _OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    from .line_blocks import extract_main_text

    return extract_main_text(C.table(spark, sf_dir, "pages"))


def _leaf_sql(text: str) -> str:
    part = lambda v: f"coalesce(strlen(CAST({v} AS VARCHAR)) || ':' || {v}, '-')"
    return f"sha256({' || '.join(part(v) for v in ('doc_id', 'source', 'lang', 'n_chars', text))})"


_OP13_SQL = f"""
WITH RECURSIVE d AS (SELECT *, {_leaf_sql('text')} AS leaf,
       CASE WHEN {_crc32_sql('CAST(doc_id AS VARCHAR)')} % 2 = 0 THEN {_leaf_sql("replace(text, chr(10), '')")} ELSE {_leaf_sql('text')} END AS forged FROM documents),
f AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
             row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM d),
lower_tree AS (SELECT tree, 0 AS level, i, n, leaf AS h FROM f
  UNION ALL SELECT tree, level + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM lower_tree WHERE n > 1 GROUP BY tree, level, i // 3, n),
upper_tree AS (SELECT 0 AS level, tree AS i, count(*) OVER () AS n, h FROM lower_tree WHERE n = 1
  UNION ALL SELECT level + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM upper_tree WHERE n > 1 GROUP BY level, i // 3, n),
w AS (SELECT doc_id, tree, leaf, 0 AS level, i, n, '' AS proof, forged AS h FROM f
  UNION ALL SELECT w.doc_id, w.tree, w.leaf, w.level + 1, w.i // 3, (w.n + 2) // 3, w.proof || s.siblings, sha256(s.before || w.h || s.after)
  FROM w, LATERAL (SELECT coalesce(string_agg(t.h, '' ORDER BY t.i) FILTER (t.i <> w.i), '') AS siblings, coalesce(string_agg(t.h, '' ORDER BY t.i) FILTER (t.i < w.i), '') AS before,
                          coalesce(string_agg(t.h, '' ORDER BY t.i) FILTER (t.i > w.i), '') AS after
                   FROM lower_tree t WHERE t.tree = w.tree AND t.level = w.level AND t.i // 3 = w.i // 3) s WHERE w.n > 1),
u AS (SELECT w.doc_id, w.leaf, w.h AS folded, w.proof, w.tree AS i, 0 AS level, (SELECT count(*) FROM lower_tree WHERE n = 1) AS n, x.h AS subroot, w.h
      FROM w JOIN lower_tree x ON x.tree = w.tree AND x.n = 1 WHERE w.n = 1
  UNION ALL SELECT u.doc_id, u.leaf, u.folded, u.proof || s.siblings, u.i // 3, u.level + 1, (u.n + 2) // 3, u.subroot, sha256(s.before || u.h || s.after)
  FROM u, LATERAL (SELECT coalesce(string_agg(t.h, '' ORDER BY t.i) FILTER (t.i <> u.i), '') AS siblings, coalesce(string_agg(t.h, '' ORDER BY t.i) FILTER (t.i < u.i), '') AS before,
                          coalesce(string_agg(t.h, '' ORDER BY t.i) FILTER (t.i > u.i), '') AS after
                   FROM upper_tree t WHERE t.level = u.level AND t.i // 3 = u.i // 3) s WHERE u.n > 1)
SELECT u.doc_id, u.leaf, u.subroot, r.h AS root, sha256(u.proof) AS proof_sha256, u.h AS folded_root, u.h = r.h AS verified
FROM u, (SELECT h FROM upper_tree WHERE n = 1) r WHERE u.n = 1
"""


@query("op13_manifest_proofs", _OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in the dataset's Merkle manifest, and whether its delivered text still proves it."""
    from .manifest_proofs import manifest, record_digest

    fields = lambda text: [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")] + [text]
    text = F.col("text")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    forged = F.when(tampered & text.contains("\n"), record_digest(*fields(F.replace(text, F.lit("\n"), F.lit("")))))
    return manifest(C.table(spark, sf_dir), "doc_id", "source", record_digest(*fields(text)), forged).drop("segment")


def tokenizer_path() -> str:
    """The public byte-level tokenizer that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op9_harmonic_packing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document, packed into sequences of 2048 tokens."""
    from .harmonic_packing import harmonic_packing

    return harmonic_packing(C.table(spark, sf_dir), tokenizer_path())


@query("op6_token_files")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, written to coded files and read back."""
    from uuid import uuid4

    from corpuslake.session import checkpoint_dir

    from .token_files import read_token_files, write_token_files

    folder = f"{checkpoint_dir(spark)}/token-files-{uuid4().hex}"
    write_token_files(C.table(spark, sf_dir), folder, tokenizer_path())
    return read_token_files(spark, folder)


def catalog() -> tuple[dict, dict]:
    """All queries of the subpackage and their SQL forms, the pipeline included."""
    pipeline = import_module("corpus_pipeline")
    queries, oracles = {**QUERIES, "pipeline": pipeline.run}, dict(ORACLES)
    if pipeline.ORACLE_SQL is not None:
        oracles["pipeline"] = pipeline.ORACLE_SQL
    return queries, oracles
