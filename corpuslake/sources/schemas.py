"""Explicit schemas (DDL) of the tables the jobs read and write."""

MANIFEST = (
    "url string, title string, slug string, lastmod string, crawled_at string, "
    "content_hash string, text_len int, status string, error string")
MANIFEST_COLUMNS = [field.split()[0] for field in MANIFEST.split(", ")]
GOLD = "id string, q string, expect string, slug string, axis string, paraphrase_of string"
TRACE = (
    "ts string, session_id string, path string, model string, latency_ms int, prompt_tokens int, "
    "completion_tokens int, total_tokens int, tool_calls array<string>, error string, "
    "is_grounded boolean, confidence double, guardrail_reason string, cost_usd double")
POLICY_CASE = "id string, input string, expected string, category string"
CLAIM_CASE = (
    "file string, brief_words array<string>, requirements struct<target_platform:array<string>,"
    "features:array<string>,constraints:array<string>,tech_stack:array<string>>")
CHUNK = (
    "id string, slug string, url string, title string, text string, score double, "
    "chunk_index int, total_chunks int")
BASELINE = "id string, rank int, gold_score double, top1_score double, embed_model string, fingerprint string"
