"""Registered queries and, where SQL can say the same, their SQL for another engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Views of docloom.sources.tables as common table expressions.
VIEWS = {
    "lines": (
        "SELECT doc_id, CAST(doc_id AS VARCHAR) AS document_id, CAST(unnest(range(len(l))) AS INTEGER) AS k, unnest(l) AS line "
        "FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)",
        (),
    ),
    "elements": (
        "SELECT document_id, k // 8 AS page, k AS ordinal, CAST(40 + 14 * (k % 8) AS DOUBLE) AS y0, line AS content, "
        "CASE WHEN k % 8 = 0 THEN 'title' WHEN k % 5 = 0 THEN 'header' END AS head FROM lines",
        ("lines",),
    ),
    "chunks": (
        "SELECT document_id || '_chunk_' || k AS chunk_id, document_id, '/corpus/' || document_id || '.pdf' AS document_path, k AS chunk_index, k // 8 AS page, "
        "CASE WHEN k % 8 = 0 THEN 'title' WHEN k % 5 = 0 THEN 'header' ELSE 'content' END AS chunk_type, k % 7 = 3 AS has_equations, k % 5 = 2 AS has_tables, k % 6 = 4 AS has_figures, "
        "line AS text, k FROM lines WHERE trim(line) <> ''",
        ("lines",),
    ),
    "questions": (
        "SELECT item_id AS qid, text AS question, CASE WHEN item_id % 3 = 0 THEN CAST(lo + item_id * 7919 % (hi - lo + 1) AS VARCHAR) END AS document_id, "
        "CASE WHEN item_id % 2 = 0 THEN string_split(text, chr(10))[1] END AS hypothetical_answer FROM benchmark, (SELECT min(doc_id) AS lo, max(doc_id) AS hi FROM documents)",
        (),
    ),
    "memory": (
        "SELECT sha256('en|vi|' || service || '|' || coalesce(model, '') || '|' || line) AS cache_key, 'en' AS source_lang, 'vi' AS target_lang, service, model, line AS source_text, 'vi: ' || line AS translated_text, "
        "cached_at, cached_at + 2592000000000 AS expires_at, CAST(d % 5 AS BIGINT) AS hit_count, CASE WHEN d % 3 <> 0 THEN cached_at + 3600000000 END AS last_used FROM ("
        "SELECT line, min(doc_id) AS d, CASE WHEN length(line) % 3 = 0 THEN 'argos' WHEN length(line) % 3 = 1 THEN 'openai' ELSE 'gemini' END AS service, "
        "CASE WHEN length(line) % 3 <> 0 THEN 'base' END AS model, min(doc_id) * 3600000000 + 1704067200000000 AS cached_at FROM lines WHERE trim(line) <> '' GROUP BY line)",
        ("lines",),
    ),
    "requests": (
        "SELECT sha256('en|vi|' || service || '|' || coalesce(model, '') || '|' || source_text) AS cache_key, * FROM (SELECT document_id || ':' || k AS request_id, line AS source_text, "
        "CASE WHEN doc_id % 3 = 0 THEN 'argos' WHEN doc_id % 3 = 1 THEN 'openai' ELSE 'gemini' END AS service, CASE WHEN doc_id % 3 <> 0 THEN 'base' END AS model, "
        "1704067200000000 + doc_id * 3600000000 + k * 1000000 AS ts FROM lines WHERE trim(line) <> '')",
        ("lines",),
    ),
    "doc_index": (
        "SELECT sha256(sha256(text) || '|vi|' || service || '|base|' || version) AS cache_key, sha256(text) AS file_hash, lang AS source_lang, 'vi' AS target_lang, service, 'base' AS model, version AS pipeline_version, "
        "'/cache/' || doc_id || '.pdf' AS cached_path, source AS original_filename, cached_at, CASE WHEN doc_id % 3 <> 0 THEN cached_at + (doc_id % 17) * 3600000000 END AS last_used, "
        "CAST(doc_id % 5 AS BIGINT) AS hit_count, n_chars AS file_size_bytes FROM (SELECT *, CASE WHEN doc_id % 3 = 0 THEN 'argos' WHEN doc_id % 3 = 1 THEN 'openai' ELSE 'gemini' END AS service, "
        "CASE WHEN doc_id % 4 = 0 THEN 'v1' ELSE 'v2' END AS version, doc_id * 3600000000 + 1704067200000000 AS cached_at FROM documents)",
        (),
    ),
    "files": (
        "SELECT page_id AS file_id, CASE WHEN page_id % 5 = 0 THEN '/tmp/job_' ELSE '/data/in_' END || CASE WHEN page_id % 7 = 0 THEN 'scan_' || page_id || '.txt' WHEN page_id % 2 = 0 THEN 'File_' || page_id || '.PDF' "
        "ELSE 'file_' || page_id || '.pdf' END AS path, length(html) * 20000 AS size_bytes, 1707523200000000 - page_id * 420000000 AS mtime, CASE WHEN page_id % 13 <> 4 THEN CAST(length(html) % 70 AS INTEGER) END AS page_count, "
        "page_id % 11 <> 3 AS present FROM pages",
        (),
    ),
    "ev": (
        "SELECT event_id, CAST(user_id AS VARCHAR) AS session_id, epoch_us(ts) AS ts_us, CASE event_type WHEN 'view' THEN 'progress_update' WHEN 'click' THEN 'paragraph_translated' "
        "WHEN 'signup' THEN 'chunk_ready' WHEN 'purchase' THEN 'finish' WHEN 'error' THEN 'error' ELSE 'log' END AS kind, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, value, event_type FROM events",
        (),
    ),
    "words_of_chunks": ("SELECT DISTINCT chunk_id, document_id, unnest(list_filter(string_split_regex(lower(text), '\\s+'), lambda w: w <> '')) AS w FROM chunks", ("chunks",)),
}


def with_views(sql: str, *names: str) -> str:
    """sql behind the views that it names and those that they need."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in VIEWS[name][1]:
            add(need)
        if name not in order:
            order.append(name)

    for n in names:
        add(n)
    head = ", ".join(f"{n} AS ({VIEWS[n][0]})" for n in order)
    if not head:
        return sql
    more = sql.lstrip().upper().startswith("WITH ")
    return f"WITH {head}{', ' + sql.lstrip()[5:] if more else ' ' + sql}"


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()):
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = with_views(sql, *views)
        return f

    return register
