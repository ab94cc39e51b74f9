"""Queries of text functions, translation memory and cache indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import memory as M
from docloom.operators import progress, sentences
from docloom.plans.registry import query
from docloom.sources import tables as S

NOW = S.NOW
_STRIP = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"

_CODE = "CASE lang WHEN 'en' THEN 'en' WHEN 'fr' THEN 'vi' WHEN 'de' THEN 'zh-cn' ELSE lang END"


@query(
    "language_names",
    f"SELECT doc_id, {_CODE} AS code, CASE {_CODE} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in T.LANGUAGES.items()) + f" ELSE {_CODE} END AS name FROM documents",
)
def language_names(spark: SparkSession, sf: str) -> DataFrame:
    code = F.when(F.col("lang") == "fr", "vi").when(F.col("lang") == "de", "zh-cn").otherwise(F.col("lang"))
    return S.table(spark, sf, "documents").select("doc_id", code.alias("code"), T.language_name(code).alias("name"))


@query(
    "clean_translation",
    "SELECT document_id, k AS line_no, regexp_replace(regexp_replace(regexp_replace(regexp_replace(" + _STRIP.format("t") + ", '\\s+([.,;:!?])', '\\1', 'g'), '([,;:])(\\p{L})', '\\1 \\2', 'g'), "
    "'([.!?])([A-Z])', '\\1 \\2', 'g'), ' {2,}', ' ', 'g') AS text FROM (SELECT *, replace(replace(line, ', ', ' ,'), '. ', '.') AS t FROM lines)",
    ("lines",),
)
def clean_translation(spark: SparkSession, sf: str) -> DataFrame:
    rough = F.replace(F.replace("line", F.lit(", "), F.lit(" ,")), F.lit(". "), F.lit("."))
    return S.lines(spark, sf).select("document_id", "line_no", T.clean_translation(rough).alias("text"))


_PARTS = "regexp_split_to_array(line, '\\p{L}{9,}')"


@query(
    "protect_restore",
    f"SELECT document_id, k AS line_no, array_to_string(list_transform({_PARTS}, lambda x, i: CASE WHEN i = 1 THEN x ELSE '{{v' || (i - 1) || '}}' || x END), '') AS protected, CAST(len({_PARTS}) - 1 AS INTEGER) AS n_formulas, true AS same FROM lines",
    ("lines",),
)
def protect_restore(spark: SparkSession, sf: str) -> DataFrame:
    """Every word of more than 8 letters stands for a formula; restoring gives the line again."""
    text, found = T.protect("line", r"\p{L}{9,}")
    rows = S.lines(spark, sf).select("document_id", "line_no", "line", text.alias("protected"), found.alias("formulas"))
    rows = rows.withColumn("restored", T.restore("protected", "formulas"))
    return rows.select("document_id", "line_no", "protected", F.size("formulas").alias("n_formulas"), (F.col("restored") == F.col("line")).alias("same"))


@query(
    "previews",
    "SELECT doc_id, substr(" + _STRIP.format("replace(text, chr(10), ' ')") + ", 1, 80) AS preview, CASE WHEN length(" + _STRIP.format("replace(text, chr(10), ' ')") + ") > 60 THEN substr("
    + _STRIP.format("replace(text, chr(10), ' ')") + ", 1, 60) || '…' ELSE " + _STRIP.format("replace(text, chr(10), ' ')") + " END AS short FROM documents WHERE " + _STRIP.format("replace(text, chr(10), ' ')") + " <> ''",
)
def previews(spark: SparkSession, sf: str) -> DataFrame:
    rows = S.table(spark, sf, "documents").select("doc_id", T.preview("text").alias("preview"), T.preview("text", 60, True).alias("short"))
    return rows.where("preview <> ''")


@query("memory_key", "SELECT request_id, cache_key FROM requests", ("requests",))
def memory_key(spark: SparkSession, sf: str) -> DataFrame:
    return M.keyed(S.memory_requests(spark, sf)).select("request_id", "cache_key")


@query("doc_key", "SELECT cached_path, cache_key FROM doc_index", ("doc_index",))
def doc_key(spark: SparkSession, sf: str) -> DataFrame:
    return S.document_index(spark, sf).select("cached_path", "cache_key")


@query(
    "memory_lookup",
    f"SELECT request_id, CASE WHEN m.cache_key IS NULL THEN 'miss' WHEN m.expires_at < {NOW} THEN 'expired' ELSE 'hit' END AS status, CASE WHEN m.expires_at >= {NOW} THEN m.translated_text END AS translated_text "
    "FROM requests r LEFT JOIN memory m USING (cache_key)",
    ("requests", "memory"),
)
def memory_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return M.lookup(M.keyed(S.memory_requests(spark, sf)), S.memory(spark, sf), NOW).select("request_id", "status", "translated_text")


@query("memory_misses", f"SELECT cache_key, min(source_text) AS source_text, count(*) AS n_requests FROM requests WHERE cache_key NOT IN (SELECT cache_key FROM memory WHERE expires_at >= {NOW}) GROUP BY cache_key", ("requests", "memory"))
def memory_misses(spark: SparkSession, sf: str) -> DataFrame:
    return M.misses(M.keyed(S.memory_requests(spark, sf)), S.memory(spark, sf), NOW)


@query("distinct_paragraphs", "SELECT cache_key, count(*) AS n_requests, arg_min(request_id, {t: ts, r: request_id}) AS first_request FROM requests GROUP BY cache_key", ("requests",))
def distinct_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    return M.distinct_paragraphs(M.keyed(S.memory_requests(spark, sf)))


def _written(spark: SparkSession, sf: str) -> DataFrame:
    """What a backend would give for all requests that the memory doesn't hold."""
    valid = S.memory(spark, sf).where(F.col("expires_at") >= NOW).select("cache_key")
    asked = M.keyed(S.memory_requests(spark, sf)).join(valid, "cache_key", "left_anti")
    one = asked.groupBy("cache_key", "lang_in", "lang_out", "service", "model", "source_text").count()
    return M.memory_entries(one.withColumn("translated_text", F.concat(F.lit("new: "), "source_text")), NOW)


@query(
    "memory_upsert",
    f"WITH new AS (SELECT DISTINCT cache_key, 'new: ' || source_text AS translated_text FROM requests WHERE cache_key NOT IN (SELECT cache_key FROM memory WHERE expires_at >= {NOW})), "
    f"a AS (SELECT cache_key, translated_text, cached_at, hit_count, last_used, 0 AS o FROM memory UNION ALL SELECT cache_key, translated_text, CAST({NOW} AS BIGINT), 0, NULL, 1 FROM new) "
    "SELECT cache_key, translated_text, cached_at, hit_count, last_used FROM (SELECT *, row_number() OVER (PARTITION BY cache_key ORDER BY cached_at DESC, o DESC) AS n FROM a) WHERE n = 1",
    ("memory", "requests"),
)
def memory_upsert(spark: SparkSession, sf: str) -> DataFrame:
    return M.upsert(S.memory(spark, sf), _written(spark, sf)).select("cache_key", "translated_text", "cached_at", "hit_count", "last_used")


@query(
    "clear_caches",
    f"WITH n AS (SELECT (SELECT count(*) FROM memory) AS m, (SELECT count(*) FROM memory WHERE expires_at >= {NOW}) AS v, (SELECT count(*) FROM doc_index) AS d), s AS (SELECT unnest(['expired', 'all']) AS scope), t AS (SELECT unnest(['memory', 'documents', 'both']) AS target) "
    "SELECT scope, target, CASE WHEN target = 'documents' THEN m WHEN scope = 'expired' THEN v ELSE 0 END AS memory_rows, CASE WHEN scope = 'expired' OR target = 'memory' THEN d ELSE 0 END AS document_rows FROM n, s, t",
    ("memory", "doc_index"),
)
def clear_caches(spark: SparkSession, sf: str) -> DataFrame:
    """What every scope and target leaves."""
    out, memory, index = None, S.memory(spark, sf), S.document_index(spark, sf)
    for scope in ("expired", "all"):
        for target in ("memory", "documents", "both"):
            left = M.clear(memory, index, scope, target, NOW)
            rows = left[0].select(F.lit(1).alias("m"), F.lit(0).alias("d")).unionAll(left[1].select(F.lit(0).alias("m"), F.lit(1).alias("d")))
            rows = rows.agg(F.coalesce(F.sum("m"), F.lit(0)).alias("memory_rows"), F.coalesce(F.sum("d"), F.lit(0)).alias("document_rows")).select(F.lit(scope).alias("scope"), F.lit(target).alias("target"), "memory_rows", "document_rows")
            out = rows if out is None else out.unionAll(rows)
    return out


@query("expire_memory", f"SELECT cache_key FROM memory WHERE expires_at >= {NOW}", ("memory",))
def expire_memory(spark: SparkSession, sf: str) -> DataFrame:
    return M.expire(S.memory(spark, sf), NOW).select("cache_key")


@query(
    "memory_stats",
    f"SELECT entries, expired, hits, misses, entries - expired AS active, round(hits / greatest(1, hits + misses), 3) AS hit_rate FROM (SELECT count(*) AS entries, count(*) FILTER (expires_at < {NOW}) AS expired FROM memory), "
    f"(SELECT count(*) FILTER (m.expires_at >= {NOW}) AS hits, count(*) FILTER (m.expires_at IS NULL OR m.expires_at < {NOW}) AS misses FROM requests LEFT JOIN memory m USING (cache_key))",
    ("requests", "memory"),
)
def memory_stats(spark: SparkSession, sf: str) -> DataFrame:
    memory = S.memory(spark, sf)
    return M.memory_stats(memory, NOW, M.lookup(M.keyed(S.memory_requests(spark, sf)), memory, NOW))


@query("memory_by_service", "SELECT service, count(*) AS entries FROM memory GROUP BY service", ("memory",))
def memory_by_service(spark: SparkSession, sf: str) -> DataFrame:
    return M.by_service(S.memory(spark, sf))


@query(
    "apply_hits",
    f"WITH h AS (SELECT cache_key, count(*) AS n, max(ts) AS t FROM requests JOIN memory USING (cache_key) WHERE expires_at >= {NOW} GROUP BY cache_key) "
    "SELECT m.cache_key, m.hit_count + coalesce(n, 0) AS hit_count, CASE WHEN t IS NULL THEN last_used WHEN last_used IS NULL THEN t ELSE greatest(t, last_used) END AS last_used FROM memory m LEFT JOIN h USING (cache_key)",
    ("requests", "memory"),
)
def apply_hits(spark: SparkSession, sf: str) -> DataFrame:
    memory = S.memory(spark, sf)
    hits = M.lookup(M.keyed(S.memory_requests(spark, sf)), memory, NOW).where("status = 'hit'")
    return M.apply_hits(memory, hits).select("cache_key", "hit_count", "last_used")


_CLEAN = (
    "regexp_replace(regexp_replace(regexp_replace(regexp_replace(" + _STRIP.format("{0}") + ", '\\s+([.,;:!?])', '\\1', 'g'), '([,;:])(\\p{{L}})', '\\1 \\2', 'g'), "
    "'([.!?])([A-Z])', '\\1 \\2', 'g'), ' {{2,}}', ' ', 'g')"
)


_NO_STARS = "replace(line, '*', '')"


@query("clean_markdown", f"SELECT document_id, k AS line_no, {_CLEAN.format(_NO_STARS)} AS text FROM lines", ("lines",))
def clean_markdown(spark: SparkSession, sf: str) -> DataFrame:
    """Lines with marks put around their words, cleaned of them."""
    marked = F.concat(F.lit("**"), F.replace("line", F.lit(" "), F.lit("* *")), F.lit("**"))
    return S.lines(spark, sf).select("document_id", "line_no", T.clean_translation(marked, strip_markdown=True).alias("text"))


@query(
    "translate_documents",
    f"SELECT request_id, CASE WHEN m.expires_at >= {NOW} THEN 'hit' WHEN NOT regexp_matches(r.source_text, '^\\d') THEN 'translated' ELSE 'failed' END AS status, "
    f"CASE WHEN m.expires_at >= {NOW} THEN m.translated_text WHEN NOT regexp_matches(r.source_text, '^\\d') THEN {_CLEAN.format(chr(39) + '[vi] ' + chr(39) + ' || r.source_text')} ELSE r.source_text END AS translated_text "
    "FROM requests r LEFT JOIN memory m USING (cache_key)",
    ("requests", "memory"),
)
def translate_documents(spark: SparkSession, sf: str) -> DataFrame:
    rows, _ = M.translate(M.keyed(S.memory_requests(spark, sf)), S.memory(spark, sf), NOW, using="marked")
    return rows.select("request_id", "status", "translated_text")


@query(
    "translate_sentences",
    "WITH s AS (SELECT request_id, service, model, unnest(l) AS s, unnest(range(len(l))) AS n FROM (SELECT request_id, service, model, "
    "list_filter(string_split(regexp_replace(" + _STRIP.format("source_text") + ", '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS l FROM requests)), "
    f"t AS (SELECT request_id, n, CASE WHEN m.expires_at >= {NOW} THEN m.translated_text WHEN NOT regexp_matches(s, '^[0-9]') THEN {_CLEAN.format(chr(39) + '[vi] ' + chr(39) + ' || s')} ELSE s END AS t, "
    f"coalesce(m.expires_at < {NOW}, true) AND regexp_matches(s, '^[0-9]') AS bad FROM s LEFT JOIN memory m ON m.cache_key = sha256('en|vi|' || s.service || '|' || coalesce(s.model, '') || '|' || s)) "
    "SELECT request_id, coalesce(string_agg(t, chr(10) ORDER BY n), any_value(source_text)) AS translated_text, count(n) AS n_sentences, count(*) FILTER (bad) AS n_failed FROM requests LEFT JOIN t USING (request_id) GROUP BY request_id",
    ("requests", "memory"),
)
def translate_sentences(spark: SparkSession, sf: str) -> DataFrame:
    """Sentences, parted by marks and white space, by way of the memory."""
    split = lambda text: F.filter(F.split(T.strip(text), r"(?<=[.!?])\s+", -1), lambda s: s != "")
    return M.translate_sentences(S.memory_requests(spark, sf), S.memory(spark, sf), NOW, split, using="marked")[0]


@query(
    "sentence_regroup",
    "SELECT doc_id, string_agg('vi: ' || s, chr(10) ORDER BY n) AS translated_text, count(*) AS n_sentences FROM (SELECT doc_id, unnest(l) AS s, unnest(range(len(l))) AS n FROM (SELECT doc_id, "
    "list_filter(string_split(regexp_replace(" + _STRIP.format("text") + ", '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS l FROM documents)) GROUP BY doc_id",
)
def sentence_regroup(spark: SparkSession, sf: str) -> DataFrame:
    return M.sentence_regroup(S.table(spark, sf, "documents"), "doc_id", "text", lambda s: F.concat(F.lit("vi: "), s))


_AGE = "coalesce(last_used, cached_at)"
_CAP = 500_000


@query("doc_cache_stats", "SELECT count(*) AS entries, round(sum(file_size_bytes) / (1024.0::DOUBLE * 1024), 3) AS total_mb, count(*) FILTER (pipeline_version = 'v2') AS hits, count(*) FILTER (pipeline_version <> 'v2') AS misses, "
       "round(count(*) FILTER (pipeline_version = 'v2') / count(*), 3) AS hit_rate, 'v2' AS pipeline_version FROM doc_index", ("doc_index",))  # fmt: skip
def doc_cache_stats(spark: SparkSession, sf: str) -> DataFrame:
    index = S.document_index(spark, sf)
    return M.document_cache_stats(index, index.select((F.col("pipeline_version") == "v2").alias("hit")), "v2")


@query(
    "doc_cache_upsert",
    f"WITH a AS (SELECT cache_key, cached_path, cached_at, last_used, 0 AS o FROM (SELECT *, row_number() OVER (PARTITION BY cache_key ORDER BY cached_at DESC, cached_path) AS n FROM doc_index) WHERE n = 1 "
    f"UNION ALL SELECT DISTINCT cache_key, '/cache/new/' || cache_key || '.pdf', CAST({NOW} AS BIGINT), CAST({NOW} AS BIGINT), 1 FROM doc_index WHERE pipeline_version = 'v2' AND service = 'openai') "
    "SELECT cache_key, cached_path, cached_at, last_used FROM (SELECT *, row_number() OVER (PARTITION BY cache_key ORDER BY cached_at DESC, o DESC) AS n FROM a) WHERE n = 1",
    ("doc_index",),
)
def doc_cache_upsert(spark: SparkSession, sf: str) -> DataFrame:
    rows = S.document_index(spark, sf).select("cache_key", "cached_path", "cached_at", "last_used", "pipeline_version", "service")
    new = rows.where("pipeline_version = 'v2' AND service = 'openai'").select("cache_key").distinct()
    new = new.select("cache_key", F.concat(F.lit("/cache/new/"), "cache_key", F.lit(".pdf")).alias("cached_path"), F.lit(NOW).alias("cached_at"), F.lit(NOW).alias("last_used"))
    latest = rows.groupBy("cache_key").agg(F.min(F.struct((-F.col("cached_at")).alias("age"), "cached_path", "last_used")).alias("r"))
    stored = latest.select("cache_key", "r.cached_path", (-F.col("r.age")).alias("cached_at"), "r.last_used")
    return M.upsert(stored, new)


@query(
    "lru_evict",
    f"SELECT cached_path FROM (SELECT cached_path, sum(file_size_bytes) OVER () - coalesce(sum(file_size_bytes) OVER (ORDER BY {_AGE}, cache_key, cached_path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_over FROM doc_index) WHERE left_over > {_CAP}",
    ("doc_index",),
)
def lru_evict(spark: SparkSession, sf: str) -> DataFrame:
    return M.lru_evicted(S.document_index(spark, sf), _CAP, by=("cache_key", "cached_path")).select("cached_path")


_BYTES = "(strlen(source_text) + strlen(translated_text))"


@query(
    "size_cap_evict",
    f"WITH t AS (SELECT sum({_BYTES}) AS s, count(*) AS n FROM memory) SELECT cache_key FROM (SELECT cache_key, row_number() OVER (ORDER BY {_AGE}, cache_key) AS p FROM memory), t "
    f"WHERE s > {_CAP} AND p <= least(n, ceil((s - 0.9::DOUBLE * {_CAP}) / greatest(1, s // n)))",
    ("memory",),
)
def size_cap_evict(spark: SparkSession, sf: str) -> DataFrame:
    return M.size_cap_evicted(S.memory(spark, sf), _CAP, (F.octet_length("source_text") + F.octet_length("translated_text")).cast("long")).select("cache_key")


@query("stale_index_rows", "SELECT cached_path FROM doc_index WHERE cached_path NOT IN (SELECT '/cache/' || page_id || '.pdf' FROM pages)", ("doc_index",))
def stale_index_rows(spark: SparkSession, sf: str) -> DataFrame:
    present = S.table(spark, sf, "pages").select(F.concat(F.lit("/cache/"), F.col("page_id").cast("string"), F.lit(".pdf")).alias("path"))
    return M.stale_rows(S.document_index(spark, sf), present).select("cached_path")


@query("orphan_files", f"SELECT file_id, path FROM files WHERE starts_with(path, '/tmp/job_') AND mtime <= {NOW} - 3600000000", ("files",))
def orphan_files(spark: SparkSession, sf: str) -> DataFrame:
    return progress.orphan_files(S.files(spark, sf), "/tmp/job_", NOW).select("file_id", "path")


@query("learned_sentences")
def learned_sentences(spark: SparkSession, sf: str) -> DataFrame:
    """Sentences of each document by boundaries learned from all of them."""
    docs = S.table(spark, sf, "documents")
    return docs.select("doc_id", F.posexplode(sentences.sentences("text", sentences.fit(docs))).alias("n", "sentence"))
