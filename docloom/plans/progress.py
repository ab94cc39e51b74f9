"""Queries of progress events, output versions, slots and services."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import progress as P
from docloom.plans.registry import ORACLES, query
from docloom.session import new_folder
from docloom.sources import blobs, eventlog
from docloom.sources import tables as S

_O = "(PARTITION BY session_id ORDER BY ts_us, event_id)"


def _views(spark: SparkSession, sf: str) -> DataFrame:
    return S.events(spark, sf).where("event_type = 'view'").select("session_id", "ts_us", "event_id", (1 + F.col("k") % 20).alias("page"))


_VIEWS = "SELECT session_id, ts_us, event_id, 1 + k % 20 AS page FROM ev WHERE event_type = 'view'"


@query(
    "events_unified",
    "SELECT event_id, session_id, ts_us, kind, CASE WHEN kind = 'progress_update' THEN value END AS progress_percent, CASE WHEN kind = 'paragraph_translated' THEN k END AS paragraphs_seen, CASE WHEN kind = 'error' THEN 'E' || k END AS error_type, "
    "CASE WHEN kind = 'finish' THEN value > 5 END AS success FROM ev WHERE kind IN ('progress_update', 'paragraph_translated', 'error', 'finish')",
    ("ev",),
)
def events_unified(spark: SparkSession, sf: str) -> DataFrame:
    ev, base = S.events(spark, sf), ["event_id", "session_id", "ts_us", "kind"]
    of = lambda kind, **cols: ev.where(F.col("kind") == kind).select(*base, *[c.alias(n) for n, c in cols.items()])
    return P.unified(
        of("progress_update", progress_percent=F.col("value")), of("paragraph_translated", paragraphs_seen=F.col("k")), of("error", error_type=F.concat(F.lit("E"), F.col("k").cast("string"))), of("finish", success=F.col("value") > 5)
    )


@query(
    "event_wire",
    "SELECT kind AS event, '{\"session_id\":\"' || session_id || '\",\"ts_us\":' || ts_us || CASE WHEN k IS NULL THEN '' ELSE ',\"k\":' || k END || CASE WHEN value IS NULL THEN '' ELSE ',\"value\":' || CAST(value AS VARCHAR) END || '}' AS data FROM ev",
    ("ev",),
)
def event_wire(spark: SparkSession, sf: str) -> DataFrame:
    return P.event_wire(S.events(spark, sf).select("kind", "session_id", "ts_us", "k", "value"))


@query(
    "parse_event_log",
    "WITH b AS (SELECT session_id AS log_id, event_id, k, value, CASE WHEN k % 3 <> 0 THEN kind END AS kind, coalesce(k % 7 <> 0, false) AS has_data FROM ev), "
    "r AS (SELECT *, coalesce(count(*) FILTER (has_data) OVER (PARTITION BY log_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM b), "
    "t AS (SELECT *, last_value(kind IGNORE NULLS) OVER (PARTITION BY log_id, run ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS kept FROM r) "
    "SELECT log_id, CAST(row_number() OVER (PARTITION BY log_id ORDER BY event_id) AS INTEGER) AS event_no, coalesce(kept, 'message') AS event, '{\"k\": ' || k || ',' || chr(10) || '\"value\": ' || CAST(value AS VARCHAR) || '}' AS data, true AS is_json "
    "FROM t WHERE has_data",
    ("ev",),
)
def parse_event_log(spark: SparkSession, sf: str) -> DataFrame:
    """Every session's events written as an event stream, and parsed again."""
    ev = S.events(spark, sf)
    text = F.array(
        F.when(F.col("k") % 3 != 0, F.concat(F.lit("event: "), "kind")), F.when(F.col("k") % 4 == 0, F.lit(": kept alive")), F.when(F.col("k") % 7 != 0, F.concat(F.lit('data: {"k": '), F.col("k").cast("string"), F.lit(","))),
        F.when(F.col("k") % 7 != 0, F.concat(F.lit('data: "value": '), F.col("value").cast("string"), F.lit("}\r"))), F.lit(""),
    )
    rows = ev.select("session_id", "event_id", F.posexplode(F.filter(text, lambda x: x.isNotNull())).alias("n", "line"))
    return P.parse_event_log(rows.select(F.col("session_id").alias("log_id"), (F.col("event_id") * 8 + F.col("n")).alias("line_no"), "line"))


@query("event_log_source", ORACLES["event_wire"])
def event_log_source(spark: SparkSession, sf: str) -> DataFrame:
    """All events written as logs by the data source, and read by it."""
    path = f"{new_folder(spark, 'logs')}/in"
    eventlog.write_logs(P.event_wire(S.events(spark, sf).select("kind", "session_id", "ts_us", "k", "value")), path)
    return eventlog.read_logs(spark, path).select("event", "data")


@query("file_hashes")
def file_hashes(spark: SparkSession, sf: str) -> DataFrame:
    """SHA-256 of the tables' own files, read in blocks."""
    return blobs.hashed(spark, sf, "*.parquet").select("path", "size_bytes", "content_hash")


@query(
    "session_status",
    "SELECT session_id, CASE WHEN bool_or(kind = 'cancelled') THEN 'cancelled' WHEN bool_or(kind = 'error') THEN 'error' WHEN bool_or(kind = 'finish') THEN 'done' ELSE 'error' END AS status, "
    "arg_max(value, {t: ts_us, e: event_id}) FILTER (kind = 'finish') AS result, count(*) AS n_events FROM ev GROUP BY session_id",
    ("ev",),
)
def session_status(spark: SparkSession, sf: str) -> DataFrame:
    return P.session_status(S.events(spark, sf))


_TOTAL = 40


@query(
    "progress_eta",
    f"SELECT session_id, event_id, done, round(50 + 40 / {_TOTAL}.0::DOUBLE * done, 6) AS percent, round(CASE WHEN done >= 2 AND s > 0 THEN done / s END, 9) AS rate, round(CASE WHEN {_TOTAL} - done > 0 AND done >= 2 AND s > 0 THEN ({_TOTAL} - done) / (done / s) END, 3) AS eta_s FROM ("
    f"SELECT session_id, event_id, CAST(row_number() OVER o AS INTEGER) AS done, (ts_us - min(ts_us) OVER o) / 1e6 AS s FROM ev WHERE kind = 'chunk_ready' WINDOW o AS {_O})",
    ("ev",),
)
def progress_eta(spark: SparkSession, sf: str) -> DataFrame:
    ready = S.events(spark, sf).where("kind = 'chunk_ready'").select("session_id", "ts_us", "event_id")
    return P.progress_eta(ready, F.lit(_TOTAL)).drop("ts_us")


@query(
    "state_fold",
    f"SELECT event_id, last_value(pct IGNORE NULLS) OVER w AS progress, last_value(para IGNORE NULLS) OVER w AS paragraphs FROM (SELECT *, CASE WHEN kind = 'progress_update' THEN value END AS pct, CASE WHEN kind = 'paragraph_translated' THEN k END AS para FROM ev) "
    "WINDOW w AS (PARTITION BY session_id ORDER BY ts_us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)",
    ("ev",),
)
def state_fold(spark: SparkSession, sf: str) -> DataFrame:
    ev = S.events(spark, sf).withColumns({"progress": F.when(F.col("kind") == "progress_update", F.col("value")), "paragraphs": F.when(F.col("kind") == "paragraph_translated", F.col("k"))})
    return P.state_fold(ev, ["progress", "paragraphs"]).select("event_id", "progress", "paragraphs")


@query(
    "ticker",
    "SELECT session_id, tick, value, CAST(sum(n) OVER o AS BIGINT) AS seen, CAST(row_number() OVER o AS INTEGER) AS tick_no FROM (SELECT session_id, ts_us // 200000 AS tick, arg_max(value, {t: ts_us, e: event_id}) AS value, count(*) AS n FROM ev GROUP BY ALL) WINDOW o AS (PARTITION BY session_id ORDER BY tick)",
    ("ev",),
)
def ticker(spark: SparkSession, sf: str) -> DataFrame:
    return P.ticker(S.events(spark, sf))


@query(
    "debounce",
    f"WITH v AS ({_VIEWS}), d AS (SELECT * FROM (SELECT *, lead(ts_us) OVER {_O} AS nxt FROM v) WHERE nxt IS NULL OR nxt - ts_us >= 7200000000) SELECT session_id, ts_us, event_id, page FROM (SELECT *, lag(page) OVER {_O} AS was FROM d) WHERE was IS NULL OR was <> page",
    ("ev",),
)
def debounce(spark: SparkSession, sf: str) -> DataFrame:
    """Bursts are parted by two hours here, as the table's events are minutes apart."""
    return P.debounce(_views(spark, sf), 7_200_000_000)


@query("dedupe_consecutive", f"WITH v AS ({_VIEWS}) SELECT session_id, ts_us, event_id, page FROM (SELECT *, lag(page) OVER {_O} AS was FROM v) WHERE was IS NULL OR was <> page", ("ev",))
def dedupe_consecutive(spark: SparkSession, sf: str) -> DataFrame:
    return P.dedupe_consecutive(_views(spark, sf))


@query(
    "stale_sessions",
    f"SELECT session_id, ended_at, last_at FROM (SELECT session_id, max(ts_us) FILTER (kind IN ('finish', 'error', 'cancelled')) AS ended_at, max(ts_us) AS last_at FROM ev GROUP BY session_id) WHERE ended_at = last_at AND {S.NOW} - last_at > 3600000000",
    ("ev",),
)
def stale_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return P.stale_sessions(S.events(spark, sf), S.NOW)


@query("last_n_history", "SELECT session_id, event_id, recency FROM (SELECT session_id, event_id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY ts_us DESC, event_id DESC) AS INTEGER) AS recency FROM ev) WHERE recency <= 50", ("ev",))
def last_n_history(spark: SparkSession, sf: str) -> DataFrame:
    return P.last_entries(S.events(spark, sf)).select("session_id", "event_id", "recency")


_SLOTS = (
    "d AS (SELECT document_id, CAST(max(k) // 8 + 1 AS INTEGER) AS n_pages FROM lines GROUP BY document_id), s AS (SELECT document_id, n_pages, CAST(unnest(range((n_pages + 2) // 3)) AS INTEGER) AS slot FROM d), "
    "slots AS (SELECT document_id, slot, CAST(3 * slot + 1 AS INTEGER) AS first_page, CAST(least(3 * slot + 3, n_pages) AS INTEGER) AS last_page FROM s)"
)


def _slots(spark: SparkSession, sf: str) -> DataFrame:
    pages = S.lines(spark, sf).groupBy("document_id").agg((F.floor(F.max("line_no") / 8) + 1).cast("int").alias("n_pages"))
    return P.page_slots(pages, 3)


@query("page_slots", f"WITH {_SLOTS} SELECT * FROM slots", ("lines",))
def page_slots(spark: SparkSession, sf: str) -> DataFrame:
    return _slots(spark, sf)


@query("priority_order", f"WITH {_SLOTS} SELECT document_id, slot, CAST(row_number() OVER (PARTITION BY document_id ORDER BY abs(slot - CAST(document_id AS BIGINT) % 4), slot) AS INTEGER) AS priority FROM slots", ("lines",))
def priority_order(spark: SparkSession, sf: str) -> DataFrame:
    return P.priority_order(_slots(spark, sf), F.col("document_id").cast("long") % 4).select("document_id", "slot", "priority")


@query("rolling_merge", f"WITH {_SLOTS} SELECT document_id, slot, CASE WHEN (CAST(document_id AS BIGINT) + slot) % 3 = 0 THEN 'vi:' ELSE 'en:' END || document_id || ':' || slot AS content, (CAST(document_id AS BIGINT) + slot) % 3 = 0 AS is_translated FROM slots", ("lines",))
def rolling_merge(spark: SparkSession, sf: str) -> DataFrame:
    name = lambda lang: F.concat_ws(":", F.lit(lang), "document_id", F.col("slot").cast("string"))
    slots = _slots(spark, sf).withColumn("original", name("en"))
    done = slots.where((F.col("document_id").cast("long") + F.col("slot")) % 3 == 0).withColumn("translated", name("vi"))
    return P.rolling_merge(slots, done).select("document_id", "slot", "content", "is_translated")


_OUT = (
    "o AS (SELECT 'job' || (page_id // 6) AS stem, 'job' || (page_id // 6) || CASE page_id % 12 WHEN 0 THEN '_translated_v' || page_id || '.pdf' WHEN 1 THEN '_translated_v0' || page_id || '.pdf' WHEN 2 THEN '_translated_vx.pdf' WHEN 3 THEN '_mono.pdf' "
    "WHEN 4 THEN '.vi.pdf' WHEN 5 THEN '_translated.pdf' WHEN 6 THEN '_other.pdf' WHEN 7 THEN '_draft_Mono.pdf' WHEN 8 THEN '_x.pdf' WHEN 9 THEN '_y.pdf' WHEN 10 THEN '_z.pdf' ELSE '_w.pdf' END AS name, 1000 + page_id * 37 % 101 AS mtime FROM pages), "
    "v AS (SELECT *, coalesce(TRY_CAST(nullif(regexp_extract(regexp_replace(name, '\\.[^.]*$', ''), '_v([0-9]+)$', 1), '') AS BIGINT), -1) AS version FROM o)"
)


def _outputs(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("page_id")
    stem = F.concat(F.lit("job"), F.floor(i / 6).cast("string"))
    tails = ["_translated_v{i}.pdf", "_translated_v0{i}.pdf", "_translated_vx.pdf", "_mono.pdf", ".vi.pdf", "_translated.pdf", "_other.pdf", "_draft_Mono.pdf", "_x.pdf", "_y.pdf", "_z.pdf", "_w.pdf"]
    tail = F.replace(F.element_at(F.array(*[F.lit(t) for t in tails]), (i % 12 + 1).cast("int")), F.lit("{i}"), i.cast("string"))
    return S.table(spark, sf, "pages").select(stem.alias("stem"), F.concat(stem, tail).alias("name"), (1000 + i * 37 % 101).alias("mtime"))


@query("latest_version", f"WITH {_OUT} SELECT stem, name, version FROM (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY version DESC, name DESC) AS n FROM v) WHERE n = 1", ("files",))
def latest_version(spark: SparkSession, sf: str) -> DataFrame:
    return P.latest_versions(_outputs(spark, sf)).where("newest = 1").select("stem", "name", "version")


@query("prune_versions", f"WITH {_OUT} SELECT stem, name FROM (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY version DESC, name DESC) AS n FROM v) WHERE n > 1", ("files",))
def prune_versions(spark: SparkSession, sf: str) -> DataFrame:
    return P.latest_versions(_outputs(spark, sf)).where("newest > 1").select("stem", "name")


@query(
    "pick_output",
    f"WITH {_OUT}, p AS (SELECT *, CASE WHEN starts_with(name, stem || '_translated_v') AND version >= 0 THEN 0 WHEN name = stem || '_mono.pdf' THEN 1 WHEN name = stem || '.vi.pdf' THEN 2 WHEN name = stem || '_translated.pdf' THEN 3 "
    "WHEN name = stem || '.pdf' THEN 4 WHEN contains(lower(name), 'mono') THEN 5 ELSE 6 END AS place FROM v) SELECT stem, name FROM (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY place, CASE WHEN place = 0 THEN -version ELSE -mtime END, name) AS n FROM p) WHERE n = 1",
    ("files",),
)
def pick_output(spark: SparkSession, sf: str) -> DataFrame:
    return P.pick_output(_outputs(spark, sf)).select("stem", "name")


@query(
    "resolve_service",
    "WITH s AS (SELECT * FROM (VALUES ('argos', 'argostranslate', true, NULL), ('openai', 'gpt', false, 3), ('gemini', 'flash', true, 2), ('anthropic', 'sonnet', true, 1)) t(service, default_model, has_key, answer_priority)), "
    "r AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'openai' WHEN 1 THEN 'gemini' WHEN 2 THEN 'anthropic' WHEN 3 THEN 'argos' ELSE 'unknown' END AS requested FROM documents), "
    "e AS (SELECT doc_id, requested, CASE WHEN has_key THEN requested ELSE 'argos' END AS service FROM r LEFT JOIN s ON s.service = r.requested) "
    "SELECT doc_id, requested, e.service, default_model AS model, CASE WHEN e.service <> 'argos' THEN e.service ELSE (SELECT arg_min(service, answer_priority) FROM s WHERE has_key AND answer_priority IS NOT NULL) END AS answer_service FROM e JOIN s ON s.service = e.service",
)
def resolve_service(spark: SparkSession, sf: str) -> DataFrame:
    services = spark.sql(
        "SELECT * FROM VALUES ('argos', 'argostranslate', true, CAST(NULL AS INT)), ('openai', 'gpt', false, 3), ('gemini', 'flash', true, 2), ('anthropic', 'sonnet', true, 1) AS t(service, default_model, has_key, answer_priority)"
    )
    d = F.col("doc_id") % 5
    requested = F.when(d == 0, "openai").when(d == 1, "gemini").when(d == 2, "anthropic").when(d == 3, "argos").otherwise("unknown")
    return P.resolve_services(S.table(spark, sf, "documents").select("doc_id", requested.alias("requested")), services).select("doc_id", "requested", "service", "model", "answer_service")


@query(
    "eta_labels",
    "WITH e AS (SELECT event_id, CASE WHEN k % 10 = 0 THEN NULL ELSE greatest(0, value * k / 10.0 - 3) END AS s, CAST(round(value * k * k) AS BIGINT) AS age FROM ev), m AS (SELECT *, floor(s / 60) AS mi, floor(s - floor(s / 60) * 60 + 0.5) AS r FROM e) "
    "SELECT event_id, CASE WHEN s IS NULL THEN '—' WHEN s < 1 THEN '<1s' WHEN s < 60 THEN CAST(CAST(floor(s + 0.5) AS BIGINT) AS VARCHAR) || 's' WHEN r = 0 THEN CAST(CAST(mi AS BIGINT) AS VARCHAR) || 'm' ELSE CAST(CAST(mi AS BIGINT) AS VARCHAR) || 'm ' || CAST(CAST(r AS BIGINT) AS VARCHAR) || 's' END AS eta FROM m",
    ("ev",),
)
def eta_labels(spark: SparkSession, sf: str) -> DataFrame:
    left = T.eta_left(F.when(F.col("k") % 10 != 0, F.col("value") * F.col("k") / 10.0), F.lit(3.0))
    left = F.when(F.col("k") % 10 != 0, left)
    return S.events(spark, sf).select("event_id", T.eta_label(left).alias("eta"))


_AGE = "CASE WHEN k % 10 <> 0 THEN 37 * k * k - 3000 END"


def _say(per: int, word: str) -> str:
    n = f"CAST(floor(-age / {per}.0::DOUBLE + 0.5) AS BIGINT)"
    many = f"abs({n}) || ' {word}' || CASE WHEN abs({n}) = 1 THEN '' ELSE 's' END"
    return f"CASE WHEN {n} < 0 THEN {many} || ' ago' ELSE 'in ' || {many} END"


@query(
    "relative_labels",
    f"SELECT event_id, CASE WHEN age IS NULL THEN 'earlier' WHEN age = 0 THEN 'now' WHEN abs(age) < 60 THEN {_say(1, 'second')} WHEN abs(age) < 3600 THEN {_say(60, 'minute')} WHEN abs(age) < 86400 THEN {_say(3600, 'hour')} "
    f"WHEN floor(-age / 86400.0::DOUBLE + 0.5) = -1 THEN 'yesterday' WHEN floor(-age / 86400.0::DOUBLE + 0.5) = 1 THEN 'tomorrow' ELSE {_say(86400, 'day')} END AS label FROM (SELECT event_id, {_AGE} AS age FROM ev)",
    ("ev",),
)
def relative_labels(spark: SparkSession, sf: str) -> DataFrame:
    return S.events(spark, sf).select("event_id", T.relative_label(F.expr(_AGE)).alias("label"))
