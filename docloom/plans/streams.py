"""Streaming queries run over the event table to its end, in several batches in the order of time; their results are those of the batch forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.plans.registry import ORACLES, query, with_views
from docloom.session import new_folder
from docloom.streaming import events as E


def _replayed(spark: SparkSession, sf: str) -> tuple[DataFrame, str]:
    """(the event table as a stream of several batches in the order of time, a folder for the run)."""
    path = new_folder(spark, "stream")
    return E.replay(E.event_table(spark, f"{sf}/events.parquet"), path), path


@query("stream_session_status", ORACLES["session_status"])
def stream_session_status(spark: SparkSession, sf: str) -> DataFrame:
    stream, path = _replayed(spark, sf)
    return E.run_to_end(E.status(stream), path, "update", ["session_id"])


@query("stream_dedupe_consecutive", ORACLES["dedupe_consecutive"])
def stream_dedupe_consecutive(spark: SparkSession, sf: str) -> DataFrame:
    stream, path = _replayed(spark, sf)
    return E.run_to_end(E.without_repeats_classic(stream.where("event_type = 'view'").withColumn("page", 1 + F.col("k") % 20)), path)


@query("stream_ticker", with_views("SELECT session_id, ts_us // 200000 * 200000 AS tick_us, arg_max(value, {t: ts_us, e: event_id}) AS value, count(*) AS n FROM ev GROUP BY ALL", "ev"))
def stream_ticker(spark: SparkSession, sf: str) -> DataFrame:
    """All ticks, those that the watermark has not closed included."""
    stream, path = _replayed(spark, sf)
    ticks = E.run_to_end(E.ticker(stream), path, "update", ["session_id", "tick"])
    return ticks.select("session_id", F.unix_micros("tick").alias("tick_us"), "value", "n")


@query(
    "stream_progress",
    with_views(
        "SELECT session_id, done, round(50 + 40 / 40.0::DOUBLE * done, 6) AS percent, round(CASE WHEN done < 40 AND done >= 2 AND hi > lo THEN (40 - done) / (done / ((hi - lo) / 1e6)) END, 3) AS eta_s "
        "FROM (SELECT session_id, count(*) AS done, min(ts_us) AS lo, max(ts_us) AS hi FROM ev WHERE kind = 'chunk_ready' GROUP BY session_id)",
        "ev",
    ),
)
def stream_progress(spark: SparkSession, sf: str) -> DataFrame:
    stream, path = _replayed(spark, sf)
    return E.run_to_end(E.progress(stream, 40), path, "update", ["session_id"])


@query(
    "stream_debounce",
    with_views(
        "WITH v AS (SELECT session_id, ts_us, event_id, 1 + k % 20 AS page FROM ev WHERE event_type = 'view'), d AS (SELECT *, lead(ts_us) OVER (PARTITION BY session_id ORDER BY ts_us, event_id) AS nxt FROM v) "
        "SELECT session_id, page, ts_us, event_id FROM d WHERE (nxt IS NULL OR nxt - ts_us >= 7200000000) AND ts_us + 7200000000 <= (SELECT max(ts_us) - 600000000 FROM v)",
        "ev",
    ),
)
def stream_debounce(spark: SparkSession, sf: str) -> DataFrame:
    """The last page of each burst that the watermark has closed; bursts are parted by two hours here."""
    stream, path = _replayed(spark, sf)
    return E.run_to_end(E.debounce(stream.where("event_type = 'view'").withColumn("page", 1 + F.col("k") % 20), "2 hours"), path)


_GAP = 6 * 3_600_000


@query(
    "stream_stale_sessions",
    with_views(
        "SELECT session_id, ts_us AS ended_at FROM (SELECT *, lead(ts_us) OVER (PARTITION BY session_id ORDER BY ts_us, event_id) AS nxt, max(ts_us) OVER () AS hi FROM ev) "
        "WHERE kind IN ('finish', 'error', 'cancelled') AND (nxt - ts_us > 3600000000 OR (nxt IS NULL AND ts_us // 1000 + 3600000 <= hi // 1000 - 600000))",
        "ev",
    ),
)
def stream_stale_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions that ended and were reclaimed after an hour, by timers, over several batches."""
    stream, path = _replayed(spark, sf)
    return E.run_to_end(E.reclaimed(stream), path, conf=E.ROCKSDB)


@query(
    "stream_jobs",
    with_views(
        f"WITH g AS (SELECT *, ts_us - lag(ts_us) OVER (PARTITION BY session_id ORDER BY ts_us, event_id) > {1000 * _GAP} AS fresh FROM ev), "
        "j AS (SELECT *, count(*) FILTER (fresh) OVER (PARTITION BY session_id ORDER BY ts_us, event_id) AS job FROM g), "
        "a AS (SELECT session_id, min(ts_us) AS began, count(*) AS n_events, count(*) FILTER (kind = 'chunk_ready') AS done, min(ts_us) FILTER (kind = 'chunk_ready') AS lo, max(ts_us) FILTER (kind = 'chunk_ready') AS hi, "
        "bool_or(kind = 'cancelled') AS c, bool_or(kind = 'error') AS e, bool_or(kind = 'finish') AS f, arg_max(value, {t: ts_us, e: event_id}) FILTER (kind = 'finish') AS result FROM j GROUP BY session_id, job) "
        "SELECT session_id, began, n_events, done, round(50 + 40 / 40.0::DOUBLE * done, 6) AS percent, round(CASE WHEN done < 40 AND done >= 2 AND hi > lo THEN (40 - done) / (done / ((hi - lo) / 1e6)) END, 3) AS eta_s, "
        "CASE WHEN c THEN 'cancelled' WHEN e THEN 'error' WHEN f THEN 'done' ELSE 'error' END AS status, result FROM a",
        "ev",
    ),
)
def stream_jobs(spark: SparkSession, sf: str) -> DataFrame:
    """Progress and status of each session's jobs, parted by six idle hours, from state that timers clear."""
    stream, path = _replayed(spark, sf)
    return E.run_to_end(E.jobs(stream, 40, _GAP), path, "update", ["session_id", "began"], conf=E.ROCKSDB)
