"""Structured Streaming over the event table: ticker, debounce, suppressed repeats, progress and terminal state.

Windows (ticker, debounce) are closed by a watermark, so their state is bounded; rows later than it are dropped. ``without_repeats`` and ``reclaimed`` keep a small
row for each session, ``jobs`` (progress and status) a small item in the row of its bucket, which an event-time timer takes away once the session has been idle for
long enough. ``status`` and
``progress`` are of whole sessions, whose end no event tells: their state lasts as long as the query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from docloom.session import ship

LATE = "10 minutes"


def read_events(spark: SparkSession, path: str, files_per_batch: int | None = 1000) -> DataFrame:
    """event_id, session_id, ts (a timestamp with zone, as watermarks need), ts_us, kind, k, value of an event table's folder.

    Files come in the order of their writing. What depends on the order of time across batches (watermarks, repeats) takes a
    bounded table whose files are not in that order with files_per_batch None: all of it is one batch.
    """
    table = spark.read.parquet(path)
    reader = spark.readStream.schema(table.schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    folder, _, name = path.rstrip("/").rpartition("/")
    alone = any(f.rstrip("/").endswith(f"/{name}") for f in table.inputFiles())  # a file source reads folders: a single file is one of its folder
    rows = reader.option("pathGlobFilter", name).parquet(folder) if alone else reader.parquet(path)
    return _columns(rows)


def event_table(spark: SparkSession, path: str) -> DataFrame:
    """The columns of ``read_events`` of the whole table, not streaming."""
    return _columns(spark.read.parquet(path))


def _columns(rows: DataFrame) -> DataFrame:
    kind = F.create_map(*[F.lit(x) for p in {"view": "progress_update", "click": "paragraph_translated", "signup": "chunk_ready", "purchase": "finish", "error": "error"}.items() for x in p])
    return rows.select(
        "event_id", F.col("user_id").cast("string").alias("session_id"), F.col("ts").cast("timestamp").alias("ts"), F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)").alias("ts_us"),
        F.coalesce(F.element_at(kind, F.col("event_type")), F.lit("log")).alias("kind"), F.get_json_object("props", "$.k").cast("int").alias("k"), "value", "event_type",
    )


def ticker(events: DataFrame, every: str = "200 milliseconds", late: str = LATE) -> DataFrame:
    """The newest event of each session and tick. The append mode gives closed ticks only, the update mode open ones too, again as they change."""
    rows = events.withWatermark("ts", late).groupBy("session_id", F.window("ts", every).alias("w"))
    return rows.agg(F.max_by("value", F.struct("ts_us", "event_id")).alias("value"), F.count(F.lit(1)).alias("n")).select("session_id", F.col("w.start").alias("tick"), "value", "n")


def debounce(views: DataFrame, gap: str = "400 milliseconds", late: str = LATE) -> DataFrame:
    """The last page of each burst; feed ``without_repeats`` to drop those sent before."""
    rows = views.withWatermark("ts", late).groupBy("session_id", F.session_window("ts", gap).alias("w"))
    return rows.agg(F.max_by("page", F.struct("ts_us", "event_id")).alias("page"), F.max("ts_us").alias("ts_us"), F.max("event_id").alias("event_id")).drop("w")


def status(events: DataFrame) -> DataFrame:
    """Terminal state of each session so far; for the update mode."""
    seen = lambda k: F.max((F.col("kind") == k).cast("int")) == 1
    last = F.max_by("value", F.when(F.col("kind") == "finish", F.struct("ts_us", "event_id")))
    state = F.when(seen("cancelled"), "cancelled").when(seen("error"), "error").when(seen("finish"), "done").otherwise("error")
    return events.groupBy("session_id").agg(state.alias("status"), F.when(seen("finish"), last).alias("result"), F.count(F.lit(1)).alias("n_events"))


def progress(events: DataFrame, total: int) -> DataFrame:
    """done, percent and eta of each session so far; for the update mode."""
    rows = events.where("kind = 'chunk_ready'").groupBy("session_id").agg(F.count(F.lit(1)).alias("done"), F.min("ts_us").alias("lo"), F.max("ts_us").alias("hi"))
    rate = F.when((F.col("done") >= 2) & (F.col("hi") > F.col("lo")), F.col("done") / ((F.col("hi") - F.col("lo")) / 1e6))
    left = F.lit(total) - F.col("done")
    return rows.select("session_id", "done", F.round(50 + 40 / total * F.col("done"), 6).alias("percent"), F.round(F.when((left > 0) & rate.isNotNull(), left / rate), 3).alias("eta_s"))


#: The state store that timers and typed state need.
ROCKSDB = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
#: Kinds of events that end a job.
TERMINAL = ("finish", "error", "cancelled")
#: How long a session may be idle before what is known of it goes.
IDLE_MS = 24 * 3_600_000


class _Idle(StatefulProcessor):
    """Keeps one row of state for a session and a timer that ends it when the session has been idle for idle_ms of event time. A row that comes later than that
    after the one before begins anew, whether or not the watermark has got to the timer; so results don't depend on how rows fall into batches."""

    schema = ""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("state", self.schema)

    def keep(self, row: tuple, last_us: int, timed: bool = True) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.state.update(row)
        if timed:
            self.handle.registerTimer(last_us // 1000 + self.idle_ms)

    def late(self, last_us: int, now_us: int) -> bool:
        return now_us - last_us > 1000 * self.idle_ms

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter([])

    def close(self) -> None:
        pass


class LastPage(_Idle):
    """Passes on views whose page differs from the session's last."""

    schema = "page int, ts_us long"

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(["ts_us", "event_id"])
        page, ts = self.state.get() if self.state.exists() else (None, None)
        before, at = frame["page"].shift(), frame["ts_us"].shift()
        before.iloc[0], at.iloc[0] = page, ts
        keep = (frame["page"] != before) | before.isna() | (frame["ts_us"] - at.astype("float") > 1000 * self.idle_ms)
        last = int(frame["ts_us"].iloc[-1])
        self.keep((int(frame["page"].iloc[-1]), last), last)
        yield frame.loc[keep, ["session_id", "ts_us", "event_id", "page"]]


class Reclaim(_Idle):
    """Gives out sessions that ended and stayed so for idle_ms. A running one has no timer and is never touched."""

    schema = "ts_us long, ended boolean"

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(["ts_us", "event_id"])
        ts, ended = self.state.get() if self.state.exists() else (None, False)
        gone = []
        for now, kind in zip(frame["ts_us"], frame["kind"]):
            if ended and self.late(ts, now):
                gone.append(ts)
            ts, ended = int(now), kind in TERMINAL
        self.keep((ts, ended), ts, timed=ended)
        yield self.gone(key[0], gone)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        ts, _ = self.state.get()
        self.state.clear()
        yield self.gone(key[0], [ts])

    @staticmethod
    def gone(session: str, ended: list[int]) -> pd.DataFrame:
        return pd.DataFrame({"session_id": pd.Series([session] * len(ended), dtype=object), "ended_at": pd.Series(ended, dtype="int64")})


#: What is known of a job; one with no idle time above idle_ms between its events.
JOB = {
    "session_id": "string", "began": "long", "last": "long", "n_events": "long", "done": "long", "lo": "long", "hi": "long", "finished": "boolean", "failed": "boolean", "cancelled": "boolean", "result": "double",
}


def _pieces(events: pd.DataFrame) -> pd.DataFrame:
    """Each event as a job of its own."""
    events = events.sort_values(["ts_us", "event_id"])
    ts, kind = events["ts_us"], events["kind"]
    chunk, finish = kind == "chunk_ready", kind == "finish"
    mark = ts.astype("Int64").where(chunk)
    return pd.DataFrame({
        "session_id": events["session_id"], "began": ts, "last": ts, "n_events": 1, "done": chunk.astype("int64"), "lo": mark, "hi": mark, "finished": finish, "failed": kind == "error", "cancelled": kind == "cancelled",
        "result": events["value"].astype("float64").where(finish),
    })


def _joined(open_jobs: pd.DataFrame, events: pd.DataFrame, idle_us: int) -> pd.DataFrame:
    """Jobs of open ones and of later events, a session's one after the other, the newest last; as columns at once, whatever the number of sessions."""
    rows = pd.concat([open_jobs, _pieces(events)], ignore_index=True) if len(open_jobs) else _pieces(events)
    code = pd.factorize(rows["session_id"], use_na_sentinel=False)[0]
    order = np.argsort(code, kind="stable")
    rows, code = rows.iloc[order].reset_index(drop=True), code[order]
    began, last, at = rows["began"].to_numpy("int64"), rows["last"].to_numpy("int64"), np.arange(len(rows))
    start = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (began[1:] - last[:-1] > idle_us)])
    end = np.r_[start[1:], len(rows)] - 1
    first = lambda has: np.minimum.reduceat(np.where(has, at, len(rows) - 1), start)
    newest = lambda has: np.maximum.reduceat(np.where(has, at, 0), start)
    some, finished = rows["lo"].notna().to_numpy(), rows["finished"].to_numpy(bool)
    any_of = lambda has: np.logical_or.reduceat(has, start)
    take = lambda column, where, has: rows[column].take(where).reset_index(drop=True).where(has)
    return pd.DataFrame({
        "session_id": rows["session_id"].to_numpy(object)[start], "began": began[start], "last": last[end], "n_events": np.add.reduceat(rows["n_events"].to_numpy("int64"), start), "done": np.add.reduceat(rows["done"].to_numpy("int64"), start),
        "lo": take("lo", first(some), any_of(some)), "hi": take("hi", newest(some), any_of(some)), "finished": any_of(finished), "failed": any_of(rows["failed"].to_numpy(bool)), "cancelled": any_of(rows["cancelled"].to_numpy(bool)),
        "result": take("result", newest(finished), any_of(finished)),
    })


def _jobs_of(idle_ms: int):
    """The function of a bucket of sessions: its state is the open job of each, as a list for each column."""

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        found = pd.DataFrame(dict(zip(JOB, state.get))).astype({"lo": "Int64", "hi": "Int64", "result": "float64"}) if state.exists else pd.DataFrame(columns=[*JOB])
        now = state.getCurrentWatermarkMs()
        if not state.hasTimedOut:
            events = pd.concat(list(frames))
            known = found["session_id"].isin(events["session_id"])
            jobs = _joined(found[known], events, 1000 * idle_ms)
            yield jobs.astype({"lo": "Int64", "hi": "Int64"})
            newest = jobs[~jobs["session_id"].duplicated(keep="last")]
            found = pd.concat([found[~known], newest], ignore_index=True) if not known.all() else newest
        ends = found["last"].to_numpy("int64") // 1000 + idle_ms
        found = found[ends > now]
        if not len(found):
            if state.exists:
                state.remove()
            return
        state.update(tuple([None if pd.isna(x) else x for x in found[c].tolist()] if c in ("session_id", "lo", "hi", "result") else found[c].tolist() for c in JOB))
        state.setTimeoutTimestamp(int(ends[ends > now].min()))

    return run


REPEATS = "session_id string, ts_us long, event_id long, page int"


def _timed(rows: DataFrame, processor: StatefulProcessor, schema: str, mode: str, late: str) -> DataFrame:
    ship(rows.sparkSession)
    return rows.withWatermark("ts", late).groupBy("session_id").transformWithStateInPandas(processor, schema, mode, "EventTime")


def without_repeats(views: DataFrame, idle_ms: int = IDLE_MS, late: str = LATE) -> DataFrame:
    """Views (session_id, ts, ts_us, event_id, page) whose page is not that of the session's view before, at most idle_ms ago. Needs ROCKSDB."""
    return _timed(views.select("session_id", "ts", "ts_us", "event_id", "page"), LastPage(idle_ms), REPEATS, "append", late)


def reclaimed(events: DataFrame, age_ms: int = 3_600_000, late: str = LATE) -> DataFrame:
    """session_id and ended_at of each session whose last event ended it and that nothing followed within age_ms. Needs ROCKSDB."""
    return _timed(events.select("session_id", "ts", "ts_us", "event_id", "kind"), Reclaim(age_ms), "session_id string, ended_at long", "append", late)


def jobs(events: DataFrame, total: int, idle_ms: int = IDLE_MS, late: str = LATE, buckets: int = 256) -> DataFrame:
    """session_id, began, n_events, done, percent, eta_s, status, result of each job so far, for the update mode, by (session_id, began).

    Sessions are dealt to buckets, whose open jobs are a row of state; a batch calls Python once for each bucket with events, not once for each session. A bucket's
    open jobs and the events of a batch are in a worker's memory at a time. The number of buckets holds for as long as the query's state."""
    ship(events.sparkSession)
    dealt = events.withWatermark("ts", late).select(F.pmod(F.xxhash64("session_id"), F.lit(buckets)).alias("_bucket"), "session_id", "ts", "ts_us", "event_id", "kind", "value")
    schema, lists = (", ".join(f"{c} {t}" for c, t in x) for x in (JOB.items(), [(c, f"array<{t}>") for c, t in JOB.items()]))
    rows = dealt.groupBy("_bucket").applyInPandasWithState(_jobs_of(idle_ms), schema, lists, "update", GroupStateTimeout.EventTimeTimeout)
    status = F.when(F.col("cancelled"), "cancelled").when(F.col("failed"), "error").when(F.col("finished"), "done").otherwise("error")
    rate = F.when((F.col("done") >= 2) & (F.col("hi") > F.col("lo")), F.col("done") / ((F.col("hi") - F.col("lo")) / 1e6))
    left = F.lit(total) - F.col("done")
    return rows.select(
        "session_id", "began", "n_events", "done", F.round(50 + 40 / total * F.col("done"), 6).alias("percent"), F.round(F.when((left > 0) & rate.isNotNull(), left / rate), 3).alias("eta_s"), status.alias("status"), "result",
    )


def without_repeats_classic(views: DataFrame) -> DataFrame:
    """The same on the state API that any state store serves."""
    ship(views.sparkSession)

    def run(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(frames)).sort_values(["ts_us", "event_id"])
        before = frame["page"].shift()
        before.iloc[0] = state.get[0] if state.exists else None
        keep = (frame["page"] != before) | before.isna()
        state.update((int(frame["page"].iloc[-1]),))
        yield frame.loc[keep, ["session_id", "ts_us", "event_id", "page"]]

    rows = views.select("session_id", "ts_us", "event_id", "page").groupBy("session_id")
    return rows.applyInPandasWithState(run, REPEATS, "page int", "append", GroupStateTimeout.NoTimeout)


def replay(events: DataFrame, path: str, batches: int = 6, rows_a_file: int = 1_000_000) -> DataFrame:
    """A bounded event table as a stream of as many batches, in the order of time: it is written below path in slices between quantiles of ts, one after the
    other, and read a slice at a time. events(ts, ...) as ``read_events`` gives them, not streaming."""
    spark = events.sparkSession
    cuts = events.agg(F.percentile_approx(F.col("ts_us"), [k / batches for k in range(1, batches)], 10_000)).first()[0] or []
    edges = [None, *sorted(set(cuts)), None]
    files = max(1, events.count() // batches // rows_a_file)
    for a, b in zip(edges[:-1], edges[1:]):
        inside = (F.lit(True) if a is None else F.col("ts_us") > a) & (F.lit(True) if b is None else F.col("ts_us") <= b)
        events.where(inside).repartition(files).write.mode("append").parquet(f"{path}/in")
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", files).parquet(f"{path}/in")


def run_to_end(stream: DataFrame, path: str, mode: str = "append", keys: list[str] | None = None, conf: dict[str, str] | None = None) -> DataFrame:
    """Runs the stream over what is there now and returns what it wrote below path; in the update mode the last row for each of keys. conf holds for the
    run. Without a batch there are no rows."""
    spark = stream.sparkSession
    before = {k: spark.conf.get(k, None) for k in conf or {}}

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/out/batch={number}")  # a batch that is run again replaces itself

    try:
        for k, v in (conf or {}).items():
            spark.conf.set(k, v)
        stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/out")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], stream.schema)
    rows = spark.read.parquet(f"{path}/out").drop("batch")
    if mode == "append":
        return rows.drop("_batch")
    rest = [c for c in rows.columns if c not in (*keys, "_batch")]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("r"))
    return last.select(*keys, "r.*")
