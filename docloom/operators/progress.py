"""Progress events, page slots, versions of output files, services: the batch forms. Times are whole microseconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MB = 1024 * 1024


def unified(*frames: DataFrame) -> DataFrame:
    """Typed payloads as one record; what a type lacks is null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def event_wire(events: DataFrame, kind: str = "kind") -> DataFrame:
    """event and data, the other columns as JSON, for a text, message-queue or foreachBatch sink."""
    rest = [c for c in events.columns if c != kind]
    return events.select(F.col(kind).alias("event"), F.to_json(F.struct(*rest)).alias("data"))


def parse_event_log(log: DataFrame) -> DataFrame:
    """Events of captured streams log(log_id, line_no, line): log_id, event_no, event, data, is_json.

    A trailing carriage return goes; lines that begin with a colon are comments; ``event:`` names the type, ``data:`` lines of a block
    are joined by newlines; an empty line ends a block. A block without data gives nothing, but its type holds for the next; the type is
    ``message`` otherwise. A block that no empty line ends is not given. Logs are independent, each is ordered in one task.
    """
    order = Window.partitionBy("log_id").orderBy("line_no")
    text = F.regexp_replace("line", r"\r$", "")
    rows = log.withColumn("t", text).withColumn("ends", (F.col("t") == "").cast("int"))
    rows = rows.withColumn("block", F.coalesce(F.sum("ends").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.where(~F.col("t").startswith(":"))
    value = lambda name: F.when(F.col("t").startswith(f"{name}:"), F.regexp_replace(F.substring("t", len(name) + 2, 1 << 30), "^ ", ""))
    rows = rows.withColumns({"kind": F.trim(value("event")), "datum": value("data")})
    lines = F.transform(F.array_sort(F.collect_list(F.when(F.col("datum").isNotNull(), F.struct("line_no", "datum")))), lambda x: x["datum"])
    blocks = rows.groupBy("log_id", "block").agg(
        F.max(F.when(F.col("kind").isNotNull(), F.struct("line_no", "kind")))["kind"].alias("kind"), lines.alias("lines"), F.max("ends").alias("ended")
    ).where("ended = 1")
    by = Window.partitionBy("log_id").orderBy("block")
    # Types are kept over blocks without data, up to the next block with data.
    blocks = blocks.withColumn("full", (F.size("lines") > 0).cast("int")).withColumn("run", F.coalesce(F.sum("full").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    kept = F.last("kind", ignorenulls=True).over(Window.partitionBy("log_id", "run").orderBy("block").rowsBetween(Window.unboundedPreceding, 0))
    out = blocks.withColumn("event", F.coalesce(kept, F.lit("message"))).where("full = 1").withColumn("data", F.array_join("lines", "\n"))
    return out.select("log_id", F.row_number().over(by).alias("event_no"), "event", "data", F.try_parse_json("data").isNotNull().alias("is_json"))


def validate_files(files: DataFrame, max_mb: float = 50.0, max_pages: int = 50) -> DataFrame:
    """Adds reason, the first that fails of: exists, suffix, size, opens, has pages, not too many; null if valid. page_count is null where a file does not open."""
    reason = (
        F.when(~F.col("present"), "missing").when(~F.lower("path").endswith(".pdf"), "not_pdf").when(F.col("size_bytes") > max_mb * MB, "too_large")
        .when(F.col("page_count").isNull(), "unreadable").when(F.col("page_count") == 0, "no_pages").when(F.col("page_count") > max_pages, "too_many_pages")
    )
    return files.withColumn("reason", reason)


def page_slots(documents: DataFrame, pages_per_slot: int = 1) -> DataFrame:
    """document_id, slot, first_page, last_page (from 1, inclusive) of documents(document_id, n_pages); the last slot may be short."""
    starts = F.when(F.col("n_pages") > 0, F.sequence(F.lit(1), F.col("n_pages"), F.lit(pages_per_slot)))
    rows = documents.select("document_id", "n_pages", F.posexplode(starts).alias("slot", "first_page"))
    return rows.select("document_id", "slot", "first_page", F.least(F.col("first_page") + pages_per_slot - 1, "n_pages").alias("last_page"))


def rolling_merge(slots: DataFrame, translated: DataFrame) -> DataFrame:
    """slots(document_id, slot, original) with content: the translated one where there is one."""
    rows = slots.join(translated.select("document_id", "slot", "translated"), ["document_id", "slot"], "left")
    return rows.withColumn("content", F.coalesce("translated", "original")).withColumn("is_translated", F.col("translated").isNotNull())


def priority_order(slots: DataFrame, anchor: Column) -> DataFrame:
    """Adds priority: slots by distance from the anchor slot, the lower first of two as near."""
    return slots.withColumn("priority", F.row_number().over(Window.partitionBy("document_id").orderBy(F.abs(F.col("slot") - anchor), "slot")))


def version_of(name: str | Column) -> Column:
    """The whole number behind the last _v of a file name's stem; -1 without one."""
    stem = F.regexp_replace(F.col(name) if isinstance(name, str) else name, r"\.[^.]*$", "")
    digits = F.regexp_extract(stem, r"_v([0-9]+)$", 1)
    return F.coalesce(F.when(digits != "", digits.cast("long")), F.lit(-1).cast("long"))


def latest_versions(outputs: DataFrame, keep: int = 1) -> DataFrame:
    """Adds version and newest (from 1) to outputs(stem, name), highest first, ties by name."""
    rows = outputs.withColumn("version", version_of("name"))
    return rows.withColumn("newest", F.row_number().over(Window.partitionBy("stem").orderBy(F.col("version").desc(), F.col("name").desc())))


def pick_output(outputs: DataFrame) -> DataFrame:
    """The one file of outputs(stem, name, mtime) that stands for each stem: the highest rolling version, else the first of
    the exact names in order, else the newest with ``mono`` in its name, else the newest."""
    name, stem = F.col("name"), F.col("stem")
    exact = [F.concat(stem, F.lit(x)) for x in ("_mono.pdf", ".vi.pdf", "_translated.pdf", ".pdf")]
    rolling = name.startswith(F.concat(stem, F.lit("_translated_v"))) & (version_of("name") >= 0)
    place = F.when(rolling, 0)
    for k, x in enumerate(exact):
        place = place.when(name == x, k + 1)
    place = place.when(F.lower("name").contains("mono"), 5).otherwise(6)
    order = Window.partitionBy("stem").orderBy("_place", F.when(F.col("_place") == 0, -version_of("name")).otherwise(-F.col("mtime")), "name")
    return outputs.withColumn("_place", place).withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", "_place")


def last_entries(history: DataFrame, n: int = 50) -> DataFrame:
    """The last n entries of each user by (ts_us, event_id)."""
    order = Window.partitionBy("session_id").orderBy(F.col("ts_us").desc(), F.col("event_id").desc())
    return history.withColumn("recency", F.row_number().over(order)).where(F.col("recency") <= n)


def progress_eta(ready: DataFrame, total: Column) -> DataFrame:
    """Adds done, percent, rate and eta_s to chunk events(session_id, ts_us, event_id) of sessions with ``total`` chunks.

    percent = 50 + 40 / total * done. From the second event on rate is done per second since the first, and eta what remains at that rate, null
    where nothing remains.
    """
    order = Window.partitionBy("session_id").orderBy("ts_us", "event_id")
    rows = ready.withColumns({"done": F.row_number().over(order), "_s": (F.col("ts_us") - F.min("ts_us").over(order)) / 1e6, "_total": total})
    rate = F.when((F.col("done") >= 2) & (F.col("_s") > 0), F.col("done") / F.col("_s"))
    rows = rows.withColumns({"percent": F.round(50 + 40 / F.col("_total") * F.col("done"), 6), "rate": F.round(rate, 9)})
    left = F.col("_total") - F.col("done")
    return rows.withColumn("eta_s", F.round(F.when((left > 0) & rate.isNotNull(), left / rate), 3)).drop("_s", "_total")


def state_fold(events: DataFrame, columns: list[str]) -> DataFrame:
    """Columns as last known at each event: a null keeps what was before."""
    order = Window.partitionBy("session_id").orderBy("ts_us", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumns({c: F.last(c, ignorenulls=True).over(order) for c in columns})


def session_status(events: DataFrame) -> DataFrame:
    """One row for each session of events(session_id, ts_us, event_id, kind, value): status (done, cancelled, error) and the last payload of a finish.

    Cancelled before error before done; a session without a terminal event is an error.
    """
    seen = lambda k: F.max((F.col("kind") == k).cast("int")) == 1
    last = F.max_by("value", F.when(F.col("kind") == "finish", F.struct("ts_us", "event_id")))
    status = F.when(seen("cancelled"), "cancelled").when(seen("error"), "error").when(seen("finish"), "done").otherwise("error")
    return events.groupBy("session_id").agg(status.alias("status"), F.when(seen("finish"), last).alias("result"), F.count(F.lit(1)).alias("n_events"))


def ticker(events: DataFrame, every_us: int = 200_000) -> DataFrame:
    """Of each session and tick only the newest event, with its tick's number: session_id, tick, value, seen (events so far), tick_no."""
    rows = events.groupBy("session_id", F.floor(F.col("ts_us") / every_us).cast("long").alias("tick")).agg(
        F.max_by("value", F.struct("ts_us", "event_id")).alias("value"), F.count(F.lit(1)).alias("n")
    )
    order = Window.partitionBy("session_id").orderBy("tick")
    return rows.withColumns({"seen": F.sum("n").over(order), "tick_no": F.row_number().over(order)}).drop("n")


def debounce(views: DataFrame, gap_us: int = 400_000) -> DataFrame:
    """The last page of each burst of views(session_id, ts_us, event_id, page), bursts being parted by gaps of gap_us, without those that repeat the page sent before."""
    order = Window.partitionBy("session_id").orderBy("ts_us", "event_id")
    rows = views.withColumn("_next", F.lead("ts_us").over(order)).where(F.col("_next").isNull() | (F.col("_next") - F.col("ts_us") >= gap_us)).drop("_next")
    return dedupe_consecutive(rows)


def dedupe_consecutive(views: DataFrame) -> DataFrame:
    """Views whose page is not that of the view before."""
    order = Window.partitionBy("session_id").orderBy("ts_us", "event_id")
    return views.withColumn("_was", F.lag("page").over(order)).where(~F.col("page").eqNullSafe(F.col("_was")) | F.col("_was").isNull()).drop("_was")


def stale_sessions(events: DataFrame, now: int, age_s: int = 3600) -> DataFrame:
    """Sessions that have ended and are older than age_s: running ones never."""
    ended = F.max(F.when(F.col("kind").isin("finish", "error", "cancelled"), F.col("ts_us")))
    rows = events.groupBy("session_id").agg(ended.alias("ended_at"), F.max("ts_us").alias("last_at"))
    return rows.where(F.col("ended_at").isNotNull() & (F.col("ended_at") == F.col("last_at")) & (F.lit(now) - F.col("last_at") > age_s * 1_000_000))


def orphan_files(files: DataFrame, prefix: str, now: int, age_s: int = 3600) -> DataFrame:
    """Files under a prefix that were last changed age_s ago or before."""
    return files.where(F.col("path").startswith(prefix) & (F.col("mtime") <= now - age_s * 1_000_000))


def resolve_services(requests: DataFrame, services: DataFrame, default: str = "argos") -> DataFrame:
    """Adds service (the requested one if it has a key, else the default) and its model, and answer_service: the preferred model service with a key, or null (template)."""
    s = F.broadcast(services)  # a handful of services
    rows = requests.join(s.select(F.col("service").alias("requested"), F.col("has_key").alias("_k")), "requested", "left")
    rows = rows.withColumn("service", F.when(F.coalesce("_k", F.lit(False)), F.col("requested")).otherwise(default)).drop("_k")
    rows = rows.join(s.select("service", F.col("default_model").alias("model")), "service", "left")
    best = services.where("has_key AND answer_priority IS NOT NULL").agg(F.min(F.struct("answer_priority", "service"))["service"].alias("_best"))
    return rows.join(F.broadcast(best)).withColumn("answer_service", F.when(F.col("service") != default, F.col("service")).otherwise(F.col("_best"))).drop("_best")
