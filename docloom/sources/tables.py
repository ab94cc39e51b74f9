"""Views over the given tables, in the schemas that the operators read. Every view grows with its table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.text import memory_key


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """document_id string, doc_id, line_no (from 0), line."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").cast("string").alias("document_id"), "doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))


def spans_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested page blocks: document_id, page, blocks array<struct<lines array<struct<spans array<struct<text, size, flags, x0, y0>>>>>>.

    A block is up to 8 lines of a document, a page; a line without text has no spans.
    """
    line = lines(spark, sf_dir)
    span = F.struct(
        F.col("line").alias("text"), F.when(F.col("line_no") % 8 == 0, 16.0).otherwise(11.0).alias("size"), F.when(F.col("line_no") % 5 == 0, 16).otherwise(0).alias("flags"),
        F.lit(40.0).alias("x0"), (40 + 14 * (F.col("line_no") % 8)).cast("double").alias("y0"),
    )
    spans = F.when(F.col("line") != "", F.array(span)).otherwise(F.array().cast(f"array<{'struct<text:string,size:double,flags:int,x0:double,y0:double>'}>"))
    by_page = line.withColumn("page", F.floor(F.col("line_no") / 8).cast("int")).groupBy("document_id", "page")
    found = by_page.agg(F.array_sort(F.collect_list(F.struct("line_no", spans.alias("spans")))).alias("lines"))
    return found.select("document_id", "page", F.array(F.struct(F.transform("lines", lambda x: F.struct(x["spans"].alias("spans"))).alias("lines"))).alias("blocks"))


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text elements straight from the lines: document_id, page, kind, ordinal, x0, y0, x1, y1, content, font_size, font_flags."""
    k = F.col("line_no")
    return lines(spark, sf_dir).select(
        "document_id", F.floor(k / 8).cast("int").alias("page"), F.lit("text").alias("kind"), k.cast("int").alias("ordinal"), F.lit(40.0).alias("x0"),
        (40 + 14 * (k % 8)).cast("double").alias("y0"), F.lit(550.0).alias("x1"), (52 + 14 * (k % 8)).cast("double").alias("y1"), F.col("line").alias("content"),
        F.when(k % 8 == 0, 16.0).otherwise(11.0).alias("font_size"), F.when(k % 5 == 0, 16).otherwise(0).alias("font_flags"),
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored chunk for each line that is not blank: chunk_id, document_id, document_path, chunk_index, page, chunk_type, has_*, text, elements (JSON)."""
    k = F.col("line_no")
    bbox = F.array(F.lit(40.0), (40 + 14 * (k % 8)).cast("double"), F.lit(550.0), (52 + 14 * (k % 8)).cast("double"))
    element = F.to_json(F.array(F.struct(F.lit("text").alias("type"), F.floor(k / 8).cast("int").alias("page"), bbox.alias("bbox"))))
    return lines(spark, sf_dir).where(F.trim("line") != "").select(
        F.concat_ws("_chunk_", "document_id", k.cast("string")).alias("chunk_id"), "document_id", F.concat(F.lit("/corpus/"), F.col("document_id"), F.lit(".pdf")).alias("document_path"),
        k.cast("int").alias("chunk_index"), F.floor(k / 8).cast("int").alias("page"), F.when(k % 8 == 0, "title").when(k % 5 == 0, "header").otherwise("content").alias("chunk_type"),
        (k % 7 == 3).alias("has_equations"), (k % 5 == 2).alias("has_tables"), (k % 6 == 4).alias("has_figures"), F.col("line").alias("text"),
        F.when(k % 11 == 5, F.lit("{broken")).otherwise(element).alias("elements"),
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qid, question (the whole text), document_id (for every third, from the range of all documents), hypothetical_answer (null for every
    second): from the benchmark."""
    items = table(spark, sf_dir, "benchmark")
    ids = table(spark, sf_dir, "documents").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
    q = F.col("item_id")
    head = F.element_at(F.split("text", "\n"), 1)
    asked = F.col("lo") + (q * 7919) % (F.col("hi") - F.col("lo") + 1)
    return items.join(F.broadcast(ids)).select(  # ids is one row
        q.alias("qid"), F.col("text").alias("question"), F.when(q % 3 == 0, asked.cast("string")).alias("document_id"), F.when(q % 2 == 0, head).alias("hypothetical_answer"),
    )


#: 2024-01-01 in microseconds; the clock of tested paths stands at NOW.
EPOCH = 1_704_067_200_000_000
HOUR, DAY = 3_600_000_000, 86_400_000_000
NOW = EPOCH + 40 * DAY


def micros(ts: str | Column) -> Column:
    """Microseconds since 1970 of a timestamp without zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ts})") if isinstance(ts, str) else ts


def memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Translation memory from all distinct lines, at their first place, by a service that their length tells; times in microseconds.
    Requests ask by the service of their document, so some hit, some miss, and entries of the first documents have expired."""
    line = lines(spark, sf_dir).where("trim(line) <> ''")
    first = line.groupBy("line").agg(F.min("doc_id").alias("d"))
    d, at = F.col("d"), (F.col("d") * HOUR + EPOCH).cast("long")
    n = F.length("line") % 3
    service = F.when(n == 0, "argos").when(n == 1, "openai").otherwise("gemini")
    model = F.when(n == 0, F.lit(None).cast("string")).otherwise(F.lit("base"))
    return first.select(
        memory_key(F.lit("en"), F.lit("vi"), service, model, F.col("line")).alias("cache_key"), F.lit("en").alias("source_lang"), F.lit("vi").alias("target_lang"), service.alias("service"), model.alias("model"),
        F.col("line").alias("source_text"), F.concat(F.lit("vi: "), "line").alias("translated_text"), at.alias("cached_at"), (at + 30 * DAY).alias("expires_at"), (d % 5).cast("long").alias("hit_count"),
        F.when(d % 3 != 0, at + HOUR).alias("last_used"),
    )


def memory_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request for each line that is not blank: request_id, source_text, lang_in, lang_out, service, model, ts."""
    d = F.col("doc_id")
    return lines(spark, sf_dir).where("trim(line) <> ''").select(
        F.concat_ws(":", "document_id", F.col("line_no").cast("string")).alias("request_id"), F.col("line").alias("source_text"), F.lit("en").alias("lang_in"), F.lit("vi").alias("lang_out"),
        F.when(d % 3 == 0, "argos").when(d % 3 == 1, "openai").otherwise("gemini").alias("service"), F.when(d % 3 == 0, F.lit(None).cast("string")).otherwise(F.lit("base")).alias("model"),
        (F.lit(EPOCH) + d * HOUR + F.col("line_no") * 1_000_000).cast("long").alias("ts"),
    )


def document_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document-cache rows from the documents."""
    from docloom.functions.text import document_key

    d, at = F.col("doc_id"), (F.col("doc_id") * HOUR + EPOCH).cast("long")
    service = F.when(d % 3 == 0, "argos").when(d % 3 == 1, "openai").otherwise("gemini")
    version = F.when(d % 4 == 0, "v1").otherwise("v2")
    return table(spark, sf_dir, "documents").select(
        document_key(F.sha2("text", 256), F.lit("vi"), service, F.lit("base"), version).alias("cache_key"), F.sha2("text", 256).alias("file_hash"), F.col("lang").alias("source_lang"), F.lit("vi").alias("target_lang"),
        service.alias("service"), F.lit("base").alias("model"), version.alias("pipeline_version"), F.concat(F.lit("/cache/"), d.cast("string"), F.lit(".pdf")).alias("cached_path"), F.col("source").alias("original_filename"),
        at.alias("cached_at"), F.when(d % 3 != 0, at + (d % 17) * HOUR).alias("last_used"), (d % 5).cast("long").alias("hit_count"), F.col("n_chars").cast("long").alias("file_size_bytes"),
    )


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file listing from pages and documents: path, size_bytes, mtime, page_count (null where it does not open), present."""
    d = F.col("page_id")
    name = F.when(d % 7 == 0, F.concat(F.lit("scan_"), d.cast("string"), F.lit(".txt"))).when(d % 2 == 0, F.concat(F.lit("File_"), d.cast("string"), F.lit(".PDF"))).otherwise(F.concat(F.lit("file_"), d.cast("string"), F.lit(".pdf")))
    return table(spark, sf_dir, "pages").select(
        d.alias("file_id"), F.concat(F.when(d % 5 == 0, "/tmp/job_").otherwise("/data/in_"), name).alias("path"), (F.length("html").cast("long") * 20000).alias("size_bytes"),
        (F.lit(NOW) - d * 60_000_000 * 7).cast("long").alias("mtime"), F.when(d % 13 != 4, (F.length("html") % 70).cast("int")).alias("page_count"), (d % 11 != 3).alias("present"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress events from the event table: event_id, session_id, ts_us, kind, k, value."""
    kind = F.create_map(*[F.lit(x) for p in {"view": "progress_update", "click": "paragraph_translated", "signup": "chunk_ready", "purchase": "finish", "error": "error"}.items() for x in p])
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").cast("string").alias("session_id"), micros("ts").alias("ts_us"), F.coalesce(F.element_at(kind, F.col("event_type")), F.lit("log")).alias("kind"),
        F.get_json_object("props", "$.k").cast("int").alias("k"), "value", "event_type",
    )
