"""File sources and sinks: listings with content hashes, captured event streams, the chunk table, event messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def listing(spark: SparkSession, path: str, pattern: str = "*", with_content: bool = False) -> DataFrame:
    """path, size_bytes, mtime (microseconds) and present of the files below path; with_content adds content_hash (SHA-256).

    Without content the column is pruned, so the files themselves are not read. With it a file is held in one row, below 2 GB; ``blobs.hashed`` takes any size.
    Spark's reader leaves empty files out.
    """
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    extra = [F.sha2("content", 256).alias("content_hash")] if with_content else []
    return rows.select("path", F.col("length").alias("size_bytes"), F.unix_micros("modificationTime").alias("mtime"), F.lit(True).alias("present"), *extra)


def event_log_lines(spark: SparkSession, path: str) -> DataFrame:
    """log_id (the file), line_no, line of captured event streams, a file each; feeds ``parse_event_log``."""
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("log_id"), "value")
    return rows.select("log_id", F.posexplode(F.split("value", "\n", -1)).alias("line_no", "line"))


def write_chunks(records: DataFrame, path: str, mode: str = "append", buckets: int | None = None) -> None:
    """The chunk table: Parquet, partitioned by document_id's hash bucket, sorted within, so that a filter on a document reads one bucket and
    skips row groups. overwrite replaces the buckets that records has, no others. All writers and readers of a table name the same number of
    buckets: some gigabytes a bucket are a good size."""
    bucketed = records.withColumn("bucket", bucket_of(F.col("document_id"), buckets))
    writer = bucketed.repartition("bucket", F.pmod(F.xxhash64("document_id", F.lit(1)), F.lit(FILES))).sortWithinPartitions("document_id", "chunk_index").write.partitionBy("bucket").mode(mode)
    (writer.option("partitionOverwriteMode", "dynamic") if mode == "overwrite" else writer).parquet(path)


#: Folders of the chunk table unless said otherwise, and files that a write deals a folder's documents over at most.
BUCKETS, FILES = 256, 8


def bucket_of(document_id: Column, buckets: int | None = None) -> Column:
    return F.pmod(F.xxhash64(document_id), F.lit(buckets or BUCKETS)).cast("int")


def read_chunks(spark: SparkSession, path: str, document_id: str | None = None, buckets: int | None = None) -> DataFrame:
    """The chunk table, or the chunks of a document by way of its bucket only."""
    rows = spark.read.parquet(path)
    if document_id is not None:
        bucket = spark.range(1).select(bucket_of(F.lit(document_id), buckets)).first()[0]
        rows = rows.where((F.col("bucket") == bucket) & (F.col("document_id") == document_id))
    return rows.drop("bucket")


def write_events(events: DataFrame, path: str) -> None:
    """Events as lines of an event stream: a text file sink."""
    events.select(F.concat(F.lit("event: "), "event", F.lit("\ndata: "), "data", F.lit("\n"))).write.mode("append").text(path)
