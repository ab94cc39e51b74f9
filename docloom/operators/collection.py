"""The chunk collection: records, idempotent indexing, reading, deleting and statistics, over a chunk table partitioned by document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def chunk_records(chunks: DataFrame, path: Column, created_at: Column | None = None) -> DataFrame:
    """Stored form of chunks(document_id, chunk_index, page, text, section, elements, has_*): derived id, lengths and the elements as JSON.

    A missing page is stored as 0. created_at is the caller's clock; without one the column is left out.
    """
    stamp = [] if created_at is None else [created_at.alias("created_at")]
    return chunks.select(
        F.concat_ws("_chunk_", "document_id", F.col("chunk_index").cast("string")).alias("chunk_id"), "document_id", path.alias("document_path"), "chunk_index",
        F.coalesce("page", F.lit(0)).alias("page"), F.coalesce("section", F.lit("content")).alias("chunk_type"), "has_equations", "has_tables", "has_figures", *stamp,
        "text", F.length("text").alias("text_length"), F.size("elements").alias("elements_count"), F.to_json("elements").alias("elements"),
    )


def index_new(incoming: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to append, report). A document with any stored chunk is skipped: the report has document_id, n_chunks and cached for every
    incoming document, with the stored count where it is skipped."""
    have = stored.groupBy("document_id").agg(F.count(F.lit(1)).alias("stored"))
    fresh = incoming.join(have, "document_id", "left_anti")
    counted = incoming.groupBy("document_id").agg(F.count(F.lit(1)).alias("n")).join(have, "document_id", "left")
    return fresh, counted.select("document_id", F.coalesce("stored", "n").alias("n_chunks"), F.col("stored").isNotNull().alias("cached"))


def document_chunks(chunks: DataFrame, document_id: str | None = None) -> DataFrame:
    """Chunks of one document (or of all) with their place in the document's order; a missing chunk_index counts as 0."""
    rows = chunks if document_id is None else chunks.where(F.col("document_id") == document_id)
    index = F.coalesce("chunk_index", F.lit(0))
    return rows.withColumn("position", F.row_number().over(Window.partitionBy("document_id").orderBy(index, "chunk_id")))


def page_range_chunks(chunks: DataFrame, first_page: int, last_page: int, limit: int | None = None) -> DataFrame:
    """Per document the chunks of an inclusive range of pages by (page, chunk_index), at most ``limit`` (None or 0: all); similarity 1."""
    order = Window.partitionBy("document_id").orderBy("page", F.coalesce("chunk_index", F.lit(0)), "chunk_id")
    rows = chunks.where(F.col("page").between(first_page, last_page)).withColumn("position", F.row_number().over(order))
    return (rows.where(F.col("position") <= limit) if limit else rows).withColumn("similarity", F.lit(1.0))


def delete_documents(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """What remains without the chunks of documents(document_id); to be written elsewhere and swapped in. Unknown documents are no error."""
    return chunks.join(documents.select("document_id").distinct(), "document_id", "left_anti")


def collection_stats(chunks: DataFrame, sample: int | None = None) -> DataFrame:
    """One row: total_chunks, documents and has_* counts, exact. sample gives those but the total over the first rows by (document_id, chunk_index) only."""
    total = chunks.agg(F.count(F.lit(1)).alias("total_chunks"))
    rows = chunks.orderBy("document_id", "chunk_index").limit(sample) if sample else chunks
    has = [F.count_if(c).alias(f"chunks_with_{c[4:]}") for c in ("has_equations", "has_tables", "has_figures")]
    if not sample:
        return chunks.agg(F.count(F.lit(1)).alias("total_chunks"), F.countDistinct("document_id").alias("unique_documents"), *has)
    return total.join(rows.agg(F.countDistinct("document_id").alias("unique_documents"), *has))


#: Sums that a part of the statistics holds.
COUNTS = ("total_chunks", "chunks_with_equations", "chunks_with_tables", "chunks_with_figures")


def stats_part(chunks: DataFrame, batch: int, sign: int = 1) -> DataFrame:
    """Statistics of a batch of chunks that come (sign 1) or go (-1): batch, document_id and the sums of COUNTS, a row a document. ``add_part`` keeps them."""
    has = [F.count_if(c).alias(f"chunks_with_{c[4:]}") for c in ("has_equations", "has_tables", "has_figures")]
    rows = chunks.groupBy("document_id").agg(F.count(F.lit(1)).alias("total_chunks"), *has)
    return rows.select(F.lit(batch).cast("long").alias("batch"), "document_id", *[(sign * F.col(c)).alias(c) for c in COUNTS])


def add_part(part: DataFrame, path: str, batch: int) -> None:
    """Keeps a part below path, in a folder of its batch; a batch that comes again replaces itself."""
    part.drop("batch").write.mode("overwrite").parquet(f"{path}/batch={batch}")


def retracted(parts: DataFrame, documents: DataFrame, batch: int) -> DataFrame:
    """The part that takes documents(document_id) out: what the parts of earlier batches hold of them, negative. The chunks are not read; unknown documents give nothing."""
    held = parts.where(F.col("batch") < batch).join(documents.select("document_id").distinct(), "document_id", "left_semi").groupBy("document_id").agg(*[F.sum(c).alias(c) for c in COUNTS])
    return held.where("total_chunks <> 0").select(F.lit(batch).cast("long").alias("batch"), "document_id", *[(-F.col(c)).alias(c) for c in COUNTS])


def merged_stats(parts: DataFrame) -> DataFrame:
    """``collection_stats`` from the parts alone, exact: documents whose chunks came and went are not counted. A document's parts are summed before all else, so
    no key is hot; a null document_id counts in the sums, not among the documents."""
    own = parts.groupBy("document_id").agg(*[F.sum(c).alias(c) for c in COUNTS])
    return own.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTS], F.count_if((F.col("total_chunks") > 0) & F.col("document_id").isNotNull()).alias("unique_documents"))


def compacted(parts: DataFrame, batch: int) -> DataFrame:
    """The same statistics in one part: a row for each document that is there. To be written elsewhere and swapped in."""
    own = parts.groupBy("document_id").agg(*[F.sum(c).alias(c) for c in COUNTS])
    return own.where("total_chunks <> 0").select(F.lit(batch).cast("long").alias("batch"), "document_id", *COUNTS)


def first_bbox(elements: str | Column) -> Column:
    """The box of the first element of a JSON list; null for malformed JSON, no element or no box."""
    parsed = F.from_json(F.col(elements) if isinstance(elements, str) else elements, "array<struct<bbox:array<double>>>")
    return F.try_element_at(parsed, F.lit(1))["bbox"]
