"""Queries over elements and the chunk collection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import chunking, collection, elements, progress
from docloom.plans.registry import query
from docloom.session import new_folder, written
from docloom.sources import tables as S


@query("content_hash", "SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_hash(spark: SparkSession, sf: str) -> DataFrame:
    return S.table(spark, sf, "documents").select("doc_id", T.content_hash("text").alias("content_hash"))


@query(
    "validate_documents",
    "SELECT file_id, CASE WHEN NOT present THEN 'missing' WHEN NOT ends_with(lower(path), '.pdf') THEN 'not_pdf' WHEN size_bytes > 52428800 THEN 'too_large' WHEN page_count IS NULL THEN 'unreadable' "
    "WHEN page_count = 0 THEN 'no_pages' WHEN page_count > 50 THEN 'too_many_pages' END AS reason FROM files",
    ("files",),
)
def validate_documents(spark: SparkSession, sf: str) -> DataFrame:
    return progress.validate_files(S.files(spark, sf)).select("file_id", "reason")


@query("spans", "SELECT document_id, page, CAST(ordinal % 8 AS INTEGER) AS line_no, regexp_replace(content, '^\\s+|\\s+$', '', 'g') AS text FROM elements WHERE length(regexp_replace(content, '^\\s+|\\s+$', '', 'g')) >= 2", ("elements",))
def spans(spark: SparkSession, sf: str) -> DataFrame:
    return elements.spans(S.spans_input(spark, sf)).select("document_id", "page", "line_no", "text")


@query("classify_headings", "SELECT document_id, ordinal, head AS heading FROM elements", ("elements",))
def classify_headings(spark: SparkSession, sf: str) -> DataFrame:
    return S.elements(spark, sf).select("document_id", "ordinal", elements.heading("font_size", "font_flags").alias("heading"))


@query(
    "classify_images",
    "SELECT document_id, k, CASE WHEN n - a < 4 THEN CASE WHEN h < 100 AND (CASE WHEN h > 0 THEN w / h ELSE 1.0 END) > 2 THEN 'equation' ELSE 'figure' END END AS image_kind FROM ("
    "SELECT document_id, k, CAST(20 + length(line) % 400 AS DOUBLE) AS w, CAST(k * 37 % 200 AS DOUBLE) AS h, 1 + k % 5 AS n, k % 2 AS a FROM lines)",
    ("lines",),
)
def classify_images(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("line_no")
    rows = S.lines(spark, sf).select(
        "document_id", k.alias("k"), (20 + F.length("line") % 400).cast("double").alias("w"), (k * 37 % 200).cast("double").alias("h"), (1 + k % 5).alias("n"), (k % 2).alias("a")
    )
    return rows.select("document_id", "k", elements.image_kind("w", "h", "n", "a").alias("image_kind"))


@query(
    "detect_tables",
    "WITH s AS (SELECT document_id, k // 8 AS page, k % 8 AS line_no, unnest(range(1 + (length(line) % 3))) AS span_no, length(line) AS n FROM lines), "
    "p AS (SELECT document_id, page, line_no, CAST(40 + 25 * span_no + n % 5 AS DOUBLE) AS x0, CAST(40 + 14 * line_no AS DOUBLE) AS y0, CAST(60 + 25 * span_no AS DOUBLE) AS x1, CAST(52 + 14 * line_no AS DOUBLE) AS y1 FROM s), "
    "l AS (SELECT document_id, page, line_no, count(DISTINCT round_even(x0 / 10, 0)) AS columns, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM p GROUP BY ALL) "
    "SELECT document_id, page, CAST(count(*) AS BIGINT) AS n_lines, CAST(max(columns) AS BIGINT) AS n_columns, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM l GROUP BY document_id, page "
    "HAVING count(*) >= 3 AND count(DISTINCT columns) <= 2 AND max(columns) >= 2",
    ("lines",),
)
def detect_tables(spark: SparkSession, sf: str) -> DataFrame:
    k, n = F.col("line_no"), F.length("line")
    rows = S.lines(spark, sf).select("document_id", F.floor(k / 8).cast("int").alias("page"), (k % 8).alias("l"), n.alias("n"), F.explode(F.sequence(F.lit(0), n % 3)).alias("s"))
    rows = rows.select(
        "document_id", "page", F.lit(0).alias("block_no"), F.col("l").alias("line_no"), (40 + 25 * F.col("s") + F.col("n") % 5).cast("double").alias("x0"), (40 + 14 * F.col("l")).cast("double").alias("y0"),
        (60 + 25 * F.col("s")).cast("double").alias("x1"), (52 + 14 * F.col("l")).cast("double").alias("y1"),
    )
    return elements.detect_tables(rows).drop("block_no")


_CELLS = "list_transform(string_split(line, '|'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g'))"


@query(
    "table_markdown",
    f"WITH r AS (SELECT document_id, k, {_CELLS} AS cells, row_number() OVER (PARTITION BY document_id ORDER BY k) AS n FROM lines WHERE contains(line, '|')), "
    "t AS (SELECT document_id, '| ' || array_to_string(cells, ' | ') || ' |' AS row, '| ' || array_to_string(list_transform(cells, lambda x: '---'), ' | ') || ' |' AS rule, n FROM r) "
    "SELECT document_id, CASE WHEN count(*) < 2 THEN '| Empty Table |' || chr(10) || '|-------------|' || chr(10) ELSE arg_min(row, n) || chr(10) || arg_min(rule, n) || chr(10) || string_agg(row, chr(10) ORDER BY n) FILTER (n > 1) END AS markdown "
    "FROM t GROUP BY document_id",
    ("lines",),
)
def table_markdown(spark: SparkSession, sf: str) -> DataFrame:
    """Lines with bars as tables: a document's first such line is the header."""
    rows = S.lines(spark, sf).where("line LIKE '%|%'").select("document_id", "line_no", F.transform(F.split("line", r"\|"), T.strip).alias("cells"))
    rows = rows.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "cells"))).alias("t"))
    cells = F.transform("t", lambda x: x["cells"])
    return rows.select("document_id", elements.table_markdown(F.get(cells, F.lit(0)), F.slice(cells, F.lit(2), F.greatest(F.size(cells) - 1, F.lit(0)))).alias("markdown"))


@query(
    "figure_captions",
    "WITH l AS (SELECT document_id, k // 8 AS page, k AS line_no, CASE WHEN k % 6 = 4 THEN 'Figure ' || k || ': ' || line ELSE line END AS line FROM lines), "
    "t AS (SELECT *, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS text FROM l), n AS (SELECT *, lead(text) OVER (PARTITION BY document_id, page ORDER BY line_no) AS nxt FROM t), "
    "h AS (SELECT document_id, page, line_no, CASE WHEN length(nxt) > 10 AND NOT regexp_matches(substr(nxt, 1, 1), '\\p{Lu}') THEN text || ' ' || nxt ELSE text END AS caption FROM n "
    "WHERE contains(lower(line), 'figure') OR contains(lower(line), 'fig.') OR contains(lower(line), 'hình')), f AS (SELECT document_id, page, arg_min(caption, line_no) AS caption FROM h GROUP BY ALL) "
    "SELECT p.document_id, p.page, coalesce(caption, '') AS caption FROM (SELECT DISTINCT document_id, page FROM l) p LEFT JOIN f USING (document_id, page)",
    ("lines",),
)
def figure_captions(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("line_no")
    rows = S.lines(spark, sf).withColumns({"page": F.floor(k / 8).cast("int"), "line": F.when(k % 6 == 4, F.concat(F.lit("Figure "), k.cast("string"), F.lit(": "), "line")).otherwise(F.col("line"))})
    return elements.figure_captions(rows)


#: The chunker as a recursion over a page's elements: a row for each step, with what it has closed.
CHUNKER = (
    "RECURSIVE e AS (SELECT document_id, page, content, head, row_number() OVER (PARTITION BY document_id, page ORDER BY y0, ordinal) AS n, count(*) OVER (PARTITION BY document_id, page) AS m FROM elements), "
    "f AS (SELECT document_id, page, CAST(0 AS BIGINT) AS n, '' AS cur, 'content' AS section, 0 AS els, CAST(NULL AS VARCHAR) AS out_text, '' AS out_section, 0 AS out_els FROM e WHERE n = 1 "
    "UNION ALL SELECT f.document_id, f.page, e.n, CASE WHEN e.head IS NOT NULL THEN e.content || ' ' WHEN length(f.cur) + length(e.content) + 1 > 1000 THEN '' ELSE f.cur || e.content || ' ' END, "
    "CASE WHEN e.head IS NOT NULL THEN e.head WHEN length(f.cur) + length(e.content) + 1 > 1000 THEN 'content' ELSE f.section END, "
    "CASE WHEN e.head IS NOT NULL THEN 1 WHEN length(f.cur) + length(e.content) + 1 > 1000 THEN 0 ELSE f.els + 1 END, "
    "CASE WHEN e.head IS NOT NULL OR length(f.cur) + length(e.content) + 1 > 1000 THEN f.cur || e.content || ' ' END, f.section, CASE WHEN e.head IS NOT NULL THEN f.els ELSE f.els + 1 END "
    "FROM f JOIN e ON e.document_id = f.document_id AND e.page = f.page AND e.n = f.n + 1), "
    "raw AS (SELECT document_id, page, n AS pos, out_text AS raw, out_section AS section, out_els AS els FROM f WHERE out_text IS NOT NULL "
    "UNION ALL SELECT f.document_id, f.page, f.n + 1, f.cur, f.section, f.els FROM f JOIN (SELECT DISTINCT document_id, page, m FROM e) c ON c.document_id = f.document_id AND c.page = f.page AND f.n = c.m "
    "WHERE regexp_replace(f.cur, '^\\s+|\\s+$', '', 'g') <> ''), "
    "made AS (SELECT document_id, page, CAST(row_number() OVER (PARTITION BY document_id, page ORDER BY pos) - 1 AS INTEGER) AS seq, raw, regexp_replace(raw, '^\\s+|\\s+$', '', 'g') AS text, section, els FROM raw), "
    "ctx AS (SELECT *, CAST(row_number() OVER o - 1 AS INTEGER) AS chunk_index, substr(lag(text) OVER o, 1, 100) AS previous_context, substr(lead(raw) OVER o, 1, 100) AS next_context FROM made "
    "WINDOW o AS (PARTITION BY document_id ORDER BY page, seq)) "
)
WITH_CHUNKER = "WITH " + CHUNKER


def _recursive(sql: str) -> str:
    """The RECURSIVE keyword stands behind the first WITH of the whole statement."""
    return sql.replace("WITH ", "WITH RECURSIVE ", 1).replace(", RECURSIVE ", ", ", 1)


def made_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.with_context(chunking.contextual_chunks(S.elements(spark, sf)))


@query("contextual_chunks", WITH_CHUNKER + "SELECT document_id, page, seq, text, section, CAST(els AS INTEGER) AS elements_count FROM made", ("elements",))
def contextual_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.contextual_chunks(S.elements(spark, sf)).select("document_id", "page", "seq", "text", "section", F.size("elements").alias("elements_count"))


#: Lines as elements of all kinds, two at each height; figures of every second have no caption.
_MIXED = (
    "mixed AS (SELECT document_id, k // 8 AS page, k AS ordinal, 40 + 14 * (k % 8 // 2) AS y0, CASE WHEN k % 7 = 3 THEN 'equation' WHEN k % 7 = 5 THEN 'table' WHEN k % 11 = 4 THEN 'figure' ELSE 'text' END AS kind, "
    "CASE WHEN k % 8 = 0 THEN 'title' WHEN k % 5 = 0 THEN 'header' END AS head, line, k FROM lines), "
    "piece AS (SELECT document_id, page, kind, CASE WHEN kind = 'text' THEN head END AS head, CASE kind WHEN 'text' THEN line || ' ' WHEN 'equation' THEN ' [EQUATION: Mathematical equation on page ' || page || '] ' "
    "WHEN 'table' THEN ' [TABLE: | ' || substr(line, 1, 20) || ' |] ' ELSE CASE WHEN k % 2 = 0 AND substr(line, 1, 30) <> '' THEN ' [FIGURE: ' || substr(line, 1, 30) || '] ' ELSE '' END END AS piece, "
    "row_number() OVER (PARTITION BY document_id, page ORDER BY y0, CASE kind WHEN 'text' THEN 0 WHEN 'table' THEN 2 ELSE 1 END, ordinal) AS n, count(*) OVER (PARTITION BY document_id, page) AS m FROM mixed)"
)
_FOLD = (
    "RECURSIVE {mixed}, f AS (SELECT document_id, page, CAST(0 AS BIGINT) AS n, '' AS cur, 'content' AS section, 0 AS els, false AS eq, false AS tab, false AS fig, CAST(NULL AS VARCHAR) AS o_text, '' AS o_section, 0 AS o_els, false AS o_eq, false AS o_tab, false AS o_fig FROM piece WHERE n = 1 "
    "UNION ALL SELECT f.document_id, f.page, e.n, CASE WHEN e.head IS NOT NULL THEN e.piece WHEN {full} THEN '' ELSE f.cur || e.piece END, CASE WHEN e.head IS NOT NULL THEN e.head WHEN {full} THEN 'content' ELSE f.section END, "
    "CASE WHEN e.head IS NOT NULL THEN 1 WHEN {full} THEN 0 ELSE f.els + 1 END, {keep} AND (f.eq OR e.kind = 'equation'), {keep} AND (f.tab OR e.kind = 'table'), {keep} AND (f.fig OR e.kind = 'figure'), "
    "CASE WHEN e.head IS NOT NULL OR {full} THEN f.cur || e.piece END, f.section, CASE WHEN e.head IS NOT NULL THEN f.els ELSE f.els + 1 END, f.eq OR e.kind = 'equation', f.tab OR e.kind = 'table', f.fig OR e.kind = 'figure' "
    "FROM f JOIN piece e ON e.document_id = f.document_id AND e.page = f.page AND e.n = f.n + 1), "
    "raw AS (SELECT document_id, page, n AS pos, o_text AS raw, o_section AS section, o_els AS els, o_eq AS eq, o_tab AS tab, o_fig AS fig FROM f WHERE o_text IS NOT NULL "
    "UNION ALL SELECT f.document_id, f.page, f.n + 1, f.cur, f.section, f.els, f.eq, f.tab, f.fig FROM f JOIN (SELECT DISTINCT document_id, page, m FROM piece) c ON c.document_id = f.document_id AND c.page = f.page AND f.n = c.m "
    "WHERE regexp_replace(f.cur, '^\\s+|\\s+$', '', 'g') <> '') "
    "SELECT document_id, page, CAST(row_number() OVER (PARTITION BY document_id, page ORDER BY pos) - 1 AS INTEGER) AS seq, regexp_replace(raw, '^\\s+|\\s+$', '', 'g') AS text, section, CAST(els AS INTEGER) AS elements_count, eq AS has_equations, tab AS has_tables, fig AS has_figures FROM raw"
)
_FULL = "length(f.cur) + length(e.piece) > 1000"


@query("contextual_chunks_mixed", "WITH " + _FOLD.format(mixed=_MIXED, full=_FULL, keep=f"NOT (e.head IS NOT NULL OR {_FULL})"), ("lines",))
def contextual_chunks_mixed(spark: SparkSession, sf: str) -> DataFrame:
    """Text among equations, tables and figures, with their markers, in the order of height, kind and place."""
    k = F.col("ordinal")
    kind = F.when(k % 7 == 3, "equation").when(k % 7 == 5, "table").when(k % 11 == 4, "figure").otherwise("text")
    rows = S.elements(spark, sf).withColumns({
        "kind": kind, "y0": (40 + 14 * F.floor(k % 8 / 2)).cast("double"), "markdown": F.concat(F.lit("| "), F.substring("content", 1, 20), F.lit(" |")), "caption": F.when(k % 2 == 0, F.substring("content", 1, 30)),
    })
    return chunking.contextual_chunks(rows).select("document_id", "page", "seq", "text", "section", F.size("elements").alias("elements_count"), "has_equations", "has_tables", "has_figures")


@query("chunk_context", WITH_CHUNKER + "SELECT document_id, page, chunk_index, previous_context, next_context FROM ctx", ("elements",))
def chunk_context(spark: SparkSession, sf: str) -> DataFrame:
    return made_chunks(spark, sf).select("document_id", "page", "chunk_index", "previous_context", "next_context")


@query(
    "chunk_records",
    WITH_CHUNKER + "SELECT document_id || '_chunk_' || chunk_index AS chunk_id, '/corpus/' || document_id || '.pdf' AS document_path, page, section AS chunk_type, CAST(length(text) AS INTEGER) AS text_length, "
    "CAST(els AS INTEGER) AS elements_count, sha256(text) AS text_hash FROM ctx",
    ("elements",),
)
def chunk_records(spark: SparkSession, sf: str) -> DataFrame:
    rows = collection.chunk_records(made_chunks(spark, sf), F.concat(F.lit("/corpus/"), "document_id", F.lit(".pdf")))
    return rows.select("chunk_id", "document_path", "page", "chunk_type", "text_length", "elements_count", F.sha2("text", 256).alias("text_hash"))


@query(
    "document_stats",
    "SELECT document_id, count(*) AS total_elements, count(*) FILTER (kind = 'text') AS text_elements, count(*) FILTER (kind = 'equation') AS equations, count(*) FILTER (kind = 'table') AS tables, "
    "count(*) FILTER (kind = 'figure') AS figures, count(DISTINCT page) AS pages_processed FROM (SELECT document_id, k // 8 AS page, CASE k % 7 WHEN 3 THEN 'equation' WHEN 5 THEN 'table' WHEN 6 THEN 'figure' ELSE 'text' END AS kind FROM lines) GROUP BY document_id",
    ("lines",),
)
def document_stats(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("ordinal") % 7
    return elements.document_stats(S.elements(spark, sf).withColumn("kind", F.when(k == 3, "equation").when(k == 5, "table").when(k == 6, "figure").otherwise("text")))


@query("translatable_lines", "SELECT document_id, k AS line_no, line FROM lines WHERE length(line) >= 5", ("lines",))
def translatable_lines(spark: SparkSession, sf: str) -> DataFrame:
    return S.lines(spark, sf).where(F.length("line") >= 5).select("document_id", "line_no", "line")


@query(
    "index_new_documents",
    "WITH stored AS (SELECT document_id, count(*) AS n FROM chunks WHERE CAST(document_id AS BIGINT) % 3 = 0 AND k % 2 = 0 GROUP BY document_id), incoming AS (SELECT document_id, count(*) AS n FROM chunks GROUP BY document_id) "
    "SELECT i.document_id, coalesce(s.n, i.n) AS n_chunks, s.n IS NOT NULL AS cached FROM incoming i LEFT JOIN stored s USING (document_id)",
    ("chunks",),
)
def index_new_documents(spark: SparkSession, sf: str) -> DataFrame:
    incoming = S.chunks(spark, sf)
    stored = incoming.where("CAST(document_id AS BIGINT) % 3 = 0 AND chunk_index % 2 = 0")
    return collection.index_new(incoming, stored)[1]


@query("document_chunks", "SELECT document_id, chunk_id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY chunk_index, chunk_id) AS INTEGER) AS position FROM chunks", ("chunks",))
def document_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return collection.document_chunks(S.chunks(spark, sf)).select("document_id", "chunk_id", "position")


@query(
    "page_range_chunks",
    "SELECT document_id, chunk_id, position, similarity FROM (SELECT document_id, chunk_id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY page, chunk_index, chunk_id) AS INTEGER) AS position, CAST(1 AS DOUBLE) AS similarity "
    "FROM chunks WHERE page BETWEEN 1 AND 3) WHERE position <= 10",
    ("chunks",),
)
def page_range_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return collection.page_range_chunks(S.chunks(spark, sf), 1, 3, 10).select("document_id", "chunk_id", "position", "similarity")


@query("delete_document", "SELECT chunk_id FROM chunks WHERE CAST(document_id AS BIGINT) % 10 <> 3", ("chunks",))
def delete_document(spark: SparkSession, sf: str) -> DataFrame:
    gone = S.table(spark, sf, "documents").where("doc_id % 10 = 3").select(F.col("doc_id").cast("string").alias("document_id"))
    return collection.delete_documents(S.chunks(spark, sf), gone).select("chunk_id")


@query(
    "collection_stats",
    "SELECT count(*) AS total_chunks, count(DISTINCT document_id) AS unique_documents, count(*) FILTER (has_equations) AS chunks_with_equations, count(*) FILTER (has_tables) AS chunks_with_tables, count(*) FILTER (has_figures) AS chunks_with_figures FROM chunks",
    ("chunks",),
)
def collection_stats(spark: SparkSession, sf: str) -> DataFrame:
    return collection.collection_stats(S.chunks(spark, sf))


_PARTS = 8


@query(
    "collection_stats_kept",
    "SELECT count(*) AS total_chunks, count(DISTINCT document_id) AS unique_documents, count(*) FILTER (has_equations) AS chunks_with_equations, count(*) FILTER (has_tables) AS chunks_with_tables, count(*) FILTER (has_figures) AS chunks_with_figures "
    "FROM chunks WHERE CAST(document_id AS BIGINT) % 10 <> 3",
    ("chunks",),
)
def collection_stats_kept(spark: SparkSession, sf: str) -> DataFrame:
    """All chunks, come in batches; then documents go; the statistics from what was kept of both."""
    path, chunks = new_folder(spark, "stats"), S.chunks(spark, sf).withColumn("batch", F.pmod(F.col("chunk_index"), F.lit(_PARTS)))
    chunks = written(chunks.select("document_id", "batch", "has_equations", "has_tables", "has_figures"), "arrived")
    for n in range(_PARTS):
        collection.add_part(collection.stats_part(chunks.where(F.col("batch") == n), n), path, n)
    gone = S.table(spark, sf, "documents").where("doc_id % 10 = 3").select(F.col("doc_id").cast("string").alias("document_id"))
    collection.add_part(collection.retracted(spark.read.parquet(path), gone, _PARTS), path, _PARTS)
    return collection.merged_stats(spark.read.parquet(path))


@query(
    "first_bbox",
    "SELECT chunk_id, CASE WHEN k % 11 <> 5 THEN 40.0::DOUBLE END AS x0, CASE WHEN k % 11 <> 5 THEN CAST(40 + 14 * (k % 8) AS DOUBLE) END AS y0, CASE WHEN k % 11 <> 5 THEN 550.0::DOUBLE END AS x1, "
    "CASE WHEN k % 11 <> 5 THEN CAST(52 + 14 * (k % 8) AS DOUBLE) END AS y1 FROM chunks",
    ("chunks",),
)
def first_bbox(spark: SparkSession, sf: str) -> DataFrame:
    box = S.chunks(spark, sf).select("chunk_id", collection.first_bbox("elements").alias("bbox"))
    return box.select("chunk_id", *[F.get("bbox", F.lit(i)).alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))])


def _fix_recursive() -> None:
    from docloom.plans.registry import ORACLES

    for name in ("contextual_chunks", "contextual_chunks_mixed", "chunk_context", "chunk_records"):
        ORACLES[name] = _recursive(ORACLES[name])


_fix_recursive()
