"""Layout elements: spans, headings, images, tables, captions and their markers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import strip


def spans(pages: DataFrame) -> DataFrame:
    """One row for each span of pages(document_id, page, blocks): block_no, line_no, span_no, text (stripped, of 2 characters at least),
    and the span's other fields. Blocks without lines (images) give nothing."""
    rows = pages.select("document_id", "page", F.posexplode("blocks").alias("block_no", "block")).where("block.lines IS NOT NULL")
    rows = rows.select("document_id", "page", "block_no", F.posexplode("block.lines").alias("line_no", "line"))
    rows = rows.select("document_id", "page", "block_no", "line_no", F.posexplode("line.spans").alias("span_no", "span"))
    rest = [f"span.{f.name}" for f in rows.schema["span"].dataType.fields if f.name != "text"]
    return rows.select("document_id", "page", "block_no", "line_no", "span_no", strip("span.text").alias("text"), *rest).where(F.length("text") >= 2)


def heading(size: str | Column, flags: str | Column) -> Column:
    """``title`` above 14 points, else ``header`` if bit 16 of the flags is set, else null."""
    size, flags = (F.col(x) if isinstance(x, str) else x for x in (size, flags))
    return F.when(size > 14, "title").when(flags.bitwiseAND(16) != 0, "header")


def image_kind(width: str | Column, height: str | Column, components: str | Column, alpha: str | Column) -> Column:
    """``equation`` for flat wide images (height under 100, aspect above 2), else ``figure``; null unless gray or RGB."""
    w, h, n, a = (F.col(x) if isinstance(x, str) else x for x in (width, height, components, alpha))
    aspect = F.when(h > 0, w / h).otherwise(1.0)
    return F.when(n - a < 4, F.when((h < 100) & (aspect > 2), "equation").otherwise("figure"))


def detect_tables(span_rows: DataFrame) -> DataFrame:
    """Blocks of spans(document_id, page, block_no, line_no, x0, y0, x1, y1) that look like tables, with their boxes.

    At least 3 lines; of each line the distinct left edges, rounded to tens half to even, are counted; at most two different counts occur
    and one is 2 or more.
    """
    block = ["document_id", "page", "block_no"]
    box = [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")]
    line = span_rows.withColumn("edge", F.bround("x0", -1)).groupBy(*block, "line_no", "edge").agg(*box)
    line = line.groupBy(*block, "line_no").agg(F.count(F.lit(1)).alias("columns"), *box)
    found = line.groupBy(*block).agg(F.count(F.lit(1)).alias("n_lines"), F.size(F.collect_set("columns")).alias("n_counts"), F.max("columns").alias("n_columns"), *box)
    return found.where("n_lines >= 3 AND n_counts <= 2 AND n_columns >= 2").drop("n_counts")


def table_markdown(headers: str | Column, rows: str | Column, empty: str = "| Empty Table |\n|-------------|\n") -> Column:
    """A Markdown table of array<string> headers and array<array<string>> rows; a fixed text if either is empty."""
    headers, rows = (F.col(x) if isinstance(x, str) else x for x in (headers, rows))
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | ", ""), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.transform(headers, lambda _: F.lit("---")), " | "), F.lit(" |"))
    body = F.concat_ws("\n", F.array(line(headers), rule), F.transform(rows, line))
    return F.when((F.coalesce(F.size(headers), F.lit(0)) < 1) | (F.coalesce(F.size(rows), F.lit(0)) < 1), empty).otherwise(body)


def figure_captions(page_lines: DataFrame) -> DataFrame:
    """One row for each page of page_lines(document_id, page, line_no, line): caption, shared by the page's figures.

    The first line with ``figure``, ``fig.`` or ``hình`` in any case, stripped; the next line follows after a space if it is longer than
    10 characters and does not begin in upper case; '' without such a line.
    """
    order = Window.partitionBy("document_id", "page").orderBy("line_no")
    low = F.lower("line")
    rows = page_lines.withColumn("text", strip("line")).withColumn("next", F.lead("text").over(order))
    hit = low.contains("figure") | low.contains("fig.") | low.contains("hình")
    goes_on = (F.length("next") > 10) & ~F.substring("next", 1, 1).rlike(r"\p{Lu}")
    caption = F.when(goes_on, F.concat("text", F.lit(" "), "next")).otherwise(F.col("text"))
    first = F.min(F.when(hit, F.struct("line_no", caption.alias("caption"))))
    return rows.groupBy("document_id", "page").agg(F.coalesce(first["caption"], F.lit("")).alias("caption"))


def marker(kind: str | Column, page: str | Column, caption: str | Column, markdown: str | Column) -> Column:
    """What an element leaves in a chunk's text: an equation's description and a table always, a figure's caption if it has one."""
    kind, page, caption, markdown = (F.col(x) if isinstance(x, str) else x for x in (kind, page, caption, markdown))
    return (
        F.when(kind == "equation", F.concat(F.lit(" [EQUATION: Mathematical equation on page "), page.cast("string"), F.lit("] ")))
        .when(kind == "table", F.concat(F.lit(" [TABLE: "), markdown, F.lit("] ")))
        .when((kind == "figure") & (F.coalesce(caption, F.lit("")) != ""), F.concat(F.lit(" [FIGURE: "), caption, F.lit("] ")))
        .otherwise("")
    )


def document_stats(element_rows: DataFrame) -> DataFrame:
    """Counts by kind and pages of each document."""
    count = lambda k: F.count_if(F.col("kind") == k)
    return element_rows.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("total_elements"), count("text").alias("text_elements"), count("equation").alias("equations"), count("table").alias("tables"),
        count("figure").alias("figures"), F.countDistinct("page").alias("pages_processed"),
    )
