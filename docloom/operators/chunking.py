"""The contextual chunker: a fold over the elements of a page, in order, written with ``aggregate``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import strip
from docloom.operators.elements import heading, marker

#: A chunk of more characters than this is closed.
LIMIT = 1000
#: Order of kinds at the same height, as the reader meets them.
KINDS = {"text": 0, "equation": 1, "figure": 1, "table": 2}

_EL = "struct<type:string,content:string,bbox:array<double>>"
_CHUNK = f"struct<text:string,section:string,elements:array<{_EL}>,eq:boolean,tab:boolean,fig:boolean>"


def contextual_chunks(elements: DataFrame, limit: int = LIMIT) -> DataFrame:
    """document_id, page, seq, text, section, elements, has_equations, has_tables, has_figures from
    elements(document_id, page, kind, ordinal, x0, y0, x1, y1, content, font_size, font_flags[, caption, markdown]).

    Per page, by top edge, kind and ordinal: text is appended with a space behind. A title or header closes the chunk,
    which ends in its text but does not list it, and opens one that begins with it and lists it. Other kinds set their
    flag and leave a marker. A chunk of more than ``limit`` characters is closed. At the page's end a chunk that is not
    blank is emitted; chunks never cross pages. Texts are stripped at last; seq counts a page's chunks from 0; raw keeps
    the text before stripping.
    """
    extra = {c: F.col(c) if c in elements.columns else F.lit(None).cast("string") for c in ("caption", "markdown")}
    rank = F.create_map(*[F.lit(x) for p in KINDS.items() for x in p])
    item = F.struct(
        F.col("y0"), F.element_at(rank, F.col("kind")).alias("rank"), F.col("ordinal"), F.col("kind").alias("type"), F.col("content"), F.array("x0", "y0", "x1", "y1").alias("bbox"),
        F.when(F.col("kind") == "text", heading("font_size", "font_flags")).alias("head"), marker("kind", "page", extra["caption"], extra["markdown"]).alias("mark"),
    )
    pages = elements.groupBy("document_id", "page").agg(F.array_sort(F.collect_list(item)).alias("items"))

    def chunk(text, section, els, eq, tab, fig):
        return F.struct(text.alias("text"), section.alias("section"), els.alias("elements"), eq.alias("eq"), tab.alias("tab"), fig.alias("fig")).cast(_CHUNK)

    no = F.lit(False)
    none = F.array().cast(f"array<{_EL}>")
    empty = chunk(F.lit(""), F.lit("content"), none, no, no, no)
    start = F.struct(F.array().cast(f"array<{_CHUNK}>").alias("done"), empty.alias("cur"))

    def step(acc, e):
        cur, this = acc["cur"], F.array(F.struct(e["type"].alias("type"), e["content"].alias("content"), e["bbox"].alias("bbox")))
        is_text = e["type"] == "text"
        text = F.when(is_text, F.concat(cur["text"], e["content"], F.lit(" "))).otherwise(F.concat(cur["text"], e["mark"]))
        flag = lambda name, kind: cur[name] | (e["type"] == kind)
        grown = chunk(text, cur["section"], F.concat(cur["elements"], this), flag("eq", "equation"), flag("tab", "table"), flag("fig", "figure"))
        closed = chunk(text, cur["section"], cur["elements"], cur["eq"], cur["tab"], cur["fig"])
        opened = chunk(F.concat(e["content"], F.lit(" ")), e["head"], this, no, no, no)
        at_head = F.struct(F.concat(acc["done"], F.array(closed)).alias("done"), opened.alias("cur"))
        full = F.struct(F.concat(acc["done"], F.array(grown)).alias("done"), empty.alias("cur"))
        on = F.struct(acc["done"].alias("done"), grown.alias("cur"))
        return F.when(e["head"].isNotNull(), at_head).when(F.length(text) > limit, full).otherwise(on)

    def finish(acc):
        return F.when(strip(acc["cur"]["text"]) != "", F.concat(acc["done"], F.array(acc["cur"]))).otherwise(acc["done"])

    rows = pages.select("document_id", "page", F.posexplode(F.aggregate("items", start, step, finish)).alias("seq", "c"))
    return rows.select(
        "document_id", "page", "seq", strip("c.text").alias("text"), F.col("c.section").alias("section"), F.col("c.elements").alias("elements"),
        F.col("c.eq").alias("has_equations"), F.col("c.tab").alias("has_tables"), F.col("c.fig").alias("has_figures"), F.col("c.text").alias("raw"),
    )


def with_context(chunks: DataFrame) -> DataFrame:
    """Adds chunk_index (over the whole document, from 0), previous_context and next_context: 100 characters of the neighbours, across
    pages, null at the ends. The successor's are those before it is stripped, the predecessor's those after."""
    order = Window.partitionBy("document_id").orderBy("page", "seq")
    return chunks.select(
        *[c for c in chunks.columns if c != "raw"], (F.row_number().over(order) - 1).cast("int").alias("chunk_index"),
        F.substring(F.lag("text").over(order), 1, 100).alias("previous_context"), F.substring(F.lead("raw").over(order), 1, 100).alias("next_context"),
    )
