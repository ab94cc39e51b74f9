"""Answers from retrieved chunks: context blocks, prompts, template answers, citations and their labels."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.operators.retrieval import dual_retrieval, rerank, surrounding_context
from docloom.session import ship

#: A generator maps frames (qid, prompt) to frames (qid, answer), with its service's settings; a null answer means that it has none.
Generator = Callable[[Iterator[pd.DataFrame], dict], Iterator[pd.DataFrame]]
GENERATORS: dict[str, Generator] = {}


def generator(name: str) -> Callable[[Generator], Generator]:
    return lambda f: GENERATORS.setdefault(name, f)


@generator("counting")
def _counting(frames: Iterator[pd.DataFrame], settings: dict) -> Iterator[pd.DataFrame]:
    """A deterministic stand-in: says how long the prompt is; has no answer to one without information."""
    for frame in frames:
        said = frame["prompt"].str.len().map(lambda n: f"The model was given {n} characters.")
        yield pd.DataFrame({"qid": frame["qid"], "answer": said.where(~frame["prompt"].str.contains(PROMPT_CONTEXT + PROMPT_END, regex=False), None)})

# Fixed texts.
CONTEXT_HEAD = "=== INFORMATION FROM PDF DOCUMENTS ==="
ANSWER_HEAD = "Based on available information, I will answer the question: '"
SOURCES_HEAD = "\n**Information from PDF documents:**"
CONCLUSION = "\n**Conclusion:** The above information provides an overview of your question. For more details, please refer to the cited sources."
APOLOGY = "\nSorry, I could not find relevant information to answer this question."
SOURCE_LINE = ("[PDF Source ", ", Page ", "]: ")  # before rank, page, text
BULLET = ("- Page ", ": ")  # before page, text
LABEL = ("Trang ", ": ")  # before page, text
MARKS = {"has_equations": "[Eq]", "has_tables": "[Table]", "has_figures": "[Fig]"}
PROMPT = (
    "\nYou are an intelligent AI assistant specialized in answering questions based on translated PDF documents.\n\nTASK:\n"
    "- Answer questions comprehensively and accurately\n- Base your answer on the PDF context provided\n- Answer in Vietnamese\n\nQUESTION: "
)
PROMPT_CONTEXT = "\n\nAVAILABLE INFORMATION:\n"
PROMPT_END = (
    "\n\nANSWER REQUIREMENTS:\nAnswer the question concisely, accurately, and completely. Provide only the final answer without dividing into "
    "multiple sections or detailed explanations.\n\nANSWER:\n"
)


def _joined(hits: DataFrame, n: int, line: Column) -> DataFrame:
    """qid and the array of lines of its first n hits, in rank order."""
    return hits.where(F.col("rank") <= n).groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]).alias("lines"))


def _page() -> Column:
    return F.coalesce(F.col("page").cast("string"), F.lit("N/A"))


def _source_line() -> Column:
    a, b, c = map(F.lit, SOURCE_LINE)
    return F.concat(a, F.col("rank").cast("string"), b, _page(), c, F.substring("text", 1, 300), F.lit("..."))


def _bullet() -> Column:
    a, b = map(F.lit, BULLET)
    return F.concat(a, _page(), b, F.substring("text", 1, 200), F.lit("..."))


def answer_context(hits: DataFrame, questions: DataFrame) -> DataFrame:
    """qid, context and prompt of every question: the first 3 sources, 300 characters each, under a head line; '' without sources."""
    line = _source_line()
    rows = questions.select("qid", "question").join(_joined(hits, 3, line), "qid", "left")
    rows = rows.withColumn("context", F.when(F.col("lines").isNull(), "").otherwise(F.concat_ws("\n", F.lit(CONTEXT_HEAD), "lines")))
    return rows.select("qid", "context", F.concat(F.lit(PROMPT), "question", F.lit(PROMPT_CONTEXT), "context", F.lit(PROMPT_END)).alias("prompt"))


def template_answer(hits: DataFrame, questions: DataFrame) -> DataFrame:
    """qid and answer without a model: the first 2 sources, 200 characters each, and a fixed end; an apology without sources."""
    line = _bullet()
    rows = questions.select("qid", "question").join(_joined(hits, 2, line), "qid", "left")
    head = F.concat(F.lit(ANSWER_HEAD), "question", F.lit("'"))
    found = F.concat_ws("\n", head, F.lit(SOURCES_HEAD), "lines", F.lit(CONCLUSION))
    return rows.select("qid", F.when(F.col("lines").isNull(), F.concat_ws("\n", head, F.lit(APOLOGY))).otherwise(found).alias("answer"))


def generated_answers(hits: DataFrame, questions: DataFrame, using: str = "counting", settings: dict | None = None) -> DataFrame:
    """qid, answer and source (model or template) of every question: what the generator makes of its prompt, or the template where it has none.

    Prompts go to the generator by Arrow batches, a task at a time; settings reach every task.
    """
    ship(hits.sparkSession)
    prompts, run, told = answer_context(hits, questions).select("qid", "prompt"), GENERATORS[using], dict(settings or {})
    made = prompts.mapInPandas(lambda frames: run(frames, told), f"qid {questions.schema['qid'].dataType.simpleString()}, answer string")
    rows = template_answer(hits, questions).withColumnRenamed("answer", "template").join(made, "qid", "left")
    return rows.select("qid", F.coalesce("answer", "template").alias("answer"), F.when(F.col("answer").isNull(), "template").otherwise("model").alias("source"))


def citations(hits: DataFrame) -> DataFrame:
    """One reference for each hit: 150 characters of text, confidence (its similarity, 0 for keyword-only hits), place and flags, box."""
    from docloom.operators.collection import first_bbox

    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    empty = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return hits.select(
        "qid", "rank", F.lit("pdf").alias("type"), F.coalesce("page", F.lit(0)).alias("page"), F.concat(F.substring(F.coalesce("text", F.lit("")), 1, 150), F.lit("...")).alias("text"),
        F.coalesce("similarity_score", F.lit(0.0)).alias("confidence"), empty("document_id"), empty("document_path"), empty("chunk_id"),
        flag("has_equations"), flag("has_tables"), flag("has_figures"), first_bbox("elements").alias("bbox"),
    )


def web_references(rows: DataFrame, *keys: str) -> DataFrame:
    """Web references, behind the columns keys, with defaults for what rows(url, title, snippet, source_type, reliability_score, scraped_at) lack."""
    default = {"url": "", "title": "", "snippet": "", "source_type": "web", "reliability_score": 0.5, "scraped_at": ""}
    return rows.select(*keys, *[(F.coalesce(F.col(c), F.lit(v)) if c in rows.columns else F.lit(v)).alias(c) for c, v in default.items()])


def percent(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c > 0, F.concat(F.lit("("), F.format_string("%.1f", F.bround(c * 100, 1)), F.lit("%)"))).otherwise("")


def citation_label(kind: str = "pdf") -> Column:
    """Display text of a row of citations (pdf) or web references (web)."""
    if kind == "web":
        return F.trim(F.concat(F.lit("["), F.initcap("source_type"), F.lit("] "), F.substring("snippet", 1, 100), F.lit("... "), percent("reliability_score")))
    marks = F.concat_ws(" ", *[F.when(F.col(c), name) for c, name in MARKS.items()])
    head = F.concat(F.lit(LABEL[0]), F.col("page").cast("string"), F.lit(LABEL[1]), F.substring("text", 1, 100), F.lit("..."))
    return F.trim(F.concat(head, F.lit(" "), marks, F.lit(" "), percent("confidence")))


def answer_metrics(hits: DataFrame, questions: DataFrame) -> DataFrame:
    """qid and the number of sources used, 0 without any."""
    n = hits.groupBy("qid").agg(F.count(F.lit(1)).alias("n"))
    return questions.select("qid").join(n, "qid", "left").select("qid", F.coalesce("n", F.lit(0)).cast("long").alias("total_sources"))


def retrieve(chunks: DataFrame, questions: DataFrame, k: int = 5) -> DataFrame:
    """Dual retrieval, neighbours' context and reranking: the k sources of each question."""
    hits = dual_retrieval(chunks, questions, k)
    return rerank(surrounding_context(hits, chunks, questions), questions, k)


def answer_questions(chunks: DataFrame, questions: DataFrame, k: int = 5) -> DataFrame:
    """Batch question answering: qid, answer (by template), total_sources, top_chunk, context of each question.

    A model takes the place of the template by mapping over ``answer_context``'s prompts.
    """
    hits = retrieve(chunks, questions, k)
    line3 = _source_line()
    line2 = _bullet()
    ordered = F.array_sort(F.collect_list(F.struct("rank", line3.alias("c"), line2.alias("a"), "chunk_id")))
    # One aggregation for all parts of the answer, so that retrieval runs once.
    rows = questions.select("qid", "question").join(hits.groupBy("qid").agg(ordered.alias("s")), "qid", "left")
    head = F.concat(F.lit(ANSWER_HEAD), "question", F.lit("'"))
    first = lambda n, f: F.transform(F.slice("s", 1, n), lambda x: x[f])
    found = F.concat_ws("\n", head, F.lit(SOURCES_HEAD), first(2, "a"), F.lit(CONCLUSION))
    none = F.col("s").isNull()
    return rows.select(
        "qid", F.when(none, F.concat_ws("\n", head, F.lit(APOLOGY))).otherwise(found).alias("answer"), F.when(none, 0).otherwise(F.size("s")).cast("long").alias("total_sources"),
        F.when(~none, F.get("s", F.lit(0))["chunk_id"]).alias("top_chunk"), F.when(none, "").otherwise(F.concat_ws("\n", F.lit(CONTEXT_HEAD), first(3, "c"))).alias("context"),
    )
