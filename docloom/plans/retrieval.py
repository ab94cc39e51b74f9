"""Queries of the retrieval pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import ann, answers, learned, postings, retrieval
from docloom.plans.registry import query
from docloom.session import new_folder, spread, written
from docloom.sources import tables as S

_BUCKETS = "v % 64 AS b, sum(CASE WHEN v // 64 % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) AS s"
_SPLIT = "list_filter(string_split_regex(lower({0}), '\\s+'), lambda w: w <> '')"
_HASH = "CAST('0x' || substr(md5(w), 1, 8) AS BIGINT)"


def scores(asked: str) -> str:
    """Common table expressions from asked(qid, list_no, question, document_id): pair(qid, list_no, chunk_id, sim, kw)."""
    return (
        f"asked AS ({asked}), cw AS (SELECT chunk_id, unnest({_SPLIT.format('text')}) AS w FROM chunks), cb AS (SELECT chunk_id, {_BUCKETS} FROM (SELECT chunk_id, {_HASH} AS v FROM cw) GROUP BY ALL), "
        "cn AS (SELECT chunk_id, sqrt(sum(s * s)) AS n FROM cb GROUP BY chunk_id), "
        f"qw AS (SELECT qid, list_no, unnest({_SPLIT.format('question')}) AS w FROM asked), qb AS (SELECT qid, list_no, {_BUCKETS} FROM (SELECT qid, list_no, {_HASH} AS v FROM qw) GROUP BY ALL), "
        "qn AS (SELECT qid, list_no, sqrt(sum(s * s)) AS n FROM qb GROUP BY ALL), "
        "dots AS (SELECT qid, list_no, chunk_id, sum(qb.s * cb.s) AS d FROM qb JOIN cb USING (b) GROUP BY ALL), "
        "sims AS (SELECT qid, list_no, chunk_id, round(d / (qn.n * cn.n), 6) AS sim FROM dots JOIN qn USING (qid, list_no) JOIN cn USING (chunk_id) WHERE qn.n > 0 AND cn.n > 0), "
        "qm AS (SELECT qid, list_no, w, count(*) AS m FROM qw GROUP BY ALL), qs AS (SELECT qid, list_no, count(*) AS n FROM qw GROUP BY ALL), "
        "low AS (SELECT chunk_id, lower(text) AS t FROM chunks), seen AS (SELECT chunk_id, w FROM low JOIN (SELECT DISTINCT w FROM qw) ON contains(t, w)), "
        "kws AS (SELECT qid, list_no, chunk_id, round(sum(m) / any_value(n), 6) AS kw FROM seen JOIN qm USING (w) JOIN qs USING (qid, list_no) GROUP BY qid, list_no, chunk_id), "
        "pair AS (SELECT a.qid, a.list_no, c.chunk_id, coalesce(sim, 0.0::DOUBLE) AS sim, coalesce(kw, 0.0::DOUBLE) AS kw FROM asked a JOIN chunks c ON a.document_id IS NULL OR a.document_id = c.document_id "
        "LEFT JOIN sims s ON s.qid = a.qid AND s.list_no = a.list_no AND s.chunk_id = c.chunk_id LEFT JOIN kws k ON k.qid = a.qid AND k.list_no = a.list_no AND k.chunk_id = c.chunk_id)"
    )


def hybrid(n: int) -> str:
    return (
        f"near AS (SELECT *, row_number() OVER (PARTITION BY qid, list_no ORDER BY sim DESC, chunk_id) <= {2 * n} AS is_near FROM pair), "
        "fin AS (SELECT qid, list_no, chunk_id, CASE WHEN is_near THEN sim ELSE 0.0 END AS similarity_score, kw AS keyword_score, "
        "round(alpha * (CASE WHEN is_near THEN sim ELSE 0.0 END) + (1 - alpha) * kw, 9) AS final_score FROM near JOIN (SELECT qid, list_no, alpha FROM asked) USING (qid, list_no) WHERE is_near OR kw > 0), "
        f"hyb AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid, list_no ORDER BY final_score DESC, chunk_id) AS INTEGER) AS rank FROM fin) WHERE rank <= {n})"
    )


ONE = "SELECT qid, CAST(1 AS INTEGER) AS list_no, question, document_id, CAST(0.7 AS DOUBLE) AS alpha FROM questions"
TWO = (
    "SELECT qid, CAST(1 AS INTEGER) AS list_no, question, document_id, CAST(0.5 AS DOUBLE) AS alpha FROM questions "
    "UNION ALL SELECT qid, 2, coalesce(hypothetical_answer, question), document_id, 0.7 FROM questions"
)
K = 5
MERGED = (
    "one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, chunk_id ORDER BY list_no) AS f FROM hyb) WHERE f = 1), "
    f"merged AS (SELECT * FROM (SELECT qid, list_no, chunk_id, similarity_score, keyword_score, final_score, CAST(row_number() OVER (PARTITION BY qid ORDER BY final_score DESC, chunk_id) AS INTEGER) AS rank FROM one) WHERE rank <= {2 * K})"
)
CONTEXT = (
    "near_text AS (SELECT a.chunk_id, string_agg(b.text, chr(10) ORDER BY b.chunk_index) FILTER (b.chunk_index < a.chunk_index) AS before, string_agg(b.text, chr(10) ORDER BY b.chunk_index) FILTER (b.chunk_index > a.chunk_index) AS after "
    "FROM chunks a JOIN chunks b ON a.document_id = b.document_id AND a.page = b.page AND abs(a.chunk_index - b.chunk_index) = 1 GROUP BY a.chunk_id), "
    "ctx AS (SELECT m.*, q.question, c.document_id, c.document_path, c.chunk_index, c.page, c.chunk_type, c.has_equations, c.has_tables, c.has_figures, c.text AS original_text, "
    "CASE WHEN q.document_id IS NULL THEN c.text ELSE coalesce('...' || chr(10) || before || chr(10), '') || c.text || coalesce(chr(10) || after || chr(10) || '...', '') END AS text "
    "FROM merged m JOIN questions q USING (qid) JOIN chunks c USING (chunk_id) LEFT JOIN near_text USING (chunk_id))"
)
_ABOUT = " OR ".join(f"contains(lower(question), '{w}')" for words in retrieval.METADATA_WORDS.values() for w in words)
RERANKED = (
    f"sig AS (SELECT *, ({_ABOUT}) AS about, list_distinct({_SPLIT.format('question')}) AS qws, list_distinct({_SPLIT.format('original_text')}) AS tws, 1 / (1 + 0.1::DOUBLE * page) AS s_page, 1 / (1 + 0.05::DOUBLE * chunk_index) AS s_index, "
    "least(length(text) / 500.0::DOUBLE, 1.0) AS s_len FROM ctx), "
    "sc AS (SELECT * EXCLUDE (final_score, rank), round(CASE WHEN about THEN 0.15::DOUBLE * final_score + 0.05::DOUBLE * (len(list_intersect(qws, tws)) / greatest(len(qws), 1)) + 0.2::DOUBLE * s_page + 0.2::DOUBLE * s_index + 0.1::DOUBLE * s_len + "
    "0.3::DOUBLE * (CASE chunk_type WHEN 'title' THEN 1.0 WHEN 'header' THEN 0.8 WHEN 'abstract' THEN 0.9 ELSE 0.0 END) ELSE 0.4::DOUBLE * final_score + 0.3::DOUBLE * (len(list_intersect(qws, tws)) / greatest(len(qws), 1)) + 0.15::DOUBLE * s_page + "
    "0.05::DOUBLE * s_index + 0.05::DOUBLE * s_len + 0.05::DOUBLE * (CASE chunk_type WHEN 'content' THEN 0.3 ELSE 0.0 END) END, 6) AS final_score FROM sig), "
    f"hits AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY final_score DESC, chunk_id) AS INTEGER) AS rank FROM sc) WHERE rank <= {K})"
)
ALL = f"WITH {scores(TWO)}, {hybrid(2 * K)}, {MERGED}, {CONTEXT}, {RERANKED} "


def _hits(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    questions = S.questions(spark, sf)
    return answers.retrieve(S.chunks(spark, sf), questions, K), questions


@query(
    "hash_embed",
    f"WITH cw AS (SELECT chunk_id, unnest({_SPLIT.format('text')}) AS w FROM chunks), cb AS (SELECT chunk_id, {_BUCKETS} FROM (SELECT chunk_id, {_HASH} AS v FROM cw) GROUP BY ALL), "
    "cn AS (SELECT chunk_id, sqrt(sum(s * s)) AS n FROM cb GROUP BY chunk_id) SELECT chunk_id, CAST(b AS INTEGER) AS bucket, round(s / n, 6) AS weight FROM cb JOIN cn USING (chunk_id) WHERE s <> 0",
    ("chunks",),
)
def hash_embed(spark: SparkSession, sf: str) -> DataFrame:
    rows = S.chunks(spark, sf).select("chunk_id", F.posexplode(retrieval.hash_embed("text")).alias("bucket", "weight"))
    return rows.where("weight <> 0").select("chunk_id", "bucket", F.round("weight", 6).alias("weight"))


@query("semantic_topk", f"WITH {scores(ONE)} SELECT qid, chunk_id, sim AS similarity, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY sim DESC, chunk_id) AS INTEGER) AS rank FROM pair) WHERE rank <= 10", ("chunks", "questions"))
def semantic_topk(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.semantic_topk(S.chunks(spark, sf), S.questions(spark, sf))


def _indexed(spark: SparkSession, sf: str) -> tuple[str, DataFrame]:
    """(a new index of all chunks' vectors, the questions with theirs)."""
    path = new_folder(spark, "ann")
    vectors = written(spread(S.chunks(spark, sf).select("chunk_id", "document_id", "text")).select("chunk_id", "document_id", retrieval.hash_embed("text").alias("embedding")), "vectors")
    ann.build(vectors, path)
    return path, S.questions(spark, sf).select("qid", "document_id", retrieval.hash_embed("question").alias("vector"))


@query("ann_topk")
def ann_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The nearest chunks by way of the index; ann_recall measures them."""
    path, asked = _indexed(spark, sf)
    return ann.search(spark, path, asked)


@query("ann_recall")
def ann_recall(spark: SparkSession, sf: str) -> DataFrame:
    """Recall of ann_topk against semantic_topk, question by question."""
    path, asked = _indexed(spark, sf)
    exact = retrieval.semantic_topk(S.chunks(spark, sf), S.questions(spark, sf))
    return ann.recall(ann.search(spark, path, asked), exact)


@query(
    "ann_rerank",
    f"WITH {scores(ONE)} SELECT qid, chunk_id, sim AS similarity, CAST(row_number() OVER (PARTITION BY qid ORDER BY sim DESC, chunk_id) AS INTEGER) AS rank "
    "FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY kw DESC, chunk_id) AS r FROM pair WHERE kw > 0) WHERE r <= 30 QUALIFY rank <= 10",
    ("chunks", "questions"),
)
def ann_rerank(spark: SparkSession, sf: str) -> DataFrame:
    """The thirty best chunks of each question by keywords, in the order of their exact similarity."""
    chunks, questions = S.chunks(spark, sf), S.questions(spark, sf)
    found = retrieval.keyword_topk(chunks, questions, 30)
    vectors = chunks.join(found.select("chunk_id").distinct(), "chunk_id", "left_semi").select("chunk_id", retrieval.hash_embed("text").alias("embedding"))
    return ann.rerank_exact(found, vectors, questions.select("qid", retrieval.hash_embed("question").alias("vector")), 10)


_KEYWORD = f"WITH {scores(ONE)} SELECT qid, chunk_id, kw AS keyword_score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY kw DESC, chunk_id) AS INTEGER) AS rank FROM pair WHERE kw > 0) WHERE rank <= 10"


@query("keyword_scores", _KEYWORD, ("chunks", "questions"))
def keyword_scores(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.keyword_topk(S.chunks(spark, sf), S.questions(spark, sf))


@query("keyword_indexed", _KEYWORD, ("chunks", "questions"))
def keyword_indexed(spark: SparkSession, sf: str) -> DataFrame:
    """The same from a substring index, which is made here in two goes."""
    path, chunks = new_folder(spark, "postings"), spread(S.chunks(spark, sf).select("chunk_id", "document_id", "chunk_index", "text"))
    postings.add(chunks.where("chunk_index < 8"), path)
    postings.add(chunks.where("chunk_index >= 8"), path)
    return postings.keyword_topk(spark, path, S.questions(spark, sf))


@query("hybrid_search", f"WITH {scores(ONE)}, {hybrid(10)} SELECT qid, chunk_id, similarity_score, keyword_score, final_score, rank FROM hyb", ("chunks", "questions"))
def hybrid_search(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.hybrid_search(S.chunks(spark, sf), S.questions(spark, sf)).drop("list_no")


@query("merge_results", f"WITH {scores(TWO)}, {hybrid(2 * K)}, {MERGED} SELECT qid, list_no, chunk_id, final_score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY final_score DESC, chunk_id) AS r FROM one) WHERE r <= {3 * K}", ("chunks", "questions"))
def merge_results(spark: SparkSession, sf: str) -> DataFrame:
    ask = S.questions(spark, sf)
    one = ask.select("qid", F.lit(1).alias("list_no"), "question", "document_id", F.lit(0.5).alias("alpha"))
    two = ask.select("qid", F.lit(2).alias("list_no"), F.coalesce("hypothetical_answer", "question").alias("question"), "document_id", F.lit(0.7).alias("alpha"))
    hits = retrieval.hybrid_search(S.chunks(spark, sf), one.unionByName(two), 2 * K)
    return retrieval.merge_results(hits, 3 * K).select("qid", "list_no", "chunk_id", "final_score")


@query("dual_retrieval", f"WITH {scores(TWO)}, {hybrid(2 * K)}, {MERGED} SELECT qid, list_no, chunk_id, similarity_score, keyword_score, final_score, rank FROM merged", ("chunks", "questions"))
def dual_retrieval(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.dual_retrieval(S.chunks(spark, sf), S.questions(spark, sf), K)


@query("surrounding_context", f"WITH {scores(TWO)}, {hybrid(2 * K)}, {MERGED}, {CONTEXT} SELECT qid, chunk_id, text, original_text FROM ctx", ("chunks", "questions"))
def surrounding_context(spark: SparkSession, sf: str) -> DataFrame:
    chunks, questions = S.chunks(spark, sf), S.questions(spark, sf)
    return retrieval.surrounding_context(retrieval.dual_retrieval(chunks, questions, K), chunks, questions).select("qid", "chunk_id", "text", "original_text")


@query("rerank", ALL + "SELECT qid, chunk_id, final_score, rank FROM hits", ("chunks", "questions"))
def rerank(spark: SparkSession, sf: str) -> DataFrame:
    return _hits(spark, sf)[0].select("qid", "chunk_id", "final_score", "rank")


_LINE3 = "string_agg('[PDF Source ' || rank || ', Page ' || page || ']: ' || substr(text, 1, 300) || '...', chr(10) ORDER BY rank) FILTER (rank <= 3)"
_LINE2 = "string_agg('- Page ' || page || ': ' || substr(text, 1, 200) || '...', chr(10) ORDER BY rank) FILTER (rank <= 2)"
_sql = lambda s: "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


@query(
    "answer_context",
    ALL + f"SELECT qid, context, {_sql(answers.PROMPT)} || question || {_sql(answers.PROMPT_CONTEXT)} || context || {_sql(answers.PROMPT_END)} AS prompt FROM (SELECT qid, q.question, "
    f"coalesce({_sql(answers.CONTEXT_HEAD)} || chr(10) || {_LINE3}, '') AS context FROM questions q LEFT JOIN hits USING (qid) GROUP BY qid, q.question)",
    ("chunks", "questions"),
)
def answer_context(spark: SparkSession, sf: str) -> DataFrame:
    return answers.answer_context(*_hits(spark, sf))


_ANSWER = f"{_sql(answers.ANSWER_HEAD)} || q.question || '''' || chr(10) || coalesce({_sql(answers.SOURCES_HEAD)} || chr(10) || {_LINE2} || chr(10) || {_sql(answers.CONCLUSION)}, {_sql(answers.APOLOGY)})"


@query("template_answer", ALL + f"SELECT qid, {_ANSWER} AS answer FROM questions q LEFT JOIN hits USING (qid) GROUP BY qid, q.question", ("chunks", "questions"))
def template_answer(spark: SparkSession, sf: str) -> DataFrame:
    return answers.template_answer(*_hits(spark, sf))


@query(
    "generated_answers",
    ALL + f"SELECT qid, CASE WHEN n = 0 THEN answer ELSE 'The model was given ' || length({_sql(answers.PROMPT)} || question || {_sql(answers.PROMPT_CONTEXT)} || context || {_sql(answers.PROMPT_END)}) || ' characters.' END AS answer, "
    f"CASE WHEN n = 0 THEN 'template' ELSE 'model' END AS source FROM (SELECT qid, q.question, count(chunk_id) AS n, {_ANSWER} AS answer, {_sql(answers.CONTEXT_HEAD)} || chr(10) || {_LINE3} AS context FROM questions q LEFT JOIN hits USING (qid) GROUP BY qid, q.question)",
    ("chunks", "questions"),
)
def generated_answers(spark: SparkSession, sf: str) -> DataFrame:
    return answers.generated_answers(*_hits(spark, sf))


@query(
    "web_references",
    "SELECT page_id, url, '' AS title, substr(html, 1, 150) AS snippet, CASE WHEN page_id % 3 = 0 THEN 'web' ELSE 'blog' END AS source_type, CASE WHEN page_id % 4 = 0 THEN 0.5::DOUBLE ELSE (page_id % 100) / 100.0::DOUBLE END AS reliability_score, "
    "'[' || CASE WHEN page_id % 3 = 0 THEN 'Web' ELSE 'Blog' END || '] ' || substr(html, 1, 100) || '...' || CASE WHEN page_id % 4 = 0 THEN ' (50.0%)' WHEN page_id % 100 = 0 THEN '' ELSE ' (' || (page_id % 100) || '.0%)' END AS label FROM pages",
)
def web_references(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("page_id")
    rows = S.table(spark, sf, "pages").select(
        "page_id", "url", F.substring("html", 1, 150).alias("snippet"), F.when(d % 3 != 0, "blog").alias("source_type"), F.when(d % 4 != 0, (d % 100) / 100).alias("reliability_score"),
    )
    return answers.web_references(rows, "page_id").select("page_id", "url", "title", "snippet", "source_type", "reliability_score", answers.citation_label("web").alias("label"))


@query(
    "citations",
    ALL + "SELECT qid, rank, 'pdf' AS type, page, substr(text, 1, 150) || '...' AS text, similarity_score AS confidence, document_id, document_path, chunk_id, has_equations, has_tables, has_figures FROM hits",
    ("chunks", "questions"),
)
def citations(spark: SparkSession, sf: str) -> DataFrame:
    return answers.citations(_hits(spark, sf)[0]).drop("bbox")


@query(
    "citation_labels",
    ALL + "SELECT qid, rank, regexp_replace('Trang ' || page || ': ' || substr(substr(text, 1, 150) || '...', 1, 100) || '... ' || concat_ws(' ', CASE WHEN has_equations THEN '[Eq]' END, CASE WHEN has_tables THEN '[Table]' END, CASE WHEN has_figures THEN '[Fig]' END) "
    "|| ' ' || CASE WHEN similarity_score > 0 THEN '(' || printf('%.1f', round_even(similarity_score * 100, 1)) || '%)' ELSE '' END, '^ +| +$', '', 'g') AS label FROM hits",
    ("chunks", "questions"),
)
def citation_labels(spark: SparkSession, sf: str) -> DataFrame:
    return answers.citations(_hits(spark, sf)[0]).select("qid", "rank", answers.citation_label().alias("label"))


@query("answer_metrics", ALL + "SELECT qid, count(chunk_id) AS total_sources FROM questions q LEFT JOIN hits USING (qid) GROUP BY qid", ("chunks", "questions"))
def answer_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return answers.answer_metrics(*_hits(spark, sf))


@query(
    "answer_questions",
    ALL + f"SELECT qid, {_ANSWER} AS answer, count(chunk_id) AS total_sources, max(chunk_id) FILTER (rank = 1) AS top_chunk, coalesce({_sql(answers.CONTEXT_HEAD)} || chr(10) || {_LINE3}, '') AS context "
    "FROM questions q LEFT JOIN hits USING (qid) GROUP BY qid, q.question",
    ("chunks", "questions"),
)
def answer_questions(spark: SparkSession, sf: str) -> DataFrame:
    return answers.answer_questions(S.chunks(spark, sf), S.questions(spark, sf), K)


@query("learned_topk")
def learned_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The chunks nearest to each question by an embedding that is learned from all of them."""
    chunks = S.chunks(spark, sf)
    return learned.topk(chunks, S.questions(spark, sf), learned.fit(chunks))
