"""Operators on hand-written rows: the corners that the tables do not reach."""

import random

import pytest
from pyspark.sql import functions as F

from docloom.operators import answers, chunking, collection, elements, memory, progress, retrieval

ELEMENT = "document_id string, page int, kind string, ordinal int, x0 double, y0 double, x1 double, y1 double, content string, font_size double, font_flags int, caption string, markdown string"


def element_rows(spark, *rows):
    """rows: (page, kind, y0, content, size, flags[, caption, markdown])."""
    return spark.createDataFrame([("d", r[0], r[1], i, 0.0, float(r[2]), 9.0, 9.0, r[3], float(r[4]), r[5], *(r[6:] or (None, None))) for i, r in enumerate(rows)], ELEMENT)


def fold(rows, limit=1000):
    """The chunker as plain Python over one page's rows in order."""
    done, text, els, section = [], "", 0, "content"
    for _, kind, _, content, size, flags, *_ in rows:
        text += content + " "
        head = "title" if size > 14 else "header" if flags & 16 else None
        if head:
            done.append((text.strip(), section, els))
            text, els, section = content + " ", 1, head
            continue
        els += 1
        if len(text) > limit:
            done.append((text.strip(), section, els))
            text, els, section = "", 0, "content"
    if text.strip():
        done.append((text.strip(), section, els))
    return done


@pytest.mark.parametrize("rows", [
    [(0, "text", 1, "Head", 16, 0), (0, "text", 2, "body", 11, 0)],
    [(0, "text", 1, "a", 11, 0), (0, "text", 2, "T", 16, 0), (0, "text", 3, "H", 11, 16), (0, "text", 4, "z", 11, 0)],
    [(0, "text", 1, "x" * 999, 11, 0), (0, "text", 2, "tail", 11, 0)],
    [(0, "text", 1, "x" * 1000, 11, 0), (0, "text", 2, "tail", 11, 0)],
    [(0, "text", 1, "  ", 11, 0)],
    [(0, "text", 1, "a", 11, 0), (0, "text", 2, "Last", 16, 0)],
])
def test_chunker_is_the_fold(spark, rows):
    got = chunking.contextual_chunks(element_rows(spark, *rows)).orderBy("seq").collect()
    assert [(r["text"], r["section"], len(r["elements"])) for r in got] == fold(rows)


def test_chunker_markers_and_context(spark):
    rows = [(0, "figure", 1, "", 0, 0, "Figure 1", None), (0, "table", 2, "", 0, 0, None, "|x|"), (0, "equation", 3, "", 0, 0), (0, "figure", 4, "", 0, 0, "", None), (1, "text", 1, "next page", 11, 0)]
    got = chunking.with_context(chunking.contextual_chunks(element_rows(spark, *rows))).orderBy("chunk_index").collect()
    assert got[0]["text"] == "[FIGURE: Figure 1]  [TABLE: |x|]  [EQUATION: Mathematical equation on page 0]"
    assert got[0]["has_equations"] and got[0]["has_tables"] and got[0]["has_figures"] and len(got[0]["elements"]) == 4
    assert got[0]["next_context"] == "next page " and got[0]["previous_context"] is None
    assert got[1]["previous_context"] == got[0]["text"][:100] and got[1]["next_context"] is None


def test_images(spark):
    rows = spark.createDataFrame([(201.0, 99.0, 3, 0, "equation"), (200.0, 100.0, 3, 0, "figure"), (10.0, 5.0, 3, 0, "figure"), (10.0, 0.0, 1, 0, "figure"), (300.0, 9.0, 5, 1, None), (300.0, 9.0, 4, 1, "equation")], "w double, h double, n int, a int, want string")
    assert all(r[0] == r[1] for r in rows.select(elements.image_kind("w", "h", "n", "a"), "want").collect())


def test_tables(spark):
    def block(no, lines):
        return [("d", 0, no, k, x, float(k), x + 5, k + 1.0) for k, xs in enumerate(lines) for x in xs]

    rows = block(0, [[10.0, 50.0]] * 3) + block(1, [[10.0], [10.0, 50.0], [10.0, 50.0, 90.0]]) + block(2, [[10.0, 50.0]] * 2) + block(3, [[10.0]] * 4) + block(4, [[25.0, 15.0], [25.0, 16.0], [35.0, 15.0]])
    got = elements.detect_tables(spark.createDataFrame(rows, "document_id string, page int, block_no int, line_no int, x0 double, y0 double, x1 double, y1 double")).orderBy("block_no").collect()
    # 25 and 15 round to 20: one column; 25 and 16 too; 35 and 15 give 40 and 20.
    assert [(r["block_no"], r["n_columns"]) for r in got] == [(0, 2), (4, 2)]
    assert (got[0]["x0"], got[0]["x1"]) == (10.0, 55.0)


def test_markdown(spark):
    row = spark.createDataFrame([(["a", "b"], [["1", "2"], ["3", None]]), ([], [["1"]]), (["a"], None)], "h array<string>, r array<array<string>>")
    got = [r[0] for r in row.select(elements.table_markdown("h", "r")).collect()]
    assert got[0] == "| a | b |\n| --- | --- |\n| 1 | 2 |\n| 3 |  |" and got[1] == got[2] != got[0]


@pytest.mark.parametrize("lines, want", [
    (["x", " Figure 1: a ", "goes on here"], "Figure 1: a goes on here"), (["Fig. 2", "Upper case follows"], "Fig. 2"), (["Hình 2", "short"], "Hình 2"), (["figure", "0123456789a"], "figure 0123456789a"), (["none", ""], ""),
])
def test_captions(spark, lines, want):
    rows = spark.createDataFrame([("d", 0, i, x) for i, x in enumerate(lines)], "document_id string, page int, line_no int, line string")
    assert elements.figure_captions(rows).first()["caption"] == want


def test_first_bbox(spark):
    rows = spark.createDataFrame([('[{"bbox":[1,2,3,4]}]',), ("{bad",), ("[]",), ('[{"type":"x"}]',), (None,)], "e string")
    assert [r[0] for r in rows.select(collection.first_bbox("e")).collect()] == [[1.0, 2.0, 3.0, 4.0], None, None, None, None]


CHUNKS = "chunk_id string, document_id string, document_path string, chunk_index int, page int, chunk_type string, has_equations boolean, has_tables boolean, has_figures boolean, text string, elements string"


def chunk_rows(spark, texts):
    return spark.createDataFrame([(f"c{i}", "d", "p", i, i // 3, "content", False, False, False, t, "[]") for i, t in enumerate(texts)], CHUNKS)


def asked(spark, *questions):
    return spark.createDataFrame([(i, q, None, None) for i, q in enumerate(questions)], "qid long, question string, document_id string, hypothetical_answer string")


def test_keywords_count_substrings_and_repeats(spark):
    got = retrieval.keyword_topk(chunk_rows(spark, ["the cathedral", "dog", None]), asked(spark, "cat cat dog", "", "  ")).orderBy("rank").collect()
    assert [(r["qid"], r["chunk_id"], r["keyword_score"]) for r in got] == [(0, "c0", 0.666667), (0, "c1", 0.333333)]


def test_first_list_wins(spark):
    rows = spark.createDataFrame([(1, 1, "a", 0.2), (1, 2, "a", 0.9), (1, 2, "b", 0.5), (1, 1, "", 0.99), (1, 1, "c", 0.5)], "qid int, list_no int, chunk_id string, final_score double")
    got = retrieval.merge_results(rows, 2).orderBy("rank").collect()
    assert [(r["chunk_id"], r["list_no"], r["final_score"]) for r in got] == [("b", 2, 0.5), ("c", 1, 0.5)]


def test_question_blocks_agree(spark):
    chunks, questions = chunk_rows(spark, ["alpha beta", "beta gamma", "gamma delta", "delta alpha"]), asked(spark, "alpha", "gamma delta", "beta", "nothing")
    queries = retrieval._as_queries(questions)
    a = retrieval.score_candidates(chunks, queries, 4).collect()
    b = retrieval.score_candidates(chunks, queries, 4, block=1).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b)) and a


def test_answers_without_sources(spark):
    questions, chunks = asked(spark, "alpha"), chunk_rows(spark, ["x"]).where("false")
    got = answers.answer_questions(chunks, questions).first()
    assert got["total_sources"] == 0 and got["answer"].endswith(answers.APOLOGY) and got["context"] == ""


def test_context_stands_between_neighbours(spark):
    chunks = chunk_rows(spark, ["a", "b", "c", "d"])
    hits = spark.createDataFrame([(0, "c1", 1.0), (0, "c3", 1.0)], "qid long, chunk_id string, final_score double")
    questions = spark.createDataFrame([(0, "q", "d")], "qid long, question string, document_id string")
    got = {r["chunk_id"]: r["text"] for r in retrieval.surrounding_context(hits, chunks, questions).collect()}
    assert got == {"c1": "...\na\nb\nc\n...", "c3": "d"}


def test_title_questions_weigh_the_place(spark):
    hits = spark.createDataFrame([(0, "a", 0.0, 0.0, "x", "x", 0, 0, "title"), (0, "b", 1.0, 1.0, "x", "x", 9, 90, "content")], "qid long, chunk_id string, final_score double, similarity_score double, text string, original_text string, page int, chunk_index int, chunk_type string")
    for q, best in (("What is the TITLE", "a"), ("tiêu đề là gì", "a"), ("what else", "b")):
        assert retrieval.rerank(hits, asked(spark, q), 1).first()["chunk_id"] == best


def test_citation_label(spark):
    row = spark.createDataFrame([(3, "t" * 150, 0.5, True, False, True), (0, "x", 0.0, False, False, False)], "page int, text string, confidence double, has_equations boolean, has_tables boolean, has_figures boolean")
    got = [r[0] for r in row.select(answers.citation_label()).collect()]
    assert got == [f"Trang 3: {'t' * 100}... [Eq] [Fig] (50.0%)", "Trang 0: x..."]
    web = answers.web_references(spark.createDataFrame([("snip", "news")], "snippet string, source_type string"))
    assert web.select(answers.citation_label("web")).first()[0] == "[News] snip... (50.0%)"


INDEX = "cache_key string, cached_at long, last_used long, file_size_bytes long"


def lru_loop(rows, cap):
    total, out = sum(r[3] for r in rows), []
    for r in sorted(rows, key=lambda r: (r[2] if r[2] is not None else r[1], r[0])):
        if total <= cap:
            break
        out.append(r[0])
        total -= r[3]
    return out


@pytest.mark.parametrize("cap", [0, 5, 9, 10, 11, 29, 30, 1000])
def test_lru(spark, cap):
    rows = [("a", 5, None, 10), ("b", 5, 1, 10), ("c", 1, 5, 10), ("d", 5, 5, 0), ("e", 2, None, 1000)]
    assert sorted(r[0] for r in memory.lru_evicted(spark.createDataFrame(rows, INDEX), cap).collect()) == sorted(lru_loop(rows, cap))


def test_size_cap(spark):
    rows = spark.createDataFrame([(f"k{i}", i, None, 10) for i in range(10)], INDEX)
    assert memory.size_cap_evicted(rows, 100, F.col("file_size_bytes")).count() == 0
    assert sorted(r[0] for r in memory.size_cap_evicted(rows, 50, F.col("file_size_bytes")).collect()) == [f"k{i}" for i in range(6)]
    assert memory.size_cap_evicted(rows.limit(0), 50, F.col("file_size_bytes")).count() == 0


def test_eviction_of_rows_without_an_age_or_a_key(spark):
    rows = spark.createDataFrame([("a", None, None, 10), (None, 3, None, 10), ("b", 3, None, None), ("b", 3, None, 10), ("c", 4, None, 10)], INDEX)
    assert sorted((r[0] or "", r[3] or 0) for r in memory.lru_evicted(rows, 20).collect()) == [("", 10), ("a", 10)]
    assert memory.lru_evicted(rows, 10).count() == 4 and memory.lru_evicted(rows, 40).count() == 0


def test_a_bulk_load_of_one_age_is_many_ranges(spark):
    n, ranges = 20_000, 16
    rows = spark.range(n).select(F.sha2(F.col("id").cast("string"), 256).alias("cache_key"), F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(7).alias("cached_at"), F.lit(None).cast("long").alias("last_used"), (F.col("id") % 13).alias("file_size_bytes"))
    sizes = [r["count"] for r in memory.by_age(rows, F.col("file_size_bytes"), ["cache_key"], ranges).groupBy("_range").count().collect()]
    assert len(sizes) == ranges and max(sizes) <= 2 * n / ranges
    cap = 40_000
    got = {r["cache_key"] for r in memory.lru_evicted(rows, cap).collect()}
    assert got == set(lru_loop([tuple(r) for r in rows.collect()], cap)) and 5_000 < len(got) < n


def test_statistics_kept_over_appends_and_deletes(spark, tmp_path):
    path, schema = f"file://{tmp_path}/stats", "document_id string, has_equations boolean, has_tables boolean, has_figures boolean"
    made = lambda n: spark.createDataFrame([(None if i % 9 == 8 else f"d{(i * n) % 7}", i % 2 == 0, i % 3 == 0, None if i % 5 else True) for i in range(20 + n)], schema)
    there = None
    for n in range(10):
        collection.add_part(collection.stats_part(made(n), n), path, n)
        there = made(n) if there is None else there.unionByName(made(n))
    for n, gone in [(10, ["d1", "d3", "none"]), (11, ["d3", "d6"])]:
        gone = spark.createDataFrame([(x,) for x in [*gone, None]], "document_id string")
        for _ in range(2):  # a batch that comes again
            collection.add_part(collection.retracted(spark.read.parquet(path), gone, n), path, n)
        there = there.join(gone, "document_id", "left_anti")
    collection.add_part(collection.stats_part(made(3).where("document_id = 'd3'"), 12), path, 12)
    there = there.unionByName(made(3).where("document_id = 'd3'"))
    want = collection.collection_stats(there).first().asDict()
    parts = spark.read.parquet(path)
    assert collection.merged_stats(parts).first().asDict() == want
    assert collection.merged_stats(collection.compacted(parts, 13)).first().asDict() == want
    assert collection.merged_stats(parts.limit(0)).first().asDict() == {k: 0 for k in want}


def test_translation_keeps_failures_out(spark):
    schema = "request_id string, source_text string, lang_in string, lang_out string, service string, model string, ts long"
    rows = [("1", "abc", "en", "vi", "s", None, 1), ("2", "abc", "en", "vi", "s", "", 2), ("3", "9 fails", "en", "vi", "s", None, 3), ("4", " ", "en", "vi", "s", None, 4)]
    requests = memory.keyed(spark.createDataFrame(rows, schema))
    empty = spark.createDataFrame([], "cache_key string, source_lang string, target_lang string, service string, model string, source_text string, translated_text string, cached_at long, expires_at long, hit_count long, last_used long")
    got, new = memory.translate(requests, empty, 100)
    assert {r["request_id"]: (r["status"], r["translated_text"]) for r in got.collect()} == {"1": ("translated", "ABC"), "2": ("translated", "ABC"), "3": ("failed", "9 fails"), "4": ("blank", " ")}
    stored = memory.upsert(empty, new)
    assert stored.count() == 1
    again = memory.lookup(requests, stored, 100 + 30 * 86_400_000_000)
    assert {r["status"] for r in again.collect()} == {"hit", "miss", "blank"}, "valid up to and with expires_at"
    assert memory.lookup(requests, stored, 101 + 30 * 86_400_000_000).where("status = 'expired'").count() == 2
    assert memory.upsert(stored, new).count() == 1, "idempotent"


LOG = """: comment
event: progress
data: {"a":
data: 1}

data: plain\r

event: kept

data: {"b": 2}

event: lost
data: no end"""


def test_event_log(spark):
    rows = spark.createDataFrame([("l", i, x) for i, x in enumerate(LOG.split("\n"))], "log_id string, line_no int, line string")
    got = progress.parse_event_log(rows).orderBy("event_no").collect()
    assert [(r["event"], r["data"], r["is_json"]) for r in got] == [("progress", '{"a":\n1}', True), ("message", "plain", False), ("kept", '{"b": 2}', True)]


@pytest.mark.parametrize("kinds, want", [(["finish", "cancelled"], "cancelled"), (["finish", "error"], "error"), (["finish", "log"], "done"), (["log"], "error")])
def test_session_status(spark, kinds, want):
    rows = spark.createDataFrame([("s", i, i, k, float(i)) for i, k in enumerate(kinds)], "session_id string, ts_us long, event_id long, kind string, value double")
    got = progress.session_status(rows).first()
    assert got["status"] == want and got["result"] == (0.0 if "finish" in kinds else None)


def test_versions(spark):
    names = {"a_translated_v2.pdf": 2, "a_v010.pdf": 10, "a_vx.pdf": -1, "a_mono.pdf": -1, "a": -1, "v3.pdf": -1}
    rows = spark.createDataFrame(list(names.items()), "name string, want long").select(progress.version_of("name"), "want")
    assert all(r[0] == r[1] for r in rows.collect())


@pytest.mark.parametrize("files, want", [
    ([("a_translated_v2.pdf", 1), ("a_translated_v10.pdf", 0), ("a_mono.pdf", 9)], "a_translated_v10.pdf"), ([("a.pdf", 1), ("a.vi.pdf", 0)], "a.vi.pdf"), ([("z.pdf", 5), ("y_MONO.pdf", 1)], "y_MONO.pdf"), ([("z.pdf", 5), ("y.pdf", 6)], "y.pdf"),
])
def test_pick_output(spark, files, want):
    assert progress.pick_output(spark.createDataFrame([("a", n, m) for n, m in files], "stem string, name string, mtime long")).first()["name"] == want


def test_clear(spark):
    mem = spark.createDataFrame([("a", 5), ("b", 9)], "cache_key string, expires_at long")
    docs = spark.createDataFrame([("d",)], "cache_key string")
    left = lambda scope, target: tuple(x.count() for x in memory.clear(mem, docs, scope, target, 6))
    assert left("expired", "both") == (1, 1) and left("expired", "documents") == (2, 1) and left("all", "both") == (0, 0) and left("all", "documents") == (2, 0)


def test_observed_translation_and_settings(spark):
    from pyspark.sql import Observation

    requests = memory.keyed(spark.createDataFrame([("a", "hello"), ("b", "hello"), ("c", "1 fails"), ("d", " ")], "request_id string, source_text string").selectExpr(
        "request_id", "source_text", "'en' lang_in", "'vi' lang_out", "'marked' service", "CAST(NULL AS STRING) model", "0L ts"
    ))
    empty = memory.memory_entries(requests.withColumn("translated_text", F.lit("")), 100)
    seen = Observation("translation")
    got, _ = memory.translate(requests, empty, 100, using="marked", settings={"marked": {"mark": "<vi> "}}, seen=seen)
    assert {r["request_id"]: (r["status"], r["translated_text"]) for r in got.collect()} == {"a": ("translated", "<vi> hello"), "b": ("translated", "<vi> hello"), "c": ("failed", "1 fails"), "d": ("blank", " ")}
    assert seen.get == {"paragraphs": 4, "hit": 0, "blank": 1, "translated": 2, "failed": 1}
    with pytest.raises(ValueError, match="no backend"):
        memory.settings_of("nobody")


def test_rows_of_candidates_are_bounded(spark):
    """Whatever the batches, a task gives at most twice the rows kept for each question; blocks and passes agree with one."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    chunks = chunk_rows(spark, [" ".join(rng.choice(words) for _ in range(rng.randint(1, 9))) for _ in range(3000)]).repartition(3)
    questions = asked(spark, *[" ".join(rng.choice(words) for _ in range(4)) for _ in range(20)])
    queries = retrieval._as_queries(questions)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        found = retrieval.score_candidates(chunks, queries, 5)
        assert found.count() <= 20 * 3 * 2 * 5
        best = lambda df, c: {q: sorted(((-r[c], r["chunk_id"]) for r in df if r["qid"] == q and r[c] > 0))[:5] for q in range(20)}
        one, many = found.collect(), retrieval.score_candidates(chunks, queries, 5, block=3, questions_a_pass=7).collect()
        whole = retrieval.score_candidates(chunks.coalesce(1), queries, 3000).collect()
        assert best(one, "sim") == best(many, "sim") == best(whole, "sim") and best(one, "kw") == best(many, "kw") == best(whole, "kw")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
