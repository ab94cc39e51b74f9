"""Batch retrieval: semantic and keyword scores, hybrid search, merging, context, reranking.

A table of questions meets the whole chunk table. The questions go to every worker, as many in a pass as PASS says; a worker goes through its
chunks once, scores them against the questions block by block, and keeps each question's best rows so far. It gives these out when its task
ends. So the chunk table is scanned once a pass, never shuffled, and what is shuffled is bounded by questions x tasks x rows kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import tokens
from docloom.session import ship, spread

DIM = 64
#: Questions of a block, which chunks meet in one matrix; and of a pass, broadcast together. More are taken in further passes.
BLOCK, PASS = 2048, 65_536
#: Chunks that meet a block at once.
ROWS = 512
#: Scores are rounded to this many places before they are ranked, so that equal texts tie on every engine; ties go by chunk_id.
PLACES = 6
#: Distinct words of texts that a task remembers.
KNOWN = 500_000
#: Words that at least this many questions of a block hold are counted by matrix product, others one by one.
COMMON = 32


@lru_cache(maxsize=500_000)
def _slot(word: str, dim: int) -> tuple[int, float]:
    v = int(hashlib.md5(word.encode()).hexdigest()[:8], 16)
    return v % dim, 1.0 if v // dim % 2 == 0 else -1.0


def embed(word_lists: list[list[str]], dim: int = DIM) -> np.ndarray:
    """Hashed bags of words: a signed count for each word's bucket, of length 1 (0 without words, or where all cancels)."""
    out = np.zeros((len(word_lists), dim))
    for row, words in zip(out, word_lists):
        for w in words:
            k, s = _slot(w, dim)
            row[k] += s
    n = np.sqrt((out * out).sum(1, keepdims=True))
    return out / np.where(n > 0, n, 1)


def hash_embed(text: str | Column, dim: int = DIM) -> Column:
    """The default embedding as array<double>; any pandas UDF from text to array may take its place."""
    ship()

    @F.pandas_udf("array<double>")
    def run(words: pd.Series) -> pd.Series:
        return pd.Series(list(embed([list(w) if w is not None else [] for w in words], dim)))

    return run(tokens(text))


def _passes(queries: DataFrame, size: int) -> Iterator[list]:
    rows = queries.orderBy("qid", "list_no").toLocalIterator()
    part: list = []
    for r in rows:
        part.append(r)
        if len(part) == size:
            yield part
            part = []
    if part:
        yield part


class WordsHeld:
    """Which of the questions' words, by number, a word holds as substrings."""

    def __init__(self, words: list[str]):
        self.machine = ahocorasick.Automaton()
        for k, w in enumerate(words):
            self.machine.add_word(w, k)
        if words:
            self.machine.make_automaton()
        self.known: dict[str, np.ndarray] = {}

    def of(self, word: str) -> np.ndarray:
        found = self.known.get(word)
        if found is None:
            if len(self.known) > KNOWN:
                self.known.clear()
            found = self.known[word] = np.array(sorted({k for _, k in self.machine.iter(word)}) if len(self.machine) else [], np.int64)
        return found


class _Words:
    """What a task's distinct words are: where they stand in the embedding, and which words of the questions they hold."""

    def __init__(self, words: list[str], dim: int):
        self.dim, self.machine = dim, ahocorasick.Automaton()
        for k, w in enumerate(words):
            self.machine.add_word(w, k)
        if words:
            self.machine.make_automaton()
        self.known: dict[str, tuple[int, float, list[int]]] = {}

    def look(self, word: str) -> tuple[int, float, list[int]]:
        found = self.known[word] = (*_slot(word, self.dim), list({k for _, k in self.machine.iter(word)}) if len(self.machine) else [])
        return found

    def of(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """From lists of words: (offsets of the rows, number of each word among the distinct ones, their slots, their signs, how many of the
        questions' words each holds, those in turn)."""
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = column.flatten().dictionary_encode()
        if len(self.known) > KNOWN:
            self.known.clear()
        get = self.known.get
        each = [get(w) or self.look(w) for w in flat.dictionary.to_pylist()]
        slots, signs = np.array([x[0] for x in each], np.int64), np.array([x[1] for x in each])
        held = np.array([len(x[2]) for x in each], np.int64)
        return np.concatenate([[0], np.cumsum(size)]), flat.indices.to_numpy(), slots, signs, held, np.array([k for x in each for k in x[2]], np.int64)


class _Best:
    """The best rows so far of each question of a block by one score; ties go by chunk_id."""

    def __init__(self, questions: int, keep: int, least: float):
        self.keep, self.bar = keep, np.full(questions, least)
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, score: np.ndarray, seen: np.ndarray, ids: np.ndarray, other: np.ndarray) -> None:
        """score, other: a row for each of ids, ascending, a column for each question; seen: which of them count."""
        hit = seen & (score >= self.bar)
        if hit.sum() > 4 * self.keep * hit.shape[1]:  # of so many the best of these rows will do
            order = np.argsort(np.where(hit, -score, np.inf), axis=0, kind="stable")[: self.keep]
            best = np.zeros_like(hit)
            np.put_along_axis(best, order, True, 0)
            hit &= best
        r, q = np.nonzero(hit)
        if len(r):
            self.parts.append((q, score[r, q], ids[r], other[r, q]))
            self.size += len(r)
            if self.size > 4 * self.keep * hit.shape[1] + 4096:
                self.settle()

    def settle(self) -> tuple[np.ndarray, ...]:
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0), np.zeros(0, object), np.zeros(0)
        q, score, ids, other = (np.concatenate(x) for x in zip(*self.parts))
        order = np.lexsort((ids.astype(str), -score, q))
        q = q[order]
        first = np.searchsorted(q, q)
        stay = np.arange(len(q)) - first < self.keep
        order, q = order[stay], q[stay]
        self.parts, self.size = [(q, score[order], ids[order], other[order])], len(q)
        full = np.flatnonzero(np.arange(len(q)) - np.searchsorted(q, q) == self.keep - 1)
        self.bar[q[full]] = np.maximum(self.bar[q[full]], self.parts[0][1][full])
        return self.parts[0]


class _Block:
    """A block of questions in a task: their vectors, how often each has each word, and their best rows."""

    def __init__(self, rows: list, number: dict[str, int], dim: int, keep: int, by: str):
        self.key = [(r["qid"], r["list_no"]) for r in rows]
        self.by, n = by, len(rows)
        given = bool(rows) and rows[0]["vector"] is not None
        self.vectors = np.array([r["vector"] for r in rows]) if given else embed([r["words"] for r in rows], dim)
        # A word counts as often as the question has it.
        times = pd.Series([(number[w], j) for j, r in enumerate(rows) for w in r["words"]], dtype=object).value_counts()
        pair = np.array([*times.index], np.int64).reshape(-1, 2)
        order = np.argsort(pair[:, 0], kind="stable")
        self.word, self.question, self.times = pair[order, 0], pair[order, 1], times.to_numpy().astype(np.int64)[order]
        self.first = np.searchsorted(self.word, np.arange(len(number) + 1))
        self.length = np.array([max(len(r["words"]), 1) for r in rows])
        self.common = np.flatnonzero(np.diff(self.first) >= COMMON)
        self.table = np.zeros((len(self.common), n), np.float32)
        for row, w in zip(self.table, self.common):
            own = slice(self.first[w], self.first[w + 1])
            row[self.question[own]] = self.times[own]
        self.rank = np.full(len(number), -1)
        self.rank[self.common] = np.arange(len(self.common))
        self.documents = np.array([r["document_id"] for r in rows], object)
        self.free = np.array([r["document_id"] is None for r in rows], bool)
        bound: dict[str, list[int]] = {}
        for j in np.flatnonzero(~self.free):
            bound.setdefault(self.documents[j], []).append(j)
        self.bound = bound
        self.best = {k: _Best(n, keep, -np.inf if k == "sim" else 1e-9) for k in ("sim", "kw") if by in (k, "both")}

    def keyword(self, row: np.ndarray, word: np.ndarray, n: int) -> np.ndarray:
        """Shares of the questions' words that rows hold; (row, word) are distinct."""
        q = len(self.key)
        own = self.rank[word] >= 0
        holds = np.zeros((n, len(self.common)), np.float32)
        holds[row[own], self.rank[word[own]]] = 1
        found = (holds @ self.table).astype(np.int64)  # counts below 2**24 are exact
        row, word = row[~own], word[~own]
        size = self.first[word + 1] - self.first[word]
        at = np.repeat(self.first[word] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        found += np.bincount(np.repeat(row, size) * q + self.question[at], self.times[at], n * q).astype(np.int64).reshape(n, q)
        return np.round(found / self.length, PLACES)

    def meet(self, ids: np.ndarray, documents: np.ndarray, X: np.ndarray | None, row: np.ndarray, word: np.ndarray) -> None:
        zero = np.zeros((len(ids), len(self.key)))
        sim = np.round(X @ self.vectors.T, PLACES) + 0.0 if self.by != "kw" else zero
        kw = self.keyword(row, word, len(ids)) if self.by != "sim" else zero
        seen = np.broadcast_to(self.free, sim.shape)
        asked = [d for d in set(documents.tolist()) if d in self.bound]
        if asked:
            seen = seen.copy()
            for d in asked:
                seen[np.ix_(documents == d, self.bound[d])] = True
        for k, best in self.best.items():
            best.add(*((sim, seen, ids, kw) if k == "sim" else (kw, seen, ids, sim)))

    def rows(self) -> pd.DataFrame:
        found = []
        for k, best in self.best.items():
            q, score, ids, other = best.settle()
            found.append(pd.DataFrame({"q": q, "chunk_id": ids, "sim": score if k == "sim" else other, "kw": other if k == "sim" else score}))
        out = pd.concat(found).drop_duplicates(["q", "chunk_id"])
        q = out["q"].to_numpy()
        return pd.DataFrame({"qid": [self.key[j][0] for j in q], "list_no": [self.key[j][1] for j in q], "chunk_id": out["chunk_id"], "sim": out["sim"], "kw": out["kw"]})


def score_candidates(chunks: DataFrame, queries: DataFrame, keep: int, dim: int = DIM, by: str = "both", block: int = BLOCK, questions_a_pass: int = PASS) -> DataFrame:
    """Rows (qid, list_no, chunk_id, sim, kw) that hold of each query at least its ``keep`` best chunks by sim and its ``keep`` best by kw
    above 0 (by: both, sim or kw), ties by chunk_id. At most 2 * keep rows come from a task for each query.

    chunks(chunk_id, document_id, text[, embedding]); queries(qid, list_no, question, document_id[, vector]). A query with a
    document_id sees that document only. kw: the share of the query's words that occur in the text, as substrings of the lower-cased
    text, repeated words counted each time; as words hold no white space, that is as substrings of the text's own words. sim: cosine of
    the embeddings: those given (embedding, vector) or, where chunks have none, hashed from the words.
    """
    spark = chunks.sparkSession
    ship(spark)
    vector = F.col("vector") if "vector" in queries.columns else F.lit(None).cast("array<double>")
    ask = queries.select("qid", "list_no", "document_id", tokens("question").alias("words"), vector.alias("vector"))
    given = "embedding" in chunks.columns
    rows = spread(chunks.select("chunk_id", "document_id", tokens("text").alias("words"), *["embedding"] * given))
    schema = f"qid {ask.schema['qid'].dataType.simpleString()}, list_no int, chunk_id string, sim double, kw double"
    out: DataFrame | None = None

    def run_for(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked = shared.value
            words = sorted({w for r in asked for w in r["words"]}) if by != "sim" else []
            number = {w: k for k, w in enumerate(words)} if by != "sim" else {w: 0 for r in asked for w in r["words"]}
            blocks = [_Block(asked[a : a + block], number, dim, keep, by) for a in range(0, len(asked), block)]
            known = _Words(words, dim)
            for batch in batches:
                names = batch.column("chunk_id").to_numpy(zero_copy_only=False)
                batch = batch.take(pa.array(np.argsort(names.astype(str), kind="stable")))  # ties go by chunk_id
                starts, every, slots, signs, held, of_questions = known.of(batch.column("words"))
                before = np.cumsum(held) - held
                for a in range(0, batch.num_rows, ROWS):
                    part = batch.slice(a, ROWS)
                    ids, documents = (part.column(c).to_numpy(zero_copy_only=False) for c in ("chunk_id", "document_id"))
                    own = starts[a : a + part.num_rows + 1]
                    row, word = np.repeat(np.arange(part.num_rows), np.diff(own)), every[own[0] : own[-1]]
                    X = None
                    if by != "kw":
                        X = np.array(part.column("embedding").to_pylist(), float) if given else np.bincount(row * dim + slots[word], signs[word], len(ids) * dim).reshape(-1, dim)
                        length = np.sqrt((X * X).sum(1, keepdims=True))
                        X = X if given else X / np.where(length > 0, length, 1)
                    size = held[word]
                    at = np.repeat(before[word] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                    pair = np.unique(np.repeat(row, size) * max(len(words), 1) + of_questions[at])
                    for b in blocks:
                        b.meet(ids, documents, X, pair // max(len(words), 1), pair % max(len(words), 1))
            for b in blocks:
                yield pa.RecordBatch.from_pandas(b.rows(), schema=result, preserve_index=False)

        return run

    from pyspark.sql.pandas.types import to_arrow_schema

    result = to_arrow_schema(spark.createDataFrame([], schema).schema)
    for part in _passes(ask, questions_a_pass):
        found = rows.mapInArrow(run_for(spark.sparkContext.broadcast(part)), schema)
        out = found if out is None else out.union(found)
    return out if out is not None else spark.createDataFrame([], schema)


def _as_queries(questions: DataFrame) -> DataFrame:
    out = questions if "list_no" in questions.columns else questions.withColumn("list_no", F.lit(1))
    return out if "document_id" in out.columns else out.withColumn("document_id", F.lit(None).cast("string"))


def _rank(by: str, *keys: str) -> Column:
    return F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(by).desc(), "chunk_id"))


def semantic_topk(chunks: DataFrame, questions: DataFrame, n: int = 10) -> DataFrame:
    """qid, chunk_id, similarity, rank of the n chunks nearest to each question."""
    found = score_candidates(chunks, _as_queries(questions), n, by="sim")
    return found.select("qid", "chunk_id", F.col("sim").alias("similarity"), _rank("sim", "qid").alias("rank")).where(F.col("rank") <= n)


def keyword_topk(chunks: DataFrame, questions: DataFrame, n: int = 10) -> DataFrame:
    """qid, chunk_id, keyword_score, rank of the n best chunks of each question with a score above 0; an empty question has none."""
    found = score_candidates(chunks, _as_queries(questions), n, by="kw").where("kw > 0")
    return found.select("qid", "chunk_id", F.col("kw").alias("keyword_score"), _rank("kw", "qid").alias("rank")).where(F.col("rank") <= n)


def hybrid_search(chunks: DataFrame, queries: DataFrame, n: int = 10, alpha: float = 0.7) -> DataFrame:
    """qid, list_no, chunk_id, similarity_score, keyword_score, final_score, rank: the n best of each query.

    The 2n nearest chunks and all keyword hits are merged; final = alpha * similarity + (1 - alpha) * keyword, where a chunk that is
    not among the 2n nearest has similarity 0. Of the keyword hits only 3n can matter: at most 2n of the best are among the nearest.
    A column alpha of queries overrides the argument, query by query.
    """
    queries = _as_queries(queries)
    found = score_candidates(chunks, queries, 3 * n)
    found = found.withColumn("near", _rank("sim", "qid", "list_no") <= 2 * n).where("near OR kw > 0")
    weight = queries.select("qid", "list_no", (F.col("alpha") if "alpha" in queries.columns else F.lit(alpha)).alias("a"))
    found = found.withColumn("similarity_score", F.when(F.col("near"), F.col("sim")).otherwise(0.0)).join(weight, ["qid", "list_no"])
    found = found.withColumn("final_score", F.round(F.col("a") * F.col("similarity_score") + (1 - F.col("a")) * F.col("kw"), PLACES + 3))
    found = found.withColumn("rank", _rank("final_score", "qid", "list_no")).where(F.col("rank") <= n)
    return found.select("qid", "list_no", "chunk_id", "similarity_score", F.col("kw").alias("keyword_score"), "final_score", "rank")


def merge_results(hits: DataFrame, limit: int) -> DataFrame:
    """Hits of several lists (qid, list_no, chunk_id, final_score, ...) as one: of each chunk the hit of the first list, even if a later one
    scored it higher; empty ids go; the best ``limit`` stay."""
    hits = hits.where("chunk_id IS NOT NULL AND chunk_id <> ''").drop("rank")
    first = F.row_number().over(Window.partitionBy("qid", "chunk_id").orderBy("list_no", F.col("final_score").desc()))
    hits = hits.withColumn("_first", first).where("_first = 1").drop("_first")
    return hits.withColumn("rank", _rank("final_score", "qid")).where(F.col("rank") <= limit)


def dual_retrieval(chunks: DataFrame, questions: DataFrame, k: int = 5) -> DataFrame:
    """Two hybrid searches in one scan: the question with alpha 0.5 and the hypothetical answer (the question where null) with 0.7, 2k hits
    each, merged to 3k, of which 2k are taken."""
    ask = questions.select("qid", "document_id", "question", F.coalesce("hypothetical_answer", "question").alias("h"))
    one = F.struct(F.lit(1).alias("list_no"), F.col("question").alias("question"), F.lit(0.5).alias("alpha"))
    two = F.struct(F.lit(2).alias("list_no"), F.col("h").alias("question"), F.lit(0.7).alias("alpha"))
    lists = ask.select("qid", "document_id", F.explode(F.array(one, two)).alias("l")).select("qid", "document_id", "l.*")
    return merge_results(hybrid_search(chunks, lists, 2 * k), 3 * k).where(F.col("rank") <= 2 * k)


def neighbours(chunks: DataFrame, window: int = 1) -> DataFrame:
    """Adds before and after: texts of the chunks of the same document and page whose index is at most ``window`` away, in order."""
    side = lambda a, b: Window.partitionBy("document_id", "page").orderBy("chunk_index").rangeBetween(a, b)
    texts = lambda w: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_id", "text")).over(w)), lambda x: x["text"]), "\n")
    return chunks.withColumns({"before": texts(side(-window, -1)), "after": texts(side(1, window))})


def surrounding_context(hits: DataFrame, chunks: DataFrame, questions: DataFrame, window: int = 1) -> DataFrame:
    """Adds text (enriched), original_text and the chunk's columns to hits(qid, chunk_id, ...).

    For questions with a document the text stands between its neighbours' on the page, each side in ``...`` lines; otherwise as it is.
    Only documents that are asked for are looked through for neighbours.
    """
    asked = questions.select("qid", F.col("document_id").alias("asked"))
    named = hits.join(asked, "qid")
    meta = ["chunk_id", "document_id", "document_path", "chunk_index", "page", "chunk_type", "has_equations", "has_tables", "has_figures", "elements"]
    near = neighbours(chunks.join(asked.where("asked IS NOT NULL").select(F.col("asked").alias("document_id")).distinct(), "document_id", "left_semi"), window)
    near = near.select("chunk_id", "before", "after")
    rows = named.join(chunks.select(*meta, F.col("text").alias("original_text")), "chunk_id").join(near, "chunk_id", "left")
    front = F.when(F.col("before") != "", F.concat(F.lit("...\n"), "before", F.lit("\n"))).otherwise("")
    back = F.when(F.col("after") != "", F.concat(F.lit("\n"), "after", F.lit("\n..."))).otherwise("")
    rows = rows.withColumn("text", F.when(F.col("asked").isNull(), F.col("original_text")).otherwise(F.concat(front, "original_text", back)))
    return rows.drop("before", "after", "asked")


# Words that make a question one about the document itself: fixed values.
METADATA_WORDS = {
    "en": ["title", "author", "abstract", "summary", "introduction", "conclusion"],
    "vi": ["tiêu đề", "tác giả", "tóm tắt", "giới thiệu", "kết luận"],
}
# Weights of base, keyword density, page, index, length and section, for questions about the document itself and for others: fixed values.
METADATA_WEIGHTS, CONTENT_WEIGHTS = (0.15, 0.05, 0.2, 0.2, 0.1, 0.3), (0.4, 0.3, 0.15, 0.05, 0.05, 0.05)


def rerank(hits: DataFrame, questions: DataFrame, top_k: int = 5) -> DataFrame:
    """Replaces final_score by a mix of signals and keeps the best top_k of each question, with a new rank.

    hits(qid, chunk_id, final_score, similarity_score, text, original_text, page, chunk_index, chunk_type); a missing page or index counts as 100.
    """
    rows = hits.join(questions.select("qid", F.col("question").alias("_q")), "qid")
    q = F.array_distinct(tokens("_q"))
    t = F.array_distinct(tokens(F.coalesce("original_text", "text")))
    about = F.lit(False)
    for w in [w for words in METADATA_WORDS.values() for w in words]:
        about = about | F.lower("_q").contains(w)
    section = F.coalesce("chunk_type", F.lit("content"))
    signals = [
        F.coalesce("final_score", "similarity_score", F.lit(0.0)), F.size(F.array_intersect(q, t)) / F.greatest(F.size(q), F.lit(1)), 1 / (1 + 0.1 * F.coalesce("page", F.lit(100))),
        1 / (1 + 0.05 * F.coalesce("chunk_index", F.lit(100))), F.least(F.length("text") / 500, F.lit(1.0)),
    ]
    sections = {True: F.when(section == "title", 1.0).when(section == "header", 0.8).when(section == "abstract", 0.9).otherwise(0.0), False: F.when(section == "content", 0.3).otherwise(0.0)}
    total = lambda weights, s: sum((w * x for w, x in zip(weights[1:], [*signals[1:], s])), weights[0] * signals[0])
    score = F.when(about, total(METADATA_WEIGHTS, sections[True])).otherwise(total(CONTENT_WEIGHTS, sections[False]))
    rows = rows.withColumn("final_score", F.round(score, PLACES)).drop("_q", "rank")
    return rows.withColumn("rank", _rank("final_score", "qid")).where(F.col("rank") <= top_k)
