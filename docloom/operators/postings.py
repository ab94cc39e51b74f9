"""Substring index for keyword search: questions meet lists of places, never the chunk table.

A word of a question occurs in a text where one of the text's own words holds it. An index folder has

- ``members``: chunks in shards of at most 2**BITS, each with its place in the shard, places in the order of chunk_id;
- ``postings``: of each shard and word of its texts the places of the chunks that have it;
- ``tokens``: the distinct words, each under a hash, and ``grams``: which of them hold each run of one to three characters, with ``counts``.

The rarest run of a question's word leads to the words that may hold it, which are then looked at themselves; their postings are counted in matrices, shard by
shard, and each shard gives its best chunks. Added chunks are new shards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.text import tokens
from docloom.operators import retrieval
from docloom.session import ship, spread, written

#: Places of a shard, as a power of two.
BITS = 14
#: Questions that are counted together, and words that they meet at once.
BLOCK, WORDS = 128, 512
#: Questions of a pass, broadcast together, and their distinct words (if a single question has no more), of which a task holds 2**BITS bits each.
PASS, PASS_WORDS = 32_768, 65_536


def _empty(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/members")
    return not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _table(spark: SparkSession, path: str, name: str) -> DataFrame:
    schemas = {
        "members": "shard long, place short, chunk_id string, document_id string", "postings": "shard long, token string, places array<short>",
        "tokens": "h long, token string", "grams": "gram string, h long", "counts": "gram string, n long",
    }
    return spark.read.schema(schemas[name]).parquet(f"{path}/{name}")


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, h) of tokens(h, token), whatever their length."""
    for batch in batches:
        size, runs, of = 0, [], []
        for h, token in zip(batch.column("h").to_pylist(), batch.column("token").to_pylist()):
            own = {token[i : i + k] for k in (1, 2, 3) for i in range(len(token) - k + 1)}
            runs += own
            of.append((h, len(own)))
            size += len(own)
            if size > 1 << 16:
                yield _gram_rows(runs, of)
                size, runs, of = 0, [], []
        yield _gram_rows(runs, of)


def _gram_rows(runs: list[str], of: list[tuple[int, int]]) -> pa.RecordBatch:
    h, n = np.array(of, np.int64).reshape(-1, 2).T
    return pa.RecordBatch.from_arrays([pa.array(runs, pa.string()), pa.array(np.repeat(h, n))], ["gram", "h"])


def add(chunks: DataFrame, path: str, bits: int = BITS) -> None:
    """Adds chunks(chunk_id, document_id, text), none of which the index at path has, as new shards; makes the index if there is none. Null texts have
    no words."""
    spark = chunks.sparkSession
    ship(spark)
    fresh = _empty(spark, path)
    base = 0 if fresh else 1 + (_table(spark, path, "members").agg(F.max(F.shiftright("shard", 48))).first()[0] or 0)
    parts = max(1, -(-chunks.count() // (1 << bits)))
    rows = chunks.select("chunk_id", "document_id", F.array_distinct(tokens("text")).alias("words"))
    rows = rows.repartition(parts, "chunk_id").sortWithinPartitions("chunk_id").withColumn("_n", F.monotonically_increasing_id())
    place = F.col("_n").bitwiseAND(F.lit((1 << 33) - 1))
    shard = F.lit(base << 48) + F.shiftleft(F.shiftright("_n", 33), 20) + F.shiftright(place, bits)
    rows = written(rows.withColumns({"shard": shard, "place": place.bitwiseAND(F.lit((1 << bits) - 1)).cast("short")}).drop("_n"), "placed")
    rows.select("shard", "place", "chunk_id", "document_id").write.mode("append").parquet(f"{path}/members")
    flat = rows.select("shard", "place", F.explode("words").alias("token"))
    flat.groupBy("shard", "token").agg(F.collect_list("place").alias("places")).sortWithinPartitions("token").write.mode("append").parquet(f"{path}/postings")
    known = flat.select("token").distinct().select(F.xxhash64("token").alias("h"), "token")
    if not fresh:
        known = known.join(_table(spark, path, "tokens"), ["h", "token"], "left_anti")
    known = written(known, "tokens")
    known.write.mode("append").parquet(f"{path}/tokens")
    grams = written(known.mapInArrow(_grams, "gram string, h long").repartitionByRange("gram").sortWithinPartitions("gram"), "grams")
    grams.write.mode("append").parquet(f"{path}/grams")
    grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).write.mode("append").parquet(f"{path}/counts")


def holders(spark: SparkSession, path: str, words: DataFrame) -> DataFrame:
    """(w, token): the index's words that hold each of words(w) as a substring. w is at least one character."""
    runs = F.when(F.length("w") < 3, F.array("w")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length("w") - 2, F.lit(1))), lambda i: F.substr("w", i, F.lit(3))))
    counts = _table(spark, path, "counts").groupBy("gram").agg(F.sum("n").alias("n"))
    every = words.select("w", F.explode(F.array_distinct(runs)).alias("gram")).join(counts, "gram", "left")
    rarest = every.groupBy("w").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"), F.min(F.coalesce("n", F.lit(0))).alias("n")).where("n > 0")
    maybe = rarest.select("w", "gram").join(_table(spark, path, "grams"), "gram").join(_table(spark, path, "tokens"), "h")
    return maybe.where(F.contains("token", "w")).select("w", "token").distinct()


class _Asked:
    """A pass of questions and their words, whose numbers are their places in the sorted list."""

    def __init__(self, rows: list):
        self.key = [r["qid"] for r in rows]
        self.length = np.array([max(len(r["words"]), 1) for r in rows])
        self.bound = np.array([r["document_id"] is not None for r in rows], bool)
        self.words = sorted({w for r in rows for w in r["words"]})
        number = {w: k for k, w in enumerate(self.words)}
        self.has = [np.unique([number[w] for w in r["words"]], return_counts=True) for r in rows]


class _Shard:
    """Which places of a shard hold each word, a bit each; and of questions with a document which places count."""

    def __init__(self, asked: _Asked, size: int):
        self.asked, self.size = asked, size
        self.bits = np.zeros((len(asked.words), size // 8), np.uint8)
        self.allowed: dict[int, np.ndarray] = {}

    def add(self, words: np.ndarray, places: np.ndarray) -> None:
        if len(places) > 8:
            row = np.zeros(self.size, bool)
            row[places] = True
            self.bits[words] |= np.packbits(row)
        else:
            for p in places:
                self.bits[words, p >> 3] |= np.uint8(128 >> (p & 7))

    def best(self, n: int, bars: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(question, places, scores) of the n best of each question; none below what the task has n of already."""
        for a in range(0, len(self.asked.key), BLOCK):
            block = range(a, min(a + BLOCK, len(self.asked.key)))
            words = np.unique(np.concatenate([self.asked.has[j][0] for j in block])).astype(np.int64)
            sums = np.zeros((len(block), self.size), np.float32)  # counts below 2**24 are exact
            for b in range(0, len(words), WORDS):
                own = words[b : b + WORDS]
                times = np.zeros((len(block), len(own)), np.float32)
                for j in block:
                    w, m = self.asked.has[j]
                    inside = slice(*np.searchsorted(w, [own[0], own[-1] + 1]))
                    times[j - a, np.searchsorted(own, w[inside])] = m[inside]
                sums += times @ np.unpackbits(self.bits[own], axis=1).astype(np.float32)
            for j in block:
                if self.asked.bound[j] and j not in self.allowed:
                    continue
                score = np.round(sums[j - a] / self.asked.length[j], retrieval.PLACES)
                hit = np.flatnonzero(score >= bars[j])
                if j in self.allowed:
                    hit = hit[np.isin(hit, self.allowed[j])]
                top = hit[np.argsort(-score[hit], kind="stable")[:n]]
                if len(top) == n:
                    bars[j] = max(bars[j], score[top[-1]])
                if len(top):
                    yield j, top, score[top]


def keyword_topk(spark: SparkSession, path: str, questions: DataFrame, n: int = 10, questions_a_pass: int = PASS, bits: int = BITS) -> DataFrame:
    """The rows of ``retrieval.keyword_topk`` from the index at path: qid, chunk_id, keyword_score, rank of the n best chunks of each of
    questions(qid, question[, document_id]) with a score above 0. The driver holds one pass of questions at a time, which ends before it has more than
    PASS_WORDS distinct words."""
    ship(spark)
    ask = retrieval._as_queries(questions).select("qid", "document_id", tokens("question").alias("words"))
    kind, out = questions.schema["qid"].dataType.simpleString(), None
    rows, words = [], set()
    for r in ask.orderBy("qid").toLocalIterator():
        if rows and (len(rows) == questions_a_pass or len(words) + len(set(r["words"])) > PASS_WORDS):
            found = _pass(spark, path, rows, n, kind, bits)
            out, rows, words = found if out is None else out.union(found), [], set()
        rows.append(r)
        words.update(r["words"])
    found = _pass(spark, path, rows, n, kind, bits)
    out = found if out is None else out.union(found)
    ids = out.join(_table(spark, path, "members"), ["shard", "place"]).select("qid", "chunk_id", F.col("kw").alias("keyword_score"))
    return ids.withColumn("rank", retrieval._rank("keyword_score", "qid")).where(F.col("rank") <= n)


def _pass(spark: SparkSession, path: str, rows: list, n: int, kind: str, bits: int) -> DataFrame:
    """qid, shard, place, kw of a pass of questions. Postings of the words that hold some question's word are shuffled by shard, and nothing else is."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = f"qid {kind}, shard long, place short, kw double"
    types = {f.name: f.type for f in to_arrow_schema(spark.createDataFrame([], schema).schema)}
    asked = _Asked(rows)
    shared = spark.sparkContext.broadcast(asked)
    words = spark.createDataFrame([(w,) for w in asked.words], "w string")
    needed = holders(spark, path, words).select("token").distinct()
    hits = _table(spark, path, "postings").join(needed, "token").select("shard", "token", F.lit(None).cast("int").alias("j"), "places")
    # Of a question with a document only its chunks count: rows without a word name them.
    bound = [(j, r["document_id"]) for j, r in enumerate(rows) if r["document_id"] is not None]
    if bound:
        of = spark.createDataFrame(bound, "j int, document_id string")
        masks = _table(spark, path, "members").join(of, "document_id").groupBy("shard", "j").agg(F.collect_list("place").alias("places"))
        hits = hits.unionByName(masks.select("shard", F.lit(None).cast("string").alias("token"), "j", "places"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: _Asked = shared.value
        look, bars = retrieval.WordsHeld(asked.words), np.full(len(asked.key), 1e-9)
        at, shard = None, None
        for batch in batches:
            lists = batch.column("places")
            flat, ends = lists.flatten().to_numpy().astype(np.int64), np.cumsum(lists.value_lengths().to_numpy())
            for now, token, j, end, begin in zip(*[batch.column(c).to_pylist() for c in ("shard", "token", "j")], ends, [0, *ends[:-1]]):
                if now != at:
                    if shard is not None:
                        yield packed(at, shard.best(n, bars), asked)
                    at, shard = now, _Shard(asked, 1 << bits)
                if token is None:
                    shard.allowed[j] = flat[begin:end]
                else:
                    shard.add(look.of(token), flat[begin:end])
        if shard is not None:
            yield packed(at, shard.best(n, bars), asked)

    def packed(shard: int, best: Iterator[tuple[int, np.ndarray, np.ndarray]], asked: _Asked) -> pa.RecordBatch:
        found = list(best)
        qids = [asked.key[j] for j, places, _ in found for _ in places]
        places, scores = (np.concatenate([np.zeros(0), *(x[k] for x in found)]) for k in (1, 2))
        return pa.RecordBatch.from_arrays([pa.array(qids, types["qid"]), pa.array(np.full(len(qids), shard)), pa.array(places.astype(np.int16)), pa.array(scores.astype(float))], ["qid", "shard", "place", "kw"])

    return hits.repartition("shard").sortWithinPartitions("shard").mapInArrow(run, schema)
