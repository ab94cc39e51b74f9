"""A learned embedding: texts in the space of the strongest directions of the corpus's term matrix.

Words are hashed to FEATURES columns and weighted by frequency in the text and rarity in the corpus. The leading right singular vectors of that matrix come from
block power iteration: each round is one pass over the corpus, in which every task multiplies its rows with the block and back; partial products are
summed by column. The block has FEATURES x dim numbers, whatever the corpus, so the driver holds and broadcasts it.
Words that keep the same company get directions alike, so texts without a word in common can be near.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.text import tokens
from docloom.operators import retrieval
from docloom.session import ship, spread, written

#: Columns of the term matrix; directions beyond those asked for, which steady the iteration; terms that are multiplied at once.
FEATURES, MORE, TERMS = 1 << 15, 16, 1 << 17
ROUNDS = 4


def features(text: str | Column, n: int = FEATURES) -> Column:
    """The columns of a text's words, in turn; null for a null text."""
    return F.transform(tokens(text), lambda w: F.pmod(F.xxhash64(w), F.lit(n)).cast("int"))


@dataclass
class Model:
    """Rarity of each column, and its place in the space."""

    idf: np.ndarray
    basis: np.ndarray

    def weights(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """Runs of rows of a list<int> column: (first row, end, row, column and weight of each distinct term). The weights of a row have length 1."""
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat, ends = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.cumsum(size)
        a = 0
        while a < len(size):
            done = ends[a - 1] if a else 0
            b = max(a + 1, int(np.searchsorted(ends, done + TERMS, "right")))
            row = np.repeat(np.arange(b - a), size[a:b])
            pair, n = np.unique(row * len(self.idf) + flat[done : ends[b - 1]], return_counts=True)
            row, term = pair // len(self.idf), pair % len(self.idf)
            w = (1 + np.log(n)) * self.idf[term]
            length = np.sqrt(np.bincount(row, w * w, b - a))
            yield a, b, row, term, w / length[row]
            a = b

    def project(self, column: pa.Array) -> np.ndarray:
        """Unit vectors of the rows, zero for rows without words."""
        out = np.zeros((len(column), self.basis.shape[1]))
        for a, b, row, term, w in self.weights(column):
            out[a:b] = _sums(self.basis[term] * w[:, None], row, b - a)
        n = np.sqrt((out * out).sum(1, keepdims=True))
        return out / np.where(n > 0, n, 1)

    def save(self, spark: SparkSession, path: str) -> None:
        rows = pa.table({"feature": pa.array(np.arange(len(self.idf), dtype=np.int32)), "idf": self.idf, "vector": pa.array(list(self.basis), pa.list_(pa.float64()))})
        spark.createDataFrame(rows).coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Model:
        rows = spark.read.parquet(path).orderBy("feature").toArrow()  # FEATURES rows
        return cls(rows["idf"].to_numpy(), np.array(rows["vector"].to_pylist()))


def _sums(values: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows by group, which ascends."""
    out = np.zeros((n, values.shape[1]))
    first = np.flatnonzero(np.diff(group, prepend=-1))
    if len(first):
        out[group[first]] = np.add.reduceat(values, first)
    return out


def _product(rows: DataFrame, model: Model) -> np.ndarray:
    """The term matrix's square times the model's basis: one pass over rows(terms). A task gives at most a row for each column."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        total = np.zeros(model.basis.shape)
        for batch in batches:
            for a, b, row, term, w in model.weights(batch.column("terms")):
                own = _sums(model.basis[term] * w[:, None], row, b - a)
                order = np.argsort(term, kind="stable")
                total += _sums(own[row[order]] * w[order, None], term[order], len(total))
        at = np.flatnonzero(total.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array([x.tobytes() for x in total[at]], pa.binary())], ["feature", "part"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, part in zip(batch.column("feature").to_pylist(), np.frombuffer(b"".join(batch.column("part").to_pylist())).reshape(batch.num_rows, -1)):
                sums[k] = sums[k] + part if k in sums else part
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["feature", "part"])

    schema = "feature int, part binary"  # the numbers of a column, as they lie in memory
    parts = rows.mapInArrow(run, schema).withColumn("task", F.spark_partition_id())
    summed = parts.repartition("feature").sortWithinPartitions("feature", "task").select("feature", "part").mapInArrow(add, schema).toArrow()  # a row for each column
    out = np.zeros(model.basis.shape)
    if summed.num_rows:
        out[summed["feature"].to_numpy()] = np.frombuffer(b"".join(summed["part"].to_pylist())).reshape(summed.num_rows, -1)
    return out


def fit(texts: DataFrame, dim: int = retrieval.DIM, seed: int = 7, rounds: int = ROUNDS, n_features: int = FEATURES) -> Model:
    """A model from all of texts(text). Null texts and texts without words count for nothing. The same seed gives the same space, up to the last digits where
    rows are dealt over tasks in another way."""
    ship(texts.sparkSession)
    rows = written(spread(texts.select("text")).select(features("text", n_features).alias("terms")).where("size(terms) > 0"), "terms")
    seen = rows.select(F.explode(F.array_distinct("terms")).alias("feature")).groupBy("feature").count().toArrow()  # a row for each column
    n, held = rows.count(), np.zeros(n_features)
    if seen.num_rows:
        held[seen["feature"].to_numpy()] = seen["count"].to_numpy()
    idf = np.log((1 + n) / (1 + held)) + 1
    block = np.linalg.qr(np.random.default_rng(seed).normal(size=(n_features, dim + MORE)))[0]
    for k in range(rounds):
        image = _product(rows, Model(idf, block))
        if k < rounds - 1:
            block = np.linalg.qr(image)[0]
    strength, turn = np.linalg.eigh((block.T @ image + image.T @ block) / 2)
    best = np.argsort(-strength, kind="stable")[:dim]
    basis = block @ turn[:, best]
    sign = np.sign(basis[np.abs(basis).argmax(0), np.arange(dim)])
    return Model(idf, np.round(basis * np.where(sign == 0, 1, sign), 9))


def embed(rows: DataFrame, model: Model | None, text: str = "text", to: str = "embedding") -> DataFrame:
    """Adds the unit vector of a text column to rows, as array<double>; zero for texts without words, null ones too. Without a model it is the hashed one."""
    if model is None:
        return rows.withColumn(to, retrieval.hash_embed(F.coalesce(F.col(text), F.lit(""))))
    ship(rows.sparkSession)
    shared, n = rows.sparkSession.sparkContext.broadcast(model), len(model.idf)

    @F.pandas_udf("array<double>")
    def run(terms: pd.Series) -> pd.Series:
        return pd.Series(list(shared.value.project(pa.array([list(t) if t is not None else [] for t in terms], pa.list_(pa.int32())))))

    return rows.withColumn(to, run(features(text, n)))


def first_model(spark: SparkSession, paths: Sequence[str]) -> Model | None:
    """The first model that is there, of paths in the order of preference; None, which stands for the hashed embedding, if there is none."""
    for path in paths:
        try:
            return Model.load(spark, path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    return None


def topk(chunks: DataFrame, questions: DataFrame, model: Model | None, n: int = 10) -> DataFrame:
    """``retrieval.semantic_topk`` by the model's vectors."""
    held = embed(spread(chunks.select("chunk_id", "document_id", "text")), model)
    return retrieval.semantic_topk(held, embed(questions, model, "question", "vector"), n)
