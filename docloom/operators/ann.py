"""Approximate nearest neighbours: a persisted inverted-file index with product-quantised residuals.

Unit vectors lie in cells around centres; an index folder holds

- ``model``: one row with the centres and the codebooks, fitted on a bounded sample;
- ``rows``: a folder for each cell, of rows (chunk_id, document_id, code, embedding); a code is one byte for each part of the vector's residual.

A question looks into the cells with the nearest centres. There codes alone are read and scored by sums of table entries; the short list is then scored
exactly from the stored vectors. Rows are added to an index without touching those that are there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.operators import retrieval
from docloom.session import ship, spread

#: Rows on which centres and codebooks are fitted at most.
SAMPLE = 65_536
#: Parts of a vector, and centres of each part's codebook (a byte tells them apart).
PARTS, CODES = 16, 256
#: Cells of an index at most, so that the model has a bounded size.
MAX_CELLS = 8192
#: Questions of a pass, broadcast together; and questions that meet a cell's codes at once.
PASS, BLOCK = 65_536, 1024


def unit(vectors: np.ndarray) -> np.ndarray:
    n = np.sqrt((vectors * vectors).sum(1, keepdims=True))
    return vectors / np.where(n > 0, n, 1)


def kmeans(points: np.ndarray, k: int, rounds: int, rng: np.random.Generator, spherical: bool = False) -> np.ndarray:
    """k centres of points by Lloyd's rounds; an empty one moves to the point that is worst off."""
    if not len(points):
        return np.zeros((k, points.shape[1]))
    centres = points[rng.choice(len(points), k, replace=len(points) < k)].copy()
    for _ in range(rounds):
        own, far = nearest(points, centres)
        count, order = np.bincount(own, minlength=k), np.argsort(own, kind="stable")
        sums, full = np.zeros_like(centres), np.flatnonzero(count)
        sums[full] = np.add.reduceat(points[order], (np.cumsum(count) - count)[full])
        centres = sums / np.maximum(count, 1)[:, None]
        empty = np.flatnonzero(count == 0)
        centres[empty] = points[np.argsort(-far, kind="stable")[: len(empty)]] if len(empty) <= len(points) else points[rng.choice(len(points), len(empty))]
        centres = unit(centres) if spherical else centres
    return centres


def nearest(points: np.ndarray, centres: np.ndarray, block: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """(the nearest centre of each point, its squared distance)."""
    half = (centres * centres).sum(1) / 2
    own, far = np.empty(len(points), np.int64), np.empty(len(points))
    for a in range(0, len(points), block):
        gain = points[a : a + block] @ centres.T - half
        own[a : a + block] = gain.argmax(1)
        far[a : a + block] = (points[a : a + block] ** 2).sum(1) - 2 * gain.max(1)
    return own, far


class Model:
    """Centres of the cells and, for each part of a residual, a codebook."""

    def __init__(self, centres: np.ndarray, books: np.ndarray):
        self.centres, self.books = centres, books  # cells x dim; parts x CODES x dim / parts
        self.width = books.shape[2]

    @classmethod
    def fit(cls, points: np.ndarray, cells: int, parts: int, seed: int) -> Model:
        rng, dim = np.random.default_rng(seed), points.shape[1]
        centres = kmeans(points, cells, 8, rng, spherical=True)
        rest = points - centres[nearest(points, centres)[0]] if len(points) else points
        width = dim // parts
        return cls(centres, np.stack([kmeans(np.ascontiguousarray(rest[:, p * width : (p + 1) * width]), CODES, 8, rng) for p in range(parts)]))

    def encode(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cell, code) of unit vectors."""
        cell = nearest(points, self.centres)[0]
        rest = points - self.centres[cell]
        parts = [nearest(np.ascontiguousarray(rest[:, p * self.width : (p + 1) * self.width]), book)[0] for p, book in enumerate(self.books)]
        return cell, np.stack(parts, 1).astype(np.uint8) if parts else np.zeros((len(points), 0), np.uint8)

    def probes(self, questions: np.ndarray, n: int) -> np.ndarray:
        """The n cells with the nearest centres of each question, nearest first."""
        return np.argsort(-(questions @ self.centres.T), axis=1, kind="stable")[:, :n]

    def tables(self, questions: np.ndarray) -> np.ndarray:
        """Products of each question's parts with the codebooks: questions x parts x CODES."""
        return np.einsum("qpw,pcw->qpc", questions.reshape(len(questions), len(self.books), self.width), self.books)

    def save(self, spark: SparkSession, path: str) -> None:
        row = (self.centres.ravel().tolist(), self.books.ravel().tolist(), *self.books.shape, len(self.centres))
        spark.createDataFrame([row], "centres array<double>, books array<double>, parts int, codes int, width int, cells int").coalesce(1).write.mode("overwrite").parquet(f"{path}/model")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Model:
        r = spark.read.parquet(f"{path}/model").first()
        return cls(np.array(r["centres"]).reshape(r["cells"], -1), np.array(r["books"]).reshape(r["parts"], r["codes"], r["width"]))


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    """Unit vectors of an array<double> column; rows without a whole vector of finite numbers are zero."""
    rows = [v if v is not None and len(v) == dim else None for v in column.to_pylist()]
    out = np.array([[np.nan if x is None else x for x in v] if v is not None else [0.0] * dim for v in rows], float).reshape(len(rows), dim)
    out[~np.isfinite(out).all(1)] = 0
    return unit(out)


def build(chunks: DataFrame, path: str, cells: int | None = None, parts: int = PARTS, sample: int = SAMPLE, seed: int = 11, dim: int | None = None) -> None:
    """Fits a model on a seeded sample of chunks(chunk_id, document_id, embedding), at most ``sample`` rows, and writes the index of all rows to path.

    cells: by default twice the square root of the rows, MAX_CELLS at most. dim, the vectors' length, is by default that of most rows;
    it is a multiple of parts.
    """
    spark = chunks.sparkSession
    n = chunks.count()
    usual = chunks.where("size(embedding) > 0").groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    dim = dim or (usual["dim"] if usual else retrieval.DIM)
    if dim % parts:
        raise ValueError(f"vectors of {dim} numbers have no {parts} equal parts")
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "chunk_id"), 11).cast("double") / float(1 << 53)
    rows = chunks.where(draw < 0.9 * sample / max(n, 1)).select("chunk_id", "embedding").limit(sample).orderBy("chunk_id").toArrow()  # at most ``sample`` rows
    points = _vectors(rows["embedding"], dim)
    points = points[(points != 0).any(1)]
    Model.fit(points, min(MAX_CELLS, cells or max(1, int(2 * n**0.5))), parts, seed).save(spark, path)
    add(chunks, path)


def add(chunks: DataFrame, path: str) -> None:
    """Writes rows of chunks(chunk_id, document_id, embedding) into an index that is there. Rows without a vector, or with a zero one, lie in cell 0.
    Partitions are cut to size as they are known, so that a cell with most of the rows is no single task's."""
    spark = chunks.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(Model.load(spark, path))  # at most MAX_CELLS centres and the codebooks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            points = _vectors(batch.column("embedding"), model.centres.shape[1])
            cell, code = model.encode(points)
            cell[~(points != 0).any(1)] = 0
            yield pa.RecordBatch.from_arrays([
                batch.column("chunk_id"), batch.column("document_id"), pa.array(cell.astype(np.int32)), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(list(points), pa.list_(pa.float64())),
            ], ["chunk_id", "document_id", "cell", "code", "embedding"])

    rows = chunks.select("chunk_id", "document_id", F.col("embedding").cast("array<double>").alias("embedding"))
    coded = spread(rows).mapInArrow(run, "chunk_id string, document_id string, cell int, code binary, embedding array<double>")
    coded.hint("rebalance", "cell").sortWithinPartitions("cell", "chunk_id").write.mode("append").partitionBy("cell").parquet(f"{path}/rows")


def index_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("chunk_id string, document_id string, code binary, embedding array<double>, cell int").parquet(f"{path}/rows")


class _Asked:
    """A pass of questions: unit vectors, their tables of products, and which of them look into each cell."""

    def __init__(self, model: Model, qids: list, vectors: np.ndarray, probes: int):
        self.model, self.qids, self.vectors = model, qids, vectors
        cells = model.probes(vectors, probes) if len(qids) else np.zeros((0, 1), np.int64)
        order = np.argsort(cells.ravel(), kind="stable")
        self.flat, self.question = cells.ravel()[order], order // cells.shape[1]
        self.cells = np.unique(self.flat)

    def of(self, cell: int) -> np.ndarray:
        a, b = np.searchsorted(self.flat, [cell, cell + 1])
        return self.question[a:b]


def short_lists(spark: SparkSession, path: str, questions: DataFrame, keep: int, probes: int, questions_a_pass: int = PASS) -> tuple[DataFrame, list[int]]:
    """(qid, cell, chunk_id, guess: of each question(qid, vector) at least its ``keep`` best rows by codes in the ``probes`` nearest cells; the cells that some
    question looks into). Of the index only those cells' folders are read, and there only ids and codes. At most ``keep`` rows of a question come from a
    task. The driver holds one pass of questions at a time."""
    ship(spark)
    model = Model.load(spark, path)
    kind = questions.schema["qid"].dataType.simpleString()
    schema, out = f"qid {kind}, cell int, chunk_id string, guess double", None
    cells: set[int] = set()
    from pyspark.sql.pandas.types import to_arrow_schema

    result = to_arrow_schema(spark.createDataFrame([], schema).schema)

    def run_for(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked: _Asked = shared.value
            best: dict[tuple[int, int], list[pd.DataFrame]] = {}
            for batch in batches:
                cells = batch.column("cell").to_numpy()
                ids = batch.column("chunk_id").to_numpy(zero_copy_only=False)
                codes = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(len(ids), -1)
                for cell in np.unique(cells):
                    own = np.flatnonzero(cells == cell)
                    who = asked.of(cell)
                    for a in range(0, len(who), BLOCK):
                        part = who[a : a + BLOCK]
                        tables = asked.model.tables(asked.vectors[part])
                        guess = np.tile((asked.vectors[part] @ asked.model.centres[cell])[:, None], (1, len(own)))
                        for p in range(codes.shape[1]):
                            guess += tables[:, p, codes[own, p]]
                        for q, g in zip(part, guess):
                            top = np.argsort(-g, kind="stable")[:keep]
                            best.setdefault(q, []).append((g[top], np.full(len(top), cell), ids[own[top]]))
                            if len(best[q]) > 16:
                                best[q] = [_best(best[q], keep)]
            for q, found in best.items():
                g, cell, ids = _best(found, keep)
                frame = pd.DataFrame({"qid": [asked.qids[q]] * len(g), "cell": cell.astype(np.int32), "chunk_id": ids, "guess": g})
                yield pa.RecordBatch.from_pandas(frame, schema=result, preserve_index=False)

        return run

    for part in _passes(questions, questions_a_pass):
        asked = _Asked(model, [r["qid"] for r in part], unit(np.array([r["vector"] for r in part], float).reshape(len(part), -1)), min(probes, len(model.centres)))
        rows = index_rows(spark, path).where(F.col("cell").isin(asked.cells.tolist())).select("chunk_id", "code", "cell")
        found = rows.mapInArrow(run_for(spark.sparkContext.broadcast(asked)), schema)
        out = found if out is None else out.union(found)
        cells.update(asked.cells.tolist())
    return out if out is not None else spark.createDataFrame([], schema), sorted(cells)


def _best(found: list, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    g, cell, ids = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((ids.astype(str), -g))[:keep]
    return g[order], cell[order], ids[order]


def _passes(questions: DataFrame, size: int) -> Iterator[list]:
    part: list = []
    for r in questions.select("qid", "vector").where("vector IS NOT NULL").orderBy("qid").toLocalIterator():
        part.append(r)
        if len(part) == size:
            yield part
            part = []
    if part:
        yield part


def cosine(a: Column, b: Column) -> Column:
    """The cosine of two arrays; 0 where one is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda i, j: i * j), F.lit(0.0), lambda s, i: s + i)
    length = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.round(F.when(length > 0, dot(a, b) / length).otherwise(0.0), retrieval.PLACES) + F.lit(0.0)


def rerank_exact(candidates: DataFrame, vectors: DataFrame, questions: DataFrame, n: int) -> DataFrame:
    """qid, chunk_id, similarity, rank of the n best of candidates(qid, chunk_id[, cell]) by the vectors themselves, ties by chunk_id.
    vectors(chunk_id, embedding[, cell]) meet the candidates on all columns that both have; questions(qid, vector)."""
    on = ["cell", "chunk_id"] if "cell" in candidates.columns and "cell" in vectors.columns else ["chunk_id"]
    rows = candidates.select("qid", *on).join(vectors.select(*on, "embedding"), on).join(questions.select("qid", "vector"), "qid")
    rows = rows.select("qid", "chunk_id", cosine(F.col("vector"), F.col("embedding")).alias("similarity"))
    return rows.withColumn("rank", retrieval._rank("similarity", "qid")).where(F.col("rank") <= n)


def search(spark: SparkSession, path: str, questions: DataFrame, n: int = 10, probes: int = 128, shortlist: int = 20, documents: DataFrame | None = None) -> DataFrame:
    """qid, chunk_id, similarity, rank of the n nearest rows of the index at path for questions(qid, vector[, document_id]).

    Questions without a document look into ``probes`` cells and score ``shortlist`` times n rows exactly. Those with a document are answered exactly from
    documents(chunk_id, document_id, embedding), a table that finds a document's rows quickly, by default the index itself. A question with a null vector has no rows, one with a zero vector similarities of 0.
    """
    if "document_id" not in questions.columns:
        questions = questions.withColumn("document_id", F.lit(None).cast("string"))
    free, bound = questions.where("document_id IS NULL"), questions.where("document_id IS NOT NULL AND vector IS NOT NULL")
    rows = index_rows(spark, path)
    found, cells = short_lists(spark, path, free, shortlist * n, probes)
    best = F.row_number().over(Window.partitionBy("qid").orderBy(F.col("guess").desc(), "chunk_id"))
    near = rerank_exact(found.withColumn("_n", best).where(F.col("_n") <= shortlist * n), rows.where(F.col("cell").isin(cells)), free, n)
    own = (documents or rows).select("chunk_id", "document_id", "embedding").join(bound, "document_id")
    own = own.select("qid", "chunk_id", cosine(F.col("vector"), F.col("embedding")).alias("similarity"))
    return near.union(own.withColumn("rank", retrieval._rank("similarity", "qid")).where(F.col("rank") <= n))


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """qid and recall: the share of the exact rows' number that found reaches with a similarity not below the worst exact one, as equal rows are as good."""
    floor = exact.groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.min("similarity").alias("floor"))
    rows = floor.join(found.select("qid", "similarity"), "qid", "left")
    return rows.groupBy("qid", "n").agg(F.count_if(F.col("similarity") >= F.col("floor")).alias("hit")).select("qid", F.round(F.col("hit") / F.col("n"), 6).alias("recall"))
