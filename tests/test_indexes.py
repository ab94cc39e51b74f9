"""The vector index and the substring index against exact search."""

import shutil
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.operators import ann, postings, retrieval

DIM = 32


def clustered(n, seed):
    """Vectors around 40 centres, many close together."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(40, DIM))
    return ann.unit(centres[rng.integers(0, 40, n)] + 0.6 * rng.normal(size=(n, DIM)))


@pytest.fixture(scope="module")
def vectors(spark):
    rows = [(f"c{i:05d}", f"d{i % 50}", v.tolist()) for i, v in enumerate(clustered(6000, 1))]
    rows += [("none", "d1", None), ("zero", "d1", [0.0] * DIM), ("nan", "d2", [float("nan")] * DIM), ("short", "d2", [1.0])]
    return spark.createDataFrame(rows, "chunk_id string, document_id string, embedding array<double>").repartition(4).cache()


@pytest.fixture(scope="module")
def asked(spark):
    rows = [(i, v.tolist(), f"d{i % 50}" if i % 5 == 0 else None) for i, v in enumerate(clustered(60, 2))]
    return spark.createDataFrame(rows, "qid int, vector array<double>, document_id string").cache()


def exact_rows(vectors, asked, n):
    held = [(r["chunk_id"], r["document_id"], np.array(r["embedding"])) for r in vectors.collect() if r["embedding"] and len(r["embedding"]) == DIM and np.isfinite(r["embedding"]).all()]
    out = {}
    for q in asked.collect():
        scored = sorted((-round(float(v @ np.array(q["vector"])) / max(np.linalg.norm(v), 1e-300) / np.linalg.norm(q["vector"]), 6), c) for c, d, v in held if q["document_id"] in (None, d))
        out[q["qid"]] = [(c, -s) for s, c in scored[:n]]
    return out


def test_recall_and_probed_cells_only(spark, vectors, asked, tmp_path):
    path = f"file://{tmp_path}/index"
    ann.build(vectors, path, cells=64, seed=3)
    assert ann.index_rows(spark, path).count() == vectors.count()
    want = exact_rows(vectors, asked, 10)
    got = {}
    for r in ann.search(spark, path, asked, 10, probes=12).orderBy("qid", "rank").collect():
        got.setdefault(r["qid"], []).append((r["chunk_id"], r["similarity"]))
    hit = sum(len({c for c, _ in got[q]} & {c for c, _ in rows}) for q, rows in want.items())
    assert hit >= 0.95 * sum(map(len, want.values()))
    bound = [r["qid"] for r in asked.where("document_id IS NOT NULL").collect()]
    for q in bound:
        real = [(c, s) for c, s in got[q] if c not in ("zero", "nan", "short", "none")]
        assert [c for c, _ in real] == [c for c, s in want[q] if s > 0][: len(real)] or real == want[q]
    # Without the folders of cells that no question looks into the answer is the same; without one that some does it is not.
    free = asked.where("document_id IS NULL").limit(3)
    before = [tuple(r) for r in ann.search(spark, path, free, 10, probes=4).orderBy("qid", "rank").collect()]
    _, cells = ann.short_lists(spark, path, free, 10, 4)
    folders = {int(p.name.split("=")[1]): p for p in (tmp_path / "index" / "rows").glob("cell=*")}
    assert len(cells) <= 12 < len(folders)
    for cell in set(folders) - set(cells):
        shutil.rmtree(folders[cell])
    assert [tuple(r) for r in ann.search(spark, path, free, 10, probes=4).orderBy("qid", "rank").collect()] == before


def test_added_rows_are_found(spark, vectors, asked, tmp_path):
    path = f"file://{tmp_path}/index"
    ann.build(vectors, path, cells=32)
    free = asked.where("document_id IS NULL")
    ann.add(free.select(F.concat(F.lit("same"), "qid").alias("chunk_id"), F.lit("new").alias("document_id"), F.col("vector").alias("embedding")), path)
    first = {r["qid"]: r["chunk_id"] for r in ann.search(spark, path, free, 3, probes=2).where("rank = 1").collect()}
    assert first == {r["qid"]: f"same{r['qid']}" for r in free.collect()}


def test_many_equal_rows_and_empty_tables(spark, vectors, asked, tmp_path):
    """A cell with most of the rows; and no rows at all."""
    same = spark.range(3000).select(F.concat(F.lit("e"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("chunk_id"), F.lit("d").alias("document_id"), F.array(*[F.lit(1.0)] * DIM).alias("embedding"))
    ann.build(same, f"file://{tmp_path}/same", cells=8)
    free = asked.where("document_id IS NULL")
    got = ann.search(spark, f"file://{tmp_path}/same", free, 5).where("qid = 1").orderBy("rank").collect()
    assert [r["chunk_id"] for r in got] == [f"e{k:05d}" for k in range(5)], "ties go by chunk_id"
    ann.build(vectors.where("false"), f"file://{tmp_path}/none", dim=DIM)
    assert ann.search(spark, f"file://{tmp_path}/none", free, 5).collect() == []
    assert ann.search(spark, f"file://{tmp_path}/same", free.where("false"), 5).collect() == []


def test_codes_stand_for_vectors():
    points = clustered(3000, 4)
    model = ann.Model.fit(points, 40, 8, 1)
    cell, code = model.encode(points)
    back = model.centres[cell] + np.concatenate([book[code[:, p]] for p, book in enumerate(model.books)], axis=1)
    assert ((points - back) ** 2).sum(1).mean() < 0.6 * ((points - model.centres[cell]) ** 2).sum(1).mean()
    tables = model.tables(points[:5])
    guess = (points[:5] @ model.centres.T)[:, cell] + sum(tables[:, p, code[:, p]] for p in range(8))
    assert np.allclose(guess, points[:5] @ back.T)


# Substring index

TEXTS = ["The quick brown fox", "quickly, then Élan", "a", "", None, "brownish foxes jump", "日本語 text 日本", "ab abc abcd", "x" * 5000, "in the inn", "QUICK quick", "  "]


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(f"c{i:04d}", f"d{i % 7}", t) for i, t in enumerate(TEXTS * 40)] + [(f"h{i:04d}", "hot", f"the hot {i % 13} one{i}") for i in range(900)]
    return spark.createDataFrame(rows, "chunk_id string, document_id string, text string").repartition(3).cache()


@pytest.fixture(scope="module")
def words(spark):
    rows = [(1, "quick fox", None), (2, "a", None), (3, "日本 in", None), (4, "nothinglikethis", None), (5, "the the THE hot", None), (6, "abc ab quick", "d3"), (7, "hot one", "hot"), (8, "quick", "d99"), (9, "", None), (10, "xxx", None), (11, "one12 13", None)]
    return spark.createDataFrame(rows, "qid int, question string, document_id string").cache()


def same(a, b):
    order = lambda df: sorted(tuple(r) for r in df.select("qid", "chunk_id", "keyword_score", "rank").collect())
    return order(a) == order(b)


@pytest.mark.parametrize("bits", [4, 7, 14])
def test_index_gives_the_rows_of_the_scan(spark, texts, words, bits, tmp_path):
    path = f"file://{tmp_path}/index"
    first = F.col("chunk_id") < "c0200"
    postings.add(texts.where(first), path, bits)
    assert same(postings.keyword_topk(spark, path, words, 6, bits=bits), retrieval.keyword_topk(texts.where(first), words, 6))
    postings.add(texts.where(~first), path, bits)
    got = postings.keyword_topk(spark, path, words, 6, bits=bits)
    assert same(got, retrieval.keyword_topk(texts, words, 6))
    assert same(postings.keyword_topk(spark, path, words, 6, questions_a_pass=2, bits=bits), got)
    assert postings._table(spark, path, "tokens").groupBy("h", "token").count().where("count > 1").count() == 0
    assert postings._table(spark, path, "members").groupBy("shard").count().agg(F.max("count")).first()[0] <= 1 << bits


def test_chunk_table_is_not_in_the_plan(spark, texts, words, tmp_path):
    texts.write.parquet(f"file://{tmp_path}/source_rows")
    postings.add(spark.read.parquet(f"file://{tmp_path}/source_rows"), f"file://{tmp_path}/index")
    shutil.rmtree(Path(tmp_path) / "source_rows")
    found = postings.keyword_topk(spark, f"file://{tmp_path}/index", words)
    assert "source_rows" not in found._jdf.queryExecution().toString() and found.count() > 20


def test_empty_index_and_no_questions(spark, texts, words, tmp_path):
    path = f"file://{tmp_path}/index"
    postings.add(texts.where("false"), path)
    assert postings.keyword_topk(spark, path, words).collect() == []
    postings.add(texts, path)
    assert postings.keyword_topk(spark, path, words.where("false")).collect() == []
    assert same(postings.keyword_topk(spark, path, words), retrieval.keyword_topk(texts, words))
