"""Spark helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.session import ship  # noqa: F401

_OWN: list[str] = []
Batches = Iterator[pa.RecordBatch]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def lean(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """run, giving freed memory back to the system at the end of a task: workers live on, beside the executor's heap."""

    def wrapped(batches: Batches) -> Batches:
        yield from run(batches)
        trim()

    return wrapped


def trim() -> None:
    """Gives memory that Arrow and the C library hold on to back to the system."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one only where none is set (local runs)."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _OWN:
        _OWN.append(f"file://{tempfile.mkdtemp(prefix='spark-docloom-')}")
    return _OWN[0]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: cuts the lineage and survives lost executors. The table goes when the
    application ends."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    trim()
    at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).deleteOnExit(at)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def id_fold(doc_id: str | Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % folds


def bit_filter(hashes: DataFrame, bits: int = 23) -> np.ndarray:
    """A bitmap of 2**bits bits with one hash function over the column ``h`` (long): a fixed 1 MB at 23.

    It only saves work: rows that it lets through wrongly are dropped by a later join, none is lost.
    """
    at = F.col("h").bitwiseAND(F.lit((1 << bits) - 1))
    rows = (
        hashes.select(F.shiftright(at, 6).alias("word"), F.expr(f"shiftleft(1L, int(h & 63L))").alias("bit"))
        .groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow()
    )  # at most 2**(bits - 6) rows
    out = np.zeros(1 << (bits - 6), np.int64)
    out[rows["word"].to_numpy()] = rows["bit"].to_numpy()
    return out


def bit_hit(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h & np.int64((len(bitmap) << 6) - 1)
    return (bitmap[at >> 6] >> (at & 63)) & 1 == 1


def unite(label: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Joins the groups of p and q pair by pair; label[i] is the first row of i's group, of which the label is itself."""
    while True:
        a, b = label[p], label[q]
        if (a == b).all():
            return label
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label != label[label]).any():
            label = label[label]


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges(a, b): (node, comp), comp being the smallest node of the component.

    Min-label propagation with pointer jumping: each round a node takes the least label among its own and its
    neighbours', then the label of that label, so chains shrink by powers. Every round is a join and a
    partially aggregated group-by, written to the shared folder; the driver sees one count a round.
    """
    both = materialize(
        edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges"
    )
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("comp")), "labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("comp").alias("near"))
        step = labels.join(near, labels.node == near.a).select("node", F.col("comp").alias("was"), F.least("comp", "near").alias("comp"))
        up = labels.select(F.col("node").alias("via"), F.col("comp").alias("root"))
        step = step.join(up, step.comp == up.via).select("node", F.least("comp", "root").alias("comp"), (F.least("comp", "root") < F.col("was")).alias("moved"))
        step = materialize(step, "labels")
        labels = step.select("node", "comp")
        if not step.where("moved").limit(1).count():
            return labels
