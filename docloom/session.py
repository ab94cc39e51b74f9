"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []


def ship(spark: SparkSession | None = None) -> None:
    """Lets Python workers import this package from where the driver has it."""
    spark = spark or SparkSession.getActiveSession()
    root, env = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    known = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in known and root not in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in [root, *known] if x)


def new_folder(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that the session names in spark.checkpoint.dir, a temporary one only where none is set (local runs). What is
    written there goes when the application ends."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _OWN:
            _OWN.append(f"file://{tempfile.mkdtemp(prefix='spark-docloom-')}")
        base = _OWN[0]
    path = f"{base}/{name}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(at)  # what does not exist yet is not deleted at the end
    system.deleteOnExit(at)
    return path


@contextmanager
def configured(spark: SparkSession, conf: dict[str, str]) -> Iterator[None]:
    """conf holds inside."""
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def written(rows: DataFrame, name: str, conf: dict[str, str] | None = None) -> DataFrame:
    """rows, written as Parquet to the shared folder and read back, so that they are computed once. conf holds while they are written."""
    path = f"{new_folder(rows.sparkSession, name)}/rows"
    with configured(rows.sparkSession, conf or {}):
        rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def spread(rows: DataFrame) -> DataFrame:
    """rows over as many partitions as there are cores, where the plan reads too little to fill them: a small file may be a single row group, which one task
    reads. Larger inputs stay as they are, without a shuffle."""
    spark = rows.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return rows.repartition(cores) if int(size) < cores * (64 << 20) else rows
