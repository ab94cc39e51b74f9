"""Files as bytes, read by workers in blocks: what neither a row nor a task's memory has to hold."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from docloom.session import ship
from docloom.sources.files import listing

BLOCK = 1 << 20


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """(file system, path in it) of a path as Spark lists it: with a scheme, not percent-encoded; without one it is local."""
    found = re.fullmatch(r"([A-Za-z][A-Za-z0-9+.-]*):(?://([^/]*))?(/.*)?", path, re.DOTALL)
    if found is None or found[1] == "file":
        return fs.LocalFileSystem(), path if found is None else found[3] or "/"
    system, base = fs.FileSystem.from_uri(f"{found[1]}://{found[2] or ''}/")
    return system, base.rstrip("/") + (found[3] or "")


def qualified(spark: SparkSession, path: str, resolve: bool = True) -> str:
    """path with the scheme of the session's file system, mount points resolved, so that workers read where the driver lists."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return (system.resolvePath(at) if resolve and system.exists(at) else system.makeQualified(at)).toString()


def digest(path: str, block: int = BLOCK) -> str | None:
    """SHA-256 of a file's bytes in lowercase hex, read in blocks; None where it is gone."""
    system, at = opened(path)
    found = hashlib.sha256()
    try:
        with system.open_input_stream(at, buffer_size=0) as file:
            while part := file.read(block):
                found.update(part)
    except FileNotFoundError:
        return None
    return found.hexdigest()


def hashed(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``listing`` with content_hash, for files of any size: a worker holds a block of 1 MB, never a file. A file that went since it was listed has a null hash.

    Tasks are packed by the files' sizes. A file is hashed by one task, as SHA-256 goes from its first byte to its last. In a store that workers can't open, but
    Spark reads, the files go through rows and have to be below 2 GB.
    """
    listed, resolved = qualified(spark, path, resolve=False), qualified(spark, path)
    try:
        opened(resolved)
    except (ValueError, OSError, ImportError):  # no such file system outside the JVM
        return listing(spark, path, pattern, with_content=True)
    ship(spark)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(content_hash=[digest(resolved + p.removeprefix(listed)) for p in frame["path"]])

    return listing(spark, path, pattern).mapInPandas(run, "path string, size_bytes long, mtime long, present boolean, content_hash string")
