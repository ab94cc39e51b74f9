"""Event logs as a data source: ``spark.read.format("event_log")``, ``readStream`` and ``write``.

A log is a text of blocks, each ended by an empty line. Files are read in splits of bytes; a block is read by the split that its first byte lies in, so blocks
across splits are whole and a log needs no sort. Rows are log_id (the file), offset (the block's first byte in the file), event and data, by the rules of
``progress.parse_event_log``: the type of a block without data holds for the next, and a block that no empty line ends is not given.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceStreamWriter, DataSourceWriter, InputPartition, WriterCommitMessage

from docloom.session import ship
from docloom.sources.blobs import BLOCK, opened, qualified

#: A line feed and an empty line behind it; the block after it begins at the match's end.
GAP = re.compile(rb"\n\r?\n")

SPLIT = 128 << 20
PENDING = "_pending"


@dataclass
class Split(InputPartition):
    path: str
    start: int
    end: int
    limit: int  # bytes of the file that exist for this read


@dataclass
class Written(WriterCommitMessage):
    name: str | None


def fields(block: bytes) -> tuple[str | None, str | None]:
    """(type, data) of a block, None for what it lacks."""
    kind, data = None, []
    for line in block.split(b"\n"):
        line = line.removesuffix(b"\r").decode("utf-8", "replace")
        if line.startswith("event:"):
            kind = line[6:].strip(" ")
        elif line.startswith("data:"):
            data.append(line[5:].removeprefix(" "))
    return kind, "\n".join(data) if data else None


class Bytes:
    """A file's bytes before ``limit``, in blocks."""

    def __init__(self, file, limit: int) -> None:
        self.file, self.limit = file, limit

    def at(self, start: int, end: int) -> bytes:
        self.file.seek(start)
        return self.file.read(max(0, min(end, self.limit) - start))

    def first_block(self, start: int, end: int) -> int | None:
        """Where the first block begins that begins in [start, end)."""
        if start == 0:
            return 0
        at = max(0, start - 3)
        while at < end:
            # The file's start counts as a line feed; two bytes more than a block are read, so that a gap across two reads is seen.
            head = b"\n" if at == 0 else b""
            part = head + self.at(at, at + BLOCK + 2)
            if len(part) < 2:
                return None
            from_ = 0
            while found := GAP.search(part, from_):
                begin = at - len(head) + found.end()
                if begin >= end:
                    return None
                if begin >= start:
                    return begin
                from_ = found.start() + 1
            at += BLOCK
        return None

    def blocks(self, begin: int, end: int) -> Iterator[tuple[int, bytes]]:
        """(offset, bytes) of the ended blocks that begin in [begin, end), a block beginning at ``begin``; the last may go beyond ``end``."""
        held, at, done, looked = bytearray(b"\n"), begin, begin, 0  # held[0] is the line feed before the block
        while done < end:
            part = self.at(at, at + BLOCK)
            if not part:
                return
            at += len(part)
            held += part
            while done < end and (found := GAP.search(held, looked)):
                size = found.end() - 1
                yield done, bytes(held[1 : size + 1])
                done, looked = done + size, 0
                del held[:size]
            looked = max(0, len(held) - 2)

    def carried(self, begin: int) -> str | None:
        """The type that blocks without data leave to the block at ``begin``."""
        width = 1 << 16
        while begin > 0:
            low = max(0, begin - width)
            first = self.first_block(low, begin)
            if first is not None and first < begin:
                kind, seen = None, low == 0
                for _, block in self.blocks(first, begin):
                    own, data = fields(block)
                    kind, seen = (None, True) if data is not None else (own if own is not None else kind, seen)
                if seen:
                    return kind
            width *= 4
        return None


def rows_of(file, split: Split) -> Iterator[tuple[str, int, str, str]]:
    text = Bytes(file, split.limit)
    begin = text.first_block(split.start, split.end)
    if begin is None:
        return
    kind = text.carried(begin)
    for offset, block in text.blocks(begin, split.end):
        own, data = fields(block)
        kind = own if own is not None else kind
        if data is not None:
            yield split.path, offset, kind if kind is not None else "message", data
            kind = None


def read_split(split: Split) -> Iterator[tuple[str, int, str, str]]:
    system, at = opened(split.path)
    with system.open_input_file(at) as file:
        yield from rows_of(file, split)


def logs(path: str) -> dict[str, int]:
    """Sizes of the files at or below path by path, those that begin with an underscore or a dot left out."""
    system, at = opened(path)
    head = path[: len(path) - len(at)] if path.endswith(at) else ""
    info = system.get_file_info(at)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(at, recursive=True))
    hidden = lambda p: any(x[:1] in "_." for x in p[len(at) :].split("/") if x)
    return {head + f.path: f.size for f in found if f.type == fs.FileType.File and not hidden(f.path)}


def splits(path: str, start: int, end: int, size: int) -> list[Split]:
    return [Split(path, a, min(a + size, end), end) for a in range(start, end, size)]


def ended(path: str, start: int, size: int) -> int:
    """The end of the last ended block among a file's first ``size`` bytes, not before ``start``: read from the back."""
    system, at = opened(path)
    with system.open_input_file(at) as file:
        text, high = Bytes(file, size), size
        while high > start:
            low = max(start, high - (1 << 16))
            head = b"\n" if low == start else b""  # a block begins at start, behind a line feed or the file's start
            part = head + text.at(low, high)
            last = max((m.end(1) for m in re.finditer(rb"\n(?=(\r?\n))", part)), default=None)
            if last is not None:
                return low - len(head) + last
            if low == start:
                break
            high = low + 2
    return start


class EventLog(DataSource):
    """Options: path; split_bytes (128 MB)."""

    @classmethod
    def name(cls) -> str:
        return "event_log"

    def schema(self) -> str:
        return "log_id string, offset long, event string, data string"

    def reader(self, schema) -> DataSourceReader:
        return LogReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return LogStreamReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("event logs are appended to")
        return LogWriter(self.options, schema)

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamWriter:
        return LogStreamWriter(self.options, schema)


class LogReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.size = options["path"], int(options.get("split_bytes", SPLIT))

    def partitions(self) -> list[Split]:
        found = [s for p, n in sorted(logs(self.path).items()) for s in splits(p, 0, n, self.size)]
        return found or [Split("", 0, 0, 0)]

    def read(self, split: Split) -> Iterator[tuple[str, int, str, str]]:
        return read_split(split) if split.path else iter([])


class LogStreamReader(DataSourceStreamReader):
    """Offsets are bytes by file, each the end of an ended block; what a file has behind its last one waits. Files only grow."""

    def __init__(self, options: dict) -> None:
        self.path, self.size, self.seen = options["path"], int(options.get("split_bytes", SPLIT)), {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        for path, size in logs(self.path).items():
            before = self.seen.get(path, (0, 0))
            if size > before[1]:
                self.seen[path] = (ended(path, before[0], size), size)
        return {p: end for p, (end, _) in sorted(self.seen.items()) if end}

    def partitions(self, start: dict, end: dict) -> list[Split]:
        return [s for p, n in end.items() for s in splits(p, start.get(p, 0), n, self.size)]

    def read(self, split: Split) -> Iterator[tuple[str, int, str, str]]:
        return read_split(split)

    def commit(self, end: dict) -> None:
        pass


def put(options: dict, columns: list[str], rows: Iterator, name: str) -> str | None:
    """Writes rows of event and data as a log in the pending folder; None if there are none. Line feeds in an event become spaces; a carriage return before
    a line feed or the end is lost to readers, as the format has it."""
    system, at = opened(options["path"])
    event, data, out = columns.index("event"), columns.index("data"), None
    try:
        for row in rows:
            if out is None:
                system.create_dir(f"{at}/{PENDING}", recursive=True)
                out = system.open_output_stream(f"{at}/{PENDING}/{name}", buffer_size=BLOCK)
            kind = f"event: {row[event]}\n".replace("\n", " ", row[event].count("\n")) if row[event] is not None else ""
            lines = "".join(f"data: {x}\n" for x in (row[data] if row[data] is not None else "").split("\n"))
            out.write(f"{kind}{lines}\n".encode())
    finally:
        if out is not None:
            out.close()
    return name if out is not None else None


def settle(options: dict, messages: list, keep: bool, folder: str | None = None) -> None:
    """Moves the named pending logs to folder (else to where the logs are), or deletes them."""
    system, at = opened(options["path"])
    for name in [m.name for m in messages if m is not None and m.name]:
        pending = system.get_file_info(f"{at}/{PENDING}/{name}").type == fs.FileType.File
        if pending and keep:
            system.move(f"{at}/{PENDING}/{name}", f"{folder or at}/{name}")
        elif pending:
            system.delete_file(f"{at}/{PENDING}/{name}")


class LogWriter(DataSourceWriter):
    """A task writes one log aside, under a name of its own; the commit moves those of the tasks that count, so lost and repeated tasks leave nothing."""

    def __init__(self, options: dict, schema) -> None:
        self.options, self.columns = options, schema.fieldNames()

    def write(self, rows: Iterator) -> Written:
        return Written(put(self.options, self.columns, rows, f"log-{uuid.uuid4().hex}"))

    def commit(self, messages: list) -> None:
        settle(self.options, messages, True)

    def abort(self, messages: list) -> None:
        settle(self.options, messages, False)


class LogStreamWriter(DataSourceStreamWriter):
    """As the batch writer, with a folder a batch, so a batch that runs again replaces itself."""

    def __init__(self, options: dict, schema) -> None:
        self.options, self.columns = options, schema.fieldNames()

    def write(self, rows: Iterator) -> Written:
        return Written(put(self.options, self.columns, rows, f"log-{uuid.uuid4().hex}"))

    def commit(self, messages: list, batchId: int) -> None:
        system, at = opened(self.options["path"])
        folder = f"{at}/batch-{batchId:08d}"
        if system.get_file_info(folder).type == fs.FileType.Directory:
            system.delete_dir(folder)
        system.create_dir(folder, recursive=True)
        settle(self.options, messages, True, folder)

    def abort(self, messages: list, batchId: int) -> None:
        settle(self.options, messages, False)


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(EventLog)


def read_logs(spark: SparkSession, path: str, split_bytes: int = SPLIT) -> DataFrame:
    register(spark)
    return spark.read.format("event_log").option("split_bytes", split_bytes).load(qualified(spark, path))


def stream_logs(spark: SparkSession, path: str, split_bytes: int = SPLIT) -> DataFrame:
    register(spark)
    return spark.readStream.format("event_log").option("split_bytes", split_bytes).load(qualified(spark, path))


def write_logs(events: DataFrame, path: str) -> None:
    """events(event, data) as logs, a file a task; a missing event is left to its default, a missing data is empty."""
    spark = events.sparkSession
    register(spark)
    events.select("event", "data").write.format("event_log").mode("append").save(qualified(spark, path))
