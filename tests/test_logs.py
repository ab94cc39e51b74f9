"""Event logs as a data source and files hashed in blocks."""

import hashlib
import io
import random

from pyspark.sql import functions as F

from docloom.operators import progress
from docloom.sources import blobs, eventlog, files


def plain(data: bytes) -> list[tuple[int, str, str]]:
    """Offsets, types and data, line by line over the whole log."""
    out, kind, lines, at, begin = [], None, [], 0, 0
    for line in data.splitlines(keepends=True) if b"\r" not in data.replace(b"\r\n", b"") else []:
        at += len(line)
        if not line.endswith(b"\n"):
            break
        text = line[:-1].removesuffix(b"\r").decode()
        if text == "":
            if lines:
                out.append((begin, kind if kind is not None else "message", "\n".join(lines)))
                kind = None
            lines, begin = [], at
        elif text.startswith("event:"):
            kind = text[6:].strip(" ")
        elif text.startswith("data:"):
            lines.append(text[5:].removeprefix(" "))
    return out


def made(seed: int) -> bytes:
    rng = random.Random(seed)
    pieces = ["event: a", "event:b ", "data: 1", "data:", "data:  two", ": rest", "", "", "", "id: 7", "data: é" + "x" * rng.randrange(40)]
    return "".join(rng.choice(pieces) + rng.choice(["\n", "\n", "\r\n"]) for _ in range(rng.randrange(60))).encode() + rng.choice([b"", b"data: open", b"event: open\n"])


def test_splits_of_every_size_give_each_block_once(monkeypatch):
    monkeypatch.setattr(eventlog, "BLOCK", 7)
    for seed in range(150):
        data = made(seed)
        want = plain(data)
        for size in (1, 2, 3, 5, 16, 1000):
            got = [r[1:] for s in eventlog.splits("x", 0, len(data), size) for r in eventlog.rows_of(io.BytesIO(data), s)]
            assert got == want, (seed, size)


def test_a_log_in_many_splits(spark, tmp_path):
    data = b"".join(made(s).rpartition(b"\n\n")[0] + b"\n\n" for s in range(400))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_bytes(data)
    (tmp_path / "in" / "_b.log").write_bytes(b"data: hidden\n\n")
    rows = eventlog.read_logs(spark, str(tmp_path / "in"), len(data) // 9)
    assert rows.rdd.getNumPartitions() >= 9
    got = sorted((r["offset"], r["event"], r["data"]) for r in rows.collect())
    assert got == plain(data) and len(got) > 500
    window = progress.parse_event_log(files.event_log_lines(spark, str(tmp_path / "in" / "a.log"))).orderBy("event_no")
    assert [(r["event"], r["data"]) for r in window.collect()] == [x[1:] for x in got]


def test_written_logs_come_back_and_empty_ones_are_none(spark, tmp_path):
    rows = spark.createDataFrame([("a", "1\n2"), (None, '{"x": 1}'), ("b", None), ("c\nd", "é")], "event string, data string").repartition(3)
    path = str(tmp_path / "out")
    eventlog.write_logs(rows, path)
    eventlog.write_logs(rows.limit(1).where("event = 'none'"), path)
    got = sorted((r["event"], r["data"]) for r in eventlog.read_logs(spark, path).collect())
    assert got == [("a", "1\n2"), ("b", ""), ("c d", "é"), ("message", '{"x": 1}')]
    assert not list((tmp_path / "out" / "_pending").iterdir())
    (tmp_path / "none").mkdir()
    assert eventlog.read_logs(spark, str(tmp_path / "none")).count() == 0


def test_the_stream_goes_on_from_its_offsets(spark, tmp_path):
    (tmp_path / "in").mkdir()
    log = tmp_path / "in" / "a.log"

    def run():
        stream = eventlog.stream_logs(spark, str(tmp_path / "in"), 64).select("event", F.concat("data", F.lit("!")).alias("data"))
        q = stream.writeStream.format("event_log").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/c").start()
        q.processAllAvailable()
        q.stop()
        return sorted((r["event"], r["data"]) for r in eventlog.read_logs(spark, str(tmp_path / "out")).collect())

    log.write_text("".join(f"event: e\ndata: {i}\n\n" for i in range(50)) + "event: kept\n\ndata: ha")
    want = [("e", f"{i}!") for i in range(50)]
    assert run() == sorted(want)
    with log.open("a") as f:
        f.write("lf\n\n")
    (tmp_path / "in" / "b.log").write_text("data: new\n\n")
    assert run() == sorted([*want, ("kept", "half!"), ("message", "new!")])
    assert run() == sorted([*want, ("kept", "half!"), ("message", "new!")])


def test_the_last_ended_block_from_the_back(tmp_path):
    for seed in range(60):
        path = tmp_path / f"{seed}.log"
        path.write_bytes(made(seed))
        data = path.read_bytes()
        ends = [i for i in range(1, len(data) + 1) if data[:i].endswith((b"\n\n", b"\n\r\n")) or data[:i] in (b"\n", b"\r\n")]
        assert eventlog.ended(str(path), 0, len(data)) == max(ends, default=0)


def test_files_are_hashed_in_blocks(spark, tmp_path):
    big = random.Random(1).randbytes(5 * blobs.BLOCK + 17)
    for name, data in [("a b%20.bin", big), ("empty.bin", b""), ("c.txt", b"abc")]:
        (tmp_path / name).write_bytes(data)
    got = {r["path"].rsplit("/", 1)[1]: (r["size_bytes"], r["content_hash"]) for r in blobs.hashed(spark, str(tmp_path), "*.bin").collect()}
    assert got == {"a b%20.bin": (len(big), hashlib.sha256(big).hexdigest())}
    assert blobs.digest(str(tmp_path / "empty.bin")) == hashlib.sha256(b"").hexdigest()
    assert blobs.digest(str(tmp_path / "gone")) is None


def test_files_below_a_mount_point(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(b"abc")
    conf = spark._jsc.hadoopConfiguration()
    conf.set("fs.viewfs.mounttable.box.link./m", f"file://{tmp_path}")
    row = blobs.hashed(spark, "viewfs://box/m", "*.bin").first()
    assert row["path"] == "viewfs://box/m/x.bin" and row["content_hash"] == hashlib.sha256(b"abc").hexdigest()


def test_a_file_is_never_held(tmp_path, monkeypatch):
    import tracemalloc

    path = tmp_path / "big"
    with path.open("wb") as f:
        f.truncate(256 << 20)
    tracemalloc.start()
    blobs.digest(str(path))
    assert tracemalloc.get_traced_memory()[1] < 8 << 20
    tracemalloc.stop()
