"""Streams whose state goes by event-time timers."""

import random

import pytest
from pyspark.sql import functions as F

from docloom.streaming import events as E

HOUR = 3_600_000_000
BASE = 1000 * HOUR  # rows at the very epoch are late before any other comes
EVENTS = "event_id long, session_id string, ts_us long, kind string, value double, page int"


def table(spark, rows):
    made = [(i, s, BASE + int(h * HOUR), k, float(i), p) for i, (h, s, k, p) in enumerate(rows)]
    return spark.createDataFrame(made, EVENTS).withColumn("ts", F.timestamp_micros("ts_us"))


@pytest.fixture(scope="module")
def day(spark):
    """A session an hour, of three events and an end; one that runs all day; one that ends, is reclaimed, comes back and runs on; one that ends twice in time."""
    rows = [(h + x / 10, f"s{h}", k, 1 + x) for h in range(24) for x, k in enumerate(["log", "chunk_ready", "chunk_ready", "finish"])]
    rows += [(h, "running", "chunk_ready", 7) for h in range(24)]
    rows += [(1, "back", "error", 1), (5, "back", "log", 1), (5.5, "back", "chunk_ready", 1)]
    rows += [(2, "twice", "finish", 1), (2.9, "twice", "finish", 2), (2.95, "twice", "finish", 2)]
    return table(spark, sorted(rows)).cache()


def watched(stream, path, conf, mode):
    """Runs the stream; (rows of state at the end of each batch, batches)."""
    spark = stream.sparkSession
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        run = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(lambda b, n: b.count()).start()
        run.awaitTermination()
        return [sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in run.recentProgress if p["stateOperators"]]
    finally:
        for k in conf:
            spark.conf.unset(k)


def test_reclaimed(spark, day, tmp_path):
    rows = E.run_to_end(E.reclaimed(E.replay(day, f"file://{tmp_path}/r", 8)), f"file://{tmp_path}/r", conf=E.ROCKSDB)
    got = sorted((r["session_id"], r["ended_at"] - BASE) for r in rows.collect())
    ends = [(f"s{h}", int((h + 0.3) * HOUR)) for h in range(24) if h + 0.3 + 1 <= 23.3 - 1 / 6]
    assert got == sorted([*ends, ("back", HOUR), ("twice", int(2.95 * HOUR))]), "running jobs never, nor one that came back"


def test_state_falls(spark, day, tmp_path):
    """A day of sessions leaves the state of those of the last hours."""
    seen = watched(E.reclaimed(E.replay(day, f"file://{tmp_path}/a", 8)), f"file://{tmp_path}/a", E.ROCKSDB, "append")
    assert len(seen) >= 8 and max(seen) < 20 and seen[-1] < 12
    seen = watched(E.jobs(E.replay(day, f"file://{tmp_path}/b", 8), 10, 2 * 3_600_000), f"file://{tmp_path}/b", E.ROCKSDB, "update")
    assert len(seen) >= 8 and seen[-1] < 12
    seen = watched(E.without_repeats(E.replay(day, f"file://{tmp_path}/c", 8), 2 * 3_600_000), f"file://{tmp_path}/c", E.ROCKSDB, "append")
    assert len(seen) >= 8 and seen[-1] < 12


@pytest.mark.parametrize("batches", [1, 7])
def test_repeats_after_idle_time_are_views(spark, tmp_path, batches):
    rows = table(spark, [(0, "a", "v", 3), (1, "a", "v", 3), (4, "a", "v", 3), (4.5, "a", "v", 4), (5, "a", "v", 4), (9, "a", "v", 4), (0, "b", "v", 1), (20, "b", "v", 1), (20.5, "b", "v", 1)])
    got = E.run_to_end(E.without_repeats(E.replay(rows, f"file://{tmp_path}/x", batches), 2 * 3_600_000), f"file://{tmp_path}/x", conf=E.ROCKSDB)
    assert sorted((r["session_id"], (r["ts_us"] - BASE) / HOUR) for r in got.collect()) == [("a", 0), ("a", 4), ("a", 4.5), ("a", 9), ("b", 0), ("b", 20)]


def test_jobs(spark, day, tmp_path):
    got = {(r["session_id"], (r["began"] - BASE) // HOUR): r for r in E.run_to_end(E.jobs(E.replay(day, f"file://{tmp_path}/j", 8), 4, 2 * 3_600_000), f"file://{tmp_path}/j", "update", ["session_id", "began"], E.ROCKSDB).collect()}
    assert len(got) == 24 + 1 + 2 + 1
    assert (got["s3", 3]["status"], got["s3", 3]["done"], got["s3", 3]["percent"], got["s3", 3]["n_events"]) == ("done", 2, 70.0, 4)
    assert got["s3", 3]["eta_s"] == pytest.approx(360) and got["running", 0]["done"] == 24 and got["running", 0]["eta_s"] is None
    assert got["back", 1]["status"] == "error" and got["back", 5]["n_events"] == 2


def test_replay_is_in_time_order_and_whole(spark, day, tmp_path):
    stream = E.replay(day.repartition(5), f"file://{tmp_path}/o", 5)
    seen = []
    run = stream.select("ts_us").writeStream.option("checkpointLocation", f"file://{tmp_path}/o/state").trigger(availableNow=True).foreachBatch(lambda b, n: seen.append(sorted(r[0] for r in b.collect()))).start()
    run.awaitTermination()
    assert len(seen) == 5 and all(a[-1] < b[0] for a, b in zip(seen, seen[1:])) and sum(map(len, seen)) == day.count()


def test_no_events(spark, day, tmp_path):
    got = E.run_to_end(E.reclaimed(E.replay(day.where("false"), f"file://{tmp_path}/n")), f"file://{tmp_path}/n", conf=E.ROCKSDB)
    assert got.collect() == [] and got.columns == ["session_id", "ended_at"]


def test_jobs_of_many_sessions(spark, tmp_path):
    """Sessions share rows of state, and Python is called once a bucket; ties, null values and a null session come out as in one go."""
    rng = random.Random(3)
    kinds = ["log", "chunk_ready", "chunk_ready", "finish", "error", "cancelled"]
    rows = [(i, rng.choice([None, *(f"s{k}" for k in range(150))]), BASE + rng.randrange(400) * HOUR // 10, rng.choice(kinds), rng.choice([None, float(i)]), 1) for i in range(3000)]
    events = spark.createDataFrame(rows, EVENTS).withColumn("ts", F.timestamp_micros("ts_us"))
    want = []
    for s in {r[1] for r in rows}:
        job = None
        for i, _, ts, kind, value, _ in sorted((r for r in rows if r[1] == s), key=lambda r: (r[2], r[0])):
            if job is None or ts - job["last"] > 2 * HOUR:
                job = {"s": s, "began": ts, "n": 0, "done": 0, "kinds": set(), "result": None}
                want.append(job)
            job["last"], job["n"], job["done"] = ts, job["n"] + 1, job["done"] + (kind == "chunk_ready")
            job["kinds"].add(kind)
            job["result"] = value if kind == "finish" else job["result"]
    told = lambda k: "cancelled" if "cancelled" in k else "error" if "error" in k or "finish" not in k else "done"
    path = f"file://{tmp_path}/m"
    got = E.run_to_end(E.jobs(E.replay(events, path, 5), 4, 2 * 3_600_000, buckets=3), path, "update", ["session_id", "began"]).collect()
    assert sorted((str(r["session_id"]), r["began"], r["n_events"], r["done"], r["status"], str(r["result"])) for r in got) == sorted((str(j["s"]), j["began"], j["n"], j["done"], told(j["kinds"]), str(j["result"])) for j in want)
    seen = watched(E.jobs(E.replay(events, f"file://{tmp_path}/w", 5), 4, 2 * 3_600_000, buckets=3), f"file://{tmp_path}/w", {}, "update")
    assert max(seen) <= 3, "rows of state are of buckets"
