"""Files and streams."""

from pyspark.sql import functions as F

from docloom.operators import progress
from docloom.sources import files
from docloom.streaming import events as E


def test_listing_and_logs(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"abc")
    (tmp_path / "b.log").write_text("event: x\ndata: 1\n\ndata: 2\n\n")
    row = files.listing(spark, str(tmp_path), "*.pdf", with_content=True).first()
    assert row["size_bytes"] == 3 and row["content_hash"] == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"
    got = progress.parse_event_log(files.event_log_lines(spark, str(tmp_path / "b.log"))).orderBy("event_no").collect()
    assert [(r["event"], r["data"]) for r in got] == [("x", "1"), ("message", "2")]


def test_chunk_table(spark, tmp_path):
    rows = spark.range(100).select(F.concat(F.lit("d"), (F.col("id") % 7).cast("string")).alias("document_id"), F.col("id").cast("int").alias("chunk_index"))
    path = str(tmp_path / "chunks")
    files.write_chunks(rows, path)
    assert files.read_chunks(spark, path).count() == 100
    assert files.read_chunks(spark, path, "d3").count() == 14
    files.write_chunks(rows.where("document_id = 'd3'").limit(1), path, "overwrite")
    assert files.read_chunks(spark, path, "d3").count() == 1


def test_event_sink_and_source(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "kind string, x int")
    files.write_events(progress.event_wire(rows), str(tmp_path / "out"))
    got = progress.parse_event_log(files.event_log_lines(spark, str(tmp_path / "out"))).collect()
    assert sorted((r["event"], r["data"]) for r in got) == [("a", '{"x":1}'), ("b", '{"x":2}')]


def views(spark, tmp_path):
    rows = spark.createDataFrame([("s", 100 * i, i, p) for i, p in enumerate([1, 1, 2, 2, 1, 3, 3])] + [("t", 5, 50, 1)], "session_id string, ts_us long, event_id long, page int")
    rows.repartition(1).write.parquet(str(tmp_path / "in"))
    return rows, spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))


def test_repeats_stream_is_batch(spark, tmp_path):
    rows, stream = views(spark, tmp_path)
    want = sorted(map(tuple, progress.dedupe_consecutive(rows).collect()))
    got = E.run_to_end(E.without_repeats_classic(stream), f"file://{tmp_path}/a")
    assert sorted(tuple(r[c] for c in rows.columns) for r in got.collect()) == want


def test_repeats_on_the_new_state_api(spark, tmp_path):
    rows, stream = views(spark, tmp_path)
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        got = E.run_to_end(E.without_repeats(stream.withColumn("ts", F.timestamp_micros(F.col("ts_us") + 1_000_000))), f"file://{tmp_path}/a")  # a row at the epoch is late
        assert sorted(tuple(r[c] for c in rows.columns) for r in got.collect()) == sorted(map(tuple, progress.dedupe_consecutive(rows).collect()))
    finally:
        spark.conf.unset(key)


def test_ticker_stream_is_batch_for_closed_ticks(spark, tmp_path):
    table = "/root/testdata/sf0.001/events.parquet"
    got = E.run_to_end(E.ticker(E.read_events(spark, table)), f"file://{tmp_path}/t")
    from docloom.sources import tables

    batch = progress.ticker(tables.events(spark, "/root/testdata/sf0.001"))
    want = {(r["session_id"], r["tick"]): r["value"] for r in batch.collect()}
    rows = got.select("session_id", (F.unix_micros("tick") / 200000).cast("long").alias("tick"), "value").collect()
    assert len(rows) > 0.9 * len(want) and all(want[r["session_id"], r["tick"]] == r["value"] for r in rows)


def test_debounce_stream_is_batch_for_closed_bursts(spark, tmp_path):
    table = "/root/testdata/sf0.001/events.parquet"
    stream = E.read_events(spark, table).where("event_type = 'view'").withColumn("page", 1 + F.col("k") % 20)
    got = {(r["session_id"], r["ts_us"]): r["page"] for r in E.run_to_end(E.debounce(stream, "2 hours"), f"file://{tmp_path}/d").collect()}
    from docloom.sources import tables

    rows = tables.events(spark, "/root/testdata/sf0.001").where("event_type = 'view'").withColumn("page", 1 + F.col("k") % 20)
    batch = {(r["session_id"], r["ts_us"]): r["page"] for r in progress.debounce(rows.select("session_id", "ts_us", "event_id", "page"), 7_200_000_000).collect()}
    assert got and all(got[k] == v for k, v in batch.items() if k in got) and len(set(batch) - set(got)) <= 15


def test_stream_queries_on_many_files_out_of_time_order(spark, tmp_path):
    """More files than a batch of the default takes, the newest events in the first."""
    import os

    import duckdb
    import pyarrow.parquet as pq

    import docloom.plans.progress  # noqa: F401
    from docloom.plans import streams
    from docloom.plans.registry import ORACLES

    table = pq.read_table("/root/testdata/sf0.01/events.parquet").sort_by([("ts", "descending")])
    (tmp_path / "events.parquet").mkdir()
    for k in range(0, len(table), 9):
        file = tmp_path / "events.parquet" / f"part-{k:05d}.parquet"
        pq.write_table(table.slice(k, 9), file)
        os.utime(file, (1_700_000_000 + k, 1_700_000_000 + k))
    con = duckdb.connect()
    con.execute("CREATE VIEW events AS SELECT * FROM '/root/testdata/sf0.01/events.parquet'")
    want = {(r[0], r[1]): r[2] for r in con.execute(f"SELECT session_id, tick, value FROM ({ORACLES['ticker']})").fetchall()}
    got = streams.stream_ticker(spark, f"file://{tmp_path}").select("session_id", (F.col("tick_us") / 200000).cast("long").alias("tick"), "value", "n").collect()
    assert len(got) == len(want) and {(r["session_id"], r["tick"]): r["value"] for r in got} == want
    assert sum(r["n"] for r in got) == len(table)
    want = sorted(con.execute(f"SELECT session_id, ts_us, event_id, page FROM ({ORACLES['dedupe_consecutive']})").fetchall())
    repeats = streams.stream_dedupe_consecutive(spark, f"file://{tmp_path}").select("session_id", "ts_us", "event_id", "page")
    assert sorted(map(tuple, repeats.collect())) == want
