import json
import time

from pyspark.sql import functions as F

from ledgerlake.operators.ledger import first_success
from ledgerlake.sources.ledgers import publish
from ledgerlake.streaming import ledgers, state

SCHEMA = "key string, status string, file_name string, line_no long, at timestamp, bytes string"


def put(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps({"key": k, "status": s, "file_name": name, "line_no": n, "at": "2024-01-0%dT00:00:00Z" % (n + 1), "bytes": b}) for n, (k, s, b) in enumerate(rows)))


def test_first_success_equals_batch_and_never_changes(spark, tmp_path):
    put(tmp_path / "in", "a.json", [("x", "downloaded", "100"), ("y", "failed", "1"), ("x", "downloaded", "5")])

    def run():
        stream = spark.readStream.schema(SCHEMA).json(str(tmp_path / "in"))
        ledgers.first_success_stream(stream, str(tmp_path / "out"), str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
        return sorted((r.key, r.bytes) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert run() == [("x", 100)]
    put(tmp_path / "in", "b.json", [("x", "downloaded", "999"), ("y", "downloaded", "7")])
    assert run() == [("x", 100), ("y", 7)]
    batch = first_success(spark.read.schema(SCHEMA).json(str(tmp_path / "in")))
    assert sorted((r.key, r.bytes) for r in batch.collect()) == run()


def test_progress_and_days(spark, tmp_path):
    put(tmp_path / "in", "a.json", [("x", "work", "1"), ("y", "work", "2"), ("x", "done", "3")])
    s = spark.readStream.schema(SCHEMA).json(str(tmp_path / "in"))
    gauges = ledgers.live_progress(s.select("key", F.col("line_no").alias("ord"), F.col("status").alias("state"), F.col("bytes").cast("long").alias("bytes")))
    q = gauges.writeStream.outputMode("update").format("memory").queryName("gauges").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.key, r.state, r.bytes) for r in spark.table("gauges").collect()) == [("x", "done", 3), ("y", "work", 2)]
    q = ledgers.daily_counts(s, "at").writeStream.outputMode("complete").format("memory").queryName("days").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((str(r.day), r.status, r.n) for r in spark.table("days").collect()) == [("2024-01-01", "work", 1), ("2024-01-02", "work", 1), ("2024-01-03", "done", 1)]


def test_last_progress_over_batches(spark, tmp_path):
    """A key that is in several batches has one row, its last gauge."""
    put(tmp_path / "in", "a.json", [("x", "work", "1"), ("y", "work", "2")])
    put(tmp_path / "in", "b.json", [("z", "work", "5"), ("z", "work", "6"), ("x", "work", "7"), ("y", "work", "8")])
    s = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    gauges = ledgers.live_progress(s.select("key", F.col("line_no").alias("ord"), F.col("status").alias("state"), F.col("bytes").cast("long").alias("bytes")))
    ledgers.progress_files(gauges, str(tmp_path / "out"), str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    assert len([f for f in (tmp_path / "out").iterdir() if f.name.startswith("batch=")]) >= 2
    assert sorted((r.key, r.ord, r.bytes) for r in ledgers.last_progress(spark, str(tmp_path / "out")).collect()) == [("x", 2, 7), ("y", 3, 8), ("z", 1, 6)]


def gauges(spark, folder):
    folder.mkdir(exist_ok=True)
    return spark.readStream.schema("key string, ord long, state string, bytes long").json(str(folder))


def deliver(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(dict(zip(("key", "ord", "state", "bytes"), r))) for r in rows))


def test_a_finished_key_is_not_revived(spark, tmp_path):
    """Batch by batch: late older gauges change nothing, before and after a key is done; a new key still counts."""
    seen = []
    rows = state.progress(gauges(spark, tmp_path / "in"))
    write = rows.writeStream.outputMode("update").foreachBatch(lambda df, n: seen.append(sorted(map(tuple, df.collect())))).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True)
    for k, part in enumerate(([("x", 5, "work", 1), ("y", 1, "work", 2)], [("x", 3, "work", 9), ("y", 4, "done", 7)], [("y", 2, "work", 8), ("x", 6, "done", 4)], [("x", 5, "work", 3), ("y", 9, "work", 1), ("z", 0, "work", 0)])):
        deliver(tmp_path / "in", f"{k}.json", part)
        write.start().awaitTermination()
    assert [b for b in seen if b] == [[("x", 5, "work", 1), ("y", 1, "work", 2)], [("y", 4, "done", 7)], [("x", 6, "done", 4)], [("z", 0, "work", 0)]]


def until(what):
    end = time.time() + 60
    while not what() and time.time() < end:
        time.sleep(0.1)
    assert what()


def test_a_silent_key_is_reported_once(spark, tmp_path):
    """By the clock: x falls silent and is reported, y is done; z is forgotten after its time, so that an older gauge counts anew."""
    seen = []
    deliver(tmp_path / "in", "0.json", [("x", 1, "work", 1), ("y", 1, "done", 2), ("z", 7, "done", 7)])
    rows = state.progress(gauges(spark, tmp_path / "in"), keep_seconds=6, stall_seconds=1)
    query = rows.writeStream.outputMode("update").foreachBatch(lambda df, n: seen.extend(map(tuple, df.collect()))).option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="300 milliseconds").start()
    try:
        until(lambda: ("x", 1, "stalled", 1) in seen)
        time.sleep(7)
        deliver(tmp_path / "in", "1.json", [("z", 2, "done", 2)])
        until(lambda: ("z", 2, "done", 2) in seen)
    finally:
        query.stop()
    assert sorted(seen) == [("x", 1, "stalled", 1), ("x", 1, "work", 1), ("y", 1, "done", 2), ("z", 2, "done", 2), ("z", 7, "done", 7)]


def test_first_successes_never_read_the_ledger(spark, tmp_path):
    """What is in the ledger's folder does not matter to later batches; files that come late never overwrite; keys known before count."""
    known = spark.createDataFrame([("k",)], "key string")

    def run():
        stream = spark.readStream.schema(SCHEMA).json(str(tmp_path / "in"))
        ledgers.first_success_stream(stream, str(tmp_path / "out"), str(tmp_path / "ck"), known).trigger(availableNow=True).start().awaitTermination()
        return sorted((r.key, r.bytes) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    put(tmp_path / "in", "b.json", [("x", "failed", "1"), ("x", "downloaded", "100"), ("k", "downloaded", "5"), ("x", "downloaded", "1"), ("n", "downloaded", "nope")])
    assert run() == [("n", 0), ("x", 100)]
    for folder in (tmp_path / "out").glob("batch=*"):
        folder.rename(tmp_path / f"old-{folder.name}")
    put(tmp_path / "in", "a.json", [("x", "downloaded", "999"), ("y", "downloaded", "7")])
    assert run() == [("y", 7)]


def test_watcher_publishes_once_a_change(spark, tmp_path):
    put(tmp_path / "in", "a.json", [("x", "downloaded", "1")])
    counts = spark.readStream.schema(SCHEMA).json(str(tmp_path / "in")).groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    watcher = state.Watcher(counts, lambda df: publish(df.filter("status = 'downloaded'"), str(tmp_path / "out")), str(tmp_path / "c"), "200 milliseconds", "1 hour", "complete")

    watcher.start()
    try:
        until(lambda: watcher.published == 1)
        put(tmp_path / "in", "b.json", [("y", "downloaded", "1")])
        time.sleep(1)
        assert watcher.published == 1  # idle: the next look is an hour away
        watcher.wake()
        until(lambda: watcher.published == 2)
        watcher.set_active(True)
        put(tmp_path / "in", "c.json", [("z", "failed", "1")])
        until(lambda: sum(p["rows"] for p in watcher.progress) == 3)
        put(tmp_path / "in", "d.json", [("z", "downloaded", "1")])
        until(lambda: watcher.published == 3 and sum(p["rows"] for p in watcher.progress) == 4)
    finally:
        watcher.stop()
    assert [r.n for r in spark.read.json(str(tmp_path / "out")).collect()] == [3]
    assert not spark.streams.active
