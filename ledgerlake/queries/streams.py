"""The streaming forms, run to completion over stored files; results equal those of the batch queries."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..streaming import ledgers, state
from .events import CASE, _BY_USER, status
from .registry import QUERIES, SQL


def _stream(spark: SparkSession, sf_dir: str):
    path = f"{str(sf_dir).rstrip('/')}/events.parquet"
    schema = spark.read.parquet(path).schema
    # A stream lists a folder; one file is picked out of the tables' folder by its name.
    if spark.read.parquet(path).select("_metadata.file_path").first()[0].rstrip("/").endswith("events.parquet"):
        return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(str(sf_dir))
    return spark.readStream.schema(schema).parquet(path)


def shared_place(spark: SparkSession) -> str:
    """A new folder that the driver and all executors share; a local one only where there is one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is not set")
        folder = tempfile.mkdtemp(prefix="ledgerlake-")
    return f"{folder.rstrip('/')}/stream-{uuid.uuid4().hex}"


def stream_first_success(spark: SparkSession, sf_dir: str):
    place = shared_place(spark)
    e = _stream(spark, sf_dir).select(F.col("user_id").cast("string").alias("key"), status().alias("status"), F.lit("download.log").alias("file_name"), F.col("event_id").alias("line_no"), F.col("ts").alias("at"), F.floor("value").cast("long").cast("string").alias("bytes"))
    ledgers.first_success_stream(e, f"{place}/ledger", f"{place}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{place}/ledger").select("key", "date", "bytes")


def stream_daily(spark: SparkSession, sf_dir: str):
    """Counts go to a folder at each batch; the last batch has them whole."""
    folder = shared_place(spark)
    daily = ledgers.daily_counts(_stream(spark, sf_dir).withColumn("status", status()), "ts")
    q = daily.writeStream.outputMode("complete").foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{folder}/out/batch={n}")).option("checkpointLocation", f"{folder}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    out = spark.read.parquet(f"{folder}/out")
    return out.join(F.broadcast(out.agg(F.max("batch").alias("batch"))), "batch").drop("batch")  # one row


def stream_progress(spark: SparkSession, sf_dir: str):
    """The last gauge of each key over all batches."""
    folder = shared_place(spark)
    e = _stream(spark, sf_dir).select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("ord"), F.col("event_type").alias("state"), F.floor("value").cast("long").alias("bytes"))
    ledgers.progress_files(ledgers.live_progress(e), f"{folder}/out", f"{folder}/c").trigger(availableNow=True).start().awaitTermination()
    return ledgers.last_progress(spark, f"{folder}/out")


def _run(spark: SparkSession, rows):
    """Appends what a stream gives to a folder until it has taken all there is, and reads it."""
    folder = shared_place(spark)
    rows.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/c").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{folder}/out")


def _timed(spark: SparkSession, sf_dir: str):
    return _stream(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))


def stream_sessions(spark: SparkSession, sf_dir: str):
    """Sessions of users with gaps of three hours, those that can't grow any more."""
    out = _run(spark, state.sessions(_timed(spark, sf_dir), "user_id", "ts", "3 hours", "1 hour"))
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


def stream_delivered_once(spark: SparkSession, sf_dir: str):
    """Every event delivered twice, taken once."""
    e = _timed(spark, sf_dir).select("event_id", "ts", "user_id")
    return _run(spark, state.delivered_once(e.unionByName(e), ["event_id"], "ts", "1 day")).select("event_id", "user_id")


def stream_followed_by(spark: SparkSession, sf_dir: str):
    """Errors of a user with the purchases that come in the two hours after."""
    e = _timed(spark, sf_dir).select("event_id", "ts", "user_id", "event_type")
    of = lambda kind: e.filter(F.col("event_type") == kind).drop("event_type")
    return _run(spark, state.followed_by(of("error"), of("purchase"), "user_id", "ts", "2 HOURS", "1 day")).select("user_id", "first_event_id", "second_event_id")


def stream_late_files(spark: SparkSession, sf_dir: str):
    """First successes by day, the days delivered backwards: what came first stays, however late the older files are."""
    folder = shared_place(spark)
    e = spark.read.parquet(f"{str(sf_dir).rstrip('/')}/events.parquet").select(F.col("user_id").cast("string").alias("key"), status().alias("status"), F.col("event_id").alias("line_no"), F.col("ts").cast("timestamp").alias("at"), F.floor("value").cast("long").cast("string").alias("bytes"), F.dayofmonth("ts").alias("day"))
    files = e.withColumn("file_name", F.format_string("download-%02d.log", "day"))
    schema = files.drop("day").schema
    for last in (True, False):  # two deliveries
        files.filter(F.col("day") > 15 if last else F.col("day") <= 15).drop("day").write.parquet(f"{folder}/in/{'a' if last else 'b'}")
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
        ledgers.first_success_stream(stream, f"{folder}/ledger", f"{folder}/c").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/ledger").select("key", "date", "bytes")


def stream_publications(spark: SparkSession, sf_dir: str):
    """Totals published after each delivery: the second changes nothing and is suppressed, the third is published."""
    folder = shared_place(spark)
    e = spark.read.parquet(f"{str(sf_dir).rstrip('/')}/events.parquet").select("event_id", "event_type")
    from ..sources.ledgers import publish

    wrote = []
    schema = "event_type string, n long"

    def totals():
        rows = spark.readStream.schema(e.schema).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
        return rows.filter("event_type <> 'view'").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))

    def write(df):
        wrote.append(publish(df, f"{folder}/out"))
        return wrote[-1]

    for name, part in (("a", "event_type = 'click'"), ("b", "event_type = 'view'"), ("c", "event_type NOT IN ('click', 'view')")):
        e.filter(part).write.parquet(f"{folder}/in/{name}")
        ledgers.publish_changes(totals(), write, f"{folder}/c").trigger(availableNow=True).start().awaitTermination()
    told = ",".join("yes" if w else "no" for w in wrote)
    return spark.read.schema(schema).json(f"{folder}/out").withColumn("wrote", F.lit(told))


_GAPS = "SELECT *, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 3 HOUR AS fresh FROM events"
_CLOSED = f"""SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 3 HOUR AS "end", count(*) AS n FROM (SELECT *, sum(CASE WHEN coalesce(fresh, true) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM ({_GAPS})) GROUP BY user_id, s
HAVING max(ts) + INTERVAL 3 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)"""

for _f, _sql in (
    (stream_sessions, _CLOSED),
    (stream_delivered_once, "SELECT event_id, user_id FROM events"),
    (stream_followed_by, "SELECT a.user_id, a.event_id AS first_event_id, b.event_id AS second_event_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'error' AND b.event_type = 'purchase' AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 2 HOUR"),
    (stream_late_files, "SELECT key, date, bytes FROM (SELECT CAST(user_id AS VARCHAR) AS key, CAST(ts AS DATE) AS date, greatest(0, CAST(floor(value) AS BIGINT)) AS bytes, row_number() OVER (PARTITION BY user_id ORDER BY dayofmonth(ts) <= 15, dayofmonth(ts), event_id) AS rn FROM events WHERE event_type = 'purchase') WHERE rn = 1"),
    (stream_publications, "SELECT event_type, count(*) AS n, 'yes,no,yes' AS wrote FROM events WHERE event_type <> 'view' GROUP BY 1"),
    (stream_first_success, f"SELECT key, date, bytes FROM ({_BY_USER})"),
    (stream_daily, f"SELECT CAST(ts AS DATE) AS day, {CASE} AS status, count(*) AS n FROM events GROUP BY 1, 2"),
    (stream_progress, "SELECT CAST(user_id AS VARCHAR) AS key, max(event_id) AS ord, arg_max(event_type, event_id) AS state, CAST(floor(arg_max(value, event_id)) AS BIGINT) AS bytes FROM events GROUP BY user_id"),
):
    QUERIES[_f.__name__] = _f
    SQL[_f.__name__] = _sql
