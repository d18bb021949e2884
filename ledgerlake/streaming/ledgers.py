"""Ledgers kept by streams: first successes, daily counts, live progress, suppressed publication.

Keys of first successes never expire, as in the batch ledgers: their state grows with the number of keys
and lies in RocksDB.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .state import first_values, progress


def first_success_stream(results: DataFrame, path: str, checkpoint: str, known: DataFrame | None = None):
    """A query that adds each batch's new first successes to the ledger at ``path``.

    Keyed state knows which keys have succeeded, so a batch costs what it brings and never reads the ledger; a
    file that comes late never changes what is there. A batch writes to its own folder, so a repeated batch
    replaces what it wrote. Equal to the batch ledger where files arrive in name order. ``known``: a ledger
    from before, for a query that starts without a checkpoint.
    """
    good = results.filter("status = 'downloaded'").select("key", "file_name", "line_no", "at", "bytes")
    new = first_values(good, "key", ["file_name", "line_no"], known)
    size = F.greatest(F.lit(0).cast("long"), F.coalesce(F.col("bytes").try_cast("long"), F.lit(0)))
    ledger = new.select("key", F.to_date("at").alias("date"), "at", size.alias("bytes"))
    return ledger.writeStream.outputMode("append").foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{path}/batch={n}")).option("checkpointLocation", checkpoint)


def first_rows(results: DataFrame, keys: list[str], order: str, values: list[str]) -> DataFrame:
    """First row of each key as an update-mode aggregate."""
    m = F.min(F.struct(order, *values)).alias("m")
    return results.groupBy(*keys).agg(m).select(*keys, F.col(f"m.{order}").alias(order), *[F.col(f"m.{v}").alias(v) for v in values])


def daily_counts(results: DataFrame, at: str, late: str = "1 day", status: str = "status") -> DataFrame:
    """Outcomes by day and status over event time; days close once they are ``late`` behind."""
    timed = results.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late)
    return timed.groupBy(F.window("_at", "1 day").alias("w"), F.col(status)).agg(F.count(F.lit(1)).alias("n")).select(F.to_date("w.start").alias("day"), status, "n")


def live_progress(updates: DataFrame) -> DataFrame:
    """Changes of the last gauge of each key; a finished key stays finished. ``updates``: key, ord, state, bytes."""
    return progress(updates)


def progress_files(gauges: DataFrame, path: str, checkpoint: str):
    """A query that writes the gauges of each batch; a repeated batch replaces what it wrote."""
    return gauges.writeStream.outputMode("update").foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{path}/batch={n}")).option("checkpointLocation", checkpoint)


def last_progress(spark, path: str) -> DataFrame:
    """The last gauge of each key over all batches; of equal places the later batch."""
    last = F.max(F.struct("ord", "batch", "state", "bytes")).alias("m")
    return spark.read.parquet(path).groupBy("key").agg(last).select("key", "m.ord", "m.state", "m.bytes")


def publish_changes(rows: DataFrame, write: Callable[[DataFrame], bool], checkpoint: str):
    """A query that hands every batch to ``write``, which may suppress unchanged content."""
    return rows.writeStream.outputMode("complete").foreachBatch(lambda df, _: write(df) and None).option("checkpointLocation", checkpoint)
