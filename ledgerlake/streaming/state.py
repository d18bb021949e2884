"""Keyed state of streams: first successes, live progress, watched publication, and what joins and closes streams.

State lives in RocksDB, so keys need not fit a task's memory, and a batch touches only its own keys.
"""

from __future__ import annotations

import threading
from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def on_disk(spark: SparkSession) -> None:
    """Keyed state needs a store that has more than one column family; set for queries that start from now on."""
    if "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass", ""):
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class FirstValue(StatefulProcessor):
    """Lets the first row of a key pass: in a batch that of the least ordinals, over batches that which came first."""

    def __init__(self, order: list[str], columns: list[str]):
        self.order, self.columns = order, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "known boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        best = None
        for frame in rows:
            frame = frame if best is None else pd.concat([best, frame])
            best = frame.sort_values(self.order, kind="stable").head(1)
        if best is not None and not self.seen.exists():
            self.seen.update((True,))
            yield best[self.columns]

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.seen.update((True,))

    def close(self) -> None:
        pass


def first_values(rows: DataFrame, key: str, order: list[str], known: DataFrame | None = None) -> DataFrame:
    """The first row of each key of a stream, once; keys of ``known`` never."""
    on_disk(rows.sparkSession)
    before = None if known is None else known.select(key).distinct().groupBy(key)
    return rows.groupBy(key).transformWithStateInPandas(FirstValue(order, rows.columns), rows.schema, "Append", "None", before)


class Progress(StatefulProcessor):
    """The last gauge of a key by its ordinal. A finished key stays finished: older gauges that come late don't revive it.

    If asked for, state goes ``keep`` milliseconds after a key's last gauge, and a key without news for ``stall``
    milliseconds is reported once as stalled.
    """

    def __init__(self, keep: int | None, stall: int | None):
        self.keep, self.stall = keep, stall

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ord long, state string, bytes long, timer long", self.keep)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        old = self.last.get() if self.last.exists() else None
        best = None
        for frame in rows:
            top = frame.iloc[frame["ord"].to_numpy().argmax()]
            if best is None or top["ord"] > best["ord"]:
                best = top
        if best is None or old is not None and (old[0] >= best["ord"] or old[1] == "done"):
            return
        timer = 0
        if self.stall is not None:
            if old is not None and old[3]:
                self.handle.deleteTimer(old[3])
            if best["state"] != "done":
                timer = timerValues.getCurrentProcessingTimeInMs() + self.stall
                self.handle.registerTimer(timer)
        self.last.update((int(best["ord"]), str(best["state"]), int(best["bytes"]), timer))
        yield pd.DataFrame({"key": [key[0]], "ord": [int(best["ord"])], "state": [str(best["state"])], "bytes": [int(best["bytes"])]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.last.exists():
            ord_, state, n_bytes, timer = self.last.get()
            if timer and state != "done":
                self.last.update((ord_, state, n_bytes, 0))
                yield pd.DataFrame({"key": [key[0]], "ord": [ord_], "state": ["stalled"], "bytes": [n_bytes]})

    def close(self) -> None:
        pass


def progress(updates: DataFrame, keep_seconds: float | None = None, stall_seconds: float | None = None) -> DataFrame:
    """Changes of the last gauge of each key. ``updates``: key, ord, state, bytes.

    With either time the clock drives the query, which then always has another batch to run: start it with a
    ``processingTime`` trigger, as ``availableNow`` would not end.
    """
    on_disk(updates.sparkSession)
    keep, stall = (None if x is None else int(x * 1000) for x in (keep_seconds, stall_seconds))
    rows = updates.select("key", "ord", "state", "bytes")
    clock = "None" if keep is None and stall is None else "ProcessingTime"
    return rows.groupBy("key").transformWithStateInPandas(Progress(keep, stall), "key string, ord long, state string, bytes long", "Update", clock)


class Watcher:
    """Publishes what a stream brings, at one of two cadences, and at once when woken.

    A query's trigger can't be changed, so another cadence or a wake-up starts the query anew from its
    checkpoint, and a started query takes what is there. ``write`` gets each batch and says whether it wrote;
    ``published`` counts that, ``progress`` holds the last reports of the query.
    """

    def __init__(self, rows: DataFrame, write: Callable[[DataFrame], bool], checkpoint: str, active_every: str = "1 second", idle_every: str = "10 seconds", output: str = "append", reports: int = 100):
        self.rows, self.write, self.checkpoint, self.output = rows, write, checkpoint, output
        self.every = {True: active_every, False: idle_every}
        self.active, self.published, self.query = False, 0, None
        self.progress: deque[dict] = deque(maxlen=reports)
        self._lock = threading.RLock()
        self._listener = _Reports(self)

    def _batch(self, df: DataFrame, number: int) -> None:
        if self.write(df):
            self.published += 1

    def _begin(self) -> None:
        self.query = self.rows.writeStream.outputMode(self.output).foreachBatch(self._batch).option("checkpointLocation", self.checkpoint).trigger(processingTime=self.every[self.active]).start()

    def start(self, active: bool = False) -> Watcher:
        with self._lock:
            self.active = active
            self.rows.sparkSession.streams.addListener(self._listener)
            self._begin()
        return self

    def _again(self) -> None:
        self.query.stop()
        self._begin()

    def wake(self) -> None:
        """Looks now instead of at the next tick."""
        with self._lock:
            if self.query is not None:
                self._again()

    def set_active(self, active: bool) -> None:
        with self._lock:
            if active != self.active and self.query is not None:
                self.active = active
                self._again()

    def stop(self) -> None:
        with self._lock:
            if self.query is not None:
                self.query.stop()
                self.query = None
                self.rows.sparkSession.streams.removeListener(self._listener)


class _Reports(StreamingQueryListener):
    def __init__(self, watcher: Watcher):
        self.watcher = watcher

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        query, p = self.watcher.query, event.progress
        if query is not None and str(p.id) == str(query.id):
            self.watcher.progress.append({"batch": p.batchId, "rows": p.numInputRows, "seconds": p.batchDuration / 1000})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


# ---- windows, duplicates and joins over event time


def sessions(rows: DataFrame, key: str, at: str, gap: str, late: str) -> DataFrame:
    """(key, start, end, n) of sessions, each once it can't grow any more: ``late`` behind the last event time."""
    timed = rows.withWatermark(at, late)
    return timed.groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def delivered_once(rows: DataFrame, keys: list[str], at: str, late: str) -> DataFrame:
    """Rows without repeated deliveries of a key that lie within ``late`` of each other; state goes with the watermark."""
    return rows.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def followed_by(first: DataFrame, second: DataFrame, key: str, at: str, within: str, late: str) -> DataFrame:
    """Pairs of rows of two streams with one key, the second at most ``within`` after the first. The columns of both
    sides but ``key`` are named ``first_`` and ``second_``; rows too old to find a partner leave the state."""
    a = first.select(F.col(key).alias("_a"), *[F.col(c).alias(f"first_{c}") for c in first.columns if c != key]).withWatermark(f"first_{at}", late)
    b = second.select(F.col(key).alias("_b"), *[F.col(c).alias(f"second_{c}") for c in second.columns if c != key]).withWatermark(f"second_{at}", late)
    span = F.expr(f"INTERVAL {within}")
    on = (F.col("_a") == F.col("_b")) & (F.col(f"second_{at}") >= F.col(f"first_{at}")) & (F.col(f"second_{at}") <= F.col(f"first_{at}") + span)
    return a.join(b, on).withColumnRenamed("_a", key).drop("_b")
