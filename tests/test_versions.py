"""Versioned tables: whole versions for readers, one of two writers, what stays."""

import threading

import pytest
from pyspark.sql import functions as F

from ledgerlake.sources import store, versions


def rows_of(spark, k, n=40):
    return spark.range(n).select("id", F.lit(k).alias("k")).repartition(2)


def test_reader_in_a_loop_sees_whole_versions(spark, tmp_path):
    path, stop, seen, wrong = str(tmp_path / "t"), threading.Event(), [], []

    def reads():
        try:
            while not stop.is_set():
                df = versions.read(spark, path)
                if df is not None:
                    (r,) = df.agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("lo"), F.max("k").alias("hi")).collect()
                    seen.append(r.lo)
                    if (r.n, r.lo) != (40, r.hi):
                        wrong.append(r)
        except Exception as error:  # told to the test
            wrong.append(error)

    reader = threading.Thread(target=reads)
    reader.start()
    for k in range(8):
        assert versions.commit(rows_of(spark, k), path, k) == k + 1
    stop.set()
    reader.join()
    assert not wrong and seen == sorted(seen) and len(seen) > 3


def test_one_of_two_writers_wins(spark, tmp_path):
    path, out = str(tmp_path / "t"), []
    versions.commit(rows_of(spark, 0), path, 0)
    gate = threading.Barrier(4)

    def writes(k):
        rows = rows_of(spark, k)
        gate.wait()
        try:
            out.append((versions.commit(rows, path, 1), k))
        except versions.Conflict:
            out.append((None, k))

    writers = [threading.Thread(target=writes, args=(k,)) for k in range(1, 5)]
    [w.start() for w in writers]
    [w.join() for w in writers]
    won = [k for number, k in out if number == 2]
    assert len(out) == 4 and len(won) == 1
    assert [r.k for r in versions.read(spark, path).select("k").distinct().collect()] == won
    assert len(store.children(spark, f"{path}/data")) == 2 and versions.history(spark, path) == [1, 2]


def test_updates_lose_nothing(spark, tmp_path):
    """Each adds its row to the newest version, again if another was first."""
    path = str(tmp_path / "t")

    def adds(k):
        one = rows_of(spark, k, 1)
        versions.update(spark, path, lambda known: one if known is None else known.unionByName(one), 10)

    writers = [threading.Thread(target=adds, args=(k,)) for k in range(4)]
    [w.start() for w in writers]
    [w.join() for w in writers]
    assert sorted(r.k for r in versions.read(spark, path).collect()) == [0, 1, 2, 3] and versions.current(spark, path) == 4


def test_old_versions_go_and_empty_tables_stay(spark, tmp_path):
    path = str(tmp_path / "t")
    assert versions.read(spark, path) is None and versions.history(spark, path) == []
    for k in range(5):
        versions.commit(rows_of(spark, k).filter(F.col("k") != 4), path, k)
    rows_of(spark, 9).write.parquet(f"{path}/data/left-by-a-dead-writer")
    assert versions.read(spark, path).collect() == [] and versions.read(spark, path).columns == ["id", "k"]
    assert versions.expire(spark, path, 1) == [1, 2, 3] and versions.history(spark, path) == [4, 5]
    assert versions.read(spark, path, 4).count() == 40
    with pytest.raises(versions.Conflict):
        versions.commit(rows_of(spark, 7), path, 4)
    assert versions.commit(rows_of(spark, 7), path, 5) == 6


def test_names_are_taken_once(spark, tmp_path):
    p = str(tmp_path / "a" / "one")
    assert store.put_new(spark, p, "é") and not store.put_new(spark, p, "b") and store.get(spark, p) == "é"
    assert [n for n in store.children(spark, str(tmp_path / "a"))] == ["one"]
