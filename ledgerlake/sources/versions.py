"""Tables that change by a pointer: each version is a folder of its own, and a small file written last names it.

``<path>/data/<unique>`` holds a version's rows, ``<path>/versions/<number>`` its folder and schema. Pointers never
change and none is written twice, so a reader sees a whole version at any time, and of two writers that began at
the same version one finds its number taken. What a writer left behind that died is never named, and no harm.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from . import store


class Conflict(RuntimeError):
    """Another writer has committed since the version that this one began at."""


def _pointer(path: str, number: int) -> str:
    return f"{path.rstrip('/')}/versions/{number:020d}"


def history(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the versions that are kept, oldest first."""
    return [int(n) for n in store.children(spark, f"{path.rstrip('/')}/versions") if n.isdigit()]


def current(spark: SparkSession, path: str) -> int:
    """The newest version's number; 0 where there is none."""
    return max(history(spark, path), default=0)


def read(spark: SparkSession, path: str, number: int | None = None) -> DataFrame | None:
    """The rows of a version, the newest if none is named; None where nothing was committed."""
    number = current(spark, path) if number is None else number
    if not number:
        return None
    told = json.loads(store.get(spark, _pointer(path, number)))
    return spark.read.schema(StructType.fromJson(told["schema"])).parquet(f"{path.rstrip('/')}/data/{told['folder']}")


def commit(rows: DataFrame, path: str, began_at: int) -> int:
    """Writes ``rows`` as the version after ``began_at``, the one that they were made from; its number.

    Raises :class:`Conflict` where that number is taken; the rows are then removed again.
    """
    spark, folder = rows.sparkSession, uuid.uuid4().hex
    data = f"{path.rstrip('/')}/data/{folder}"
    rows.write.parquet(data)
    told = json.dumps({"folder": folder, "schema": json.loads(rows.schema.json())})
    if not store.put_new(spark, _pointer(path, began_at + 1), told):
        store.delete(spark, data)
        raise Conflict(f"{path}: version {began_at + 1} is there already")
    return began_at + 1


def update(spark: SparkSession, path: str, change: Callable[[DataFrame | None], DataFrame], tries: int = 5) -> int:
    """Commits ``change`` of the newest version; done again from the then newest one after a conflict."""
    for left in range(tries - 1, -1, -1):
        number = current(spark, path)
        try:
            return commit(change(read(spark, path, number) if number else None), path, number)
        except Conflict:
            if not left:
                raise
    raise ValueError("tries must be positive")


def expire(spark: SparkSession, path: str, keep: int) -> list[int]:
    """Removes all but the newest ``keep`` versions (2 at least: readers may still be at the one before)."""
    gone = history(spark, path)[: -max(2, keep)]
    for number in gone:
        folder = json.loads(store.get(spark, _pointer(path, number)))["folder"]
        store.delete(spark, _pointer(path, number))
        store.delete(spark, f"{path.rstrip('/')}/data/{folder}")
    return gone
