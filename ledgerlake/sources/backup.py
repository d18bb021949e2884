"""Versioned backups of ledgers and their verified restore.

A backup is a folder ``version=<stamp>`` with one row a file: (name, relative, bytes, sha256, content). Files are
read and hashed where they are; nothing but the manifest's digest comes to the driver. A version is written only if
its manifest differs from the newest one's; the newest ``retain`` versions stay. Restoring checks every file's size
and hash before the first one is written.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from . import store
from .ledgers import digest

_SCHEMA = "name string, relative string, bytes long, sha256 string, content binary"


class Damaged(ValueError):
    """A backed-up file that has not the size or hash of its manifest."""


def files_of(spark: SparkSession, paths: dict[str, str]) -> DataFrame | None:
    """Rows of all files under the named files or folders; missing ones are passed over."""
    out = None
    for name, path in sorted(paths.items()):
        if not store.exists(spark, path):
            continue
        found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        last = path.rstrip("/").rsplit("/", 1)[-1]
        inside = F.regexp_replace(F.regexp_extract("path", f"/{last}((?:/.*)?)$", 1), "^/", "")
        rows = found.select(F.lit(name).alias("name"), inside.alias("relative"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), "content")
        out = rows if out is None else out.unionByName(rows)
    return out


def versions(spark: SparkSession, folder: str) -> list[str]:
    """Stamps of the complete versions, oldest first."""
    return [n.split("=", 1)[1] for n in store.children(spark, folder) if n.startswith("version=") and store.exists(spark, f"{folder}/{n}/_SUCCESS")]


def version(spark: SparkSession, folder: str, stamp: str) -> DataFrame:
    return spark.read.schema(_SCHEMA).parquet(f"{folder}/version={stamp}")


def backup(spark: SparkSession, paths: dict[str, str], folder: str, stamp: str, settings: Settings = DEFAULT) -> str | None:
    """The stamp under which the files are kept: a new one, or the newest if nothing changed. None without files."""
    rows = files_of(spark, paths)
    if rows is None or rows.isEmpty():
        return None
    old = versions(spark, folder)
    if old and digest(version(spark, folder, old[-1]).drop("content")).first() == digest(rows.drop("content")).first():
        return old[-1]
    new = f"{folder}/.{uuid.uuid4().hex}"
    rows.write.parquet(new)
    store.move(spark, new, f"{folder}/version={stamp}")
    kept = sorted({*old, stamp}, reverse=True)[: max(1, settings.retained_backups)]
    for gone in set(old) - set(kept):
        store.delete(spark, f"{folder}/version={gone}")
    return stamp


def restore(spark: SparkSession, folder: str, targets: dict[str, str], stamp: str | None = None) -> list[str]:
    """Writes the files of a version to their places, by name; the paths written. Raises before writing anything
    where a name is unknown or a file does not hold its size and hash."""
    found = versions(spark, folder)
    if not found:
        raise Damaged("no backup")
    rows = version(spark, folder, stamp or found[-1])
    bad = rows.filter(~F.col("name").isin(*targets) | (F.octet_length("content") != F.col("bytes")) | (F.sha2("content", 256) != F.col("sha256")))
    if first := bad.select("name", "relative").head():
        raise Damaged(f"{first.name} {first.relative}".strip())
    written = []
    for r in rows.select("name", "relative", "content").orderBy("name", "relative").toLocalIterator():  # a file at a time
        path = targets[r.name] + (f"/{r.relative}" if r.relative else "")
        store.put(spark, path, bytes(r.content))
        written.append(path)
    return written
