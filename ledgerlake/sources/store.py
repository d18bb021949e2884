"""Small documents and folders in any store that Spark's file systems reach."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _path(spark, path)
    return fs.exists(p)


def size(spark: SparkSession, path: str) -> int:
    """Bytes of a file or of all files of a folder; 0 where there is none."""
    fs, p = _path(spark, path)
    return fs.getContentSummary(p).getLength() if fs.exists(p) else 0


def put(spark: SparkSession, path: str, content: str | bytes) -> None:
    """Writes one small file as a whole: to a name of its own first, then moved to its place."""
    raw = content.encode("utf-8") if isinstance(content, str) else content
    temporary = f"{path}.{uuid.uuid4().hex}.tmp"
    fs, t = _path(spark, temporary)
    out = fs.create(t, True)
    try:
        out.write(bytearray(raw))
    finally:
        out.close()
    move(spark, temporary, path)


def put_new(spark: SparkSession, path: str, content: str) -> bool:
    """Writes one small file unless the name is taken, and says whether it did. Of several writers one does.

    The whole content appears at once: a link on a local disk, elsewhere a rename that replaces nothing. Stores
    without such a rename (plain object stores) do not keep writers apart.
    """
    from py4j.protocol import Py4JJavaError

    temporary = f"{path}.{uuid.uuid4().hex}.tmp"
    put(spark, temporary, content)
    fs, t = _path(spark, temporary)
    _, p = _path(spark, path)
    jvm = spark._jvm
    try:
        if fs.getUri().getScheme() == "file":
            of = lambda x: jvm.java.io.File(x.toUri().getPath()).toPath()
            jvm.java.nio.file.Files.createLink(of(p), of(t))
        else:
            context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
            plain = spark._sc._gateway.new_array(getattr(jvm, "org.apache.hadoop.fs.Options$Rename"), 0)
            context.rename(fs.makeQualified(t), fs.makeQualified(p), plain)
        return True
    except Py4JJavaError as error:
        if error.java_exception.getClass().getSimpleName() != "FileAlreadyExistsException":
            raise
        return False
    finally:
        fs.delete(t, False)


def get(spark: SparkSession, path: str) -> str:
    """The text of one small file."""
    fs, p = _path(spark, path)
    stream = fs.open(p)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
    finally:
        stream.close()


def move(spark: SparkSession, source: str, target: str) -> None:
    """A file or folder to another name; what was there is put aside first and goes once the new one is in place."""
    fs, s = _path(spark, source)
    _, t = _path(spark, target)
    if t.getParent() is not None:
        fs.mkdirs(t.getParent())
    aside = None
    if fs.exists(t):
        _, aside = _path(spark, f"{target}.{uuid.uuid4().hex}.old")
        if not fs.rename(t, aside):
            raise OSError(f"can't put {target} aside")
    if not fs.rename(s, t):
        if aside is not None:
            fs.rename(aside, t)
        raise OSError(f"can't move {source} to {target}")
    if aside is not None:
        fs.delete(aside, True)


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _path(spark, path)
    fs.delete(p, True)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; none where there is no folder."""
    fs, p = _path(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []


def replace_with(rows: DataFrame, path: str, form: str = "json") -> None:
    """Writes ``rows`` to a new folder and then puts it in the place of the old one."""
    spark = rows.sparkSession
    new = f"{path.rstrip('/')}.{uuid.uuid4().hex}.new"
    rows.write.format(form).save(new)
    move(spark, new, path)


def one_file(rows: DataFrame, path: str, ordered_by: list[str]) -> None:
    """A column of lines as one text file of this name. For documents that are small by nature (a day's log)."""
    spark = rows.sparkSession
    folder = f"{path}.{uuid.uuid4().hex}.new"
    value = [c for c in rows.columns if c not in ordered_by][0]
    rows.coalesce(1).sortWithinPartitions(*ordered_by).select(value).write.text(folder)
    part = next((n for n in children(spark, folder) if n.startswith("part-")), None)
    if part is None:
        put(spark, path, "")
    else:
        move(spark, f"{folder}/{part}", path)
    delete(spark, folder)
