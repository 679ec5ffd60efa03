"""Small operations on the file system of a path, through Spark's own Hadoop client: any store that Spark can write to."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, sorted; none if there is no such folder."""
    fs, where = _at(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


def listing(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(path, size) of the files in a folder or of those that a pattern matches; empty files too."""
    fs, where = _at(spark, path)
    found = fs.globStatus(where) or []
    if len(found) == 1 and found[0].isDirectory():
        found = fs.listStatus(found[0].getPath())
    return sorted((s.getPath().toString(), s.getLen()) for s in found if s.isFile())


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _at(spark, path)
    return fs.exists(where)


def read_text(spark: SparkSession, path: str) -> str:
    fs, where = _at(spark, path)
    stream = fs.open(where)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def create_text(spark: SparkSession, path: str, text: str, overwrite: bool = False) -> bool:
    """Writes a file; False if it is there already and must not be replaced. The name appears once the content is whole."""
    fs, where = _at(spark, path)
    if not overwrite and fs.exists(where):
        return False
    jvm = spark.sparkContext._jvm
    hidden = jvm.org.apache.hadoop.fs.Path(f"{path}.{jvm.java.util.UUID.randomUUID()}.tmp")
    stream = fs.create(hidden, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    if overwrite:
        fs.delete(where, False)
    if fs.rename(hidden, where):
        return True
    fs.delete(hidden, False)
    return False


def claim(spark: SparkSession, path: str) -> bool:
    """Makes an empty file unless there is one: only one of several callers gets True."""
    fs, where = _at(spark, path)
    fs.mkdirs(where.getParent())
    try:
        fs.create(where, False).close()
        return True
    except Exception as e:  # the client's error for a name that is taken differs by file system
        if fs.exists(where):
            return False
        raise e


def delete(spark: SparkSession, path: str) -> bool:
    fs, where = _at(spark, path)
    return fs.delete(where, True)


def rename(spark: SparkSession, source: str, target: str) -> None:
    """Moves a file in place of another one."""
    fs, where = _at(spark, source)
    _, to = _at(spark, target)
    fs.delete(to, True)
    if not fs.rename(where, to):
        raise OSError(f"{source} could not be moved to {target}")


def size(spark: SparkSession, path: str) -> int:
    """Bytes of a file, or of all files in a folder; 0 if there is none."""
    fs, where = _at(spark, path)
    return fs.getContentSummary(where).getLength() if fs.exists(where) else 0
