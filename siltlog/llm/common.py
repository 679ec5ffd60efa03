"""What several operators share: written tables that cut lineage, ranks without a single task, deterministic folds."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where that is unset and all is one process (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='siltlog-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


_made: list[list[str]] = []
#: Of the driver's largest heap, the share above which what finished jobs left there is collected after a table is written.
FULL = 0.5


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder as Parquet and reads it again: nothing is computed twice, and lost executors lose nothing."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    for paths in _made:
        paths.append(path)
    heap = df.sparkSession.sparkContext._jvm.java.lang.Runtime.getRuntime()
    if heap.totalMemory() > FULL * heap.maxMemory():  # plans and broadcasts of many small jobs
        release(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def tables():
    """Lists the paths that `written` makes inside, in their order."""
    paths: list[str] = []
    _made.append(paths)
    try:
        yield paths
    finally:
        _made[:] = [x for x in _made if x is not paths]


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Deletes written tables of which no further use is made."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Has the driver's JVM collect plans of finished jobs now, upon which Spark deletes their shuffle files."""
    spark.sparkContext._jvm.java.lang.System.gc()


def fold_of(doc_id: Column | str, n: int) -> Column:
    """crc32(doc_id as text) mod n."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")), F.lit(n)).cast("int")


def ranked(df: DataFrame, group: list[str], order: list[str], out: str, salts: int = 256, about: DataFrame | None = None) -> DataFrame:
    """Adds `out`, a gapless number from 0 in each group, without one task holding a group.

    A group is split into `salts` parts by a hash of the order columns; a part's rows are numbered by themselves and
    moved up by the sizes of the parts before it. Groups and order columns must not be null. The counts are aggregated
    before they are shuffled; a table of them has at most `salts` rows for each group. `about` has one row for each group,
    whose other columns come with the counts, so that the rows are not shuffled by group for them.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    before = Window.partitionBy(*group).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    parts = salted.groupBy(*group, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    parts = parts.select(*group, "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    if about is not None:
        parts = parts.join(about, group)
    own = Window.partitionBy(*group, "_salt").orderBy(*order)
    numbered = salted.withColumn("_own", F.row_number().over(own) - F.lit(1))
    return numbered.join(parts, [*group, "_salt"]).withColumn(out, F.col("_own") + F.col("_before")).drop("_salt", "_own", "_before")


def let(value: Column, f) -> Column:
    """f(value) with value computed once for each row."""
    return F.transform(F.array(value), f)[0]
