"""The state of every key kept from a stream of operations: each micro-batch writes the states of the keys that it touches.

A version v of the table holds the whole states (also uncommitted buffers with their reserves) of the keys of batch v. The
newest version of a key counts. A batch reads the versions before its own and writes its own in one step, so a batch that
runs again finds the same past and writes the same version, and a restarted query goes on from what is on disk. Every
`every` versions are merged into one, in the same way.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import files
from ..operators import state
from ..sources.adapters import event_log

COLUMNS = "seq long, key string, op string, offset long, size long, data binary, flags long, ext binary, gone boolean"


class StateTable:
    """States under `path`; folders b{n} hold the keys of batch n, m{n} all keys up to batch n."""

    def __init__(self, spark: SparkSession, path: str, every: int = 16):
        self.spark, self.path, self.every = spark, path, every

    def versions(self, before: int | None = None) -> list[str]:
        """Complete folders that make up the state before a batch: the newest merged one and the batches after it."""
        found = [n for n in files.names(self.spark, self.path) if n[0] in "bm" and n[1:].isdigit() and files.exists(self.spark, f"{self.path}/{n}/_SUCCESS")]
        found = [n for n in found if before is None or int(n[1:]) < before]
        merged = max((int(n[1:]) for n in found if n[0] == "m"), default=-1)
        return [f"m{merged}"] * (merged >= 0) + sorted((n for n in found if n[0] == "b" and int(n[1:]) > merged), key=lambda n: int(n[1:]))

    def read_ops(self, before: int | None = None) -> DataFrame:
        """The newest state of each key as an operation, or none for a removed key (gone)."""
        out = None
        for n in self.versions(before):
            part = self.spark.read.schema(COLUMNS).parquet(f"{self.path}/{n}").withColumn("_v", F.lit(int(n[1:])))
            out = part if out is None else out.unionByName(part)
        if out is None:
            return self.spark.createDataFrame([], COLUMNS)
        names = [c.split()[0] for c in COLUMNS.split(", ")]
        newest = out.groupBy("key").agg(F.max_by(F.struct(*[c for c in names if c != "key"]), "_v").alias("s"))
        return newest.select("key", "s.*").select(*names)

    def current(self, include_uncommitted: bool = False) -> DataFrame:
        """key, data, data_size, kind of every live key."""
        kind = F.when(F.col("flags").bitwiseAND(F.lit(128)) != 0, "uncommitted").otherwise("committed")
        live = self.read_ops().where("not gone").withColumn("kind", kind)
        shown = live if include_uncommitted else live.where("kind = 'committed'")
        return shown.select("key", "data", F.length("data").cast("long").alias("data_size"), "kind")

    def apply(self, ops: DataFrame, batch: int) -> None:
        """Operations of a key come in order of seq over the batches; those that its state already has are passed over."""
        names = [c.split()[0] for c in COLUMNS.split(", ")][:-1]
        new = ops.select(*[F.col(c) if c in ops.columns else F.lit(None).cast("binary").alias(c) for c in names])
        touched = new.select("key").distinct()
        before = self.read_ops(batch).join(touched, "key", "left_semi")
        past = before.select("key", F.col("seq").alias("_last"))
        fresh = new.join(past, "key", "left").where("_last is null or seq > _last").drop("_last")
        found = state.states(before.where("not gone").select(*names).unionByName(fresh))
        s = state.as_ops(found).withColumn("gone", F.lit(False))
        dead = found.where("state.kind = 'absent'").select(F.col("last_seq").alias("seq"), "key", F.lit("state").alias("op"), F.lit(0).cast("long").alias("offset"), F.lit(0).cast("long").alias("size"), F.expr("X''").alias("data"), F.lit(0).cast("long").alias("flags"), F.lit(None).cast("binary").alias("ext"), F.lit(True).alias("gone"))
        s.select(*names, "gone").unionByName(dead).write.mode("overwrite").parquet(f"{self.path}/b{batch}")
        if batch and batch % self.every == 0:
            self.merge(batch)

    def merge(self, upto: int) -> None:
        """Writes all states up to a batch as one folder. What the merge before it had replaced goes; the rest stays, as the newest batches may run again."""
        self.read_ops(upto + 1).where("not gone").write.mode("overwrite").parquet(f"{self.path}/m{upto}")
        for n in files.names(self.spark, self.path):
            if n[0] in "bm" and n[1:].isdigit() and int(n[1:]) < upto - self.every:
                files.delete(self.spark, f"{self.path}/{n}")


def shared_path(spark: SparkSession) -> str:
    """A folder of its own under spark.checkpoint.dir, which driver and executors share."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        import tempfile

        folder = f"file://{tempfile.mkdtemp(prefix='siltlog-stream-')}"
    return f"{folder}/stream-{uuid.uuid4().hex}"


def start(spark: SparkSession, ops: DataFrame, home: str, trigger: dict | None = None):
    """Runs a stream of operations into the table under `home`; the same call goes on after a restart."""
    table = StateTable(spark, f"{home}/state")
    query = ops.writeStream.foreachBatch(table.apply).option("checkpointLocation", f"{home}/checkpoint").trigger(**(trigger or {"availableNow": True})).start()
    return table, query


def current_from_stream(spark: SparkSession, schema: StructType, path: str, trigger: dict | None = None, files_at_once: int = 1, machine: bool = False, home: str | None = None) -> DataFrame:
    """key, data, data_size, kind after all of the files under `path` have been read as a stream."""
    folder, _, name = path.rpartition("/")
    ops = event_log(spark.readStream.schema(schema).option("pathGlobFilter", name).option("maxFilesPerTrigger", files_at_once).parquet(folder), machine)
    table, query = start(spark, ops, home or shared_path(spark), trigger)
    query.awaitTermination()
    return table.current(machine)
