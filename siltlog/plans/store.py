"""A store over an operation log in Parquet: the calls of a record store as DataFrame plans.

Writes append operations; reads fold them. Nothing is loaded on opening, and every method that gives a DataFrame is lazy.

A compaction writes the states of all keys, sorted by key, and then a manifest that names them and the last operation they
hold; from then on the log is that table and the operations after it. Manifests are numbered and made under a name that
only one caller can take, so of two compactions one loses, and readers see the old log or the new one. A store has one
writer at a time (`exclusive`), as operations are ordered by the numbers that their writer gives them.
"""

from __future__ import annotations

import hashlib
import json
import logging
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import files
from ..functions.checksum import footer, verify_error
from ..functions.records import CHUNKED_CSUM, EXTHDR, NOCSUM, UNCOMMITTED, disk_size
from ..operators import maintain, reads, segments, state, stats

OPLOG = "seq long, key binary, op string, offset long, size long, data binary, flags long, ext binary"
NAMES = [c.split()[0] for c in OPLOG.split(", ")]
APPEND = 16
DEFRAG_STATES = ("not_started", *maintain.LEVELS)
log = logging.getLogger("siltlog")


@dataclass(frozen=True)
class StoreConfig:
    """Limits and defaults of a store."""

    blob_size: int = 50 << 30
    records_in_blob: int = 50_000_000
    defrag_percentage: int = 25
    defrag_timeout: int = 86_400
    defrag_time: int = 3
    defrag_splay: int = 3
    periodic_timeout: int = 15
    index_block_size: int = 40
    index_block_bloom_length: int = 40 * 128
    sync: int = 30
    no_footer: bool = False
    flags: int = 0
    blob_size_limit: int = 0
    path: str = ""

    def checked(self) -> StoreConfig:
        """The configuration, or ValueError for one that no store can have."""
        for name in ("blob_size", "records_in_blob", "index_block_size", "index_block_bloom_length", "periodic_timeout"):
            if getattr(self, name) <= 0:
                raise ValueError(f"{name} must be positive")
        if not 0 <= self.defrag_percentage <= 100:
            raise ValueError("defrag_percentage is a share of 100")
        if not (0 <= self.defrag_time < 24 and 0 <= self.defrag_splay < 24):
            raise ValueError("defrag_time and defrag_splay are hours of a day")
        return self


def key_of(name: str | bytes) -> bytes:
    return hashlib.sha512(name.encode() if isinstance(name, str) else name).digest()


def id_of(values: list[int]) -> bytes:
    """A key from up to 64 small whole numbers, padded with zeros."""
    if len(values) > 64:
        raise ValueError("a key has 64 bytes")
    return bytes(values).ljust(64, b"\0")


def next_defrag(now: float, last: float, config: StoreConfig, splay: float = 0.0) -> float:
    """Seconds until the next compaction: the sooner of the timed and the daily one, at least 60."""
    timed = last + config.defrag_timeout - now
    today = now - now % 86_400 + config.defrag_time * 3600 + splay
    daily = (today if today > now else today + 86_400) - now
    return max(60.0, min(timed, daily))


def free_space_error(available: int, total: int, needed: int, used: int, config: StoreConfig, limit: int = 0, reserve: bool = False) -> str | None:
    if available < needed or (limit and used + needed > limit):
        return "ENOSPC"
    return "ENOSPC" if (available < total // 10 if reserve else available < 2 * config.blob_size) else None


class Store:
    """`exclusive` takes a lock file, as only one writer with a store of its own may have it; close() gives it back."""

    def __init__(self, spark: SparkSession, path: str, config: StoreConfig | None = None, exclusive: bool = False):
        self.spark, self.path, self.config = spark, path.rstrip("/"), (config or StoreConfig()).checked()
        self._seq, self._seen, self._state, self._locked = time.time_ns(), False, "not_started", False
        if exclusive:
            if not files.claim(spark, f"{self.path}/_lock"):
                raise OSError("EB0000: another process has this store")
            self._locked = True

    def close(self) -> None:
        if self._locked:
            files.delete(self.spark, f"{self.path}/_lock")
            self._locked = False

    def __enter__(self) -> Store:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    # writes

    def append_ops(self, ops: DataFrame) -> None:
        """Many operations at once, which is how a log grows; each call is a job."""
        whole = ops if "ext" in ops.columns else ops.withColumn("ext", F.lit(None).cast("binary"))
        whole.select(*NAMES).write.mode("append").parquet(f"{self.path}/oplog")

    def _op(self, op: str, key: bytes, data: bytes = b"", offset: int = 0, size: int = -1, flags: int = 0, ext: bytes | None = None) -> None:
        if not self._seen:  # after all that writers before this one have written, whatever the clock says
            self._seq, self._seen = max(self._seq, self.oplog().agg(F.max("seq")).first()[0] or 0), True
        self._seq = max(self._seq + 1, time.time_ns())
        self.append_ops(self.spark.createDataFrame([(self._seq, key, op, offset, size, data, flags | (EXTHDR if ext is not None else 0), ext)], OPLOG))

    def write(self, key: bytes, data: bytes, offset: int = 0, flags: int = 0, ext: bytes | None = None) -> None:
        self._op("append" if flags & APPEND else "write", key, data, offset, flags=flags & ~APPEND, ext=ext)

    def write_return(self, key: bytes, data: bytes, offset: int = 0, flags: int = 0):
        """Writes, and gives the location of the record after it."""
        self.write(key, data, offset, flags)
        return self.locate(key)

    def writev(self, key: bytes, vectors: list[tuple[int, bytes]], flags: int = 0) -> None:
        """One write of 1 to 128 (offset, bytes) pieces, laid over each other in order."""
        if not 1 <= len(vectors) <= 128:
            raise OSError("E2BIG")
        start, end = min(o for o, _ in vectors), max(o + len(d) for o, d in vectors)
        whole = bytearray(end - start)
        for o, d in vectors:
            whole[o - start : o - start + len(d)] = d
        self.write(key, bytes(whole), start, flags)

    def insert(self, key: bytes, data: bytes) -> None:
        """A write that fails (see `errors`) if the key is there."""
        self._op("insert", key, data)

    def update(self, key: bytes, data: bytes) -> None:
        """A write that fails (see `errors`) if the key is not there."""
        self._op("update", key, data)

    def upsert(self, key: bytes, data: bytes) -> None:
        self._op("upsert", key, data)

    def prepare(self, key: bytes, size: int, flags: int = 0) -> None:
        self._op("prepare", key, size=size, flags=flags)

    def plain_write(self, key: bytes, data: bytes, offset: int = 0, flags: int = 0) -> None:
        self._op("plain_write", key, data, offset, flags=flags)

    def commit(self, key: bytes, size: int = -1) -> None:
        self._op("commit", key, size=size)

    truncate = commit

    def remove(self, key: bytes) -> None:
        self._op("remove", key)

    def write_hashed(self, name: str, data: bytes, offset: int = 0, flags: int = 0) -> None:
        self.write(key_of(name), data, offset, flags)

    def prepare_hashed(self, name: str, size: int, flags: int = 0) -> None:
        self.prepare(key_of(name), size, flags)

    def commit_hashed(self, name: str, size: int = -1) -> None:
        self.commit(key_of(name), size)

    truncate_hashed = commit_hashed

    def remove_hashed(self, name: str) -> None:
        self.remove(key_of(name))

    def remove_blobs(self) -> None:
        """All records and everything that was kept about them."""
        for name in files.names(self.spark, self.path):
            if name != "_lock":
                files.delete(self.spark, f"{self.path}/{name}")

    # reads

    def generation(self) -> int:
        """Number of the newest manifest, 0 without one."""
        found = [int(n[1:-5]) for n in files.names(self.spark, f"{self.path}/manifest") if n[0] == "g" and n.endswith(".json") and n[1:-5].isdigit()]
        return max(found, default=0)

    def manifest(self) -> dict:
        g = self.generation()
        return json.loads(files.read_text(self.spark, f"{self.path}/manifest/g{g}.json")) if g else {"generation": 0, "states": None, "through": None}

    def oplog(self, manifest: dict | None = None) -> DataFrame:
        """The states of the last compaction and the operations after it."""
        m = manifest or self.manifest()
        if files.exists(self.spark, f"{self.path}/oplog"):
            ops = self.spark.read.schema(OPLOG).parquet(f"{self.path}/oplog")
        else:
            ops = self.spark.createDataFrame([], OPLOG)
        if m["states"] is None:
            return ops
        return self.spark.read.schema(OPLOG).parquet(f"{self.path}/{m['states']}").unionByName(ops.where(F.col("seq") > F.lit(m["through"])))

    def current(self, include_uncommitted: bool = False) -> DataFrame:
        return state.current(self.oplog(), include_uncommitted)

    def errors(self) -> DataFrame:
        return state.errors(self.oplog())

    def _one(self, key: bytes, include_uncommitted: bool = False) -> DataFrame:
        """One key's state; the key's filter reaches the scan of the log."""
        return state.current(self.oplog().where(F.col("key") == F.lit(key)), include_uncommitted)

    def read(self, key: bytes, offset: int = 0, size: int = 0) -> bytes:
        """One value or a slice of it, without its extended header."""
        found = self._one(key).select(*[c.alias(n) for c, n in zip(reads.read_slice(F.col("data"), offset, size), ("part", "error"))], "data").take(1)
        if not found:
            raise KeyError("ENOENT")
        if found[0]["error"] and offset:
            raise OSError(found[0]["error"])
        return bytes(found[0]["part"] or b"")

    read_nocsum = read  # the log has no checksums of its own; records have (see verify_records)

    def read_extended(self, key: bytes) -> tuple[bytes | None, bytes]:
        """(extended header or None, payload)."""
        found = self._one(key).select("ext", "data").take(1)
        if not found:
            raise KeyError("ENOENT")
        return (None if found[0]["ext"] is None else bytes(found[0]["ext"])), bytes(found[0]["data"])

    def read_hashed(self, name: str, offset: int = 0, size: int = 0) -> bytes:
        return self.read(key_of(name), offset, size)

    def read_range(self, start: bytes, end: bytes, offset: int = 0, limit: int | None = None) -> DataFrame:
        return reads.read_range(state.current(self.oplog().where(F.col("key").between(F.lit(start), F.lit(end))), True), start, end, offset, limit)

    def each_in_range(self, start: bytes, end: bytes, callback: Callable, offset: int = 0, limit: int | None = None) -> int:
        """Calls callback(key, data) in key order until it gives a number other than 0; gives the number of calls.

        Records come to the caller one by one, a partition at a time.
        """
        n = 0
        for row in self.read_range(start, end, offset, limit).select("key", "data").toLocalIterator():
            n += 1
            if callback(bytes(row["key"]), bytes(row["data"])):
                break
        return n

    def iterate(self, ranges: list[tuple[bytes, bytes]] | None = None) -> DataFrame:
        """All live records, uncommitted ones too; apply `process` or mapInPandas to it for callbacks."""
        found = self.current(True)
        return reads.multi_range(found, ranges) if ranges is not None else found

    def process(self, function: Callable, schema: str, start: Callable | None = None, stop: Callable | None = None, ranges: list[tuple[bytes, bytes]] | None = None) -> DataFrame:
        """Rows that function(own, key, data) gives for each live record, in the tasks.

        own is what start() made for the task, and stop(own) ends it. A function that gives None stops its task, any
        other list of rows goes on.
        """
        names = [c.strip().split()[0] for c in schema.split(",")]

        def run(batches) -> Iterator:
            import pandas as pd

            own = start() if start else None
            try:
                for batch in batches:
                    rows = []
                    for key, data in zip(batch["key"], batch["data"]):
                        made = function(own, bytes(key), bytes(data))
                        if made is None:
                            yield pd.DataFrame(rows, columns=names)
                            return
                        rows += made
                    yield pd.DataFrame(rows, columns=names)
            finally:
                if stop:
                    stop(own)

        return self.iterate(ranges).select("key", "data").mapInPandas(run, schema)

    def elements(self) -> int:
        return self.current(True).count()

    # records

    def records(self, include_uncommitted: bool = False) -> DataFrame:
        """The live records in segments by count, in key order: headers, position, data and footer."""
        live = self.current(include_uncommitted)
        flags = F.lit(CHUNKED_CSUM | (NOCSUM if self.config.no_footer else 0)).bitwiseOR(F.when(F.col("kind") == "uncommitted", F.lit(UNCOMMITTED)).otherwise(F.lit(0)))
        flags = flags.bitwiseOR(F.when(F.col("ext").isNotNull(), F.lit(EXTHDR)).otherwise(F.lit(0))).cast("long")
        live = live.select("key", F.concat(F.coalesce("ext", F.expr("X''")), F.col("data")).alias("data"), flags.alias("flags"))
        live = live.withColumn("data_size", F.length("data").cast("long")).withColumn("disk_size", disk_size(F.col("data_size"), self.config.no_footer))
        bucket = F.conv(F.hex(F.substring("key", 1, 2)), 16, 10).cast("long")
        return segments.positions(segments.by_count(live, bucket, ["key"], self.config.records_in_blob))

    def locate(self, key: bytes, include_uncommitted: bool = True):
        """The location of a key's record as a row, or KeyError."""
        found = reads.locate(self.records(True), key, include_uncommitted).take(1)
        if not found:
            raise KeyError("ENOENT")
        return found[0]

    def verify_records(self, records: DataFrame | None = None) -> DataFrame:
        """key, error of the records whose checksums fail; records: with chunks, as a segment file's (its own ones by default)."""
        rows = records if records is not None else self.records().withColumn("chunks", footer("data")["chunks"])
        error = verify_error(F.col("data"), F.col("disk_size"), F.col("flags"), F.col("chunks"), no_footer=self.config.no_footer)
        return rows.where(F.col("data_size") > 0).select("key", error.alias("error")).where("error is not null")

    # maintenance

    def defrag_status(self) -> str:
        """One of DEFRAG_STATES; that of another process as long as it holds the defragmentation's lock."""
        if self._state == "not_started" and files.exists(self.spark, f"{self.path}/_defrag"):
            return "data_sort"
        return self._state

    def start_defrag(self, level: str = "data_sort") -> str:
        """Makes the sorted states of all keys the store's log and gives their folder; EALREADY while another run has the store.

        Uncommitted keys keep their buffers. Nothing is dropped before `vacuum`.
        """
        if level not in maintain.LEVELS:
            raise OSError("EINVAL")
        if self._state != "not_started" or not files.claim(self.spark, f"{self.path}/_defrag"):
            raise OSError("EALREADY")
        self._state = level
        try:
            m = self.manifest()
            ops = self.oplog(m)
            through = ops.agg(F.max("seq")).first()[0] or 0
            name = f"states-{uuid.uuid4().hex}"
            states = state.as_ops(state.states(ops.where(F.col("seq") <= F.lit(through)))).select(*NAMES)
            maintain.compact(states).write.parquet(f"{self.path}/{name}")
            self._publish(m, name, through)
            return f"{self.path}/{name}"
        finally:
            self._state = "not_started"
            files.delete(self.spark, f"{self.path}/_defrag")

    def stop_defrag(self) -> None:
        """Gives up a run that has ended without giving its lock back; EALREADY if none is there."""
        if not files.delete(self.spark, f"{self.path}/_defrag"):
            raise OSError("EALREADY")
        self._state = "not_started"

    def _publish(self, before: dict, name: str, through: int) -> None:
        g = before["generation"] + 1
        text = json.dumps({"generation": g, "states": name, "through": through, "time": time.time()})
        if not files.create_text(self.spark, f"{self.path}/manifest/g{g}.json", text):
            raise OSError("EALREADY")
        log.info("generation %d of %s holds all operations up to %d", g, self.path, through)

    def vacuum(self) -> list[str]:
        """Deletes the states of older generations, which no reader that starts now can see; gives their names."""
        m = self.manifest()
        old = [n for n in files.names(self.spark, self.path) if n.startswith("states-") and n != m["states"]]
        for n in old:
            files.delete(self.spark, f"{self.path}/{n}")
        return old

    # statistics

    def statistics(self) -> DataFrame:
        return stats.with_summary(self.records())

    def size(self) -> int:
        """Bytes of all the store's files."""
        return files.size(self.spark, self.path)

    def refresh_statistics(self) -> str:
        """Writes the text form and the JSON document in place of the old ones and gives the document."""
        rows = self.records(True).withColumn("base_sorted", F.lit(self.generation() > 0))
        bases = stats.all_base_stats(rows, self.config.blob_size, self.config.defrag_percentage, self.config.index_block_size, self.config.index_block_bloom_length)
        m = self.manifest()
        whole = stats.all_global_stats(self.oplog(m), completion=int(m.get("time", 0)))
        lines = stats.text_sections(whole, bases).orderBy("part", "at").select("line").collect()  # a few lines for each base
        files.create_text(self.spark, f"{self.path}/data.stat", "\n".join(r["line"] for r in lines), overwrite=True)
        doc = json.loads(stats.document(whole, bases).first()["json"])
        local = self.path.removeprefix("file://")
        doc |= {"config": stats.config_section(self.config), "vfs": stats.vfs_section(local), "dstat": stats.dstat_section(local), "timestamp": stats.timestamp()}
        text = json.dumps(doc)
        files.create_text(self.spark, f"{self.path}/data.stat.json", text, overwrite=True)
        return text

    def statistics_json(self) -> str:
        """The last document, with an error in it once it is older than twice the period; the first call makes one."""
        if not files.exists(self.spark, f"{self.path}/data.stat.json"):
            return self.refresh_statistics()
        text = files.read_text(self.spark, f"{self.path}/data.stat.json")
        made = json.loads(text)["timestamp"]
        age = time.time() - made["tv_sec"] - made["tv_usec"] / 1_000_000
        return self.spark.range(1).select(stats.with_staleness(F.lit(text), F.lit(age), self.config.periodic_timeout)).first()[0]

    def periodic(self, now: float | None = None) -> bool:
        """Refreshes the statistics if their period is over; for a caller's timer."""
        now = time.time() if now is None else now
        if now - getattr(self, "_refreshed", 0) < self.config.periodic_timeout:
            return False
        self._refreshed = now
        self.refresh_statistics()
        return True
