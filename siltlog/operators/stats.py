"""Statistics of a store: each base, all bases, the operation log, and their JSON and text forms."""

from __future__ import annotations

import os
import time
from dataclasses import asdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.records import HEADER
from .maintain import DECISIONS, want_defrag

GLOBAL = (
    "datasort_start_time", "read_copy_updates", "prepare_reused", "memory_index_tree", "lookup_reads_number", "data_reads_number",
    "writes_number", "reads_size", "writes_size", "index_files_reads_number", "datasort_completion_time", "datasort_completion_status",
)
BASE = ("records_total", "records_removed", "records_removed_size", "records_corrupted", "base_size", "memory_bloom_filter", "memory_index_blocks", "want_defrag", "is_sorted")
#: Bytes of an entry of the index in memory, and of an index block.
ENTRY, BLOCK_ENTRY = 72, 144
TIMED_OUT = 110


def _counters() -> list[Column]:
    removed = F.col("flags").bitwiseAND(F.lit(1)) != 0
    footprint = F.col("disk_size") + HEADER
    return [
        F.count(F.lit(1)).alias("records_total"),
        F.count_if(removed).alias("records_removed"),
        F.coalesce(F.sum(F.when(removed, footprint)), F.lit(0)).alias("records_removed_size"),
        F.sum(footprint).alias("base_size"),
    ]


def base_stats(records: DataFrame) -> DataFrame:
    return records.groupBy("base").agg(*_counters())


def with_summary(records: DataFrame) -> DataFrame:
    """base_stats and one row for all (base null), from one aggregation of the records."""
    return records.rollup("base").agg(*_counters())


def all_base_stats(records: DataFrame, blob_size: int, percent: int = 25, block: int = 40, bloom_bits: int = 40 * 128) -> DataFrame:
    """base and the nine counters of BASE (records may have validity and base_sorted; all bases are unsorted without it).

    The filters and blocks in memory are those of sorted bases. want_defrag is the code, -22 for EINVAL.
    """
    bad = ~F.col("validity").isin("ok", "hole") if "validity" in records.columns else F.lit(False)
    is_sorted = F.col("base_sorted") if "base_sorted" in records.columns else F.lit(False)
    s = records.groupBy("base").agg(*_counters(), F.count_if(bad).alias("records_corrupted"), F.max(is_sorted.cast("int")).cast("long").alias("is_sorted"))
    n = F.col("records_total")
    s = s.withColumn("memory_bloom_filter", F.when(F.col("is_sorted") == 1, ((F.floor(n / block) + 1) * bloom_bits / 8).cast("long")).otherwise(0).cast("long"))
    s = s.withColumn("memory_index_blocks", F.when(F.col("is_sorted") == 1, F.ceil(n / block) * BLOCK_ENTRY).otherwise(0).cast("long"))
    named = s.withColumns({"total": n, "removed": F.col("records_removed"), "size": F.col("base_size"), "removed_size": F.col("records_removed_size"), "index_size": n * HEADER})
    return want_defrag(named, blob_size, percent).select("base", *[F.coalesce(F.col("code"), F.lit(-22)).cast("long").alias("want_defrag") if c == "want_defrag" else F.col(c) for c in BASE])


def summary_of(bases: DataFrame) -> DataFrame:
    """Sums of every counter over all bases."""
    return bases.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in BASE])


def global_stats(oplog: DataFrame) -> DataFrame:
    writes = F.col("op").isin("write", "append")
    return oplog.agg(
        F.count_if(writes).alias("writes_number"),
        F.coalesce(F.sum(F.when(writes, F.length("data"))), F.lit(0)).cast("long").alias("writes_size"),
        F.count_if(F.col("op") == "remove").alias("removes_number"),
    )


def all_global_stats(oplog: DataFrame, reads: DataFrame | None = None, unsorted_records: int = 0, start: int = 0, completion: int = 0, status: int = 0) -> DataFrame:
    """The twelve counters of GLOBAL, from the operation log and a log of reads (kind: lookup or data, size, bases: index files read).

    read_copy_updates counts writes that keep bytes of an older value (appends, and writes behind its begin), prepare_reused
    the prepares of a key that is there. Whether a key is there is seen from the operations before, in one window by key.
    """
    past = Window.partitionBy("key").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    made = F.max(F.when(F.col("op") != "remove", F.col("seq"))).over(past)
    gone = F.max(F.when(F.col("op") == "remove", F.col("seq"))).over(past)
    there = made.isNotNull() & (gone.isNull() | (made > gone))
    writes = F.col("op").isin("write", "append", "insert", "update", "upsert", "plain_write")
    keeps = F.col("_there") & F.col("op").isin("write", "append", "update", "upsert") & ((F.col("op") == "append") | (F.coalesce("offset", F.lit(0)) > 0))
    out = oplog.withColumn("_there", there).agg(
        F.count_if(keeps).alias("read_copy_updates"),
        F.count_if(F.col("_there") & (F.col("op") == "prepare")).alias("prepare_reused"),
        F.count_if(writes).alias("writes_number"),
        F.coalesce(F.sum(F.when(writes, F.length("data"))), F.lit(0)).cast("long").alias("writes_size"),
    )
    if reads is None:
        seen = out.sparkSession.createDataFrame([(0, 0, 0, 0)], "lookup_reads_number long, data_reads_number long, reads_size long, index_files_reads_number long")
    else:
        data = F.col("kind") == "data"
        sum_of = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
        seen = reads.agg(F.count(F.lit(1)).alias("lookup_reads_number"), F.count_if(data).alias("data_reads_number"), sum_of(F.when(data, F.col("size"))).alias("reads_size"), sum_of(F.col("bases")).alias("index_files_reads_number"))
    fixed = {"datasort_start_time": start, "datasort_completion_time": completion, "datasort_completion_status": status, "memory_index_tree": unsorted_records * ENTRY}
    both = out.withColumn("_one", F.lit(1)).join(seen.withColumn("_one", F.lit(1)), "_one")  # one row on either side
    return both.withColumns({k: F.lit(v).cast("long") for k, v in fixed.items()}).select(*GLOBAL)


def stats_json(records: DataFrame) -> DataFrame:
    """base, json: one document for each base."""
    s = base_stats(records)
    return s.select("base", F.to_json(F.struct(*[c for c in s.columns if c != "base"])).alias("json"))


def config_section(config) -> dict:
    """The section on the configuration; `flags` of the store are shown by number and name."""
    c = asdict(config)
    names = {"data": "path", "blob_flags": "flags"}
    keys = ("blob_flags", "sync", "data", "blob_size", "records_in_blob", "defrag_percentage", "defrag_timeout", "index_block_size", "index_block_bloom_length", "blob_size_limit", "defrag_time", "defrag_splay")
    return {k: c.get(names.get(k, k), 0) for k in keys} | {"string_blob_flags": store_flags(c.get("flags", 0))}


#: Names of the store's flags, by bit (fixed values; bit 5 is internal).
STORE_FLAGS = {
    0: "reserve_10_percents", 1: "overwrite_commits", 2: "try_overwrite", 3: "no_footer", 4: "no_free_space_check", 6: "l2hash",
    7: "auto_datasort", 8: "timed_datasort", 9: "scheduled_datasort", 10: "disabled_threads", 11: "auto_indexsort",
}


def store_flags(flags: int) -> str:
    return f"0x{flags:x} [{'|'.join(n for i, n in STORE_FLAGS.items() if flags >> i & 1)}]"


def timestamp(now: float | None = None) -> dict:
    now = time.time() if now is None else now
    return {"tv_sec": int(now), "tv_usec": int(now % 1 * 1_000_000), "string": time.strftime("%Y-%m-%d %H:%M:%S", time.gmtime(now))}


def vfs_section(folder: str) -> dict:
    """Figures of the file system of a folder of the driver's machine."""
    try:
        s = os.statvfs(folder)
    except OSError as e:
        return {"timestamp": timestamp(), "error": -e.errno}
    names = ("bsize", "frsize", "blocks", "bfree", "bavail", "files", "ffree", "favail", "fsid", "flag", "namemax")
    return {"timestamp": timestamp(), **{n: getattr(s, f"f_{n}", 0) for n in names}}


DISK = ("read_ios", "read_merges", "read_sectors", "read_ticks", "write_ios", "write_merges", "write_sectors", "write_ticks", "in_flight", "io_ticks", "time_in_queue")


def dstat_section(folder: str) -> dict:
    """Figures of the block device of a folder of the driver's machine, as far as the system tells them."""
    try:
        device = os.stat(folder).st_dev
        with open(f"/sys/dev/block/{os.major(device)}:{os.minor(device)}/stat") as f:
            return {"timestamp": timestamp(), **dict(zip(DISK, map(int, f.read().split())))}
    except OSError as e:
        return {"timestamp": timestamp(), "error": -(e.errno or 5)}


def document(whole: DataFrame, bases: DataFrame, name: str = "data") -> DataFrame:
    """json: one document with global_stats, summary_stats and base_stats (a map by the name of the base)."""
    names = F.create_map(*[F.lit(x) for i, n in enumerate(DECISIONS) for x in (i, n)])
    each = F.struct(F.concat(F.lit(f"{name}-0."), F.col("base").cast("string")).alias("key"), F.struct(*[F.col(c) for c in BASE], F.coalesce(names[F.col("want_defrag").cast("int")], F.lit("unknown")).alias("string_want_defrag")).alias("value"))
    by_base = bases.agg(F.map_from_entries(F.array_sort(F.collect_list(each))).alias("base_stats"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in BASE])  # a row for each base
    one = by_base.select(F.lit(1).alias("_one"), "base_stats", F.struct(*BASE).alias("summary_stats"))
    return one.join(whole.select(F.lit(1).alias("_one"), F.struct(*GLOBAL).alias("global_stats")), "_one").select(F.to_json(F.struct("global_stats", "summary_stats", "base_stats")).alias("json"))


def read_document(json: DataFrame) -> DataFrame:
    """section, name, counter, value of a document's statistics."""
    counters = "map<string,bigint>"
    bare = f"struct<{','.join(f'{c}:bigint' for c in BASE)}>"
    j = json.select(F.from_json("json", f"struct<global_stats:{counters},summary_stats:{counters},base_stats:map<string,{bare}>>").alias("j"))
    flat = lambda section, c: j.select(F.lit(section).alias("section"), F.lit(None).cast("string").alias("name"), F.explode(c).alias("counter", "value"))
    each = j.select(F.explode("j.base_stats").alias("name", "s")).select(F.lit("base").alias("section"), "name", F.explode(F.create_map(*[x for c in BASE for x in (F.lit(c), F.col(f"s.{c}"))])).alias("counter", "value"))
    return flat("global", "j.global_stats").unionByName(flat("summary", "j.summary_stats")).unionByName(each)


def with_staleness(json: Column, age: Column, period: int = 15) -> Column:
    """The document, with an error in it once it is older than twice the period (age in seconds)."""
    error = F.concat(F.lit(f',"error":{{"code":{TIMED_OUT},"message":"cached json is too old","lifetime":'), (age * 1_000_000).cast("long").cast("string"), F.lit(f',"lifetime_limit":{2 * period * 1_000_000}}}}}'))
    return F.when(age > 2 * period, F.concat(F.regexp_replace(json, r"\}\s*$", ""), error)).otherwise(json)


def stat_text(stats: DataFrame) -> DataFrame:
    """Lines of the text form, one for each counter."""
    names = [c for c in stats.columns if c != "base"]
    pairs = F.array(*[F.concat(F.rpad(F.lit(n + ":"), 48, " "), F.col(n).cast("string")) for n in names])
    return stats.select("base", F.explode(pairs).alias("line"))


def text_sections(whole: DataFrame, bases: DataFrame, name: str = "data") -> DataFrame:
    """part, at, line of the text form: GLOBAL, SUMMARY, then each base; a section ends with an empty line."""

    def lines(rows: DataFrame, part: Column, title: Column, names: tuple[str, ...]) -> DataFrame:
        each = F.array(title, *[F.concat(F.lit(f"{n}: "), F.col(n).cast("string")) for n in names], F.lit(""))
        return rows.select(part.cast("long").alias("part"), F.posexplode(each).alias("at", "line"))

    first = lines(whole, F.lit(-2), F.lit("GLOBAL:"), GLOBAL).unionByName(lines(summary_of(bases), F.lit(-1), F.lit("SUMMARY:"), BASE))
    return first.unionByName(lines(bases, F.col("base"), F.concat(F.lit(f"BASE: {name}-0."), F.col("base").cast("string")), BASE))
