"""Maintenance: the defragmentation decision, packing of bases, sorting, compaction and merging."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.records import HEADER

DECISIONS = ("not_needed", "needed", "can_be_removed", "can_be_merged")


def want_defrag(stats: DataFrame, blob_size: int, percent: int = 25) -> DataFrame:
    """stats: base, total, removed, size, removed_size, index_size, data_offset (optional: size). Adds code (null: EINVAL) and decision.

    A base without any records but with bytes in its files only seems to be empty, so it is EINVAL and never removable.
    """
    t, r, z, rz = (F.col(c) for c in ("total", "removed", "size", "removed_size"))
    bytes_ = F.col("data_offset") if "data_offset" in stats.columns else z
    newest = stats.agg(F.max("base")).first()[0]  # one number
    code = (
        F.when(F.col("base") == F.lit(newest), 0)
        .when((t == 0) & (r == 0) & ((bytes_ != 0) | (F.col("index_size") != 0)), F.lit(None))
        .when((r > t) | (rz > z) | (z < 0), F.lit(None))
        .when(t == r, F.when(F.col("index_size") == t * HEADER, 2).otherwise(1))
        .when(rz >= F.expr(f"size * {percent}L div 100"), 1)
        .when(z - rz < F.lit(blob_size // 10), 3)
        .otherwise(0)
    )
    names = F.create_map(*[F.lit(x) for i, n in enumerate(DECISIONS) for x in (i, n)])
    return stats.withColumn("code", code.cast("int")).withColumn("decision", F.coalesce(names[F.col("code")], F.lit("EINVAL")))


LEVELS = ("data_sort", "index_sort", "compact")


def defrag_plan(decided: DataFrame, size_limit: int, records_limit: int, level: str = "data_sort") -> DataFrame:
    """What a run of a level does with each base of `want_defrag` (with is_sorted): base, action (remove, sort, skip), grp.

    The last base is left alone and removable ones go. Of the rest, a compacting run leaves those that need nothing, the others
    leave them if they are sorted. Neighbours are sorted together as `pack` groups them, a sorted base by itself only if it is
    needed; a run that only sorts indexes takes each unsorted base by itself.
    """
    if level not in LEVELS:
        raise ValueError(f"a level is one of {LEVELS}")
    newest = decided.agg(F.max("base")).first()[0]
    idle = F.coalesce(F.col("code") == 0, F.lit(False)) & (F.lit(level == "compact") | F.col("is_sorted"))
    first = F.when(F.col("base") == F.lit(newest), "skip").when(F.col("code") == 2, "remove").when(idle | (F.lit(level == "index_sort") & F.col("is_sorted")), "skip").otherwise("sort")
    judged = decided.withColumn("action", first)
    todo = judged.where("action = 'sort'")
    if level == "index_sort":
        return judged.select("base", "action", F.when(F.col("action") == "sort", F.col("base")).alias("grp"))
    grouped = pack(todo.select("base", "size", (F.col("total") - F.col("removed")).alias("live")), size_limit, records_limit)
    alone = grouped.groupBy("grp").agg(F.count(F.lit(1)).alias("_n"))
    out = judged.join(grouped.join(alone, "grp"), "base", "left")
    idle = (F.col("_n") == 1) & F.col("is_sorted") & ~F.coalesce(F.col("code") == 1, F.lit(False))
    action = F.when((F.col("action") == "sort") & idle, "skip").otherwise(F.col("action"))
    return out.select("base", action.alias("action"), F.when(action == "sort", F.col("grp")).alias("grp"))


def apply_plan(records: DataFrame, plan: DataFrame) -> DataFrame:
    """The records after a run of `defrag_plan`: base, idx, position as they become, from_base, is_new.

    The live records of a group are sorted by key into its first base; removable bases go, the others stay as they are.
    """
    firsts = plan.where("action = 'sort'").groupBy("grp").agg(F.min("base").alias("_to"))
    todo = plan.join(firsts, "grp", "left").select("base", "action", F.coalesce("_to", "base").alias("_to"))
    found = records.join(todo, "base").where("action <> 'remove'").withColumnRenamed("base", "from_base").withColumnRenamed("_to", "base").withColumn("is_new", F.col("action") == "sort")
    stay = found.where("not is_new")
    live = found.where(F.col("is_new") & (F.col("flags").bitwiseAND(F.lit(1)) == 0))
    w = Window.partitionBy("base").orderBy("key", "from_base", "idx")
    here = F.sum("disk_size").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("disk_size")
    made = live.withColumn("position", here).withColumn("_idx", F.row_number().over(w) - 1).withColumn("idx", F.col("_idx").cast("long")).drop("_idx")
    return stay.unionByName(made).drop("action")


def merged_index_bytes(plan: DataFrame, stats: DataFrame) -> DataFrame:
    """grp, index_size: the size of the index that sorting each group makes."""
    live = stats.select("base", (F.col("total") - F.col("removed")).alias("live"))
    return plan.where("action = 'sort'").join(live, "base").groupBy("grp").agg((F.sum("live") * HEADER).alias("index_size"))


def compact_bases(records: DataFrame) -> DataFrame:
    """Bases that hold removed records, without them: base, key, idx, new_position in the order of idx. Others are left out."""
    w = Window.partitionBy("base")
    gone = F.col("flags").bitwiseAND(F.lit(1)) != 0
    live = records.withColumn("_gone", F.max(gone).over(w)).where(F.col("_gone") & ~gone).drop("_gone")
    before = w.orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return live.withColumn("new_position", F.sum("disk_size").over(before) - F.col("disk_size"))


def pack(candidates: DataFrame, size_limit: int, records_limit: int) -> DataFrame:
    """candidates: base, size, live. Adds grp: consecutive bases together while both limits hold; empty ones always join.

    One fold over a row for each base, which is far smaller than the data.
    """
    rows = candidates.agg(F.array_sort(F.collect_list(F.struct("base", F.col("size").cast("long").alias("size"), F.col("live").cast("long").alias("live")))).alias("r"))
    fits = f"(r.live = 0 or (s.n + r.live <= {records_limit}L and s.z + r.size <= {size_limit}L))"
    step = f"""(s, r) -> if(s.g >= 0 and {fits},
        named_struct('g', s.g, 'z', s.z + r.size, 'n', s.n + r.live, 'out', concat(s.out, array(named_struct('base', r.base, 'grp', s.g)))),
        named_struct('g', s.g + 1, 'z', r.size, 'n', r.live, 'out', concat(s.out, array(named_struct('base', r.base, 'grp', s.g + 1)))))"""
    start = "named_struct('g', -1L, 'z', 0L, 'n', 0L, 'out', cast(array() as array<struct<base:bigint,grp:bigint>>))"
    return rows.select(F.expr(f"inline(aggregate(r, {start}, {step}).out)"))


def compact(records: DataFrame, removed_keys: DataFrame | None = None, partitions: int | None = None) -> DataFrame:
    """Live records without those removed since the snapshot, range-partitioned and sorted by key."""
    live = records.where(F.col("flags").bitwiseAND(F.lit(1)) == 0)
    if removed_keys is not None:
        live = live.join(removed_keys.select("key").distinct(), "key", "left_anti")
    return (live.repartitionByRange(partitions, "key") if partitions else live.repartitionByRange("key")).sortWithinPartitions("key")


def index_order(records: DataFrame) -> DataFrame:
    """Adds pos: the place in the sorted index of the base, by key, removed records first."""
    w = Window.partitionBy("base").orderBy("key", F.col("flags").bitwiseAND(F.lit(1)).desc(), "idx")
    return records.withColumn("pos", F.row_number().over(w) - 1)


def merge_class(records: DataFrame, max_size: int = 10 << 30) -> DataFrame:
    """Adds class (broken, removed or written) to headers with data_size, disk_size, position, flags, file_size."""
    d = F.col("disk_size")
    broken = ((d < F.col("data_size") + HEADER) & (d != HEADER)) | (F.col("position") + d > F.col("file_size")) | (d > max_size)
    removed = F.col("flags").bitwiseAND(F.lit(1)) != 0
    return records.where(~((d == 0) & (F.col("data_size") == 0))).withColumn("class", F.when(broken, "broken").when(removed, "removed").when(d <= HEADER, "broken").otherwise("written"))


def merge(records: DataFrame, base: str = "target") -> DataFrame:
    """Written records of all inputs in key order within each target, with new positions; equal keys all stay."""
    w = Window.partitionBy(base).orderBy("key", "input", "idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return merge_class(records).where("class = 'written'").withColumn("new_position", F.sum("disk_size").over(w) - F.col("disk_size"))
