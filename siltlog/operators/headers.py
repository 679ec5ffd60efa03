"""Index headers beside the headers in the data files: mismatches, repairs, and what can be read of a damaged index.

Headers: base, idx, key, flags, data_size, disk_size, position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.records import HEADER, REMOVE, validity

FIELDS = ("key", "flags", "data_size", "disk_size")
#: Damaged entries of a sorted index up to which it is still used.
CORRUPT_MAX = 1024


def _data_side(data: DataFrame) -> DataFrame:
    return data.select("base", "position", *[F.col(c).alias(f"data_{c}") for c in FIELDS])


def header_pairs(index: DataFrame, data: DataFrame) -> DataFrame:
    """base, position, the fields of both sides and `pair`: same, mismatch, index_only or data_only. One join, by (base, position)."""
    left = index.select("base", "position", "idx", *FIELDS)
    both = left.join(_data_side(data), ["base", "position"], "full_outer")
    same = F.lit(True)
    for c in FIELDS:
        same = same & F.col(c).eqNullSafe(F.col(f"data_{c}"))
    pair = F.when(F.col("data_disk_size").isNull(), "index_only").when(F.col("disk_size").isNull(), "data_only").when(same, "same").otherwise("mismatch")
    return both.withColumn("pair", pair)


def reconcile_removed(index: DataFrame, data: DataFrame) -> DataFrame:
    """The index with REMOVE set where the data header has it and the index has not, and `fixed` there."""
    gone = data.where(F.col("flags").bitwiseAND(F.lit(REMOVE)) != 0).select("base", "position", F.lit(True).alias("_gone"))
    fixed = F.coalesce(F.col("_gone"), F.lit(False)) & (F.col("flags").bitwiseAND(F.lit(REMOVE)) == 0)
    out = index.join(gone, ["base", "position"], "left").withColumn("fixed", fixed)
    return out.withColumn("flags", F.when(fixed, F.col("flags").bitwiseOR(F.lit(REMOVE))).otherwise(F.col("flags"))).drop("_gone")


def _verdict() -> Column:
    return validity(*(F.col(c) for c in ("data_size", "disk_size", "position", "file_size", "flags")))


def walk_index(index: DataFrame) -> DataFrame:
    """Entries of an unsorted index (with file_size, the size of the data file) up to its first bad one, as opening a store keeps them.

    Holes of zeros are no reason to stop and are passed over. What is behind a bad entry is cut off.
    """
    judged = index.withColumn("validity", _verdict())
    bad = F.min(F.when(~F.col("validity").isin("ok", "hole"), F.col("idx"))).over(Window.partitionBy("base"))
    return judged.withColumn("_bad", bad).where((F.col("_bad").isNull() | (F.col("idx") < F.col("_bad"))) & (F.col("validity") != "hole")).drop("_bad")


def sorted_index_report(index: DataFrame, block: int = 40) -> DataFrame:
    """base, entries, corrupted, error: whether a sorted index can be used.

    EBADF for one without entries cannot be seen here (see `index_size_error`). EB0001: a bad entry at the begin or end of a block of
    `block` entries, or more than CORRUPT_MAX bad ones. EINVAL: keys out of order.
    """
    judged = index.withColumn("_bad", ~_verdict().isin("ok", "hole")).withColumn("_edge", (F.col("idx") % block).isin(0, block - 1))
    good = F.when(~F.col("_bad"), F.col("key"))
    before = F.last(good, ignorenulls=True).over(Window.partitionBy("base").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1))
    judged = judged.withColumn("_back", F.coalesce(~F.col("_bad") & (before > F.col("key")), F.lit(False)))
    out = judged.groupBy("base").agg(F.count(F.lit(1)).alias("entries"), F.count_if("_bad").alias("corrupted"), F.max(F.col("_bad") & F.col("_edge")).alias("_edge"), F.max("_back").alias("_back"))
    error = F.when(F.col("_edge") | (F.col("corrupted") > CORRUPT_MAX), "EB0001").when(F.col("_back"), "EINVAL")
    return out.select("base", "entries", "corrupted", error.alias("error"))


def index_size_error(size: Column, is_sorted: Column) -> Column:
    """Null, or EBADF for an index that does not hold whole headers or, if sorted, none at all."""
    return F.when((size % HEADER != 0) | (is_sorted & (size == 0)), "EBADF")


def merge_validated(index: DataFrame, data: DataFrame, max_size: int = 10 << 30) -> DataFrame:
    """Adds class (broken, removed or written) to index entries (with input, file_size), checked against the data headers.

    An entry of only a header's size is of an old store: its disk_size is not compared, and the one of the data header counts (new_size).
    """
    d, old = F.col("disk_size"), F.col("disk_size") == HEADER
    outside = F.col("position") + d > F.col("file_size")
    both = index.join(_data_side(data), ["base", "position"], "left")
    removed = lambda c: F.col(c).bitwiseAND(F.lit(REMOVE)) != 0
    differs = ~F.col("key").eqNullSafe(F.col("data_key")) | (~old & (F.col("data_disk_size") != d))
    kind = (
        F.when(~old & (d < F.col("data_size") + HEADER), "broken")
        .when(outside | (d > max_size), "broken")
        .when(removed("flags"), "removed")
        .when(F.col("data_disk_size").isNull() | differs | (F.col("position") + F.col("data_disk_size") > F.col("file_size")), "broken")
        .when(removed("data_flags"), "removed")
        .when(F.col("data_disk_size") > HEADER, "written")
        .otherwise("broken")
    )
    return both.withColumn("class", kind).withColumn("new_size", F.col("data_disk_size")).drop("data_key", "data_flags", "data_data_size", "data_disk_size")


def merged_positions(classified: DataFrame, base: str = "target") -> DataFrame:
    """The written entries of `merge_validated` in key order within each target, with new positions; equal keys all stay."""
    w = Window.partitionBy(base).orderBy("key", "input", "idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return classified.where("class = 'written'").withColumn("new_position", F.sum("new_size").over(w) - F.col("new_size"))
