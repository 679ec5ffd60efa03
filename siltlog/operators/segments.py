"""Segments (bases) of a record log: roll-over, positions, blocks, order and duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 40


def global_number(rows: DataFrame, bucket: Column, order: list[str], out: str, wide: int = 4096) -> DataFrame:
    """Adds a gapless number from 0 in `order`, without one task for all rows.

    bucket: a whole number that rises with the order and splits the rows; a bucket is numbered in its own task and moved up
    by the sizes of the buckets before it, which are summed in two levels of `wide` buckets. The table of buckets is joined by hash, not broadcast.
    """
    cut = rows.withColumn("_b", bucket)
    sizes = cut.groupBy("_b").agg(F.count(F.lit(1)).alias("_n")).withColumn("_w", F.floor(F.col("_b") / wide))
    to_here = Window.rowsBetween(Window.unboundedPreceding, -1)
    tops = sizes.groupBy("_w").agg(F.sum("_n").alias("_m")).select("_w", F.coalesce(F.sum("_m").over(to_here.orderBy("_w")), F.lit(0)).alias("_top"))
    inner = sizes.select("_w", "_b", F.coalesce(F.sum("_n").over(to_here.partitionBy("_w").orderBy("_b")), F.lit(0)).alias("_low"))
    before = inner.join(tops, "_w").select("_b", (F.col("_top") + F.col("_low")).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_b").orderBy(*order)) - 1
    return cut.withColumn("_own", own).join(before, "_b").withColumn(out, F.col("_own") + F.col("_before")).drop("_b", "_own", "_before")


def by_count(rows: DataFrame, bucket: Column, order: list[str], records: int) -> DataFrame:
    """Adds idx and base: a new base after every `records` rows."""
    return global_number(rows, bucket, order, "idx").withColumn("base", F.expr(f"idx div {records}"))


def by_bytes(rows: DataFrame, stream: list[str], order: str, size: str, limit: int) -> DataFrame:
    """stream, order, base: a base is closed once it has reached `limit` bytes. A fold over each stream's sizes."""
    grouped = rows.groupBy(*stream).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(size).cast("long").alias("z")))).alias("_r"))
    step = f"""(s, r) -> named_struct('base', if(s.used >= {limit}L, s.base + 1, s.base), 'used', if(s.used >= {limit}L, r.z, s.used + r.z),
        'out', concat(s.out, array(named_struct('o', r.o, 'base', if(s.used >= {limit}L, s.base + 1, s.base)))))"""
    start = "named_struct('base', 0L, 'used', 0L, 'out', cast(array() as array<struct<o:bigint,base:bigint>>))"
    return grouped.select(*stream, F.expr(f"inline(aggregate(_r, {start}, {step}).out)")).withColumnRenamed("o", order)


def positions(records: DataFrame) -> DataFrame:
    """Adds position: where each record starts in its base."""
    w = Window.partitionBy("base").orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return records.withColumn("position", F.sum("disk_size").over(w) - F.col("disk_size"))


def blocks(records: DataFrame, size: int = BLOCK) -> DataFrame:
    """base, block, start_key, end_key, n for every `size` headers in key order."""
    n = F.row_number().over(Window.partitionBy("base").orderBy("key", "idx")) - 1
    return records.withColumn("_n", n).groupBy("base", F.expr(f"_n div {size}").alias("block")).agg(F.min("key").alias("start_key"), F.max("key").alias("end_key"), F.count(F.lit(1)).alias("n"))


def unsorted_at(records: DataFrame) -> DataFrame:
    """Records with a smaller key than the one before."""
    before = F.lag("key").over(Window.partitionBy("base").orderBy("idx"))
    return records.withColumn("previous_key", before).where(F.col("previous_key") > F.col("key"))


def duplicates(records: DataFrame) -> DataFrame:
    return records.groupBy("base", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def bloom_bytes(records: int, block: int = BLOCK, bits: int = 40 * 128) -> int:
    return (records // block + 1) * bits // 8


def index_block_bytes(records: int, block: int = BLOCK, entry: int = 144) -> int:
    return -(-records // block) * entry
