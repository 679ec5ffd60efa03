"""Tables of the test data as operation logs and records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.records import disk_size
from ..sizes import parts

#: Input bytes whose records make one partition.
PART = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_log(events: DataFrame, machine: bool = False) -> DataFrame:
    """events as an operation log; machine: the variant that uses prepare, plain_write and commit."""
    kind, odd = F.col("event_type"), F.col("event_id") % 2 != 0
    op = F.when(kind == "click", "write").when(kind == "view", "append").when(kind == "error", "remove")
    if machine:
        op = op.when(kind == "purchase", "commit").when((kind == "signup") & odd, "plain_write").when(kind == "signup", "prepare")
    else:
        op = op.when(kind == "purchase", "write").when(kind == "signup", "append")
    offset = F.lit(0) if machine else F.when(kind == "purchase", 4).when(kind == "signup", 2).otherwise(0)
    size = F.when(op == "prepare", 1 << 40).otherwise(-1)
    data = F.encode(F.concat("event_type", F.lit(":"), "props"), "UTF-8")
    return events.select(F.col("event_id").alias("seq"), F.concat(F.lit("user-"), F.col("user_id")).alias("key"), op.alias("op"), offset.cast("long").alias("offset"), size.cast("long").alias("size"), data.alias("data"), F.lit(0).cast("long").alias("flags"))


def item_records(lineitem: DataFrame, dealt: bool = False) -> DataFrame:
    """lineitem as record headers in bases of 1000 order keys; returned items are removed records.

    dealt: the rows are dealt out by base in partitions of PART bytes of input, for windows over a base, which then need no other
    shuffle; without it a count by base need not move the rows.
    """
    w = "row_number() over (partition by base order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) - 1"
    rows = lineitem.withColumn("base", F.expr("l_orderkey div 1000"))
    rows = rows.repartition(parts(lineitem, PART), "base") if dealt else rows
    out = rows.select(
        "base",
        F.expr(w).cast("long").alias("idx"),
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("key"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(256).cast("long").alias("flags"),
        (F.col("l_quantity").cast("long") * 10).alias("data_size"),
    )
    return out.withColumn("disk_size", disk_size(F.col("data_size")))
