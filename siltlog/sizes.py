"""How many partitions a step needs so that its tasks stay of one size however large the input is."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame

#: More partitions than this cost the driver more than they save a task.
MOST = 20_000


def input_bytes(*frames: DataFrame) -> int | None:
    """Bytes of the files that the frames read, from the plan alone; None where a source can't tell."""
    total = 0
    for df in frames:
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
        for i in range(leaves.size()):
            total += int(str(leaves.apply(i).stats().sizeInBytes()))
    return total if total < 1 << 60 else None  # a source of unknown size counts as the largest number


def parts(df: DataFrame, each: int, *others: DataFrame) -> int:
    """Partitions for `each` bytes of input files apiece, one for each core at least; what is set for shuffles where the size is not known."""
    spark = df.sparkSession
    found = input_bytes(df, *others)
    if found is None:
        return int(spark.conf.get("spark.sql.shuffle.partitions"))
    return min(MOST, max(spark.sparkContext.defaultParallelism, math.ceil(found / each)))
