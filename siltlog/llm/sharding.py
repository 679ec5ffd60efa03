"""Operator 1, native: shards as runs of a Hilbert curve over metadata, for pruning files by several columns at once.

Each metadata dimension (text size, source, language) is quantised to 2^bits levels that keep the order of its values: a
dimension of few values has a level for each, spread over all levels; another has levels of about equal numbers of rows. A
Hilbert curve visits the cells so that neighbours on the curve are neighbours in the space; rows are ordered by (cell, salt,
tie columns) and the order is cut into equally long runs. The smallest and largest value of a column in a shard
(`bounds_of`) then tell readers which shards they need.

Law `rows`: the shards' row counts differ by one at most. The number of cells, 2^(bits * dimensions), is fixed, so the
table of cell sizes that is broadcast is bounded (4096 rows with the defaults) whatever the input; of a dimension's values
only the 2^bits - 1 that begin a level reach the driver.

Defined cases: a null or empty text has 16 bytes and CRC 0; a very long text is only measured; null metadata have level 0;
a null doc_id stays null and comes first in its cell; equal rows are told apart by any order among themselves; an empty table gives no rows; fewer
rows than shards leave shards empty. Equal texts may fall in different shards, as the law counts rows. Other columns of the
input, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, ranked, written


def hilbert(levels: list[Column], bits: int) -> Column:
    """The place on the Hilbert curve of a cell with these coordinates (0 to 2^bits - 1), by bit transposition."""
    n = len(levels)
    steps = F.array(*[F.struct(F.lit(1 << q).alias("q"), F.lit(i).alias("i")) for q in range(bits - 1, 0, -1) for i in range(n)])

    def turn(x: Column, s: Column) -> Column:
        mask = s["q"] - F.lit(1)
        here = F.element_at(x, s["i"] + 1)
        swap = x[0].bitwiseXOR(here).bitwiseAND(mask)
        set_ = here.bitwiseAND(s["q"]) != 0
        return F.transform(x, lambda v, k: F.when(set_, F.when(k == 0, v.bitwiseXOR(mask)).otherwise(v)).otherwise(F.when((k == 0) | (k == s["i"]), v.bitwiseXOR(swap)).otherwise(v)))

    def gray(x: Column) -> Column:
        sums = [x[0]]
        for i in range(1, n):
            sums.append(sums[-1].bitwiseXOR(x[i]))
        return F.array(*sums)

    def undo(x: Column) -> Column:
        t = F.lit(0)
        for q in range(bits - 1, 0, -1):
            t = t.bitwiseXOR(F.when(x[n - 1].bitwiseAND(F.lit(1 << q)) != 0, F.lit((1 << q) - 1)).otherwise(F.lit(0)))
        return F.transform(x, lambda v: v.bitwiseXOR(t))

    def interleave(x: Column) -> Column:
        out = F.lit(0)
        for q in range(bits):
            for i in range(n):
                out = out + F.shiftleft(F.shiftright(x[i], q).bitwiseAND(F.lit(1)), q * n + n - 1 - i)
        return out

    x = F.array(*[c.cast("int") for c in levels])
    if bits > 1:
        x = F.aggregate(steps, x, turn)
    return let(let(let(x, gray), undo), interleave)


def level_starts(rows: DataFrame, column: str, levels: int) -> list[tuple]:
    """(level, smallest value) of the levels above 0 in the order of the values; null is not a value.

    The distinct values are sorted in parts and their counts are summed by part, so that no task gets them all.
    """
    counts = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    counts = written(counts.repartitionByRange("v").withColumn("p", F.spark_partition_id()), "values")
    many, total = counts.agg(F.count(F.lit(1)), F.sum("n")).first()
    if many <= levels:
        return [(i * levels // many, r["v"]) for i, r in enumerate(counts.orderBy("v").collect())][1:]
    to_here = Window.rowsBetween(Window.unboundedPreceding, -1)
    sums = counts.groupBy("p").agg(F.sum("n").alias("m")).select("p", F.coalesce(F.sum("m").over(to_here.orderBy("p")), F.lit(0)).alias("before"))
    inner = counts.withColumn("own", F.coalesce(F.sum("n").over(to_here.partitionBy("p").orderBy("v")), F.lit(0)))
    level = ((F.col("before") + F.col("own")) * levels / F.lit(total)).cast("int")
    starts = inner.join(sums, "p").groupBy(level.alias("level")).agg(F.min("v").alias("v"))
    return [(r["level"], r["v"]) for r in starts.where("level > 0").orderBy("level").collect()]


def ordered_level(column: Column, starts: list[tuple]) -> Column:
    """Level of a value: that of the last start that is not greater. Null has level 0."""
    out = F.lit(0)
    for level, value in starts:
        out = F.when(column >= F.lit(value), F.lit(level)).otherwise(out)
    return out.cast("int")


def shard_by_hilbert(rows: DataFrame, levels: list[Column], keep: list[str], ties: list[str], shards: int = 40, bits: int = 4) -> DataFrame:
    """keep, with `cell`, `shard` (0 to shards - 1) and `slot` (gapless from 0 in each shard). ties: not null, for the order in a cell."""
    if bits * len(levels) > 16:
        raise ValueError("the cells are counted in one small table: bits * dimensions is 16 at most")
    placed = rows.select(*keep, hilbert(levels, bits).alias("cell"))
    sizes = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("_n"))
    order = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = sizes.select("cell", F.coalesce(F.sum("_n").over(order), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("_all"))
    at = ranked(placed, ["cell"], ties, "_in_cell").join(F.broadcast(cells), "cell")
    rank = F.col("_before") + F.col("_in_cell")
    # Run s has the ranks from ceil(s * all / shards): exact whole-number arithmetic.
    shard = F.expr(f"((_before + _in_cell) * {shards}) div _all")
    start = F.expr(f"(shard * _all + {shards - 1}) div {shards}")
    return at.withColumn("shard", shard).withColumn("slot", rank - start).withColumn("shard", F.col("shard").cast("int")).drop("_before", "_in_cell", "_all")


def shard_documents(documents: DataFrame, shards: int = 40, bits: int = 4) -> DataFrame:
    """All documents by text size, source and language: doc_id, size, text_crc32, law, shard, slot, grown_shard, cell, source, lang."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents.select(
        F.col("doc_id"),
        F.coalesce(F.col("doc_id"), F.lit(-1 << 63)).alias("_tie"),
        (F.octet_length(text).cast("long") + F.lit(16)).alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        "source",
        "lang",
    )
    rows = written(rows, "metadata")  # the texts are read once
    levels = [ordered_level(F.col(c), level_starts(rows, c, 1 << bits)) for c in ("size", "source", "lang")]
    out = shard_by_hilbert(rows, levels, rows.columns, ["_tie", "text_crc32", "size"], shards, bits)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col("cell").cast("int").alias("cell"), "source", "lang")


def bounds_of(sharded: DataFrame, columns: tuple[str, ...] = ("size", "source", "lang")) -> DataFrame:
    """For each shard its number of rows and each column's smallest and largest value: what a reader prunes by."""
    ends = [f(c).alias(f"{name}_{c}") for c in columns for name, f in (("min", F.min), ("max", F.max))]
    return sharded.groupBy("shard").agg(F.count(F.lit(1)).alias("n_rows"), *ends)
