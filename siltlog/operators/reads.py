"""Lookups, slices, ranges and scans over the current state or over records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import checksum
from ..functions.records import HEADER, REMOVE, UNCOMMITTED
from ..sizes import parts

#: Ranges up to this number become one predicate, which reaches the Parquet scan.
PREDICATE_RANGES = 64
#: Input bytes that make one partition of `in_ranges`.
PART = 2 << 20


def lookup(state: DataFrame, key) -> DataFrame:
    return state.where(F.col("key") == F.lit(key))


def multi_get(state: DataFrame, keys: DataFrame) -> DataFrame:
    return state.join(keys, "key", "left_semi")


def missing(state: DataFrame, keys: DataFrame) -> DataFrame:
    return keys.join(state, "key", "left_anti")


def read_slice(data: Column, offset: int, size: int = 0) -> tuple[Column, Column]:
    """(slice, error): size 0 reads to the end; an offset at or past the end is E2BIG."""
    late = F.length(data) <= F.lit(offset)
    part = F.substring(data, offset + 1, size if size else (1 << 31) - 1 - offset)
    return F.when(~late, part), F.when(late, F.lit("E2BIG"))


def read_range(state: DataFrame, start, end, offset: int = 0, limit: int | None = None) -> DataFrame:
    """Inclusive range in key order; Spark keeps only the first offset + limit rows of each task."""
    out = state.where(F.col("key").between(F.lit(start), F.lit(end))).orderBy("key")
    out = out.offset(offset) if offset else out
    return out if limit is None else out.limit(limit)


def merged(ranges: list[tuple]) -> list[tuple]:
    """Sorted disjoint ranges that cover the same keys."""
    out: list[tuple] = []
    for a, b in sorted(r for r in ranges if r[0] <= r[1]):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def multi_range(rows: DataFrame, ranges: list[tuple], key: str = "key") -> DataFrame:
    """Rows whose key lies in any inclusive range, each once.

    Few ranges become an OR of BETWEEN that the scan can use. More are merged, which makes them disjoint: each key then has one
    possible range, found by binary search in a constant sorted array, in one pass and without a join. Ranges that are a
    table are `in_ranges`.
    """
    found = merged(ranges)
    if not found:
        return rows.where(F.lit(False))
    if len(found) <= PREDICATE_RANGES:
        test = F.lit(False)
        for a, b in found:
            test = test | F.col(key).between(F.lit(a), F.lit(b))
        return rows.where(test)
    starts, ends = F.array(*[F.lit(a) for a, _ in found]), F.array(*[F.lit(b) for _, b in found])
    at = _last_start(F.col(key), starts, len(found))
    return rows.where(F.col(key).between(F.lit(found[0][0]), F.lit(found[-1][1]))).withColumn("_at", at).where((F.col("_at") >= 0) & (F.col(key) <= F.get(ends, F.col("_at")))).drop("_at")


def _last_start(value: Column, starts: Column, n: int) -> Column:
    """Index of the last of n sorted starts that is not greater, -1 without one: a binary search by descending powers of 2."""
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(n.bit_length()))])
    return F.aggregate(steps, F.lit(-1), lambda at, s: F.when((at + s < n) & (F.get(starts, at + s) <= value), at + s).otherwise(at))


def in_ranges(rows: DataFrame, ranges: DataFrame, key: str = "key", cuts: int = 64) -> DataFrame:
    """Rows whose key lies in any inclusive range of a table (start, end) of any size, each once; ranges may overlap.

    Keys and ranges are sorted together, in parts that a sample of all keys cuts to one size (at least `cuts`, and more the larger
    the input), and a running maximum of the ends tells whether a range that has begun reaches the key. A part begins with the
    largest end of the ranges that begin before it. The cuts steer only the plan. Null keys and empty ranges match nothing.
    """
    spark, n = rows.sparkSession, parts(rows, PART, ranges)
    cuts = max(cuts, 4 * n)  # several to a task, so that tasks are even
    keys = rows.select(F.col(key).alias("k")).where(F.col("k").isNotNull())
    share = min(1.0, 20 * cuts / max(1, keys.count()))
    few = sorted(r["k"] for r in keys.sample(share, 1).collect())
    marks = sorted(set(few[:: max(1, len(few) // cuts)]))
    good = ranges.select("start", "end").where("start <= end")
    part = lambda c: _last_start(c, F.array(*[F.lit(m) for m in marks]), len(marks)) if marks else F.lit(-1)
    opened = good.select(F.lit(None).cast("int").alias("_first"), F.col("start").alias("_k"), F.lit(0).alias("_is_row"), F.col("end").alias("_end"))
    ends = good.groupBy(part(F.col("start")).alias("_first")).agg(F.max("end").alias("_top"))
    every = spark.range(-1, len(marks), 1, 1).select(F.col("id").cast("int").alias("_first")).join(ends, "_first", "left")
    so_far = F.max("_top").over(Window.orderBy("_first").rowsBetween(Window.unboundedPreceding, -1))  # one row for each part
    carried = every.select("_first", F.lit(None).cast(good.schema["start"].dataType).alias("_k"), F.lit(0).alias("_is_row"), so_far.alias("_end"))
    # exploded: what the optimizer infers of a key and its copy in the row makes it fail on the union
    asked = rows.where(F.col(key).isNotNull()).select(F.explode(F.array(F.struct(F.col(key).alias("_k"), F.struct(*rows.columns).alias("_row")))).alias("_z"))
    asked = asked.select(F.lit(None).cast("int").alias("_first"), "_z._k", F.lit(1).alias("_is_row"), F.lit(None).cast(good.schema["end"].dataType).alias("_end"), "_z._row")
    none = F.lit(None).cast(asked.schema["_row"].dataType).alias("_row")
    both = opened.select("*", none).unionByName(carried.select("*", none)).unionByName(asked)
    both = both.select(F.coalesce("_first", part(F.col("_k"))).alias("_p"), "_k", "_is_row", "_end", "_row").repartition(n, "_p")
    reach = F.max("_end").over(Window.partitionBy("_p").orderBy("_k", "_is_row").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return both.withColumn("_reach", reach).where((F.col("_is_row") == 1) & (F.col("_reach") >= F.col("_k"))).select("_row.*")


def scan(records: DataFrame, include_removed: bool = False, bases: tuple[int, int] | None = None, unsorted_only: bool = False) -> DataFrame:
    """Records, live ones by default, of bases in [lo, hi)."""
    out = records
    if bases is not None:
        out = out.where((F.col("base") >= bases[0]) & (F.col("base") < bases[1]))
    if unsorted_only:
        out = out.where(~F.col("base_sorted"))
    return out if include_removed else out.where(F.col("flags").bitwiseAND(F.lit(1)) == 0)


def scan_verified(records: DataFrame, include_removed: bool = False, no_footer: bool = False) -> DataFrame:
    """Records without those whose checksum does not hold; removed and uncommitted ones are not verified.

    records: headers with data, chunks and, for records without chunked checksums, csum.
    """
    csum = F.col("csum") if "csum" in records.columns else None
    error = checksum.verify_error(F.col("data"), F.col("disk_size"), F.col("flags"), F.col("chunks"), csum, no_footer=no_footer)
    unverified = F.col("flags").bitwiseAND(F.lit(REMOVE | UNCOMMITTED)) != 0
    found = records.withColumn("_error", F.when(~unverified, error)).where("_error is null").drop("_error")
    return scan(found, include_removed)


def read_checked(records: DataFrame, offset: int = 0, size: int = 0, check: bool = True, no_footer: bool = False) -> DataFrame:
    """The readable records with `part`, a slice of their data, or `error`: the checksum's (only touched chunks are hashed), else the slice's.

    Removed and uncommitted records are not there for a read.
    """
    live = records.where(F.col("flags").bitwiseAND(F.lit(REMOVE | UNCOMMITTED)) == 0)
    part, late = read_slice(F.col("data"), offset, size)
    csum = F.col("csum") if "csum" in records.columns else None
    wrong = checksum.verify_error(F.col("data"), F.col("disk_size"), F.col("flags"), F.col("chunks"), csum, offset, size, no_footer) if check else F.lit(None).cast("string")
    return live.withColumn("error", F.coalesce(wrong, late)).withColumn("part", F.when(F.col("error").isNull(), part))


def locate(records: DataFrame, key, include_uncommitted: bool = True) -> DataFrame:
    """Where a key's newest live record lies: base, position, data_offset, data_size, disk_size, flags, total_size."""
    hidden = REMOVE if include_uncommitted else REMOVE | UNCOMMITTED
    found = records.where((F.col("key") == F.lit(key)) & (F.col("flags").bitwiseAND(F.lit(hidden)) == 0))
    return locations(found).orderBy(F.col("base").desc(), F.col("idx").desc()).limit(1)


def locations(records: DataFrame) -> DataFrame:
    """The location of each record, as a write returns it."""
    return records.select("key", "base", "idx", "position", (F.col("position") + HEADER).alias("data_offset"), "data_size", "disk_size", "flags")


def lookup_trace(keys: DataFrame, headers: DataFrame, bases: DataFrame) -> DataFrame:
    """key, loops, no_sort, found: the search for each key, newest base first, in the sorted bases (bases: base, sorted).

    loops counts the bases visited, no_sort those among them that have no sorted index and are passed over.
    """
    newest = Window.orderBy(F.col("base").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # one row for each base, far fewer than records
    order = bases.select("base", "sorted", F.count(F.lit(1)).over(newest).alias("loops"), F.count_if(~F.col("sorted")).over(newest).alias("no_sort"))
    total = bases.agg(F.count(F.lit(1)).alias("loops"), F.count_if(~F.col("sorted")).alias("no_sort")).first()
    live = scan(headers).select("key", "base").join(order.where("sorted").select("base"), "base", "left_semi")
    hit = keys.select("key").distinct().join(live, "key", "left").groupBy("key").agg(F.max("base").alias("base"))
    out = hit.join(order.drop("sorted"), "base", "left")
    return out.select("key", F.coalesce("loops", F.lit(total["loops"])).alias("loops"), F.coalesce("no_sort", F.lit(total["no_sort"])).alias("no_sort"), F.col("base").isNotNull().alias("found"))


def prefix(rows: DataFrame, start: str, key: str = "key") -> DataFrame:
    return rows.where(F.col(key).startswith(start))


def matching(rows: DataFrame, pattern: str, data: str = "data") -> DataFrame:
    return rows.where(F.col(data).rlike(pattern))


def compare(expected: DataFrame, actual: DataFrame, key: str = "key") -> DataFrame:
    """key, verdict (missing, unexpected or different) of the keys whose rows are not the same on both sides; nulls equal nulls."""
    other = [c for c in expected.columns if c != key]
    left = expected.select(key, F.struct(*other).alias("_a"))
    right = actual.select(key, F.struct(*other).alias("_b"))
    verdict = F.when(F.col("_a").isNull(), "unexpected").when(F.col("_b").isNull(), "missing").when(~F.col("_a").eqNullSafe(F.col("_b")), "different")
    return left.join(right, key, "full_outer").select(key, verdict.alias("verdict")).where("verdict is not null")
