"""Bloom filters over record keys: two hashes, combined to up to 20, and bit sets for each base."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

from ..sizes import parts

KEY = 64
#: Input bytes whose keys make one partition; a record of some 20 bytes sets up to 20 places.
PART = 1 << 18
# Fixed values of the FNV-1a hash.
FNV_START, FNV_PRIME = 14695981039346656037, 1099511628211


def bloom_bytes(records: int, block: int = 40, bits: int = 40 * 128) -> int:
    """Length of a base's filter: `bits` for each index block, and one block more."""
    return (records // block + 1) * bits // 8


def func_num(records: int, size: int) -> int:
    """Number of hash functions for a filter of `size` bytes: bits for each key times ln 2, from 1 to 20."""
    return min(20, max(1, math.floor(8 * size // max(records, 1) * 0.69)))


def key_hashes(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(sum of the first eight bytes, FNV-1a of all) of each key, padded to 64 bytes."""
    b = np.frombuffer(b"".join(k[:KEY].ljust(KEY, b"\0") for k in keys), dtype=np.uint8).reshape(-1, KEY).astype(np.uint64)
    h = np.full(len(b), FNV_START, dtype=np.uint64)
    for i in range(KEY):
        h = (h ^ b[:, i]) * np.uint64(FNV_PRIME)
    return b[:, :8].sum(axis=1), h


@F.pandas_udf(StructType().add("sum8", LongType()).add("fnv", LongType()))
def hashes(keys: pd.Series) -> pd.DataFrame:
    """Both hashes; fnv as a signed number."""
    a, b = key_hashes([bytes(k) for k in keys])
    return pd.DataFrame({"sum8": a.view(np.int64), "fnv": b.view(np.int64)})


@F.pandas_udf(ArrayType(LongType()))
def places(keys: pd.Series, size: pd.Series, funcs: pd.Series) -> pd.Series:
    """The places in a filter of `size` that a key sets: h1, h2 and h1 + i * h2 for i from 2, all modulo size."""
    a, b = key_hashes([bytes(k) for k in keys])
    n = size.to_numpy().astype(np.uint64)
    a, b = a % n, b % n
    out = [np.unique(np.array([a[i], b[i], *((a[i] + np.uint64(j) * b[i]) % n[i] for j in range(2, f))], dtype=np.int64)) for i, f in enumerate(funcs)]
    return pd.Series(out)


def build(headers: DataFrame, block: int = 40, bits: int = 40 * 128) -> DataFrame:
    """base, size, funcs, place: the places that the live keys of each base set (headers: base, key, flags).

    Keys are shuffled by base and their places, up to twenty times as many rows, by base and place, both in partitions that
    PART bytes of input fill; a base has a bounded size.
    """
    n_parts = parts(headers, PART)
    cut = headers.where(F.col("base").isNotNull()).select("base", "key", "flags").repartition(n_parts, "base")
    n = F.count(F.lit(1)).over(Window.partitionBy("base"))
    size = ((F.floor(F.col("n") / block) + 1) * bits / 8).cast("long")
    funcs = F.greatest(F.lit(1), F.least(F.lit(20), F.floor(F.floor(8 * F.col("size") / F.greatest(F.col("n"), F.lit(1))) * 0.69))).cast("int")
    sized = cut.withColumn("n", n).withColumn("size", size).withColumn("funcs", funcs)
    live = sized.where(F.col("flags").bitwiseAND(F.lit(1)) == 0)
    return live.select("base", "size", "funcs", F.explode(places("key", "size", "funcs")).alias("place")).repartition(n_parts, "base", "place").distinct()


def _held(keys: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
    """The keys of one base that its filter does not rule out, each once."""
    keys = keys.drop_duplicates("key")
    if not len(keys) or not len(filters):
        return keys[:0]
    size, funcs = int(filters["size"].iloc[0]), int(filters["funcs"].iloc[0])
    held = np.zeros(size, dtype=bool)
    held[filters["place"].to_numpy()] = True
    a, b = (x % np.uint64(size) for x in key_hashes([bytes(k) for k in keys["key"]]))
    ok = held[a] & held[b]
    for i in range(2, funcs):
        ok &= held[(a + np.uint64(i) * b) % np.uint64(size)]
    return keys[ok]


def may_contain(keys: DataFrame, filters: DataFrame) -> DataFrame:
    """(base, key) pairs of `keys` (base, key) that the base's filter does not rule out.

    Keys and filters meet by base, which has a bounded size, in partitions of PART bytes of input: no row for each place of a
    key, and nothing is broadcast.
    """
    n = parts(keys, PART, filters)
    asked = keys.select("base", "key").repartition(n, "base").groupBy("base")
    return asked.cogroup(filters.repartition(n, "base").groupBy("base")).applyInPandas(_held, keys.select("base", "key").schema)


def column_sum8(key: Column) -> Column:
    """The first hash in SQL: the sum of the first eight bytes."""
    byte = lambda i: F.conv(F.hex(F.substring(key, i + 1, 1)), 16, 10).cast("long")
    return sum((F.coalesce(byte(i), F.lit(0)) for i in range(1, 8)), F.coalesce(byte(0), F.lit(0)))
