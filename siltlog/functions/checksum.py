"""MurmurHash64A, the chunked record footer and its verification.

No built-in function computes this hash, so these are pandas UDFs. They work on all chunks of a batch at once: step t hashes word t of every
block that is long enough, so the number of numpy calls depends on the longest chunk and not on the number of records.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StructType

from .records import CHUNK, CHUNKED_CSUM, HEADER, NOCSUM, footer_size

M, R, MASK = 0xC6A4A7935BD1E995, 47, (1 << 64) - 1  # fixed values of the hash
BLOCK = 4096
#: Bytes that are joined and hashed at once, besides one chunk.
PIECE = 16 << 20
#: Size of the older footer: a SHA-512 and the position of the record.
SHA_FOOTER = 72
_M, _R = np.uint64(M), np.uint64(R)


def _blocks(flat: np.ndarray, words: np.ndarray, starts: np.ndarray, sizes: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """MurmurHash64A of flat[starts : starts + sizes], longest first; words: the 8 bytes at every place."""
    h = seeds ^ (sizes.astype(np.uint64) * _M)
    whole = sizes >> 3
    for j in range(int(whole[0]) if len(whole) else 0):
        n = int(np.searchsorted(-whole, -j, "left"))  # whole > j
        k = words[starts[:n] + 8 * j] * _M
        k = (k ^ (k >> _R)) * _M
        h[:n] = (h[:n] ^ k) * _M
    rest = sizes & 7
    some = np.flatnonzero(rest)
    if len(some):
        tail = words[starts[some] + 8 * whole[some]] & ((np.uint64(1) << (8 * rest[some]).astype(np.uint64)) - np.uint64(1))
        h[some] = (h[some] ^ tail) * _M
    h = (h ^ (h >> _R)) * _M
    return h ^ (h >> _R)


def _words(values: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    padded = np.frombuffer(b"".join([*values, b"\0" * 8]), dtype=np.uint8)
    return padded, np.ndarray((len(padded) - 7,), dtype="<u8", buffer=padded, strides=(1,))


def hashes(values: list[bytes], seed: int = 0) -> np.ndarray:
    """MurmurHash64A of each value."""
    sizes = np.array([len(v) for v in values], dtype=np.int64)
    starts = np.cumsum(sizes) - sizes
    order = np.argsort(-sizes, kind="stable")
    out = np.zeros(len(values), dtype=np.uint64)
    if len(values):
        out[order] = _blocks(*_words(values), starts[order], sizes[order], np.full(len(values), seed, dtype=np.uint64))
    return out


def chains(values: list[bytes]) -> np.ndarray:
    """Hash of each value of up to a chunk: blocks of 4096 bytes, each seeded with the hash before it. An empty one has 0.

    Values of like size are joined and hashed in pieces of about PIECE bytes, so that memory beside the values has a bound.
    """
    sizes = np.array([len(v) for v in values], dtype=np.int64)
    order = np.argsort(-sizes, kind="stable")
    out = np.zeros(len(values), dtype=np.uint64)
    for some in np.split(order, np.flatnonzero(np.diff(np.cumsum(sizes[order]) // PIECE)) + 1):
        out[some] = _chains([values[i] for i in some], sizes[some])
    return out


def _chains(values: list[bytes], sizes: np.ndarray) -> np.ndarray:
    """`chains` of values that are sorted, the longest first."""
    starts = np.cumsum(sizes) - sizes
    h = np.zeros(len(values), dtype=np.uint64)
    if len(values):
        flat, words = _words(values)
        for at in range(0, int(sizes[0]), BLOCK):
            n = int(np.searchsorted(-sizes, -at, "left"))
            h[:n] = _blocks(flat, words, starts[:n] + at, np.minimum(sizes[:n] - at, BLOCK), h[:n])
    return h


def footers(values: list[bytes]) -> tuple[list[np.ndarray], np.ndarray]:
    """(hash of each chunk, hash of these hashes) of each value; an empty value has none and 0."""
    parts = [memoryview(v)[i : i + CHUNK] for v in values for i in range(0, len(v), CHUNK)]
    many = np.array([-(-len(v) // CHUNK) for v in values], dtype=np.int64)
    each = np.split(chains(parts), np.cumsum(many)[:-1]) if len(values) else []
    final = hashes([x.astype("<u8").tobytes() for x in each])
    final[many == 0] = 0
    return each, final


def murmur64a(data: bytes, seed: int = 0) -> int:
    return int(hashes([data], seed)[0])


def chunk_hash(data: bytes) -> int:
    return int(chains([data])[0])


def footer_of(data: bytes) -> tuple[list[int], int]:
    chunks, final = footers([data])
    return chunks[0].tolist(), int(final[0])


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _bytes(data: pd.Series) -> list[bytes]:
    return [b"" if d is None else bytes(d) for d in data]


@F.pandas_udf(LongType())
def murmur(data: pd.Series) -> pd.Series:
    found = pd.Series(hashes(_bytes(data)).view(np.int64), dtype="Int64")
    return found.mask(data.isna().to_numpy())


@F.pandas_udf(StructType().add("chunks", ArrayType(LongType())).add("final", LongType()))
def footer(data: pd.Series) -> pd.DataFrame:
    """Both parts of the footer, from one pass over the data. Null data has no chunks."""
    chunks, final = footers(_bytes(data))
    return pd.DataFrame({"chunks": [c.view(np.int64) for c in chunks], "final": final.view(np.int64)})


def chunk_hashes(data) -> Column:
    return footer(data)["chunks"]


def final_hash(data) -> Column:
    return footer(data)["final"]


@F.pandas_udf(BooleanType())
def _same_chunks(data: pd.Series, chunks: pd.Series, first: pd.Series, last: pd.Series) -> pd.Series:
    """Whether the stored hashes of chunks first to last - 1 are those of the data."""
    parts, want, of = [], [], []
    ok = np.ones(len(data), dtype=bool)
    for i, (d, c, a, b) in enumerate(zip(_bytes(data), chunks, first, last)):
        c = [] if c is None else c
        if b > len(c):
            ok[i] = False
            continue
        for k in range(a, b):
            parts.append(memoryview(d)[k * CHUNK : (k + 1) * CHUNK])
            want.append(c[k])
            of.append(i)
    wrong = chains(parts) != np.array(want, dtype=np.int64).view(np.uint64)
    ok[np.array(of, dtype=np.int64)[wrong]] = False
    return pd.Series(ok)


def verify_error(data: Column, disk: Column, flags: Column, chunks: Column, csum: Column | None = None, offset: Column | int = 0, size: Column | int = 0, no_footer: bool = False) -> Column:
    """Null, or why the checksum of a record refuses a read: EINVAL (no room for a footer) or EILSEQ (mismatch).

    Only chunks that the read of `size` bytes (0: all) from `offset` touches are hashed; the hash of the hashes is not compared.
    Records without checksums pass. `csum` is the SHA-512 of records that do not have chunked checksums.
    """
    if no_footer:
        return F.lit(None).cast("string")
    n = F.length(data).cast("long")
    offset = F.lit(offset).cast("long") if isinstance(offset, int) else offset
    size = F.lit(size).cast("long") if isinstance(size, int) else size
    end = F.least(n, F.when(size == 0, n).otherwise(offset + size))
    first, last = F.floor(offset / CHUNK).cast("int"), F.ceil(end / CHUNK).cast("int")
    chunked = F.when(disk - footer_size(n) < n + HEADER, "EINVAL").when(~_same_chunks(data, chunks, first, last), "EILSEQ")
    legacy = F.lit("EINVAL") if csum is None else F.when(disk < n + HEADER + SHA_FOOTER, "EINVAL").when(F.unhex(F.sha2(data, 512)) != csum, "EILSEQ")
    return F.when(flags.bitwiseAND(F.lit(NOCSUM)) != 0, None).when(disk <= n + HEADER, "EINVAL").otherwise(F.when(flags.bitwiseAND(F.lit(CHUNKED_CSUM)) != 0, chunked).otherwise(legacy))


def verify(data: Column, chunks: Column, flags: Column, final: Column | None = None) -> Column:
    """True unless a stored chunk hash (and the final one, if given) differs; records without checksums pass."""
    made = footer(data)
    ok = made["chunks"] == chunks
    if final is not None:
        ok = ok & (made["final"] == final)
    return (flags.bitwiseAND(F.lit(NOCSUM)) != 0) | ok


def sha512_range(data: Column, offset: Column, size: Column) -> tuple[Column, Column]:
    """(SHA-512 in hexadecimal of a byte range, error): ESPIPE where the range ends past the data."""
    late = offset + size > F.length(data)
    part = F.substring(data, (offset + 1).cast("int"), size.cast("int"))
    return F.when(~late, F.sha2(F.coalesce(part, F.expr("X''")), 512)), F.when(late, F.lit("ESPIPE"))
