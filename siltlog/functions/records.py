"""Scalar functions over keys, flags and sizes, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the record format.
HEADER, CHUNK = 96, 1 << 20
REMOVE, NOCSUM, COMPRESS, WRITE_RETURN, APPEND, OVERWRITE, EXTHDR, UNCOMMITTED, CHUNKED_CSUM = (1 << i for i in range(9))
FLAG_NAMES = ("remove", "nocsum", "compress", "write_return", "append", "overwrite", "exthdr", "uncommitted", "chunked_csum")


def key_of(name: Column) -> Column:
    """The 64-byte key of a name: its SHA-512."""
    return F.unhex(F.sha2(name, 512))


def hex_of(key: Column, n: int = 6) -> Column:
    return F.lower(F.hex(F.substring(key, 1, n)))


def footer_size(size: Column, no_footer: bool = False) -> Column:
    """One checksum for each MiB and one for them all."""
    if no_footer:
        return F.lit(0).cast("long")
    return F.when(size == 0, F.lit(0)).otherwise((F.floor((size - 1) / F.lit(CHUNK)) + 2) * 8).cast("long")


def disk_size(size: Column, no_footer: bool = False) -> Column:
    return size + F.lit(HEADER) + footer_size(size, no_footer)


def stored_flags(flags: Column, no_footer: bool = False) -> Column:
    """Flags as a write stores them: checksums are chunked, and off without a footer."""
    return flags.bitwiseOR(F.lit(CHUNKED_CSUM | (NOCSUM if no_footer else 0)))


def render_flags(flags: Column) -> Column:
    """0x.. [a|b]"""
    names = [F.when(flags.bitwiseAND(F.lit(1 << i)) != 0, F.lit(n)) for i, n in enumerate(FLAG_NAMES)]
    return F.concat(F.lit("0x"), F.lower(F.hex(flags)), F.lit(" ["), F.concat_ws("|", *names), F.lit("]"))


def validity(data_size: Column, disk: Column, position: Column, end: Column, flags: Column) -> Column:
    """ok, hole, short, outside or footer: why a header can or can't be right. Holes are tolerated by scans.

    A record with checksums needs room for its data and one hash for each MiB, or for the older footer.
    """
    chunks = (F.floor((data_size - 1) / F.lit(CHUNK)) + 1) * 8
    needed = F.when(flags.bitwiseAND(F.lit(CHUNKED_CSUM)) == 0, 72).when(data_size == 0, 0).otherwise(chunks)
    return (
        F.when((data_size == 0) & (disk == 0), "hole")
        .when(disk < data_size + HEADER, "short")
        .when(position + disk > end, "outside")
        .when((flags.bitwiseAND(F.lit(NOCSUM)) == 0) & (disk < data_size + needed), "footer")
        .otherwise("ok")
    )


def render_header(key: Column, flags: Column, data_size: Column, disk: Column, position: Column) -> Column:
    """One line that shows a header."""
    return F.concat(hex_of(key), F.lit(": data_size: "), data_size.cast("string"), F.lit(", disk_size: "), disk.cast("string"), F.lit(", position: "), position.cast("string"), F.lit(", flags: "), render_flags(flags))


def raw_write_error(offset: Column, size: Column, reserve: Column) -> Column:
    """Null, or ERANGE for a piece that does not fit the reserve."""
    return F.when((offset < 0) | (offset + size > reserve), "ERANGE")


def iovec_bounds(pieces: Column) -> Column:
    """pieces: array of struct(offset, size). Struct of start, end, contiguous and error (E2BIG unless there are 1 to 128)."""
    ends = F.transform(pieces, lambda p: p["offset"] + p["size"])
    # contiguous: each piece begins where the one before ends
    linked = F.forall(F.sequence(F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(1))), lambda i: (F.size(pieces) < 2) | (F.get(pieces, i)["offset"] == F.get(ends, i - 1)))
    bad = ~F.size(pieces).between(1, 128)
    return F.struct(F.array_min(F.transform(pieces, lambda p: p["offset"])).alias("start"), F.array_max(ends).alias("end"), linked.alias("contiguous"), F.when(bad, "E2BIG").alias("error"))
