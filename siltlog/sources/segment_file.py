"""Binary segment files: readers and a writer for data and index files of 96-byte headers.

Header, little-endian: key (64 bytes), flags, data_size, disk_size, position (8 bytes each). A data file holds header,
payload and footer of one record after the other; an index file holds the headers only.

Files are listed on the driver (three for each base) and read by byte ranges, so no file is held whole: an index in ranges of `RANGE` headers,
payloads by the index in groups of records, and a data file without an index by one task that walks it.
Paths may be of any file system that pyarrow knows (local, HDFS, S3 and the like).
"""

from __future__ import annotations

import struct
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import files
from ..functions.checksum import footers, signed
from ..functions.records import HEADER, validity

LAYOUT = "<64sQQQQ"
NAME = r"([^/]*)-0\.(\d+)(\.index|\.index\.sorted)?$"
HEADER_SCHEMA = "file string, base long, idx long, key binary, flags long, data_size long, disk_size long, position long, validity string"
RECORD_SCHEMA = HEADER_SCHEMA + ", data binary, chunks array<long>, final long"
BATCH, RANGE = 1024, 1 << 16
FIELDS = np.dtype([("key", "V64"), ("flags", "<i8"), ("data_size", "<i8"), ("disk_size", "<i8"), ("position", "<i8")])


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _open(path: str):
    """(file system, path in it) of a URI or a local path."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
    return fs.LocalFileSystem(), path


def files_of(spark: SparkSession, path: str, kind: str = "data") -> DataFrame:
    """file, base, size of the files of a kind (data, index, sorted, or best: the sorted index of a base, else its index)."""
    found = spark.createDataFrame(files.listing(spark, path), "file string, size long")
    found = found.withColumn("base", F.regexp_extract("file", NAME, 2).try_cast("long")).withColumn("_kind", F.regexp_extract("file", NAME, 3)).where("base is not null")
    if kind == "best":
        best = found.where("_kind <> ''").groupBy("base").agg(F.max_by(F.struct("file", "size"), "_kind").alias("f"))
        return best.select("f.file", "base", "f.size")
    return found.where(F.col("_kind") == {"data": "", "index": ".index", "sorted": ".index.sorted"}[kind]).select("file", "base", "size")


def _check(data_size: int, disk: int, position: int, end: int) -> str:
    if data_size == 0 and disk == 0:
        return "hole"
    if disk < data_size + HEADER:
        return "short"
    return "outside" if position + disk > end else "ok"


def walk(stream, size: int, payload: bool):
    """Records of an open data file by their disk_size. A hole of zeros is passed over; a header that leads nowhere is the last row."""
    at = idx = 0
    while at + HEADER <= size:
        stream.seek(at)
        head = stream.read(HEADER)
        if len(head) < HEADER:
            return
        key, flags, n, disk, position = struct.unpack(LAYOUT, head)
        verdict = _check(n, disk, at, size)
        if verdict == "hole":
            at = _after_zeros(stream, at, size)
            continue
        row = (idx, key, signed(flags), signed(n), signed(disk), signed(position), verdict)
        if payload:
            good = verdict == "ok"
            rest = stream.read(disk - HEADER) if good else b""
            row += _payload(rest, n, flags) if good else (None, [], None)
        yield row
        if verdict != "ok":
            return
        at, idx = at + disk, idx + 1


def _after_zeros(stream, start: int, size: int) -> int:
    """Where the first record after a run of zeros from `start` begins: a header that tells its own position, as keys may begin with zeros."""
    at = start
    while at < size:
        stream.seek(at)
        part = stream.read(min(1 << 20, size - at))
        some = np.flatnonzero(np.frombuffer(part, dtype=np.uint8))
        if len(some):
            first = at + int(some[0])
            low = max(start, first - 64)
            stream.seek(low)
            near = stream.read(first - low + HEADER)
            told = (c for c in range(len(near) - HEADER + 1) if struct.unpack_from(LAYOUT, near, c)[4] == low + c)
            return low + next(told, size)
        at += len(part)
    return size


def _payload(rest: bytes, n: int, flags: int) -> tuple:
    foot = rest[n:]
    values = [signed(x) for (x,) in struct.iter_unpack("<Q", foot[: len(foot) // 8 * 8])]
    return rest[:n], values[:-1], values[-1] if values else None


def _rows(parts, names: list[str]):
    part = []
    for row in parts:
        part.append(row)
        if len(part) == BATCH:
            yield pd.DataFrame(part, columns=names)
            part = []
    if part:
        yield pd.DataFrame(part, columns=names)


def read_data(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Records of the data files, found by walking each of them in one task; one that cannot be a record ends its file (see validity)."""
    schema = RECORD_SCHEMA if payload else HEADER_SCHEMA
    names = _names(schema)

    def run(batches):
        for pdf in batches:
            for file, base, size in zip(pdf["file"], pdf["base"], pdf["size"]):
                fs, inner = _open(file)
                with fs.open_input_file(inner) as stream:
                    yield from _rows(((file, base, *row) for row in walk(stream, int(size), payload)), names)

    return files_of(spark, path).repartition("base").mapInPandas(run, schema)


def read_index(spark: SparkSession, path: str, kind: str | bool = "index") -> DataFrame:
    """Headers of the index files of a kind (see `files_of`), in ranges; `validity` is judged against the base's data file.

    An index that does not hold whole headers, or a sorted one without any, gives one row without a key and validity EBADF.
    """
    kind = {True: "sorted", False: "index"}.get(kind, kind)
    found_files = files_of(spark, path, kind).withColumn("bad", (F.col("size") % HEADER != 0) | ((F.lit(kind) == "sorted") & (F.col("size") == 0)))
    ends = files_of(spark, path).select("base", F.col("size").alias("file_size"))
    found_files = found_files.join(ends, "base", "left")
    cut = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0).cast("long")), F.lit(RANGE * HEADER).cast("long"))
    ranges = found_files.where("not bad and size > 0").select("file", "base", "size", "file_size", F.explode(cut).alias("start"))
    made = HEADER_SCHEMA.replace(", validity string", ", file_size long")
    names = _names(made)

    def run(batches):
        for pdf in batches:
            for file, base, size, end, start in zip(pdf["file"], pdf["base"], pdf["size"], pdf["file_size"], pdf["start"]):
                fs, inner = _open(file)
                with fs.open_input_file(inner) as stream:
                    rows = np.frombuffer(stream.read_at(min(RANGE * HEADER, int(size) - int(start)), int(start)), dtype=FIELDS)
                out = {n: rows[n] for n in ("flags", "data_size", "disk_size", "position")}
                first = int(start) // HEADER
                yield pd.DataFrame({"file": file, "base": base, "idx": np.arange(first, first + len(rows)), "key": [k.tobytes() for k in rows["key"]], **out, "file_size": end})[names]

    found = ranges.repartition("base", "start").mapInPandas(run, made)
    end = F.coalesce("file_size", F.lit((1 << 63) - 1))
    found = found.withColumn("validity", validity(*(F.col(c) for c in ("data_size", "disk_size", "position")), end, F.col("flags")))
    nothing = lambda kind: F.lit(None).cast(kind)
    refused = found_files.where("bad").select("file", "base", nothing("long").alias("idx"), nothing("binary").alias("key"), *[nothing("long").alias(c) for c in ("flags", "data_size", "disk_size", "position", "file_size")], F.lit("EBADF").alias("validity"))
    return found.unionByName(refused).select(*_names(HEADER_SCHEMA), "file_size")


def read_records(spark: SparkSession, path: str, kind: str = "best") -> DataFrame:
    """Records by an index: each task reads the byte ranges of its entries. Bad entries come without payload."""
    index = read_index(spark, path, kind).where("idx is not null").drop("file", "file_size")
    data_files = files_of(spark, path).select("base", "file")
    names = _names(RECORD_SCHEMA)

    def run(batches):
        for pdf in batches:
            pdf = pdf.sort_values(["file", "position"])
            for file, part in pdf.groupby("file", sort=False):
                fs, inner = _open(file)
                with fs.open_input_file(inner) as stream:
                    rows = []
                    for r in part.itertuples(index=False):
                        good = r.validity == "ok"
                        more = _payload(stream.read_at(int(r.disk_size) - HEADER, int(r.position) + HEADER), int(r.data_size), int(r.flags)) if good else (None, [], None)
                        rows.append((file, r.base, r.idx, r.key, r.flags, r.data_size, r.disk_size, r.position, r.validity, *more))
                    yield from _rows(rows, names)

    grouped = index.join(data_files, "base").withColumn("_part", F.expr(f"idx div {RANGE}"))
    return grouped.repartition("base", "_part").drop("_part").select("file", *_names(HEADER_SCHEMA)[1:]).mapInPandas(run, RECORD_SCHEMA)


def read_pairs(spark: SparkSession, path: str, kind: str = "best") -> tuple[DataFrame, DataFrame]:
    """(index entries, headers in the data files at the entries' positions), for the operators on header pairs."""
    index = read_index(spark, path, kind).where("idx is not null")
    data_files = files_of(spark, path).select("base", F.col("file").alias("data_file"))
    made = "base long, idx long, key binary, flags long, data_size long, disk_size long, position long"

    def run(batches):
        for pdf in batches:
            for file, part in pdf.groupby("data_file", sort=False):
                fs, inner = _open(file)
                with fs.open_input_file(inner) as stream:
                    rows = []
                    for r in part.itertuples(index=False):
                        head = stream.read_at(HEADER, int(r.position))
                        if len(head) == HEADER:
                            key, flags, n, disk, _ = struct.unpack(LAYOUT, head)
                            rows.append((r.base, r.idx, key, signed(flags), signed(n), signed(disk), r.position))
                    yield from _rows(rows, _names(made))

    at = index.where("position >= 0 and position < file_size").select("base", "idx", "position")
    return index, at.join(data_files, "base").mapInPandas(run, made)


def pack_record(key: bytes, data: bytes, position: int, flags: int = 0, no_footer: bool = False, foot: bytes | None = None) -> tuple[bytes, bytes]:
    """(header, whole record) with flags as a write stores them."""
    flags = (flags | 256 | (2 if no_footer else 0)) & ((1 << 64) - 1)
    if foot is None:
        foot = _footer_bytes([data])[0]
    foot = b"" if no_footer else foot
    head = struct.pack(LAYOUT, key.ljust(64, b"\0"), flags, len(data), HEADER + len(data) + len(foot), position)
    return head, head + data + foot


def _footer_bytes(values: list[bytes]) -> list[bytes]:
    chunks, final = footers(values)
    return [np.append(c, f).astype("<u8").tobytes() if len(c) else b"" for c, f in zip(chunks, final)]


def write_segments(records: DataFrame, path: str, name: str = "data", no_footer: bool = False, sorted_index: bool = False) -> None:
    """Writes `{path}/{name}-0.{base}` and its index from the tasks (records: base, idx, key, data, flags), record by record.

    A base is written by one task in the order of idx, to names that are replaced once it is whole, so a task that runs again leaves the same
    files. The index is called sorted if the caller says that idx follows the keys.
    """
    ending = ".index.sorted" if sorted_index else ".index"

    def put(batches):
        fs, folder = _open(path)
        fs.create_dir(folder, recursive=True)
        base, at, n, streams = None, 0, 0, []

        def close():
            for stream, hidden, target in streams:
                stream.close()
                fs.move(hidden, target)

        for pdf in batches:
            pdf["foot"] = _footer_bytes([bytes(d) for d in pdf["data"]])
            for r in pdf.itertuples(index=False):
                if r.base != base:
                    close()
                    base, at, streams = r.base, 0, []
                    for target in (f"{folder}/{name}-0.{base}", f"{folder}/{name}-0.{base}{ending}"):
                        hidden = f"{target}.{uuid.uuid4().hex}.tmp"
                        streams.append((fs.open_output_stream(hidden), hidden, target))
                head, whole = pack_record(bytes(r.key), bytes(r.data), at, int(r.flags), no_footer, r.foot)
                streams[0][0].write(whole)
                streams[1][0].write(head)
                at += len(whole)
                n += 1
        close()
        yield pd.DataFrame({"n": [n]})

    rows = records.select("base", "idx", "key", "data", "flags").repartition("base").sortWithinPartitions("base", "idx")
    rows.mapInPandas(put, "n long").agg(F.sum("n")).collect()
