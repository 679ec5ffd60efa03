"""Operator 10: quality rules, base counts and then compression bands.

Base rule: a text fails with fewer than 10 words, or when more than 20 % of its words stand in five-word windows that the
text holds twice or more. The rest is judged by zstandard: the ratio of compressed to raw bytes must lie within a band that
depends on the length, for the whole text and for fixed chunks of it. Repetitive text falls below its band, noise above.
A text is rejected if its whole ratio is outside or if chunks with more than half of its bytes are outside.

The band of a length of n bytes comes from all texts of about that length (four classes for each doubling; a chunk is a text of
its length): from median m and third quartile q of their ratios it goes from m - (0.02 + 6 / n + 3.5 (q - m)) to
m + (0.02 + 6 / n + 7 (q - m)). Up to a quarter of a class may be noise, or half of it repetitive, before it moves the band. Equal texts count once, the
chunks of a text once together. The counts of classes by ratio (thousandths) are one aggregation of bounded size; a class
with fewer than `least` texts is judged by its neighbours too, as many as it takes, and where all classes together have fewer the
fixed limits BANDS hold.

Whole texts are compressed; memory is that of a slice of texts or of one long text. The texts are read once; what was measured is
written, and only hashes, sizes and ratios are shuffled.
Defined cases: null and empty texts have no words and fail; a very long text is a slice of its own; a null doc_id stays null, rows
that share an id are judged by themselves; equal rows give equal results; an empty table gives no rows; extra columns, whatever
their names, are not read. Windows and lines are compared by 64-bit hashes within one text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .common import written

SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[list(b"#*$%&|<>")] = True
#: Smallest number of bytes, lowest and highest ratio of compressed to raw size, for a corpus too small to learn from.
BANDS = ((0, 0.0, 9.0), (64, 0.30, 1.25), (256, 0.38, 0.92), (1024, 0.33, 0.80), (4096, 0.28, 0.75), (16384, 0.25, 0.72))
CHUNK = 4096
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, bad_chunk_share double"


def base_counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    w = tk.words(data, offsets)
    line_of, line_hash, _, _ = tk.lines(data, offsets)
    later, _ = tk.again(line_hash, line_of) if len(line_of) else (np.zeros(0, dtype=bool), None)
    return {
        "n_words": np.diff(w.first),
        "word_chars": tk.per_text(((data & 0xC0) != 0x80) & ~tk._SPACE[data], offsets),
        "n_symbols": tk.per_text(SYMBOLS[data], offsets),
        "n_dup_lines": np.bincount(line_of[later], minlength=len(offsets) - 1),
        "n_repeat_words": tk.repeated_words(w, 5),
    }


def class_of(size: np.ndarray) -> np.ndarray:
    """Four classes of lengths for each doubling."""
    return np.floor(4 * np.log2(np.maximum(size, 1)) + 1e-9).astype(np.int64)


def ratios(raw: bytes, packer: zstandard.ZstdCompressor, chunk: int) -> tuple[float, list[float]]:
    """(ratio of the whole, ratios of its chunks); a text of one chunk has none."""
    if not raw:
        return 0.0, []
    parts = [raw[i : i + chunk] for i in range(0, len(raw), chunk)] if len(raw) > chunk else []
    return len(packer.compress(raw)) / len(raw), [len(packer.compress(x)) / len(x) for x in parts]


MEASURED = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, size long, ratio double, chunks array<float>, h long"


def measured(documents: DataFrame, level: int, chunk: int, min_words: int, max_repeat: int) -> DataFrame:
    """The base counts and ratios of every document, and a hash of its text."""
    names = [x.split()[0] for x in MEASURED.split(", ")]

    def run(batches):
        packer = zstandard.ZstdCompressor(level=level, write_content_size=False, write_checksum=False)
        for batch in batches:
            for lo, hi, data, offsets in tk.slices(batch.column(1)):
                got = base_counts(data, offsets)
                n = got["n_words"]
                failed = (n < min_words) | (100 * got["n_repeat_words"] > max_repeat * n)
                raw = data.tobytes()
                whole, parts = zip(*(ratios(raw[a:b], packer, chunk) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())))
                cols = [batch.column(0).slice(lo, hi - lo), *(pa.array(v.astype(np.int64)) for v in got.values()), pa.array(failed), pa.array(np.diff(offsets)), pa.array(whole, pa.float64()), pa.array(parts, pa.list_(pa.float32())), batch.column(2).slice(lo, hi - lo)]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return documents.select("doc_id", "text", F.xxhash64("text").alias("h")).mapInArrow(run, MEASURED)


def histogram(rows: DataFrame, chunk: int) -> np.ndarray:
    """Counts by class of length and ratio in thousandths (2 and more together). Each text once, and once for its full chunks."""
    each = rows.where("size > 0").groupBy("h").agg(F.first("size").alias("size"), F.first("ratio").alias("ratio"), F.first("chunks").alias("chunks"))
    full = F.when(F.size("chunks") > 0, F.slice("chunks", F.lit(1), F.floor(F.col("size") / chunk).cast("int")))
    mean = F.aggregate(full, F.lit(0.0), lambda a, x: a + x) / F.size(full)
    seen = each.select(F.explode(F.array(F.struct(F.col("size").alias("size"), F.col("ratio").alias("r")), F.struct(F.when(F.size("chunks") > 0, F.lit(chunk)).cast("long").alias("size"), mean.alias("r")))).alias("o"))
    kind = F.floor(4 * F.log2(F.col("o.size").cast("double")) + 1e-9).cast("int")
    cell = F.least(F.lit(1999), F.floor(F.col("o.r") * 1000)).cast("int")
    found = seen.where("o.size is not null").groupBy(kind.alias("k"), cell.alias("c")).agg(F.count(F.lit(1)).alias("n")).toArrow()
    out = np.zeros((160, 2000), dtype=np.int64)
    out[found.column("k").to_numpy(), found.column("c").to_numpy()] = found.column("n").to_numpy()
    return out


def quartiles(counts: np.ndarray, least: int) -> np.ndarray | None:
    """(median, third quartile) of the ratios of each class, with its neighbours' where it has fewer than `least`; None where all have fewer."""
    sums = np.cumsum(counts.sum(axis=1))
    if sums[-1] < least:
        return None
    out = np.zeros((len(counts), 2))
    for k in range(len(counts)):
        around = 0
        while counts[max(0, k - around) : k + around + 1].sum() < least:
            around += 1
        own = np.cumsum(counts[max(0, k - around) : k + around + 1].sum(axis=0))
        out[k] = [(np.searchsorted(own, q * own[-1]) + 0.5) / 1000 for q in (0.5, 0.75)]
    return out


def inside(size: np.ndarray, ratio: np.ndarray, learnt: np.ndarray | None, bands=BANDS) -> np.ndarray:
    """Whether texts of these lengths may have these ratios."""
    if learnt is None:
        at = np.searchsorted([b[0] for b in bands], size, "right") - 1
        return (ratio >= np.array([b[1] for b in bands])[at]) & (ratio <= np.array([b[2] for b in bands])[at])
    middle, upper = learnt[class_of(size)].T
    slack, spread = 0.02 + 6 / np.maximum(size, 1), upper - middle
    return (ratio >= middle - slack - 3.5 * spread) & (ratio <= middle + slack + 7 * spread)


def rate(documents: DataFrame, level: int = 3, bands=BANDS, chunk: int = CHUNK, min_words: int = 10, max_repeat: int = 20, least: int = 100) -> DataFrame:
    """The columns of SCHEMA for each document."""
    rows = written(measured(documents, level, chunk, min_words, max_repeat), "measured")
    learnt = quartiles(histogram(rows, chunk), least)

    def run(batches):
        for batch in batches:
            size, ratio, parts = batch.column(7).to_numpy(), batch.column(8).to_numpy(), batch.column(9)
            many = np.asarray(parts.value_lengths()).astype(np.int64)
            of = np.repeat(np.arange(len(batch)), many)
            place = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
            part = np.minimum(size[of] - place * chunk, chunk)
            ok = inside(size, ratio, learnt, bands)
            bad = np.bincount(of, weights=part * ~inside(part, parts.flatten().to_numpy().astype(np.float64), learnt, bands), minlength=len(batch))
            bad = np.where(many > 0, bad, size * ~ok)
            failed = batch.column(6).to_numpy(zero_copy_only=False)
            kept = ~failed & ok & (2 * bad <= size) & (size > 0)
            cols = [*(batch.column(i) for i in range(7)), pa.array(kept), batch.column(8), pa.array(bad / np.maximum(size, 1))]
            yield pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in SCHEMA.split(", ")])

    return rows.mapInArrow(run, SCHEMA)
