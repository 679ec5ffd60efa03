"""Operator 8, native: line-level deduplication by content-defined chunks.

A polynomial rolling hash over the hashes of the last three lines decides where a chunk ends, so that boundaries move with
the lines when text is inserted before them (28 bits of MD5 for each line). In a run of equal lines that hash stands still and ends
no chunk. Chunks of more than `longest` + 1 lines are cut from their start into pieces of `longest`, so that a long run's
pieces are equal wherever it stands. A chunk of two lines or more that occurs again, in any document, is removed;
its first occurrence (smallest doc_id, then line) stays. Chunks are found by hash and compared byte for byte before
anything is removed.

Shuffles: hashes of chunks (aggregated first), all chunks once, those with a repeated hash (written, as they are few and
read twice), and at last the documents.
A chunk that a third of all documents share is one row for each task in the aggregations; its rows in the joins are dealt to
several tasks by the adaptive plan (skewed joins).

Defined cases: a very long text is one row and all its lines count; a null text stays null and has no lines; an empty text is one empty line; single-line chunks always stay;
equal rows (same doc_id and text) count as one document, two texts under one id as two; a null doc_id is the smallest. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Modulus and base of the rolling hash: products stay below 2^63.
PRIME, BASE = (1 << 31) - 1, 1_103_515_245 % ((1 << 31) - 1)


def line_hash(line: Column) -> Column:
    """28 bits of the line's MD5, so that SQL elsewhere can give the same boundaries."""
    return F.conv(F.substring(F.md5(line), 1, 7), 16, 10).cast("long")


def with_chunks(documents: DataFrame, divisor: int = 4, window: int = 3, longest: int = 8, more: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns of `more`, lines, chunks: array of struct(start, n) that covers all lines."""
    out = documents.select("doc_id", *more, F.split("text", "\n", -1).alias("lines"))
    out = out.withColumn("_h", F.transform("lines", line_hash))

    def rolled(i: Column) -> Column:
        total = F.get("_h", i)
        for j in range(1, window):
            total = (F.coalesce(F.get("_h", i - j), F.lit(0)) * F.lit(pow(BASE, j, PRIME)) + total) % F.lit(PRIME)
        return total

    def alike(i: Column) -> Column:
        """The window holds one line `window` times: its hash would end a chunk at every line of a run, or at none."""
        same = F.lit(True)
        for j in range(1, window):
            same = same & F.get("_h", i).eqNullSafe(F.get("_h", i - j))
        return same

    last = F.size("lines") - 1
    ends = F.when(F.size("lines") > 0, F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: (i == last) | ((rolled(i) % F.lit(divisor) == 0) & ~alike(i))))
    out = out.withColumn("_ends", ends)
    start = lambda k: F.when(k == 0, F.lit(0)).otherwise(F.get("_ends", k - 1) + 1)
    out = out.withColumn("_whole", F.transform("_ends", lambda e, k: F.struct(start(k).alias("start"), (e - start(k) + 1).alias("n"))))
    # a longer chunk is cut from its start; a single line at its end stays with the piece before
    pieces = lambda c: F.greatest(F.lit(1), F.ceil((c["n"] - 1) / longest).cast("int"))
    size = lambda c, j: F.when(j == pieces(c) - 1, c["n"] - j * longest).otherwise(F.lit(longest))
    cut = lambda c: F.transform(F.sequence(F.lit(0), pieces(c) - 1), lambda j: F.struct((c["start"] + j * longest).alias("start"), size(c, j).alias("n")))
    return out.select("doc_id", *more, "lines", F.flatten(F.transform("_whole", cut)).alias("chunks"))


def repeated_chunks(documents: DataFrame, divisor: int = 4, window: int = 3, min_lines: int = 2) -> DataFrame:
    """(_doc, start, n): the chunks to remove; documents has `_doc`, a key of doc_id and text."""
    many = F.filter("chunks", lambda c: c["n"] >= min_lines)
    texts = F.transform(many, lambda c: F.struct(c["start"].alias("start"), c["n"].alias("n"), F.array_join(F.slice("lines", c["start"] + 1, c["n"]), "\n").alias("chunk")))
    each = with_chunks(documents, divisor, window, more=("_doc",)).select("doc_id", "_doc", F.inline(texts)).withColumn("key", F.xxhash64("chunk"))
    # the small sides are written and merged whatever their size, so that both sides of a join come from a shuffle alone, the adaptive plan can
    # split a hot chunk's partition, and small tables are joined as large ones are
    hot = written(each.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("key"), "repeated")
    suspects = written(each.join(hot.hint("merge"), "key"), "suspects")
    at = F.struct("doc_id", "_doc", "start")
    firsts = suspects.groupBy("key", "chunk").agg(F.min(at).alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    firsts = written(firsts.select("key", "chunk", "_first"), "firsts")
    return suspects.join(firsts.hint("merge"), ["key", "chunk"]).where(~at.eqNullSafe(F.col("_first"))).select("_doc", "start", "n")


def dedup_lines(documents: DataFrame, divisor: int = 4, window: int = 3, min_lines: int = 2) -> DataFrame:
    """doc_id, kept (text), n_lines, n_removed_lines, n_removed_chunks for each document."""
    docs = documents.select("doc_id", "text", F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text").alias("_doc"))
    gone = repeated_chunks(docs, divisor, window, min_lines).distinct().groupBy("_doc").agg(F.collect_list(F.struct("start", "n")).alias("_gone"))
    # merged whatever its size, so that small tables are joined as large ones are
    out = docs.join(gone.hint("merge"), "_doc", "left").withColumn("_lines", F.split("text", "\n", -1))
    cuts = F.concat(F.array_sort("_gone"), F.array(F.struct(F.size("_lines").alias("start"), F.lit(0).alias("n"))))
    out = out.withColumn("_cuts", F.when(F.col("_gone").isNotNull(), cuts))
    after = lambda k: F.when(k == 0, F.lit(0)).otherwise(F.get("_cuts", k - 1)["start"] + F.get("_cuts", k - 1)["n"])
    kept = F.array_join(F.flatten(F.transform("_cuts", lambda c, k: F.slice("_lines", after(k) + 1, c["start"] - after(k)))), "\n")
    return out.select(
        "doc_id",
        F.when(F.col("_gone").isNull(), F.col("text")).otherwise(kept).alias("kept"),
        F.when(F.col("_lines").isNull(), 0).otherwise(F.size("_lines")).cast("long").alias("n_lines"),
        F.coalesce(F.aggregate("_gone", F.lit(0), lambda a, g: a + g["n"]), F.lit(0)).cast("long").alias("n_removed_lines"),
        F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_gone")).cast("long").alias("n_removed_chunks"),
    )


def digests(deduped: DataFrame) -> DataFrame:
    return deduped.select("doc_id", "n_lines", "n_removed_lines", "n_removed_chunks", F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))
