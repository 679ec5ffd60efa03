"""Operator 3: documents whose shingle sets have a Jaccard similarity of at least `percent` / 100, by a grouped prefix join.

A document's set holds its distinct `k`-word shingles (A-Z folded). Shingles are ordered rarest first, by sketches of all
shingles' and all words' counts over all data; ties by hash. Two sets of n and m shingles can only be similar if their prefixes of
n - ceil(t n) + l and m - ceil(t m) + l' shingles share min(l, l') of them (l = 2 + n // 10), if the smaller has t times the
larger's size, and if enough shingles remain after the first shared one.

Equal sets are one class. Classes with the same prefix and size are one group. Only groups are posted under the shingles of
their prefix and joined; pairs of groups are filtered by sizes, places and number of shared shingles, and what is left
is expanded to pairs of members and verified. No step makes all pairs of a crowded shingle, and no link between components is missed, as these are
what is returned:

1. A pivot group of every shared shingle is verified against the other groups there, and a pivot class of every group against
   its other classes (as many pairs as postings); the links make components.
2. The groups of a shingle within a band of sizes are a cell (and so is a group by itself). In cells of up to `heavy` classes, pairs of groups that
   hold several components are filtered, then expanded to the pairs of classes of different components.
3. Larger cells of several components take their most central class P as their reference. As |A ^ B| = |A ^ P| + |B ^ P| - 2 |(A ^ P) & (B ^ P)|, two near copies
   that differ from P in more than their similarity allows must share what sets them apart from P: a prefix join over
   these differences, rarest first, finds them. Classes closer to P than that are linked with P itself.

Before a pair's sets are compared, parity sketches are: a bit is flipped for each shingle, and the number of bits in which
two sketches differ is never more than |A ^ B|, so a pair that this rejects is not similar. `component_id` is the smallest
doc_id of a component; `n_verified` counts the links of a class that were verified (links within a component need not all be).

The sketches (2^18 counters each) have a fixed size and are broadcast; they steer only the order, never which pairs are found.
Sets are compared by 64-bit hashes of the shingles.

Defined cases: with fewer than k words the whole sequence is one shingle; null, empty and wordless texts have an empty set
and are linked with nothing, not even with each other; a very long text is a slice of its own and all its shingles count;
rows with one doc_id are separate rows that share this id; a null doc_id is smaller than any other and comes back as null, as does the
component_id of its component; an empty table gives no rows. Extra columns, whatever their names, are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .common import discard, release, tables, written
from .components import components

SKETCH_BITS = 18
#: Bytes and texts that are worked on at a time, so that a task's temporaries stay small.
PIECE, PIECE_TEXTS = 1 << 18, 1 << 14
LEAST = -(1 << 63)


def shingles(data: np.ndarray, offsets: np.ndarray, k: int, commonness: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """(text, hash, summed commonness of the words) of the distinct shingles, ordered by text and hash."""
    w = tk.words(data, offsets, tk.FOLDED)
    n = np.diff(w.first)
    at = np.flatnonzero(tk.inside(w, k))
    texts, found = w.text_of[at], tk.grams(w.hashes, k)[at]
    score = None
    if commonness is not None:
        word = commonness[_bucket(w.hashes)]
        score = sum((word[at + j] for j in range(k)), np.zeros(len(at), dtype=np.int64))
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        whole = np.zeros(len(short), dtype=np.uint64)
        for j in range(k - 1):
            have = n[short] > j
            whole[have] = tk.mix(whole[have] * np.uint64(0xD6E8FEB86659FD93) + w.hashes[w.first[short[have]] + j] + np.uint64(j + 1))
        texts, found = np.concatenate([texts, short]), np.concatenate([found, whole])
        score = None if score is None else np.concatenate([score, np.zeros(len(short), dtype=np.int64)])
    order = np.lexsort((found, texts))
    texts, found = texts[order], found[order]
    new = np.ones(len(found), dtype=bool)
    new[1:] = (found[1:] != found[:-1]) | (texts[1:] != texts[:-1])
    return texts[new], found[new], None if score is None else score[order][new]


def _bucket(found: np.ndarray) -> np.ndarray:
    return (found >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def order_sketch(docs: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(level of each shingle counter, commonness of each word counter), from counts over all data.

    A shingle's level is 0 unless its counter stands out from the others; then it grows with the excess. A word's
    commonness is the logarithm of its counter. Rare words make rare shingles, and these come first in the order.
    """
    size = 1 << SKETCH_BITS

    def run(batches):
        total = np.zeros(2 * size, dtype=np.int64)
        for batch in batches:
            for _, _, data, offsets in tk.slices(batch.column(0), PIECE, PIECE_TEXTS):
                total[:size] += np.bincount(_bucket(shingles(data, offsets, k)[1]), minlength=size)
                total[size:] += np.bincount(_bucket(tk.words(data, offsets, tk.FOLDED).hashes), minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["c", "n"])

    found = docs.select("text").mapInArrow(run, "c int, n long").groupBy("c").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(2 * size, dtype=np.int64)
    out[found.column("c").to_numpy()] = found.column("n").to_numpy()
    counts = out[:size].astype(float)
    usual = np.median(counts)
    spread = 1.4826 * np.median(np.abs(counts - usual)) + 1
    level = np.maximum(0, np.floor(np.log2(np.maximum(counts - usual, 1) / (4 * spread)) + 1)).astype(np.int64)
    return level, np.floor(2 * np.log2(out[size:] + 1)).astype(np.int64)


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    """n - ceil(t n) + (2 + n // 10): so many that two similar sets share at least the last term, of the smaller one, in their prefixes."""
    return np.minimum(n, n - (percent * n + 99) // 100 + 2 + n // 10)


def shared_least(n: str, m: str, percent: int):
    """How many shingles the prefixes of similar sets of n and m shingles share at least."""
    n, m = F.col(n), F.col(m)
    return F.least(F.lit(2) + F.floor(F.least(n, m) / 10), F.floor((F.lit(percent) * F.greatest(n, m) + 99) / 100))


SIGNED = "d long, n long, cid long, gid long, prefix array<long>, odd array<long>"


def signed(docs: DataFrame, sketch, k: int, percent: int) -> DataFrame:
    """Set size, class (hash of the set), group (hash of prefix and size), prefix and parity sketch of each document."""

    def run(batches):
        for batch in batches:
            for lo, hi, data, offsets in tk.slices(batch.column(1), PIECE, PIECE_TEXTS):
                texts, found, common = shingles(data, offsets, k, sketch.value[1])
                n = np.bincount(texts, minlength=hi - lo)
                first = np.concatenate([[0], np.cumsum(n)])
                cid = class_of(n, first, found)
                order = np.lexsort((found, common, sketch.value[0][_bucket(found)], texts))
                size = prefix_length(n, percent)
                at = np.arange(len(found)) - first[texts] < size[texts]
                prefix = found[order][at]
                ends = np.concatenate([[0], np.cumsum(size)])
                sums = np.concatenate([[np.uint64(0)], np.cumsum(tk.mix(prefix))])
                gid = tk.mix((sums[ends[1:]] - sums[ends[:-1]]) + tk.mix(n.astype(np.uint64) + np.uint64(77)))
                lists = pa.ListArray.from_arrays(ends.astype(np.int32), prefix.view(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n), pa.array(cid), pa.array(gid.view(np.int64)), lists, parities(n, texts, found)], names=["d", "n", "cid", "gid", "prefix", "odd"])

    return docs.select("d", "text").mapInArrow(run, SIGNED)


def parities(n: np.ndarray, texts: np.ndarray, found: np.ndarray) -> pa.ListArray:
    """One bit for each value of a hash's last bits: the parity of its shingles. At least 256 bits and two for each shingle, a power of 2."""
    bits = np.int64(1) << np.ceil(np.log2(np.maximum(2 * n, 256))).astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(bits)])
    at = ends[texts] + (found & (bits[texts] - 1).astype(np.uint64)).astype(np.int64)
    odd = np.bincount(at, minlength=ends[-1]).astype(np.uint8) & 1
    return pa.ListArray.from_arrays((ends // 64).astype(np.int32), np.packbits(odd, bitorder="little").view(np.int64))


def apart_at_most(pairs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """pairs: a, b (classes). Those whose parity sketches allow for the similarity; the longer sketch is folded to the shorter."""
    left = members.select(F.col("cid").alias("a"), F.col("n").alias("_n"), F.col("odd").alias("_x"))
    right = members.select(F.col("cid").alias("b"), F.col("n").alias("_m"), F.col("odd").alias("_y"))
    xor = lambda x, y: F.zip_with(x, y, lambda p, q: p.bitwiseXOR(q))
    half = lambda x: xor(F.slice(x, F.lit(1), F.expr(f"size({x}) div 2")), F.slice(x, F.expr(f"size({x}) div 2 + 1"), F.expr(f"size({x}) div 2")))
    x = F.when(F.size("_x") > F.size("_y"), half("_x")).otherwise(F.col("_x"))
    y = F.when(F.size("_y") > F.size("_x"), half("_y")).otherwise(F.col("_y"))
    least = F.aggregate(xor(x, y), F.lit(0), lambda total, z: total + F.bit_count(z))
    both = pairs.join(left, "a").join(right, "b").where(sized("_n", "_m", percent))
    return both.where((100 + percent) * least <= (100 - percent) * (F.col("_n") + F.col("_m"))).select("a", "b")


def class_of(n: np.ndarray, first: np.ndarray, found: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[np.uint64(0)], np.cumsum(tk.mix(found ^ np.uint64(0x5851F42D4C957F2D)))])
    return tk.mix((sums[first[1:]] - sums[first[:-1]]) ^ tk.mix(n.astype(np.uint64))).view(np.int64)


def sets_of(texts: DataFrame, k: int) -> DataFrame:
    """cid, s: class and shingles of each text."""

    def run(batches):
        for batch in batches:
            for lo, hi, data, offsets in tk.slices(batch.column(0), PIECE, PIECE_TEXTS):
                at, found, _ = shingles(data, offsets, k)
                n = np.bincount(at, minlength=hi - lo)
                ends = np.concatenate([[0], np.cumsum(n)])
                yield pa.RecordBatch.from_arrays([pa.array(class_of(n, ends, found)), pa.ListArray.from_arrays(ends.astype(np.int32), found.view(np.int64))], names=["cid", "s"])

    return texts.select("text").mapInArrow(run, "cid long, s array<long>")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """pairs: a, b (classes). Those whose sets are similar."""
    left, right = sets.select(F.col("cid").alias("a"), F.col("s").alias("_x")), sets.select(F.col("cid").alias("b"), F.col("s").alias("_y"))
    both = pairs.join(left, "a").join(right, "b").withColumn("_i", F.size(F.array_intersect("_x", "_y")))
    return both.where(100 * F.col("_i") >= percent * (F.size("_x") + F.size("_y") - F.col("_i"))).select("a", "b").distinct()


def sized(n: str, m: str, percent: int):
    """Sizes n and m of two different sets allow for the similarity: sets of one size differ in a shingle on either side."""
    less, more = F.least(F.col(n), F.col(m)), F.greatest(F.col(n), F.col(m))
    return F.when(less == more, 100 * (less - 1) >= percent * (less + 1)).otherwise(100 * less >= percent * more)


def fits(n: str, m: str, i: str, j: str, percent: int):
    """Sizes n, m and places i, j (from 0) of a shared shingle allow for the similarity."""
    n, m, i, j = map(F.col, (n, m, i, j))
    most = F.least(n - i, m - j)
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & ((100 + percent) * most >= percent * (n + m))


def centrality(postings: DataFrame, heavy: int) -> DataFrame:
    """gid, score: how much of a group's prefix is crowded shingles. A group amid many near copies lacks few of theirs."""
    crowded = postings.where(F.col("holders") > heavy)
    return crowded.groupBy("gid").agg((F.sum(F.log2("holders")) / F.first("n")).alias("score"))


def pivot_pairs(postings: DataFrame, members: DataFrame, central: DataFrame, percent: int, heavy: int, r: int) -> DataFrame:
    """(a, b): each group with the pivot group of its shared shingles, and each member of a group with the group's pivot.

    A crowded shingle's pivot is the most central of its groups in the first round; other pivots are taken by a hash.
    """
    crowded = postings.where(F.col("holders") > heavy).join(central, "gid")
    others = postings.where(F.col("holders") <= heavy).withColumn("score", F.lit(0.0))
    pivot = F.struct((F.col("score") if r == 0 else F.lit(0.0)).alias("score"), F.xxhash64("rep", F.lit(r)).alias("h"), F.col("rep").alias("p"), F.col("n").alias("m"))
    first = crowded.groupBy("token").agg(F.max(pivot).alias("_p")).union(others.groupBy("token").agg(F.max(pivot).alias("_p")))
    near = postings.join(first, "token").select("rep", "n", "_p.p", "_p.m").where((F.col("rep") != F.col("p")) & sized("n", "m", percent))
    near = near.groupBy(F.col("rep").alias("a"), F.col("p").alias("b"), "n", "m").agg(F.count(F.lit(1)).alias("_c")).where(F.col("_c") >= shared_least("n", "m", percent)).select("a", "b")
    own = members.groupBy("gid").agg(F.min(F.struct(F.xxhash64("cid", F.lit(r)).alias("h"), F.col("cid").alias("p"))).alias("_p"))
    return near.union(members.where(sized("n", "n", percent)).join(own, "gid").select(F.col("cid").alias("a"), F.col("_p.p").alias("b")))


def rooted(members: DataFrame, label: DataFrame) -> DataFrame:
    """gid, cid, n, score, root: the members of the groups and the components that they are known to be in."""
    return members.join(label.select(F.col("node").alias("cid"), "root"), "cid", "left").select("gid", "cid", "n", "score", F.coalesce("root", "cid").alias("root"))


def cells(postings: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """token, k, own, gid, n, i, band, root_a, root_b, size, ref: the groups of each cell whose classes are of several components.

    Bands grow by 100 / percent, so that similar sets are in one band or in neighbours; a group is in the cells of its band
    and of the next, and a pair meets in the cell of the larger one's band. A group with classes of several components is
    a cell with `own`. size is the number of classes in a cell, ref the most central of them.
    """
    groups = roots.groupBy("gid").agg(F.first("n").alias("n"), F.first("score").alias("score"), F.min("root").alias("root_a"), F.max("root").alias("root_b"), F.count(F.lit(1)).alias("many"), F.max(F.struct(F.xxhash64("cid").alias("h"), F.col("cid").alias("p"))).alias("of"))
    groups = groups.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / percent)) + 1e-9) if percent < 100 else F.col("n"))
    shown = ["gid", "n", "band", "root_a", "root_b", "many", "score", "of"]
    at = postings.select("token", "gid", "i").join(groups, "gid").select("token", F.explode(F.array(F.col("band"), F.col("band") + 1)).alias("k"), F.lit(False).alias("own"), "i", *shown)
    at = at.union(groups.where(sized("n", "n", percent) & (F.col("root_a") < F.col("root_b"))).select(F.col("gid").alias("token"), F.col("band").alias("k"), F.lit(True).alias("own"), F.lit(0).alias("i"), *shown))
    mixed = at.groupBy("token", "k", "own").agg(F.min("root_a").alias("_a"), F.max("root_b").alias("_b"), F.sum("many").alias("size"), F.max(F.struct("score", "of.h", "of.p")).alias("_p"))
    return at.drop("score", "of", "many").join(mixed.where("_a < _b").select("token", "k", "own", "size", F.col("_p.p").alias("ref")), ["token", "k", "own"])


def group_pairs(at: DataFrame, percent: int) -> DataFrame:
    """(gid, other): pairs of groups of cells of few classes that the prefix filter leaves, and groups with themselves."""
    shared = at.where(~F.col("own"))
    to = shared.select("token", "k", F.col("gid").alias("other"), F.col("n").alias("m"), F.col("i").alias("j"), F.col("band").alias("band_b"), F.col("root_a").alias("root_c"), F.col("root_b").alias("root_d"))
    apart = (F.col("root_a") != F.col("root_b")) | (F.col("root_c") != F.col("root_d")) | (F.col("root_a") != F.col("root_c"))
    met = (F.col("gid") < F.col("other")) & apart & (F.col("k") == F.greatest("band", "band_b")) & sized("n", "m", percent)
    met = shared.join(to, ["token", "k"]).where(met).groupBy("gid", "other", "n", "m").agg(F.count(F.lit(1)).alias("_c"), F.max(fits("n", "m", "i", "j", percent)).alias("_fits"))
    met = met.where(F.col("_fits") & (F.col("_c") >= shared_least("n", "m", percent))).select("gid", "other")
    return met.union(at.where("own").select("gid", F.col("gid").alias("other")))


def expanded(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """(a, b): the pairs of members of different components, from pairs of groups."""
    left = roots.select("gid", F.col("cid").alias("a"), F.col("root").alias("_a"))
    right = roots.select(F.col("gid").alias("other"), F.col("cid").alias("b"), F.col("root").alias("_b"))
    met = (F.col("_a") != F.col("_b")) & ((F.col("gid") != F.col("other")) | (F.col("a") < F.col("b")))
    return pairs.join(left, "gid").join(right, "other").where(met).select("a", "b")


def differences(homes: DataFrame, sets: DataFrame, sketch, percent: int) -> DataFrame:
    """ref, cid, n, d, near, prefix: how a class differs from its reference.

    d is the number of shingles in which they differ, near tells whether they are similar, and prefix holds the shingles that
    come first in the reference's order: those that it lacks, the rarest first, then its own, the commonest first.
    """

    def run(batches):
        for batch in batches:
            refs, n = batch.column(0), batch.column(2).to_numpy()
            d, near, prefix, ends = [], [], [], [0]
            for i, (x, p) in enumerate(zip(batch.column(3), batch.column(4), strict=True)):
                x, p = x.values.to_numpy().view(np.uint64), p.values.to_numpy().view(np.uint64)
                more, less = np.setdiff1d(x, p, assume_unique=True), np.setdiff1d(p, x, assume_unique=True)
                both = np.concatenate([more[np.lexsort((more, sketch.value[0][_bucket(more)]))], less[np.lexsort((less, -sketch.value[0][_bucket(less)]))]])
                d.append(len(both))
                near.append((100 + percent) * len(both) <= (100 - percent) * (len(x) + len(p)))
                prefix.append(both[: (100 - percent) * int(n[i]) // percent + 1])
                ends.append(ends[-1] + len(prefix[-1]))
            flat = np.concatenate(prefix).view(np.int64) if prefix else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([refs, batch.column(1), batch.column(2), pa.array(d, pa.int64()), pa.array(near, pa.bool_()), pa.ListArray.from_arrays(np.array(ends, dtype=np.int32), flat)], names=["ref", "cid", "n", "d", "near", "prefix"])

    own, of = sets.select("cid", F.col("s").alias("x")), sets.select(F.col("cid").alias("ref"), F.col("s").alias("p"))
    return homes.join(own, "cid").join(of, "ref").select("ref", "cid", "n", "x", "p").mapInArrow(run, "ref long, cid long, n long, d long, near boolean, prefix array<long>")


def heavy_pairs(apart: DataFrame, label: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs between components whose differences from a common reference share a shingle early enough."""
    at = apart.join(label.select(F.col("node").alias("cid"), "root"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    at = at.select("ref", "cid", "n", "d", "root", F.posexplode("prefix").alias("i", "token"))
    mixed = at.groupBy("ref", "token").agg(F.min("root").alias("_a"), F.max("root").alias("_b")).where("_a < _b").select("ref", "token")
    at = at.join(mixed, ["ref", "token"])
    to = at.select("ref", "token", F.col("cid").alias("b"), F.col("n").alias("m"), F.col("d").alias("e"), F.col("i").alias("j"), F.col("root").alias("root_b"))
    # The share of both differences must be (d + e - most) / 2 at least, of which the first is at i and j.
    most = F.floor(F.lit(100 - percent) * (F.col("n") + F.col("m")) / (100 + percent))
    early = 2 * F.least(F.col("d") - F.col("i"), F.col("e") - F.col("j")) >= F.col("d") + F.col("e") - most
    return at.join(to, ["ref", "token"]).where((F.col("cid") < F.col("b")) & (F.col("root") != F.col("root_b")) & sized("n", "m", percent) & early).select(F.col("cid").alias("a"), "b")


def similar(documents: DataFrame, k: int = 3, percent: int = 90, rounds: int = 1, heavy: int = 64) -> DataFrame:
    """doc_id, n_shingles, component_id, class_id, n_verified for each document."""
    docs = documents.select(F.coalesce(F.col("doc_id"), F.lit(LEAST)).alias("d"), "text")
    spark = documents.sparkSession
    sketch = spark.sparkContext.broadcast(order_sketch(docs, k))
    made: dict[str, list[str]] = {}

    def keep(df: DataFrame, name: str) -> DataFrame:
        with tables() as paths:
            out = written(df, name)
        made.setdefault(name, []).extend(paths)
        return out

    def drop(*names: str) -> None:
        """Deletes tables that only tables written since have been made from."""
        discard(spark, [path for name in names for path in made.pop(name, [])])

    each = keep(signed(docs, sketch, k, percent), "signed")
    release(spark)
    classes = each.where("n > 0").groupBy("cid").agg(F.min("d").alias("d"), F.first("n").alias("n"), F.first("gid").alias("gid"), F.first("odd").alias("odd"))
    groups = each.where("n > 0").groupBy("gid").agg(F.min("cid").alias("rep"), F.first("n").alias("n"), F.count(F.lit(1)).alias("_rows"), F.first("prefix").alias("prefix"))
    postings = groups.select("gid", F.posexplode("prefix").alias("i", "token"))
    # written, so that the shuffles of the counts are gone before the postings are shuffled
    common = keep(postings.groupBy("token").agg(F.count(F.lit(1)).alias("holders")).where("holders > 1"), "common")
    release(spark)
    # most postings are of one holder: what else is told of a group joins those that are left
    shared = postings.join(common, "token").select("token", "gid", "i", "holders")
    postings = keep(shared.join(groups.select("gid", "rep", "n"), "gid").select("token", "gid", "rep", "n", "i", "holders"), "postings")
    drop("common")
    release(spark)
    central = keep(centrality(postings, heavy), "central")
    crowded = classes.groupBy("gid").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("gid")
    members = classes.join(postings.select("gid").union(crowded).distinct(), "gid", "left_semi")
    members = keep(members.join(central, "gid", "left").withColumn("score", F.coalesce("score", F.lit(0.0))), "members")
    each = keep(each.select("d", "n", "cid"), "rows")
    drop("signed")
    release(spark)
    links = tested = label = apart = None

    def sets_for(cids: DataFrame) -> DataFrame:
        # A text is found by the smallest doc_id of its class; of rows that share an id, the class decides which is meant.
        # Rows that are equal in both make a pair twice, which `distinct` undoes.
        asked = members.join(cids.distinct(), "cid", "left_semi").select("d").distinct()
        return sets_of(docs.join(asked, "d", "left_semi"), k)

    for r in range(rounds + 1):
        if r < rounds:
            pairs = pivot_pairs(postings, members, central, percent, heavy, r)
        else:
            roots = keep(rooted(members, label), "rooted")
            at = keep(cells(postings, roots, percent), "cells")
            drop("postings", "central")
            release(spark)
            crowd = at.where(F.col("size") > heavy).select("ref", "gid").distinct()
            homes = keep(crowd.join(roots.select("gid", "cid", "n"), "gid").where("cid <> ref").select("ref", "cid", "n").distinct(), "homes")
            pairs = expanded(keep(group_pairs(at.where(F.col("size") <= heavy), percent), "groups"), roots)
            drop("cells")
            if not homes.isEmpty():
                sets = keep(sets_for(homes.select(F.explode(F.array("cid", "ref")).alias("cid"))).distinct(), "home-sets")
                apart = keep(differences(homes, sets, sketch, percent), "differences")
                drop("homes", "home-sets")
                close = apart.where("near").select(F.least("ref", "cid").alias("a"), F.greatest("ref", "cid").alias("b")).distinct()
                links = keep(links.unionByName(close).distinct(), "links")
                label = components(links)
                pairs = pairs.union(heavy_pairs(apart, label, percent))
        pairs = pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        pairs = pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti")
        pairs = keep(apart_at_most(pairs, members, percent), "pairs")
        drop("rooted", "groups", "differences")
        sets = keep(sets_for(pairs.select(F.explode(F.array("a", "b")).alias("cid"))), "sets")
        found = keep(verified(pairs, sets, percent), "links")
        drop("sets")
        tested = pairs if tested is None else tested.unionByName(pairs)
        links = found if links is None else links.unionByName(found).distinct()
        label = components(links)
    drop("members", "pairs")
    counted = links.select(F.explode(F.array("a", "b")).alias("cid")).groupBy("cid").agg(F.count(F.lit(1)).alias("n_verified"))
    told = label.select(F.col("node").alias("cid"), "root").join(counted, "cid", "left")
    rows = each.select("d", "n", "cid").join(told, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    # written, so that the adaptive plan can split the rows of a large component
    least = written(rows.where("n > 0").groupBy("root").agg(F.min("d").alias("_least")), "least")
    out = rows.join(least, "root", "left")
    shown = lambda c: F.when(c != LEAST, c)
    return out.select(
        shown(F.col("d")).alias("doc_id"),
        F.col("n").alias("n_shingles"),
        shown(F.when(F.col("n") > 0, F.col("_least")).otherwise(F.col("d"))).alias("component_id"),
        F.col("cid").alias("class_id"),
        F.coalesce("n_verified", F.lit(0)).alias("n_verified"),
    )
