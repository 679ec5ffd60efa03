"""Operator 2: documents that hold a benchmark passage, also reworded, by latent semantic retrieval.

Passages are windows of two blocks of `block` words, each overlapping the next by one block; a passage's region is the
passage and as many words as the item has on either side, so that a region can hold an item of any length.

1. TF-IDF vectors over hashed words. A word counts 1 + log of its places in the passage, and its weight is 1 + log((1 + n) / (1 + df)) / log(1 + n), between 1 and 2, so that a
   passage that many documents hold still weighs as much as the text around it. Frequencies are counted over all documents.
2. A randomised SVD of all passages of all documents and items gives `rank` orthonormal directions. The passage matrix is never
   stored; each task multiplies its own rows, the products are summed by word in a shuffle, and one task makes the columns
   orthonormal. The first pass adds rows up at random (a sparse sketch), each later one multiplies by the matrix and its
   transpose, and the last one's product also gives the singular directions (Nystroem). 24 spare columns make up for having no pass of its own for these.
3. Candidates are pairs of an item and a region whose latent vectors, both projected and normalised, have a cosine of `near`
   or more. It is worked out only where the pair could pass step 4 at all: if c of an item's L words must be matched, then
   of any L - c + h of them h must be. The rarest are taken, so few regions are left and none that could pass is missed.
4. A pair counts if the longest common subsequence (LCS) of item and region covers `cover` of the item and `answer` of its last
   quarter, where its answer stands (punctuation and case aside).

Every passage of the corpus counts in the basis, one that is repeated as often as it stands there; all of them together
weigh as much as MASS rows of norm 1 and an item's passages 16 each, so that a large corpus leaves directions to the items.
Only a caller that gives `sample` has a basis of a bounded draw instead; the queries do not. All documents are searched. One basis serves all items; the benchmark is the query set and is searched in blocks of about `items`
rows, each in one pass, so that what a task holds is bounded. Only counters, found pairs and the products (13 MB for each
SPAN passages and pass) are shuffled.

Defined cases: null and empty texts and items match nothing; a very long text is one slice and is searched whole; equal rows
of documents give equal pairs once; items with equal texts are found separately; a null doc_id or item_id is kept as null;
empty tables give no rows; extra columns, whatever their names, are unread.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .common import release, written

BITS = 14
#: Rows of norm 1 that all passages of the corpus together weigh as much as; passages of the corpus that one product is made of.
MASS, SPAN = 2000, 200_000
#: Bytes and texts that are worked on at a time, so that a task's temporaries stay small; passages that are multiplied together.
PIECE, PIECE_TEXTS, TOGETHER = 1 << 18, 1 << 16, 8
SCHEMA = "doc_id long, item_id long, cosine double, lcs_share double, answer_share double, first_word long"
_DROP = bytes(c for c in range(128) if not chr(c).isalnum())


_KEPT = np.array([c >= 128 or chr(c).isalnum() or c == 32 or 9 <= c <= 13 for c in range(256)])


def words_of(data: np.ndarray, offsets: np.ndarray) -> tk.Words:
    """The hashed `normal_words`, at their places in data without ASCII punctuation."""
    kept = _KEPT[data]
    moved = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(kept, out=moved[1:])
    return tk.words(data[kept], moved[offsets], tk.FOLDED)


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BITS)).astype(np.int64)


def normal_words(raw: bytes) -> list[bytes]:
    return [y for x in raw.split() if (y := x.translate(None, _DROP).lower())]


def document_frequencies(docs: DataFrame, block: int) -> tuple[np.ndarray, int, int]:
    """(documents that hold each hashed word, number of documents, number of passages)."""
    size = 1 << BITS

    def run(batches):
        total, n, m = np.zeros(size, dtype=np.int64), 0, 0
        for batch in batches:
            n += len(batch)
            for _, _, data, offsets in tk.slices(batch.column(0), PIECE, PIECE_TEXTS):
                w = words_of(data, offsets)
                keys = w.text_of.astype(np.int32) << BITS | _bucket(w.hashes).astype(np.int32)
                keys.sort()
                total += np.bincount(keys[np.diff(keys, prepend=-1) != 0] & (size - 1), minlength=size)
                m += len(passages(w, block)[0])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, [size, size + 1])), pa.array(np.append(total[at], [n, m]))], names=["c", "n"])

    found = docs.select("text").mapInArrow(run, "c long, n long").groupBy("c").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size + 2, dtype=np.int64)
    out[found.column("c").to_numpy()] = found.column("n").to_numpy()
    return out[:size], int(out[size]), int(out[size + 1])


def passages(w: tk.Words, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, end word) of each window of two blocks; a text's last window ends with the text."""
    n = np.diff(w.first)
    many = np.where(n > 0, np.maximum(-(-n // block) - 1, 1), 0)
    text = np.repeat(np.arange(len(n)), many)
    inner = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
    first = w.first[text] + inner * block
    return text, first, np.minimum(first + 2 * block, w.first[text + 1])


def weights(df: np.ndarray, n: int) -> np.ndarray:
    """A weight between 1 and 2 for each hashed word: the commonest has 1, one that no document holds 2."""
    return (1 + np.log((1 + n) / (1 + df)) / max(np.log1p(n), 1e-9)).astype(np.float32)


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for each range, one after the other."""
    first = np.cumsum(lengths) - lengths
    return np.arange(int(lengths.sum())) - np.repeat(first - starts, lengths)


def frequencies(group: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, hashed word, 1 + log of its number of places in the group) by groups: a word that is repeated does not outweigh the others."""
    keys = (group.astype(np.int64) << BITS) | at
    if not len(keys):
        return keys, keys, np.zeros(0, dtype=np.float32)
    if int(group[-1]) >> (31 - BITS) == 0:  # groups come in their order
        keys = keys.astype(np.int32)
    keys.sort()
    new = np.flatnonzero(np.diff(keys, prepend=-1))
    keys, n = keys[new].astype(np.int64), np.diff(new, append=len(keys))
    return keys >> BITS, keys & ((1 << BITS) - 1), (1 + np.log(n)).astype(np.float32)


def passage_lists(batches, block: int):
    """(words, texts, places of the words, lengths) of the passages in batches of texts, of about PIECE bytes at a time."""
    for batch in batches:
        for _, _, data, offsets in tk.slices(batch.column(0), PIECE, PIECE_TEXTS):
            w = words_of(data, offsets)
            text, first, end = passages(w, block)
            if len(text):
                yield w, text, _ranges(first, end - first), end - first


def passage_rows(texts: DataFrame, block: int) -> DataFrame:
    """(h, at): a hash and the hashed words of every passage of a column of texts."""

    def run(batches):
        for w, text, at, lengths in passage_lists(batches, block):
            place = at - np.repeat(w.first[text], lengths)
            h = tk.mix(np.add.reduceat(tk.mix(w.hashes[at] + place.astype(np.uint64)), np.cumsum(lengths) - lengths))
            lists = pa.ListArray.from_arrays(np.append(0, np.cumsum(lengths)).astype(np.int32), _bucket(w.hashes[at]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), lists], names=["h", "at"])

    return texts.mapInArrow(run, "h long, at array<int>")


def fitted_rows(docs: DataFrame, n: int, m: int, questions: DataFrame, block: int, most: int) -> DataFrame:
    """(weight, at): all passages of the questions and at most `most` of the m passages of the n documents, for callers that ask for a draw.

    Documents and passages are drawn by hashes, so that about twice as many as `most` are left, each once, of which those
    with the smallest hashes are taken.
    """
    some, of = min(1.0, 20 * most / max(n, 1)), 1 << 30
    grain = F.pmod(F.xxhash64("doc_id", "text"), F.lit(of))
    drawn = passage_rows(docs.where(grain < F.lit(int(some * of))).select("text"), block)
    drawn = drawn.where(F.pmod(F.xxhash64("h"), F.lit(of)) < F.lit(int(min(1.0, 2 * most / max(m * some, 1)) * of)))
    taken = drawn.groupBy("h").agg(F.first("at").alias("at")).orderBy("h").limit(most).select(F.lit(1.0).alias("weight"), "at")
    asked = passage_rows(questions.select("text"), block).select(F.lit(4.0).alias("weight"), "at")
    return written(taken.unionByName(asked).repartition(8), "passages")


class _Rows:
    """The weighted matrix of some passages, given by their hashed words and lengths; a row is a passage, scaled to a norm of its weight."""

    def __init__(self, at: np.ndarray, lengths: np.ndarray, weight: np.ndarray | float, idf: np.ndarray):
        self.row, self.at, tf = frequencies(np.repeat(np.arange(len(lengths)), lengths), at)
        self.first = np.searchsorted(self.row, np.arange(len(lengths)))  # passages are not empty
        self.value = tf * idf[self.at]
        norm = np.sqrt(np.add.reduceat(self.value**2, self.first))
        self.value = (self.value * (weight / norm)[self.row]).astype(np.float32)

    def add_product(self, total: np.ndarray, basis: np.ndarray) -> None:
        """Adds the transposed matrix times the matrix times basis to total.

        TOGETHER rows at a time are a dense matrix of the words that they hold: rows that follow each other share many words,
        and each word's part of basis and total is read once for all of them.
        """
        group = self.row // TOGETHER
        keys = group << BITS | self.at
        order = np.argsort(keys)
        keys, row = keys[order], self.row[order]
        new = np.diff(keys, prepend=-1) != 0
        words, of = keys[new] & ((1 << BITS) - 1), keys >> BITS
        n = int(group[-1]) + 1
        ends = np.searchsorted(keys[new] >> BITS, np.arange(n + 1))
        many, rows = np.diff(ends), np.minimum(TOGETHER, len(self.first) - TOGETHER * np.arange(n))
        starts = np.append(0, np.cumsum(many * rows))
        dense = np.zeros(int(starts[-1]), dtype=np.float32)
        dense[starts[of] + (row - of * TOGETHER) * many[of] + np.cumsum(new) - 1 - ends[of]] = self.value[order]
        for k, (lo, hi) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
            part, at = dense[starts[k] : starts[k + 1]].reshape(-1, hi - lo), words[lo:hi]
            total[at] += part.T @ (part @ basis.take(at, axis=0))

    def add_up(self, total: np.ndarray, rng: np.random.Generator) -> None:
        """Adds each row, with a random sign, to a random column of total."""
        n, width = len(self.first), total.shape[1]
        column, sign = rng.integers(0, width, n), rng.choice(np.array([-1, 1], dtype=np.float32), n)
        np.add.at(total.reshape(-1), self.at * width + column[self.row], self.value * sign[self.row])


def fit_basis(rows: DataFrame, idf: np.ndarray, rank: int, power: int = 1, seed: int = 5, corpus: DataFrame | None = None, weight: float = 1.0, block: int = 20) -> np.ndarray:
    """Orthonormal columns (hashed words by directions): the right singular vectors of a randomised SVD.

    rows: weight, at. corpus: text, whose passages are rows of this weight besides; it is read in each pass and none of them is stored.
    """
    spark, size, width = rows.sparkSession, len(idf), rank + 24
    kept = None

    def packed(keys: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
        offsets = np.arange(len(keys) + 1, dtype=np.int32) * values.shape[1]
        return pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int32)), pa.ListArray.from_arrays(offsets, np.ascontiguousarray(values, dtype=np.float32).ravel())], names=["b", "v"])

    def unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        return batch.column(0).to_numpy(), batch.column(1).flatten().to_numpy().reshape(len(batch), -1)

    def of_rows(batches):
        for batch in batches:
            for lo in range(0, len(batch), 8192):
                part = batch.slice(lo, 8192)
                lists = part.column(1)
                yield _Rows(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.asarray(lists.value_lengths()).astype(np.int64), part.column(0).to_numpy(zero_copy_only=False), idf)

    def of_texts(batches):
        for w, _, at, lengths in passage_lists(batches, block):
            yield _Rows(_bucket(w.hashes)[at], lengths, weight, idf)

    def product(made):
        def run(batches):
            total, seen = np.zeros((size, width), dtype=np.float32), np.zeros(size, dtype=bool)
            rng = np.random.default_rng([seed, TaskContext.get().partitionId()])
            for m in made(batches):
                seen[m.at] = True
                if kept:
                    m.add_product(total, kept.value)
                else:
                    m.add_up(total, rng)
            at = np.flatnonzero(seen)
            for lo in range(0, len(at), 2048):
                yield packed(at[lo : lo + 2048], total[at[lo : lo + 2048]])

        return run

    def summed(batches):
        total: dict = {}
        for batch in batches:
            for k, v in zip(*unpacked(batch)):
                total[k] = total[k] + v if k in total else v
        if total:
            yield packed(np.fromiter(total, dtype=np.int64), np.stack(list(total.values())))

    def orthonormal(batches):
        total = np.zeros((size, width), dtype=np.float32)
        for batch in batches:
            keys, v = unpacked(batch)
            total[keys] = v
        q = directions(kept.value, total, rank) if last else np.linalg.qr(total)[0]
        for lo in range(0, size, 2048):
            yield packed(np.arange(lo, min(size, lo + 2048)), q[lo : lo + 2048])

    def read(table: DataFrame) -> np.ndarray:
        parts = [unpacked(batch) for batch in table.toArrow().to_batches()]
        out = np.zeros((size, rank if last else width), dtype=np.float32)
        for keys, v in parts:
            out[keys] = v
        return out

    for k in range(1 + power):
        last = k == power
        sums = rows.mapInArrow(product(of_rows), "b int, v array<float>")
        if corpus is not None:
            sums = sums.unionByName(corpus.mapInArrow(product(of_texts), "b int, v array<float>"))
        sums = sums.repartition("b").mapInArrow(summed, "b int, v array<float>")
        q = read(written(sums.repartition(1).mapInArrow(orthonormal, "b int, v array<float>"), "basis"))
        if kept:
            kept.unpersist()
        if not last:
            kept = spark.sparkContext.broadcast(q)
            release(spark)
    return q


def directions(q: np.ndarray, product: np.ndarray, rank: int) -> np.ndarray:
    """The first eigenvectors of a symmetric matrix without negative eigenvalues, from orthonormal columns and its product with them (Nystroem)."""
    parts = [slice(lo, lo + 2048) for lo in range(0, len(q), 2048)]  # in double precision some rows at a time
    small = sum(q[at].T.astype(np.float64) @ product[at].astype(np.float64) for at in parts)
    values, turn = np.linalg.eigh((small + small.T) / 2)
    turn /= np.sqrt(np.maximum(values, max(1e-6 * values[-1], 1e-30)))
    turned = np.concatenate([product[at].astype(np.float64) @ turn for at in parts])
    return np.linalg.svd(turned, full_matrices=False)[0][:, :rank].astype(np.float32)


def lcs(masks: dict, length: int, words: list) -> int:
    """Positions of the item in a longest common subsequence, as a bit set: 0 bits of the result are matched."""
    full = (1 << length) - 1
    v = full
    for x in words:
        m = masks.get(x, 0)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return length - v.bit_count()


def _masks(words: list) -> dict:
    out: dict = {}
    for i, x in enumerate(words):
        out[x] = out.get(x, 0) | (1 << i)
    return out


def find_leaks(documents: DataFrame, benchmark: DataFrame, rank: int = 192, block: int = 20, near: float = 0.2, cover: float = 0.7, answer: float = 0.5, sample: int | None = None, items: int = 2000) -> DataFrame:
    """Rows of SCHEMA: pairs of a document and an item that it holds."""
    docs = documents.select("doc_id", "text")
    df, n, m = document_frequencies(docs, block)
    idf = weights(df, n)
    questions = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text")).distinct().withColumn("_p", F.pmod(F.xxhash64("item_id", "text"), F.lit(1 << 30)))
    if sample is None:
        asked = written(passage_rows(questions.select("text"), block).select(F.lit(4.0).alias("weight"), "at"), "passages")
        basis = fit_basis(asked, idf, rank, corpus=docs.select("text").coalesce(max(8, -(-m // SPAN))), weight=min(1.0, MASS / max(m, 1)) ** 0.5, block=block)
    else:
        basis = fit_basis(fitted_rows(docs, n, m, questions, block, sample), idf, rank)
    parts = max(1, -(-questions.count() // items))
    out = None
    for part in range(parts):
        own = questions.where((F.col("_p") * parts >= part * (1 << 30)) & (F.col("_p") * parts < (part + 1) * (1 << 30))).drop("_p")
        found = search(docs, own.orderBy("item_id", "text").toArrow(), df, idf, basis, block, near, cover, answer)
        out = found if out is None else out.unionByName(found)
    return out.distinct()


def least_matched(length: int, share: float) -> int:
    """The smallest number of `length` words that is `share` of them."""
    return max(1, next(c for c in range(length + 1) if c / length >= share))


def by_word(words: np.ndarray, items: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, number, items): for each word number, its items among those flagged in `among`."""
    order = np.argsort(words, kind="stable")
    order = order[among[items[order]]]
    many = np.bincount(words[order], minlength=int(words.max(initial=-1)) + 1)
    return np.cumsum(many) - many, many, items[order]


def regions(w: tk.Words, word: np.ndarray, item: np.ndarray, length: np.ndarray, hits: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, text, window) of each window whose region holds `hits` of an item's taken words; word, item: places where one stands, by places."""
    order = np.argsort(item, kind="stable")
    word, item = word[order], item[order]
    to = np.arange(len(word)) + hits[item] - 1
    at = np.flatnonzero(to < len(word))
    at = at[item[to[at]] == item[at]]
    at = at[word[to[at]] - word[at] < 2 * block + 2 * length[item[at]]]
    text = np.searchsorted(w.first, word[at], "right") - 1
    same = word[to[at]] < w.first[text + 1]
    at, text = at[same], text[same]
    item, low, high = item[at], word[at] - w.first[text], word[to[at]] - w.first[text]
    last = np.maximum(-(-np.diff(w.first)[text] // block) - 1, 1) - 1
    from_, until = np.maximum((high - 2 * block - length[item]) // block + 1, 0), np.minimum((low + length[item]) // block, last)
    # both grow within an item and text, so a window is left to the first that holds it
    again = np.flatnonzero((item[1:] == item[:-1]) & (text[1:] == text[:-1])) + 1
    from_[again] = np.maximum(from_[again], until[again - 1] + 1)
    many = np.maximum(until - from_ + 1, 0)
    inner = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    return np.repeat(item, many), np.repeat(text, many), np.repeat(from_, many) + inner


def cosines(at: np.ndarray, start: np.ndarray, end: np.ndarray, item: np.ndarray, projected: np.ndarray, vectors: np.ndarray, most: int = 1 << 13) -> np.ndarray:
    """Latent cosine of the words start to end - 1 (not empty) and an item's vector, for each pair; at: hashed words."""
    keys, of = np.unique(start * np.int64(len(at) + 1) + end, return_inverse=True)
    low, high = keys // (len(at) + 1), keys % (len(at) + 1)
    out, total = np.zeros(len(item), dtype=np.float32), np.cumsum(high - low)
    order = np.argsort(of, kind="stable")
    lo = 0
    while lo < len(keys):  # some regions at a time, so that their words' vectors stay small
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + most, "right")))
        lengths = high[lo:hi] - low[lo:hi]
        row, word, tf = frequencies(np.repeat(np.arange(hi - lo), lengths), at[_ranges(low[lo:hi], lengths)])
        made = np.add.reduceat(tf[:, None] * projected[word], np.searchsorted(row, np.arange(hi - lo)), axis=0)
        made /= np.maximum(np.linalg.norm(made, axis=1, keepdims=True), 1e-9)
        own = order[np.searchsorted(of[order], lo) : np.searchsorted(of[order], hi)]
        out[own] = np.einsum("ij,ij->i", made[of[own] - lo], vectors[item[own]])
        lo = hi
    return out


def search(docs: DataFrame, rows: pa.Table, df: np.ndarray, idf: np.ndarray, basis: np.ndarray, block: int, near: float, cover: float, answer: float, most: int = 1 << 21) -> DataFrame:
    """`most`: hits that are held at once, above which a block's items are searched in smaller blocks."""
    ids = rows.column("item_id").to_pylist()
    projected = idf[:, None] * basis
    wanted, kept, vectors, taken, hits = [], [], [], [], []
    for i, text in enumerate(rows.column("text").to_pylist()):
        raw = text.encode()
        hashes = words_of(np.frombuffer(raw, dtype=np.uint8), np.array([0, len(raw)])).hashes
        if not len(hashes):
            continue
        at, item = _bucket(hashes), hashes.tolist()
        _, word, tf = frequencies(np.zeros(len(at)), at)
        latent = tf @ projected[word]
        vectors.append(latent / max(float(np.linalg.norm(latent)), 1e-9))
        tail = item[-max(1, len(item) // 4) :]
        least = least_matched(len(item), cover)
        wanted.append((_masks(item), len(item), least, _masks(tail), len(tail)))
        hits.append(max(1, least // 3))
        taken.append(np.unique(hashes[np.argsort(df[at], kind="stable")[: len(item) - least + hits[-1]]]))
        kept.append(ids[i])
    vectors = np.array(vectors, dtype=np.float32).reshape(len(kept), basis.shape[1])
    length, hits = np.array([x[1] for x in wanted], dtype=np.int64), np.array(hits, dtype=np.int64)
    vocabulary, numbers = np.unique(np.concatenate([np.zeros(0, dtype=np.uint64), *taken]), return_inverse=True)
    holder = np.repeat(np.arange(len(kept)), [len(x) for x in taken])
    some = np.zeros(1 << 16, dtype=bool)
    some[(vocabulary >> np.uint64(48)).astype(np.int64)] = True
    every = by_word(numbers, holder, np.ones(len(kept), dtype=bool))
    apart = [by_word(numbers, holder, np.arange(len(kept)) % 8 == k) for k in range(8)]
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    model = docs.sparkSession.sparkContext.broadcast((projected, vectors, wanted))

    def run(batches):
        projected, vectors, wanted = model.value
        for batch in batches:
            ids_of = batch.column(0)
            for lo, _, data, offsets in tk.slices(batch.column(1), 1 << 19):
                w = words_of(data, offsets)
                if not len(w.hashes) or not kept:
                    continue
                places = np.flatnonzero(some[(w.hashes >> np.uint64(48)).astype(np.int64)])
                number = np.minimum(np.searchsorted(vocabulary, w.hashes[places]), len(vocabulary) - 1)
                real = vocabulary[number] == w.hashes[places]
                places, number = places[real], number[real]
                best: dict[tuple[int, int], tuple] = {}
                for start, many, items_of in [every] if every[1][number].sum() <= most else apart:
                    n = many[number]
                    inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    q, t, x = regions(w, np.repeat(places, n), items_of[np.repeat(start[number], n) + inner], length, hits, block)
                    if not len(q):
                        continue
                    first = w.first[t] + x * block
                    low, high = np.maximum(w.first[t], first - length[q]), np.minimum(w.first[t + 1], first + 2 * block + length[q])
                    cosine = cosines(_bucket(w.hashes), low, high, q, projected, vectors)
                    for i in np.flatnonzero(cosine >= near).tolist():
                        pair = int(t[i]), int(q[i])
                        masks, size, least, tail_masks, tail_size = wanted[pair[1]]
                        region = [h for h in w.hashes[low[i] : high[i]].tolist() if h in masks]
                        if len(region) < least:
                            continue
                        share = lcs(masks, size, region) / size
                        if share < cover:
                            continue
                        tail = lcs(tail_masks, tail_size, region) / tail_size
                        if tail >= answer:
                            row = (share, tail, float(cosine[i]), int(x[i]) * block)
                            best[pair] = max(best.get(pair, row), row)
                if best:
                    rows_ = [(ids_of[lo + t].as_py(), kept[q], r[2], r[0], r[1], r[3]) for (t, q), r in best.items()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows_), (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64()))], names=names)

    return docs.mapInArrow(run, SCHEMA)
