"""Operator 5: repeated passages by compressed FM-indexes, one for each shard.

Every window of `window` words has a minimiser, its smallest hash of `gram` consecutive words; windows in a row with the
same minimiser are one segment. Equal windows have equal minimisers, so segments are routed by it: all places of a window
meet in one shard. Only segments whose minimiser occurs twice or more are routed.

A task builds FM-indexes of about `shard_rows` segments one after the other: suffixes sorted by their first `window` words,
the Burrows-Wheeler transform in a wavelet tree (bit vectors with rank directories), and streams the shard's segments
through it. Backward search, with a step back to the enclosing interval whenever a match is `window` words long, gives the
matching statistics; a window that reaches the threshold has an interval, and the earliest place in the interval tells
whether it repeats an earlier one.

Skew: equal segments are reduced to their earliest in each task before the shuffle (the others are known to be repeats).
Segments of a minimiser with more than `hot` places are routed window by window, by the hash of the window, so that a
passage that a third of all documents hold is spread, and its equal windows again collapse before the shuffle.

Defined cases: a null text has no words; a very long text is a slice of its own and its windows are all judged; a document is (doc_id, text): equal rows give the same result and do not repeat
each other; rows with the same doc_id and another text are ordered by a checksum; a null doc_id comes first; documents
shorter than a window are kept whole; an empty table gives no rows. Extra columns, whatever their names, are not read.
Words are compared by the lowest `TOKEN` bytes of a 64-bit hash, over `window` words in a row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .common import written

TOKEN = 5
LEAST = -(1 << 63)
_COVER = np.int64(1)


def segments(w: tk.Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(minimiser hash, place of the first window among all words, number of windows) of each segment, in order."""
    width = window - gram + 1
    value = tk.grams(w.hashes, gram)
    ok = tk.inside(w, window)
    if not ok.any():
        none = np.zeros(0, dtype=np.int64)
        return none.astype(np.uint64), none, none
    place = np.arange(len(value))
    least, at, have = value, place, 1
    while have < width:  # the leftmost smallest of `have` hashes in a row
        step = min(have, width - have)
        left, right = least[:-step], least[step:]
        take = left <= right
        least, at = np.where(take, left, right), np.where(take, at[:-step], at[step:])
        have += step
    starts = np.flatnonzero(ok)
    own = at[starts]
    new = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (starts[1:] != starts[:-1] + 1)]))
    return value[own[new]], starts[new], np.diff(np.append(new, len(starts)))


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for each range, one after the other."""
    total = int(lengths.sum())
    first = np.cumsum(lengths) - lengths
    return np.arange(total) - np.repeat(first - starts, lengths)


class Bits:
    """A bit vector with a rank directory: one bit for each flag and four bytes for each 64."""

    def __init__(self, flags: np.ndarray):
        packed = np.packbits(flags, bitorder="little")
        self.words = np.zeros(len(flags) // 64 + 2, dtype=np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.ranks = np.zeros(len(self.words) + 1, dtype=np.int32)
        np.cumsum(np.bitwise_count(self.words), out=self.ranks[1:])
        self.total = int(self.ranks[-1])

    def rank(self, place: np.ndarray) -> np.ndarray:
        """Number of set bits before each place."""
        at = place >> 6
        below = (np.uint64(1) << (place & 63).astype(np.uint64)) - np.uint64(1)
        return self.ranks[at].astype(np.int64) + np.bitwise_count(self.words[at] & below)


class FmIndex:
    """Over `text` (ids from 1, 0 between segments), for patterns of up to `window` ids.

    It keeps the Burrows-Wheeler transform as a wavelet tree of bit vectors, a bit vector that marks where suffixes with the same
    first `window` ids begin, one for `window` - 1 with the beginnings themselves (four bytes for each group), and the smallest of `keys` (one for each place)
    in each group of the first kind. The suffix order is only used to build these.
    """

    def __init__(self, text: np.ndarray, window: int, keys: np.ndarray | None = None):
        self.n, self.window = len(text), window
        ranks = {1: np.unique(text, return_inverse=True)[1]}
        size = 1
        while size * 2 <= window:
            ranks[size * 2] = self._joined(ranks[size], ranks[size], size)
            size *= 2
        full, part = self._ranked(ranks, window), self._ranked(ranks, window - 1)
        del ranks
        sa = np.argsort(full, kind="stable")
        begins = lambda group: np.concatenate([[True], group[sa][1:] != group[sa][:-1]])
        same, wider = begins(full), begins(part)
        self.groups, self.wider = Bits(same), Bits(wider)
        self.wider_starts = np.append(np.flatnonzero(wider), self.n).astype(np.int32)
        self.earliest = None if keys is None else np.minimum.reduceat(keys[sa], np.flatnonzero(same))
        bwt = text[sa - 1]
        self.sigma = int(text.max()) + 1
        counts = np.bincount(text, minlength=self.sigma)
        self.before = np.cumsum(counts) - counts
        self.levels = []
        for bit in range(max(1, (self.sigma - 1).bit_length()) - 1, -1, -1):
            one = ((bwt >> bit) & 1).astype(bool)
            bits = Bits(one)
            self.levels.append((bit, bits, self.n - bits.total))
            bwt = np.concatenate([bwt[~one], bwt[one]])
        symbols = np.arange(self.sigma)
        self.node = self._descend(symbols, np.zeros(self.sigma, dtype=np.int64))

    def _joined(self, a: np.ndarray, b: np.ndarray, shift: int) -> np.ndarray:
        second = np.zeros(len(a), dtype=np.int64)
        second[: len(a) - shift] = b[shift:] + 1 if shift < len(a) else 0
        return np.unique(a * (int(b.max()) + 2) + second, return_inverse=True)[1]

    def _ranked(self, ranks: dict, length: int) -> np.ndarray:
        """Rank of each suffix by its first `length` ids."""
        out, have = None, 0
        for size in sorted(ranks, reverse=True):
            if have + size <= length:
                out = ranks[size] if out is None else self._joined(out, ranks[size], have) if have < self.n else out
                have += size
        return out

    def _descend(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        for bit, bits, zeros in self.levels:
            ones = bits.rank(place)
            place = np.where((symbol >> bit) & 1, zeros + ones, place - ones)
        return place

    def _widened(self, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of the first `window` - 1 ids of the suffixes at lo."""
        group = self.wider.rank(lo + 1)
        return self.wider_starts[group - 1].astype(np.int64), self.wider_starts[group].astype(np.int64)

    def extend(self, lo: np.ndarray, hi: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of symbol + pattern, given those of the patterns."""
        both = self._descend(np.concatenate([symbol, symbol]), np.concatenate([lo, hi]))
        base = self.before[symbol] - self.node[symbol]
        return both[: len(lo)] + base, both[len(lo) :] + base

    def matches(self, text: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
        """Streams segments of `text`, longest first, from their ends; yields (segments, offset of a window, its group of equal windows)."""
        lo, hi = np.zeros(len(starts), dtype=np.int64), np.full(len(starts), self.n, dtype=np.int64)
        for step in range(int(lengths[0]) if len(lengths) else 0):
            active = int(np.searchsorted(-lengths, -step, "left"))  # lengths > step
            lo, hi = lo[:active], hi[:active]
            if step >= self.window:  # all matches are `window` long: give up the last word
                lo, hi = self._widened(lo)
            offset = lengths[:active] - 1 - step
            lo, hi = self.extend(lo, hi, text[starts[:active] + offset])
            if step >= self.window - 1:
                found = hi > lo
                yield np.flatnonzero(found), offset[found], self.groups.rank(lo[found] + 1) - 1


def shard_masks(tokens: list[np.ndarray], key: np.ndarray, windows: np.ndarray, window: int) -> np.ndarray:
    """For distinct segments: a bit for each window that also starts earlier. key orders the segments' first windows."""
    lengths = windows + window - 1
    if not len(lengths):
        return np.zeros(0, dtype=np.int64)
    order = np.argsort(-lengths, kind="stable")
    lengths, windows, key = lengths[order], windows[order], key[order]
    starts = np.cumsum(lengths + 1) - lengths - 1
    text = np.zeros(int((lengths + 1).sum()), dtype=np.int64)
    flat, offsets = tokens
    text[_ranges(starts, lengths)] = np.unique(flat[_ranges(offsets[order], lengths)], return_inverse=True)[1] + 1
    keys = np.full(len(text), np.iinfo(np.int64).max)
    keys[_ranges(starts, windows)] = np.repeat(key, windows) + _ranges(np.zeros(len(windows), dtype=np.int64), windows)
    index = FmIndex(text, window, keys)
    masks = np.zeros(len(lengths), dtype=np.int64)
    for at, offset, group in index.matches(text, starts, lengths):
        masks[at] |= np.where(index.earliest[group] < key[at] + offset, _COVER << offset, 0)
    out = np.empty_like(masks)
    out[order] = masks
    return out


def _runs(rows: np.ndarray, d: np.ndarray, v: np.ndarray, at: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Joins adjacent segments of a document, up to 61 windows: (first segment of each run, windows of the run)."""
    rows = rows[np.lexsort((at[rows], v[rows], d[rows]))]
    if not len(rows):
        return rows, rows
    a, b = rows[:-1], rows[1:]
    new = np.concatenate([[True], (d[a] != d[b]) | (v[a] != v[b]) | (at[a] + windows[a] != at[b])])
    inner = np.cumsum(windows[rows]) - windows[rows]
    part = (inner - np.maximum.accumulate(np.where(new, inner, 0))) // 45
    new[1:] |= part[1:] != part[:-1]
    first = np.flatnonzero(new)
    return rows[first], np.add.reduceat(windows[rows], first)


def _binary(flat: np.ndarray, at: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Binary values with the lowest TOKEN bytes of flat[at], `lengths` words in each."""
    raw = np.ascontiguousarray(flat[at]).view(np.uint8).reshape(-1, 8)[:, :TOKEN]
    offsets = np.concatenate([[0], np.cumsum(lengths * TOKEN)]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(raw))]).cast(pa.binary())


def _unbinary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(uint64 words, offset of each value)."""
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]] if column.buffers()[2] is not None else np.zeros(0, dtype=np.uint8)
    wide = np.zeros((len(raw) // TOKEN, 8), dtype=np.uint8)
    wide[:, :TOKEN] = raw.reshape(-1, TOKEN)
    return wide.view(np.uint64).ravel(), (offsets - offsets[0]) // TOKEN


def _keyed(documents: DataFrame) -> DataFrame:
    return documents.select(F.coalesce(F.col("doc_id"), F.lit(LEAST)).alias("d"), (F.coalesce(F.crc32(F.encode("text", "UTF-8")), F.lit(0)) - F.lit(1 << 31)).cast("int").alias("v"), "text")


def find_segments(docs: DataFrame, window: int, gram: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for lo, hi, data, offsets in tk.slices(batch.column(2)):
                w = tk.words(data, offsets)
                m, start, n = segments(w, window, gram)
                text = np.searchsorted(w.first, start, "right") - 1
                cols = [pa.array(m.view(np.int64)), batch.column(0).take(pa.array(lo + text)), batch.column(1).take(pa.array(lo + text)), pa.array((start - w.first[text]).astype(np.int32)), pa.array(n.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(cols, names=["m", "d", "v", "pos", "n"])

    return docs.mapInArrow(run, "m long, d long, v int, pos int, n int")


ROUTED = "route long, d long, v int, pos int, n int, tokens binary"


def route_segments(docs: DataFrame, window: int) -> DataFrame:
    """docs: d, v, text, found (array of pos, n, m, hot). Gives ROUTED rows; tokens is null where all windows are known repeats."""

    def run(batches):
        for batch in batches:
            found = batch.column(3)
            many = np.asarray(found.value_lengths()).astype(np.int64)
            firsts = np.concatenate([[0], np.cumsum(many)])
            inner = found.flatten()
            pos, n, m, hot = (inner.field(i).to_numpy(zero_copy_only=False) for i in range(4))
            ds, vs = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            for lo, hi, data, offsets in tk.slices(batch.column(2)):
                w = tk.words(data, offsets)
                part = slice(firsts[lo], firsts[hi])
                text = np.repeat(np.arange(hi - lo), many[lo:hi])
                start, windows, route = w.first[text] + pos[part], n[part].astype(np.int64), m[part]
                each = np.where(hot[part], windows, 1)
                split = np.repeat(hot[part], each)
                start = np.repeat(start, each) + np.where(split, _ranges(np.zeros(len(each), dtype=np.int64), each), 0)
                text, windows, route = np.repeat(text, each), np.where(split, 1, np.repeat(windows, each)), np.repeat(route, each)
                whole = tk.grams(w.hashes, window)
                content = tk.mix(whole[start] ^ tk.mix(whole[start + windows - 1] + windows.astype(np.uint64)))
                route = np.where(split, whole[start].view(np.int64), route)
                d, v, at = ds[lo:hi][text], vs[lo:hi][text], start - w.first[text]
                order = np.lexsort((at, v, d, content))
                same = content[order][1:] == content[order][:-1]
                # equal places (equal rows) do not repeat each other: they share the fate of the first
                twin = same & (d[order][1:] == d[order][:-1]) & (v[order][1:] == v[order][:-1]) & (at[order][1:] == at[order][:-1])
                head = order[np.concatenate([[True], ~same])] if len(order) else order
                tail = order[1:][same & ~twin]
                lengths = windows[head] + window - 1
                tail, sums = _runs(tail, d, v, at, windows)
                spread = tk.mix(d[tail].view(np.uint64) ^ at[tail].astype(np.uint64)).view(np.int64)
                cols = [[route[head], spread], [d[head], d[tail]], [v[head], v[tail]], [at[head], at[tail]], [windows[head], sums]]
                kinds = (np.int64, np.int64, np.int32, np.int32, np.int32)
                tokens = _binary(w.hashes, _ranges(start[head], lengths), lengths)
                made = [pa.array(np.concatenate(c).astype(k)) for c, k in zip(cols, kinds)]
                yield pa.RecordBatch.from_arrays([*made, pa.concat_arrays([tokens, pa.nulls(len(tail), pa.binary())])], names=[x.split()[0] for x in ROUTED.split(", ")])

    return docs.select("d", "v", "text", "found").mapInArrow(run, ROUTED)


MASKED = "d long, v int, pos int, mask long"


def search_shards(routed: DataFrame, window: int, shard_rows: int) -> DataFrame:
    """MASKED rows from ROUTED ones, which come grouped by route and ordered by (route, d, v, pos)."""

    def distinct(table):
        """(the first of each content in each route, all others with a flag: same place as the first)."""
        route, d, v, pos = (table.column(i).to_numpy() for i in range(4))
        flat, offsets = _unbinary(table.column("tokens").combine_chunks())
        n = table.column("n").to_numpy().astype(np.int64)
        inner = _ranges(np.zeros(len(n), dtype=np.int64), np.diff(offsets)).astype(np.uint64)
        whole = np.add.reduceat(tk.mix(flat + inner * np.uint64(0x9E3779B97F4A7C15)), offsets[:-1]) if len(n) else np.zeros(0, dtype=np.uint64)
        whole = tk.mix(whole ^ route.view(np.uint64) * np.uint64(31) ^ n.astype(np.uint64))
        order = np.argsort(whole, kind="stable")
        head = np.concatenate([[True], whole[order][1:] != whole[order][:-1]])
        first = order[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
        twin = (d[order] == d[first]) & (v[order] == v[first]) & (pos[order] == pos[first])
        tail = order[~head & ~twin]
        return np.sort(order[head]), tail

    def repeats(table, at):
        d, v, pos, n = (table.column(k).to_numpy()[at] for k in ("d", "v", "pos", "n"))
        return pa.RecordBatch.from_arrays([pa.array(d), pa.array(v), pa.array(pos), pa.array((np.int64(1) << n.astype(np.int64)) - 1)], names=["d", "v", "pos", "mask"])

    def shard(table):
        firsts, tail = distinct(table)
        yield repeats(table, tail)
        own = table.take(pa.array(firsts))
        d, v, pos, n = (own.column(k).to_numpy() for k in ("d", "v", "pos", "n"))
        flat, offsets = _unbinary(own.column("tokens").combine_chunks())
        order = np.lexsort((v, d))
        new = np.concatenate([[0], ((d[order][1:] != d[order][:-1]) | (v[order][1:] != v[order][:-1])).astype(np.int64)]) if len(order) else order
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.cumsum(new)
        masks = shard_masks((flat, offsets), (rank << 32) + pos, n.astype(np.int64), window)
        some = np.flatnonzero(masks)
        yield pa.RecordBatch.from_arrays([pa.array(d[some]), pa.array(v[some]), pa.array(pos[some]), pa.array(masks[some])], names=["d", "v", "pos", "mask"])

    def run(batches):
        pending = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            known = table.column("tokens").is_null().to_numpy()
            if known.any():
                yield repeats(table, np.flatnonzero(known))
                table = table.take(pa.array(np.flatnonzero(~known)))
            pending = table if pending is None else pa.concat_tables([pending, table])
            if len(pending) < shard_rows:
                continue
            route = pending.column("route").to_numpy()
            cut = int(np.searchsorted(route, route[-1]))  # the last route may go on in the next batch
            if cut:
                yield from shard(pending.slice(0, cut))
                pending = pending.slice(cut)
            else:  # one route: keep its distinct segments only
                firsts, tail = distinct(pending)
                yield repeats(pending, tail)
                pending = pending.take(pa.array(firsts))
        if pending is not None and len(pending):
            yield from shard(pending)

    return routed.repartition("route").sortWithinPartitions("route", "d", "v", "pos").mapInArrow(run, MASKED)


KEPT = "doc_id long, n_words long, n_removed long, kept string"


def remove_covered(docs: DataFrame, window: int) -> DataFrame:
    """docs: d, text, gone (array of pos, mask; null for none). Gives KEPT rows."""

    def run(batches):
        for batch in batches:
            gone = batch.column(2)
            many = np.asarray(gone.value_lengths().fill_null(0)).astype(np.int64)
            firsts = np.concatenate([[0], np.cumsum(many)])
            inner = gone.flatten()
            pos, mask = (inner.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(2))
            texts = batch.column(1).fill_null("")
            ids = batch.column(0).to_numpy()
            counts, kept = [], []
            for i in range(len(batch)):
                words = texts[i].as_buffer().to_pybytes().split()
                total = len(words)
                if many[i]:
                    p, m = pos[firsts[i] : firsts[i + 1]], mask[firsts[i] : firsts[i + 1]]
                    cover = np.zeros(total + 1, dtype=np.int64)
                    for j in range(int(m.max()).bit_length()):
                        at = np.unique(p[(m >> j) & 1 == 1] + j)
                        cover[at] += 1
                        cover[at + window] -= 1
                    free = np.cumsum(cover[:-1]) == 0
                    words = [x for x, ok in zip(words, free.tolist()) if ok]
                counts.append((total, total - len(words)))
                kept.append(b" ".join(words).decode())
            n = np.array(counts, dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(ids, mask=ids == LEAST), pa.array(n[:, 0]), pa.array(n[:, 1]), pa.array(kept, pa.string())], names=[x.split()[0] for x in KEPT.split(", ")])

    return docs.select("d", "text", "gone").mapInArrow(run, KEPT)


def dedup_passages(documents: DataFrame, window: int = 20, gram: int = 5, hot: int = 2000, shard_rows: int = 30000) -> DataFrame:
    """KEPT for each document: every word in a window that also starts earlier is removed."""
    docs = _keyed(documents)
    found = find_segments(docs, window, gram)
    # written, so that both sides of the join come from a shuffle alone and the adaptive plan can split a hot minimiser's partition
    shared = written(found.groupBy("m").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("m", (F.col("_n") > hot).alias("hot")), "shared")
    suspects = found.join(shared, "m").groupBy("d", "v").agg(F.collect_list(F.struct("pos", "n", "m", "hot")).alias("found"))
    routed = route_segments(docs.join(suspects, ["d", "v"]), window)
    gone = search_shards(routed, window, shard_rows).groupBy("d", "v").agg(F.collect_list(F.struct("pos", "mask")).alias("gone"))
    return remove_covered(docs.join(gone, ["d", "v"], "left"), window)


def digests(kept: DataFrame) -> DataFrame:
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
