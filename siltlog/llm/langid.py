"""Operator 6: language identification by nearest centroid.

A text becomes the TF-IDF vector of its hashed byte trigrams (letters folded, everything else one blank), normalised. Each
language has several centroids, from spherical k-means over a bounded sample of its labelled texts; the language of the
most similar centroid (cosine) wins. A text whose best cosine is below `reject` is far from all that was learned: it still
carries its nearest language, with `accepted` false. A text without any letter is `und`.

Document frequencies are counted over all training texts, as sums per task before the shuffle. Only the k-means sees a
sample: about `sample` texts, dealt evenly to the languages but `least` for each, chosen by a hash of doc_id and text; of a
language with fewer texts than that all are taken, and the text with the smallest hash always is, so no language is left out. The model
(dimension by centroids) is fixed in size for a given number of languages; more than `most_languages` are refused.

Defined cases: null text or no letter: `und`, score 0; without training rows every text is `und`; a very long text is a
slice of its own and counted whole; equal rows give equal results; a row with a null doc_id is not held out; ties go to the
first language by name; extra columns, whatever their names, are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .common import fold_of

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = 32
_FOLD[97:123] = _FOLD[65:91] = np.arange(97, 123)
BITS = 13
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, cosine double, accepted boolean"


def counts(data: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Trigram counts, a row for each text. Trigrams of blanks do not count."""
    n, size = len(offsets) - 1, 1 << bits
    if len(data) < 3:
        return np.zeros((n, size), dtype=np.float32)
    b = _FOLD[data].astype(np.uint32)
    code = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
    text_of = np.repeat(np.arange(n), np.diff(offsets))
    ok = (text_of[:-2] == text_of[2:]) & ~((b[:-2] == 32) & (b[1:-1] == 32)) & ~((b[1:-1] == 32) & (b[2:] == 32))
    hashed = (code[ok] * np.uint32(2654435761)) >> np.uint32(32 - bits)
    return np.bincount(text_of[:-2][ok] * size + hashed, minlength=n * size).reshape(n, size).astype(np.float32)


def vectors(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(tf, out=tf) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    plain = (data >= 65) & (data <= 90) | (data >= 97) & (data <= 122)
    some = tk.per_text(plain, offsets) > 0
    for i in np.flatnonzero(~some & (np.diff(offsets) > 0)):
        some[i] = any(c.isalpha() for c in data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace"))
    return some


def cluster(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; begins with rows far from each other."""
    centres = [x.mean(axis=0)]
    while len(centres) < min(k, len(x)):
        near = np.max(x @ np.stack(centres).T, axis=1)
        centres.append(x[int(np.argmin(near))])
    c = np.stack(centres)
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        c = np.stack([x[own == i].mean(axis=0) if (own == i).any() else c[i] for i in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    return c


def fit(training: DataFrame, sample: int = 4000, per_language: int = 4, bits: int = BITS, least: int = 64, most_languages: int = 2000):
    """training: doc_id, text, lang (not null). Returns (languages, centroid's language, idf, centroids), or None without rows."""
    grain = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30))
    sizes = training.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min(grain).alias("first")).limit(most_languages + 1).collect()
    if len(sizes) > most_languages:
        raise ValueError(f"more than {most_languages} languages: the model has centroids for each")
    firsts, sizes = {r["lang"]: r["first"] for r in sizes}, {r["lang"]: r["n"] for r in sizes}
    if not sizes:
        return None
    languages = sorted(sizes)

    def frequencies(batches):
        total = np.zeros(1 << bits, dtype=np.int64)
        for batch in batches:
            for _, _, data, offsets in tk.slices(batch.column(0), rows=256):
                total += (counts(data, offsets, bits) > 0).sum(axis=0)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["gram", "n"])

    found = training.select("text").mapInArrow(frequencies, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(1 << bits)
    for r in found:
        df[r["gram"]] = r["n"]
    idf = np.log((1 + sum(sizes.values())) / (1 + df)).astype(np.float32) + 1

    share = max(least, sample // len(languages))
    limits = [(x, max(firsts[x], int(min(1.0, share / sizes[x]) * (1 << 30)) - 1)) for x in languages]
    limits = F.broadcast(training.sparkSession.createDataFrame(limits, "lang string, _limit long"))

    def sparse(batches):
        for batch in batches:
            for lo, hi, data, offsets in tk.slices(batch.column(0), rows=256):
                tf = counts(data, offsets, bits)
                at = [np.flatnonzero(x) for x in tf]
                cols = [batch.column(1).slice(lo, hi - lo), pa.array([a.astype(np.int32) for a in at], pa.list_(pa.int32())), pa.array([x[a] for x, a in zip(tf, at)], pa.list_(pa.float32()))]
                yield pa.RecordBatch.from_arrays(cols, names=["lang", "at", "tf"])

    # of rows with one id and text, one: copies without an id could otherwise fill the sample
    own = training.withColumn("_grain", grain).join(limits, "lang").where("_grain <= _limit").dropDuplicates(["lang", "_grain"])
    taken = own.select("text", "lang").mapInArrow(sparse, "lang string, at array<int>, tf array<float>").toArrow()
    of, langs, centres = taken.column("lang").to_pylist(), [], []
    for x in languages:
        rows = [i for i, y in enumerate(of) if y == x]
        tf = np.zeros((len(rows), 1 << bits), dtype=np.float32)
        for j, i in enumerate(rows):
            tf[j, taken.column("at")[i].values.to_numpy()] = taken.column("tf")[i].values.to_numpy()
        if rows:
            c = cluster(vectors(tf, idf), per_language)
            langs += [x] * len(c)
            centres.append(c)
    return (languages, langs, idf, np.concatenate(centres).astype(np.float32)) if centres else None


def predict(documents: DataFrame, model, held_out, reject: float = 0.05, sharpness: float = 20.0) -> DataFrame:
    """The columns of SCHEMA for each document; held_out: a boolean column over the documents."""
    languages, langs, idf, centres = model or ([], [], np.zeros(1 << BITS, dtype=np.float32), np.zeros((0, 1 << BITS), dtype=np.float32))
    bits = len(idf).bit_length() - 1
    member = np.array([[x == y for x in langs] for y in languages], dtype=bool).reshape(len(languages), len(langs))

    def run(batches):
        for batch in batches:
            for lo, hi, data, offsets in tk.slices(batch.column(2), rows=256):
                letters = has_letter(data, offsets)
                n = hi - lo
                if languages:
                    near = vectors(counts(data, offsets, bits), idf) @ centres.T
                    best = np.stack([near[:, m].max(axis=1) if m.any() else np.full(n, -1.0) for m in member], axis=1).astype(np.float64)
                    top = best.argmax(axis=1)
                    cosine = best.max(axis=1)
                    score = 1 / np.exp(sharpness * (best - cosine[:, None])).sum(axis=1)
                    named = [languages[t] if ok else "und" for t, ok in zip(top, letters)]
                else:
                    cosine, score, named = np.zeros(n), np.zeros(n), ["und"] * n
                known = np.array([x != "und" for x in named])
                cols = [batch.column(0).slice(lo, n), batch.column(1).slice(lo, n), pa.array(named), pa.array(np.where(known, score, 0.0)), pa.array(np.where(known, cosine, 0.0)), pa.array(known & (cosine >= reject))]
                yield pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in SCHEMA.split(", ")])

    return documents.select("doc_id", held_out.alias("held_out"), "text").mapInArrow(run, SCHEMA)


def identify(documents: DataFrame, **options) -> DataFrame:
    """Learns from the rows with a language whose crc32(doc_id) mod 4 is not 2, and predicts for all."""
    docs = documents.select("doc_id", "text", "lang")
    held = F.coalesce(fold_of("doc_id", 4) == 2, F.lit(False))
    training = docs.where(~held & F.col("lang").isNotNull()).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang")
    return predict(docs, fit(training, **options), held)
