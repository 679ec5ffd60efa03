"""Operator 4: quality classifier, kernel ridge regression by random Fourier features with isotonic calibration.

Statistics of a whole text (lengths, symbols, case, repetition, line shape, compression; see FEATURES) are standardised
and mapped to `width` random cosine features, whose inner products approximate a Gaussian kernel, and a constant. Ridge scores come from
the normal equations: each task adds up its own matrices, Spark sums them, and a fixed-size system is solved. The scores
are calibrated by isotonic regression over a fixed grid of score cells, on labelled rows that the ridge did not see.

All labelled rows of the training folds are used, without a sample. What reaches the driver has a fixed size.
Labels, lang, source and doc_id are never inputs of a score.

Defined cases: null and empty texts have zero statistics and get a score like any other; a very long text is a slice of
its own and is measured whole; without usable labels every score is 0.5; several labels of one document are averaged, and
rows that share an id have its label; a row with a null doc_id has no label and is not held out; equal rows give equal
results; empty tables give no rows; extra columns, whatever their names, are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .common import fold_of, written

CLASSES = {"symbol": b"#*$%&|<>", "mark": b"!?~^_=@{}[]\\/", "point": b".,;:", "digit": b"0123456789", "upper": bytes(range(65, 91)), "lower": bytes(range(97, 123)), "blank": b" \t", "newline": b"\n"}
FEATURES = ("chars", "words", "mean_word", "long_word", "short_words", "distinct_words", "top_word", "repeat_words", "title_words", "plain_ends", "lines", "dup_lines", "mean_line", "ended_lines", "other_bytes", "packed", *CLASSES)
_CLASS = {k: np.isin(np.arange(256), list(v)) for k, v in CLASSES.items()}


def statistics(data: np.ndarray, offsets: np.ndarray, packer) -> np.ndarray:
    """A row of FEATURES for each text."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    some = np.maximum(size, 1)
    w = tk.words(data, offsets)
    n_words = np.diff(w.first)
    many = np.maximum(n_words, 1)
    texts, lengths = w.text_of, w.ends - w.starts
    sums = lambda v: np.bincount(texts, weights=v, minlength=n)
    later, _ = tk.again(w.hashes, texts) if len(texts) else (np.zeros(0, dtype=bool), None)
    longest, top = np.zeros(n), np.zeros(n)
    np.maximum.at(longest, texts, lengths)
    if len(texts):
        keys, of = np.unique(tk.mix(w.hashes ^ (texts.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))), return_inverse=True)
        own = np.bincount(of, minlength=len(keys))[of]
        np.maximum.at(top, texts, own)
    first, last = data[w.starts] if len(texts) else data, data[w.ends - 1] if len(texts) else data
    line_of, line_hash, line_size, line_end = tk.lines(data, offsets)
    n_lines = np.bincount(line_of, minlength=n)
    lines = np.maximum(n_lines, 1)
    dup, _ = tk.again(line_hash, line_of) if len(line_of) else (np.zeros(0, dtype=bool), None)
    raw = data.tobytes()
    packed = np.array([len(packer.compress(raw[a:b])) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())])
    cols = [
        np.log1p(size), np.log1p(n_words), sums(lengths) / many, np.log1p(longest), sums(lengths <= 3) / many, 1 - sums(later) / many, top / many,
        tk.repeated_words(w, 5) / many, sums(_CLASS["upper"][first] if len(texts) else []) / many, sums(_CLASS["lower"][last] if len(texts) else []) / many,
        np.log1p(n_lines), np.bincount(line_of[dup], minlength=n) / lines, np.log1p(np.bincount(line_of, weights=line_size, minlength=n) / lines),
        np.bincount(line_of, weights=np.isin(line_end, list(b".!?")), minlength=n) / lines, tk.per_text(data >= 128, offsets) / some, packed / (some + 40),
        *(tk.per_text(c[data], offsets) / some for c in _CLASS.values()),
    ]
    return np.stack(cols, axis=1)


def with_statistics(documents: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns of `more` (long), x."""
    names = ["doc_id", *more]

    def run(batches):
        packer = zstandard.ZstdCompressor(level=1, write_content_size=False)
        for batch in batches:
            for lo, hi, data, offsets in tk.slices(batch.column(len(names))):
                x = statistics(data, offsets, packer)
                flat = pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), x.ravel())
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(lo, hi - lo) for i in range(len(names))), flat], names=[*names, "x"])

    return documents.select(*names, "text").mapInArrow(run, ", ".join([*(f"{c} long" for c in names), "x array<double>"]))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def isotonic(y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Pool adjacent violators."""
    blocks: list[list[float]] = []
    for i, (a, b) in enumerate(zip(y.tolist(), weight.tolist())):
        blocks.append([a, b, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            a2, b2, n2 = blocks.pop()
            a1, b1, n1 = blocks[-1]
            blocks[-1] = [(a1 * b1 + a2 * b2) / (b1 + b2), b1 + b2, n1 + n2]
    return np.concatenate([np.full(n, a) for a, _, n in blocks]) if blocks else y


class Model:
    def __init__(self, mean, scale, width: int, gamma: float, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.w = rng.normal(0, np.sqrt(2 * gamma), (len(mean), width))
        self.b = rng.uniform(0, 2 * np.pi, width)
        self.beta = self.grid = self.level = None

    def map(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.concatenate([np.cos(z @ self.w + self.b) * np.sqrt(2 / len(self.b)), np.ones((len(z), 1))], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.map(x) @ self.beta

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.grid, self.level), 0, 1)


def fit(labelled: DataFrame, width: int = 256, gamma: float = 0.02, ridge: float = 1.0, cells: int = 400) -> Model | None:
    """labelled: x, y (0 to 1), part (0: ridge, 1: calibration). None if one of the parts is empty."""

    def moments(batches):
        n, s, q = 0, 0.0, 0.0
        for batch in batches:
            x = _matrix(batch.column(0))
            n, s, q = n + len(x), s + x.sum(axis=0), q + (x * x).sum(axis=0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(s))), pa.array(np.full(len(s), float(n))), pa.array(s), pa.array(q)], names=["i", "n", "s", "q"])

    sums = labelled.where("part = 0").select("x").mapInArrow(moments, "i long, n double, s double, q double").groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")).orderBy("i").collect()
    if not sums:
        return None
    n, s, q = (np.array([r[k] for r in sums]) for k in "nsq")
    mean = s / n
    model = Model(mean, np.sqrt(np.maximum(q / n - mean**2, 1e-12)) + 1e-6, width, gamma)
    size = width + 1
    upper = np.triu_indices(size + 1)

    def equations(batches):
        total = np.zeros((size + 1, size + 1))
        for batch in batches:
            z = np.concatenate([model.map(_matrix(batch.column(0))), batch.column(1).to_numpy(zero_copy_only=False)[:, None]], axis=1)
            total += z.T @ z
        yield pa.RecordBatch.from_arrays([pa.array(upper[0]), pa.array(upper[1]), pa.array(total[upper])], names=["i", "j", "v"])

    found = labelled.where("part = 0").select("x", "y").mapInArrow(equations, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
    total = np.zeros((size + 1, size + 1))
    i, j, v = (found.column(k).to_numpy() for k in "ijv")
    total[i, j] = total[j, i] = v
    model.beta = np.linalg.solve(total[:size, :size] + ridge * np.eye(size), total[:size, size])

    def placed(batches):
        for batch in batches:
            cell = np.clip((model.raw(_matrix(batch.column(0))) + 0.5) / 2 * cells, 0, cells - 1).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(cell), batch.column(1)], names=["cell", "y"])

    held = labelled.where("part = 1").select("x", "y").mapInArrow(placed, "cell long, y double").groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("y")).orderBy("cell").collect()
    if not held:
        return None
    model.grid = np.array([(r["cell"] + 0.5) / cells * 2 - 0.5 for r in held])
    model.level = isotonic(np.array([r["y"] for r in held]), np.array([float(r["n"]) for r in held]))
    return model


def classify(documents: DataFrame, labels: DataFrame, threshold: float = 0.3, more: tuple[str, ...] = (), **options) -> DataFrame:
    """doc_id, the columns of `more` (long), held_out, score, predicted. Learns from labels.quality outside the fold 0 of 5; fold 4 calibrates."""
    told = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.avg("quality").alias("y"))
    told = told.withColumn("_fold", fold_of("doc_id", 5)).where("_fold <> 0").select("doc_id", "y", (F.col("_fold") == 4).cast("int").alias("part"))
    x = written(with_statistics(documents, more), "statistics")
    model = fit(x.join(told, "doc_id").select("x", "y", "part"), **options)

    def run(batches):
        for batch in batches:
            score = model.score(_matrix(batch.column(1 + len(more)))) if model else np.full(len(batch), 0.5)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(1 + len(more))), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", *more, "score", "predicted"])

    out = x.mapInArrow(run, ", ".join(["doc_id long", *(f"{c} long" for c in more), "score double, predicted int"]))
    return out.select("doc_id", *more, F.coalesce(fold_of("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")
