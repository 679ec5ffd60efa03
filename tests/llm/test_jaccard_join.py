import random
import re
import tracemalloc
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from siltlog.llm import jaccard_join
from siltlog.llm.components import components

from helpers import clashing, documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text, k=3):
    fold = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(fold)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, percent=90, k=3):
    """rows: (doc_id, text), ids distinct. All pairs that share a shingle, without any filter."""
    sets = {d: shingle_set(t, k) for d, t in rows}
    parent = {d: d for d in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = {}
    for d in sorted(sets):
        near = {e for s in sets[d] for e in holders.get(s, ())}
        for e in near:
            i = len(sets[d] & sets[e])
            if 100 * i >= percent * (len(sets[d]) + len(sets[e]) - i):
                a, b = sorted((top(d), top(e)))
                parent[b] = a
        for s in sets[d]:
            holders.setdefault(s, []).append(d)
    return sorted((d, len(s), top(d)) for d, s in sets.items())


def result(df, **options):
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.similar(df, **options).collect())


@pytest.mark.parametrize("seed,vocabulary,rounds,heavy", [(1, 5000, 1, 64), (2, 60, 1, 2), (3, 500, 2, 1)])
def test_against_brute_force(spark, seed, vocabulary, rounds, heavy):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)]
    rows = []
    for _ in range(8):
        base = [rng.choice(words) for _ in range(rng.randint(1, 150))]
        for _ in range(12):
            edit = list(base)
            for _ in range(rng.randint(0, 4)):
                edit[rng.randrange(len(edit))] = rng.choice(words)
            if rng.random() < 0.3:
                edit += [rng.choice(words) for _ in range(rng.randint(0, 8))]
            rows.append(" ".join(edit).upper() if rng.random() < 0.2 else " ".join(edit))
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    want = brute(rows)
    assert result(documents(spark, rows), rounds=rounds, heavy=heavy) == want
    assert 8 <= len({r[2] for r in want}) < 96


def test_one_crowd_of_near_copies(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    base, rows = [rng.choice(words) for _ in range(150)], []
    for _ in range(300):
        edit = list(rng.choice(rows)) if rows and rng.random() < 0.3 else list(base)
        for _ in range(rng.randint(2, 5)):
            edit[rng.randrange(len(edit))] = rng.choice(words)
        rows.append(edit)
    rows = [(i, " ".join(r)) for i, r in enumerate(rows)]
    want = brute(rows)
    assert 20 < len({r[2] for r in want}) < 280
    assert result(documents(spark, rows)) == want


def test_on_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert result(docs) == want and any(r[0] != r[2] for r in want)


def test_odd_cases(spark):
    long = "word " * 40000 + " ".join(map(str, range(20000)))
    rows = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (4, "A  B"), (5, "a"), (6, long), (7, long + " x"), (8, "\n\t"), (3, "other text of three"), (9, "é x y z")]
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.similar(clashing(documents(spark, rows))).collect())
    n = len(shingle_set(long))
    assert got == Counter([(1, 0, 1), (2, 0, 2), (3, 1, 3), (3, 1, 3), (4, 1, 3), (5, 1, 5), (6, n, 6), (7, n + 1, 6), (8, 0, 8), (3, 2, 3), (9, 2, 9)])
    assert jaccard_join.similar(documents(spark, rows).limit(0)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, j) for j in range(101, 150)] + [(7, 7), (300, 200)]
    random.Random(1).shuffle(edges)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{j: 100 for j in range(100, 150)}, 200: 200, 300: 200}


@pytest.mark.parametrize("k,percent,heavy", [(5, 80, 64), (5, 80, 3), (4, 100, 64), (2, 60, 2)])
def test_other_shingles_and_thresholds(spark, k, percent, heavy):
    """Edited copies of a few texts, which make groups of many sets with one prefix and size."""
    rng = random.Random(k * percent + heavy)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for _ in range(5):
        base = [rng.choice(words) for _ in range(rng.randint(20, 120))]
        for _ in range(16):
            edit = list(base)
            for _ in range(rng.randint(0, 3)):
                edit[rng.randrange(len(edit))] = rng.choice(words)
            rows.append(" ".join(edit))
    rows = list(enumerate(rows))
    assert result(documents(spark, rows), k=k, percent=percent, heavy=heavy) == brute(rows, percent, k)


def test_rows_without_id(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(None, text), (None, text + " x"), (5, text), (7, "a b c d"), (None, None), (None, "q r s"), (8, "a b c d")]
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.similar(documents(spark, rows)).collect())
    assert got == Counter([(None, 58, None), (None, 59, None), (5, 58, None), (7, 2, 7), (None, 0, None), (None, 1, None), (8, 2, 7)])


def test_shuffles_go_between_the_first_tables(spark, monkeypatch):
    """What one of the large first steps has shuffled is not on disk any more when the next one shuffles."""
    done = []
    write, free = jaccard_join.written, jaccard_join.release
    monkeypatch.setattr(jaccard_join, "written", lambda df, name: done.append(name) or write(df, name))
    monkeypatch.setattr(jaccard_join, "release", lambda s: done.append("release") or free(s))
    near = " ".join(f"w{i}" for i in range(40))
    got = jaccard_join.similar(documents(spark, [(1, near), (2, near + " x"), (3, "a b c d"), (4, None)]))
    assert [(r.doc_id, r.component_id) for r in got.orderBy("doc_id").collect()] == [(1, 1), (2, 1), (3, 3), (4, 4)]
    assert done[: done.index("members")] == ["signed", "release", "common", "release", "postings", "release", "central"]


def test_a_task_holds_little():
    """Signing a batch of texts and making its sets takes little memory besides the batch; pieces do not change the sets."""
    rng = random.Random(5)
    vocabulary = [f"w{rng.randrange(10**6)}" for _ in range(4000)]
    texts = pa.array([" ".join(rng.choice(vocabulary) for _ in range(400)) for _ in range(2000)])
    sketch = SimpleNamespace(value=(np.zeros(1 << jaccard_join.SKETCH_BITS, dtype=np.int64),) * 2)

    class Docs:
        def __init__(self, batch):
            self.batch, self.rows, self.peak = batch, [], 0

        def select(self, *_):
            return self

        def mapInArrow(self, run, _):  # noqa: N802
            tracemalloc.start()
            for out in run(iter([self.batch])):
                self.rows += out.column("cid").to_pylist()
            self.peak = tracemalloc.get_traced_memory()[1]
            tracemalloc.stop()
            return self

    assert texts.nbytes > 5_000_000
    named = Docs(pa.RecordBatch.from_arrays([pa.array(range(2000)), texts], names=["d", "text"]))
    plain = Docs(pa.RecordBatch.from_arrays([texts], names=["text"]))
    jaccard_join.signed(named, sketch, 3, 90)
    jaccard_join.sets_of(plain, 3)
    assert named.rows == plain.rows and len(set(named.rows)) == 2000
    assert max(named.peak, plain.peak) < 50e6, (named.peak, plain.peak)
