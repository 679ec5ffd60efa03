import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa

from siltlog.llm import decontaminate as dc

from helpers import clashing, documents


def brute_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def test_lcs_against_brute_force():
    rng = random.Random(0)
    for _ in range(300):
        a, b = ([bytes([rng.choice(b"abcd")]) for _ in range(rng.randint(1, 30))] for _ in range(2))
        assert dc.lcs(dc._masks(a), len(a), b) == brute_lcs(a, b)


def test_every_verbatim_passage_is_found(spark, sf):
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    want = {(d.doc_id, i.item_id) for d in docs.collect() for i in items.collect() if i.text in d.text}
    got = dc.find_leaks(docs, items).collect()
    pairs = {(r.doc_id, r.item_id) for r in got}
    texts, asked = {r.doc_id: r.text for r in docs.collect()}, {r.item_id: r.text for r in items.collect()}
    assert want and want <= pairs and len(got) == len(pairs)
    for d, i in pairs:
        item = dc.normal_words(asked[i].encode())
        assert brute_lcs(item, dc.normal_words(texts[d].encode())) >= 0.7 * len(item)


def made(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 9))) for _ in range(3000)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    items = [(i, " ".join(text(rng.randint(15, 60)))) for i in range(30)]
    rows, want = [], set()
    for d in range(120):
        body = text(rng.randint(0, 300))
        if d % 3 == 0:
            i = d % 30
            passage = items[i][1].split()
            if d % 2:
                passage = [w.upper() + "," for j, w in enumerate(passage) if j % 9 != 4]
            body[rng.randint(0, len(body)) : 0] = passage
            want.add((d, i))
        rows.append((d, " ".join(body)))
    return documents(spark, rows), spark.createDataFrame(items, "item_id long, text string"), want


def test_reworded_passages_and_clean_documents(spark):
    docs, items, want = made(spark)
    assert {(r.doc_id, r.item_id) for r in dc.find_leaks(docs, items).collect()} == want
    assert {(r.doc_id, r.item_id) for r in dc.find_leaks(docs, items, items=10).collect()} == want


def test_odd_cases(spark):
    passage = " ".join(f"word{i}" for i in range(25))
    docs = clashing(documents(spark, [(1, None), (2, ""), (3, passage), (3, passage), (4, "x " * 60000 + passage), (None, passage), (5, "é")]))
    items = spark.createDataFrame([(1, None), (2, ""), (3, passage), (3, passage), (None, passage)], "item_id long, text string")
    got = sorted((r.doc_id or -1, r.item_id or -1) for r in dc.find_leaks(docs, clashing(items)).collect())
    assert got == [(-1, -1), (-1, 3), (3, -1), (3, 3), (4, -1), (4, 3)]
    assert dc.find_leaks(docs.limit(0), items).count() == 0 and dc.find_leaks(docs, items.limit(0)).count() == 0


def test_passages_cover_all_words():
    from siltlog.llm import textkernel as tk

    raw = ("a " * 95).encode()
    w = tk.words(np.frombuffer(raw, dtype=np.uint8), np.array([0, 0, 100, 190]))
    text, first, end = dc.passages(w, 20)
    assert {i for t, a, b in zip(text, first, end) for i in range(a, b)} == set(range(95)) and (end - first <= 40).all()


def brute_pairs(rows, items, block=20, cover=0.7, answer=0.5):
    """All regions of all documents, without any filter."""
    out = set()
    for d, text in rows:
        words = dc.normal_words(text.encode())
        for i, asked in items:
            item = dc.normal_words(asked.encode())
            tail, n = item[-max(1, len(item) // 4) :], len(item)
            for k in range(max(-(-len(words) // block) - 1, 1)):
                region = words[max(0, k * block - n) : min(len(words), (k + 2) * block) + n]
                if brute_lcs(item, region) >= cover * n and brute_lcs(tail, region) >= answer * len(tail):
                    out.add((d, i))
                    break
    return out


def test_passages_of_many_documents_are_found(spark):
    """An item in a third of the documents, also reworded, whose words are commoner than the text around it."""
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 9))) for _ in range(4000)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    items = [(i, " ".join(text(n))) for i, n in enumerate((15, 17, 19, 24))]
    rows = []
    for d in range(240):
        body = text(rng.randint(20, 120))
        for i, asked in items:
            if d % 3 == i % 3:
                passage = asked.split()
                if d % 2:
                    passage = [f"({w.title()})" for j, w in enumerate(passage) if j % 8 != 5]
                at = rng.randint(0, len(body))
                body[at:at] = passage
        rows.append((d, " ".join(body)))
    want = brute_pairs(rows, items)
    assert {(d, i) for d in range(240) for i, _ in items if d % 3 == i % 3} <= want
    docs, asked = documents(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in dc.find_leaks(docs, asked).collect()} == want


def test_long_items_are_found(spark):
    """More long items in a block than the basis has directions for all their passages."""
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 9))) for _ in range(3000)]
    items = [(i, " ".join(rng.choice(words) for _ in range(600))) for i in range(120)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(50)) + " " + t + " end") for i, t in items]
    got = dc.find_leaks(documents(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(i, i) for i, _ in items}


def test_basis_against_the_exact_decomposition(spark):
    """The directions hold nearly as much of the passages as those of an exact SVD, of a matrix whose singular values hardly fall, which is the hardest case."""
    rng = np.random.default_rng(2)
    rows = [(1.0, sorted(rng.choice(60, 12).tolist())) if i % 2 else (1.0, sorted((60 + rng.choice(400, 12)).tolist())) for i in range(400)]
    idf = rng.uniform(1, 2, 1 << dc.BITS).astype(np.float32)
    basis = dc.fit_basis(spark.createDataFrame(rows, "weight double, at array<int>").repartition(5), idf, 20)
    a = np.zeros((400, 1 << dc.BITS), dtype=np.float32)
    for i, (_, at) in enumerate(rows):
        words, n = np.unique(at, return_counts=True)
        a[i, words] = (1 + np.log(n)) * idf[words]
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    assert np.allclose(basis.T @ basis, np.eye(20), atol=1e-3)
    exact = np.linalg.svd(a, compute_uv=False)[:20]
    assert (np.linalg.norm(a @ basis) ** 2) >= 0.9 * (exact**2).sum()


def test_sample_is_bounded_whatever_the_ids(spark):
    rng = random.Random(6)
    rows = [(None, " ".join(str(rng.randrange(10**6)) for _ in range(300))) for _ in range(400)] + [(None, "again " * 3000)] * 50
    docs = documents(spark, rows)
    asked = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    df, n, m = dc.document_frequencies(docs.select("doc_id", "text"), 20)
    assert (n, m) == (450, 400 * 14 + 50 * 149) and len(df) == 1 << dc.BITS
    kept = dc.fitted_rows(docs, n, m, asked, 20, 100)
    assert 30 < kept.where("weight = 1").count() <= 100 and kept.where("weight = 4").count() == 1
    assert max(len(r.at) for r in kept.collect()) <= 40


def test_rows_without_id_keep_their_pairs(spark):
    rng = random.Random(8)
    words = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    leak = words(20)
    docs = documents(spark, [(None, f"{words(30)} {leak}"), (None, words(60)), (3, f"{leak} {words(9)}"), (3, words(40))])
    got = dc.find_leaks(docs, spark.createDataFrame([(None, leak), (5, words(20))], "item_id long, text string")).collect()
    assert sorted(((r.doc_id, r.item_id) for r in got), key=str) == [(3, None), (None, None)]


def test_cosines_of_regions(spark):
    rng = np.random.default_rng(4)
    at = rng.integers(0, 50, 300)
    projected = rng.normal(size=(1 << dc.BITS, 7)).astype(np.float32)
    vectors = rng.normal(size=(3, 7)).astype(np.float32)
    start = rng.integers(0, 250, 90)
    end = start + rng.integers(1, 50, 90)
    item = rng.integers(0, 3, 90)
    got = dc.cosines(at, start, end, item, projected, vectors, most=64)
    for i in range(90):
        words, n = np.unique(at[start[i] : end[i]], return_counts=True)
        v = ((1 + np.log(n))[:, None] * projected[words]).sum(axis=0)
        assert abs(got[i] - v @ vectors[item[i]] / np.linalg.norm(v)) < 1e-4


def test_basis_is_fitted_on_every_passage(spark, monkeypatch):
    """More passages than were once drawn: each is a row of the decomposed matrix, and all of them weigh as much as MASS."""
    rng = random.Random(9)
    texts = [" ".join(f"w{min(rng.randrange(400), rng.randrange(400))}" for _ in range(rng.randint(150, 250))) for _ in range(300)] + ["again " * 60] * 20
    docs = documents(spark, [(i % 7 or None, t) for i, t in enumerate(texts)]).repartition(6)
    made, fit = [], dc.fit_basis
    monkeypatch.setattr(dc, "fit_basis", lambda *a, **more: made.append((a, more, fit(*a, **more))) or made[-1][2])
    assert dc.find_leaks(docs, spark.createDataFrame([(1, " ".join(texts[0].split()[:40]))], "item_id long, text string"), rank=20).count() >= 1
    (rows, idf, rank), more, basis = made[0]
    passages = [r.at for r in dc.passage_rows(docs.select("text"), 20).collect()]
    assert len(passages) > 2000 and Counter(map(tuple, passages)) == Counter(tuple(r.at) for r in dc.passage_rows(more["corpus"], 20).collect())
    assert abs(more["weight"] ** 2 * len(passages) - dc.MASS) < 1 and [r.weight for r in rows.collect()] == [4.0]
    a = np.zeros((len(passages) + 1, 1 << dc.BITS), dtype=np.float32)
    for i, (at, weight) in enumerate([*((p, more["weight"]) for p in passages), *((r.at, r.weight) for r in rows.collect())]):
        words, n = np.unique(at, return_counts=True)
        a[i, words] = (1 + np.log(n)) * idf[words]
        a[i] *= weight / np.linalg.norm(a[i])
    exact = np.linalg.svd(a[:, a.any(axis=0)], compute_uv=False)[:rank]
    assert np.allclose(basis.T @ basis, np.eye(rank), atol=1e-3) and np.linalg.norm(a @ basis) ** 2 >= 0.9 * (exact**2).sum()


def texts_of(n, words):
    rng = random.Random(10)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 9))) for _ in range(5000)]
    return pa.RecordBatch.from_arrays([pa.array([" ".join(vocabulary[min(rng.randrange(5000), rng.randrange(5000))] for _ in range(words)) for _ in range(n)])], names=["text"])


def test_product_of_rows_against_the_whole_matrix():
    """Rows that are multiplied together, the last of them fewer, equal the plain product; so do rows of one word."""
    rng = np.random.default_rng(3)
    idf, basis = rng.uniform(1, 2, 1 << dc.BITS).astype(np.float32), rng.normal(size=(1 << dc.BITS, 9)).astype(np.float32)
    for n in (1, dc.TOGETHER, 5 * dc.TOGETHER + 3):
        lengths = rng.integers(1, 40, n)
        at, weight = rng.integers(0, 1 << dc.BITS, lengths.sum()) // rng.integers(1, 4000, lengths.sum()), rng.uniform(0.1, 4, n)
        a = np.zeros((n, 1 << dc.BITS))
        for i, part in enumerate(np.split(at, np.cumsum(lengths)[:-1])):
            words, many = np.unique(part, return_counts=True)
            a[i, words] = (1 + np.log(many)) * idf[words]
            a[i] *= weight[i] / np.linalg.norm(a[i])
        total = np.ones((1 << dc.BITS, 9), dtype=np.float32)
        dc._Rows(at, lengths, weight, idf).add_product(total, basis)
        assert np.allclose(total - 1, a.T @ (a @ basis), atol=1e-4)


def test_a_task_holds_little():
    """Counting and multiplying a batch of texts takes little memory besides the batch and the sums."""
    batch, size = texts_of(2000, 400), 1 << dc.BITS
    idf, basis = np.ones(size, dtype=np.float32), np.ones((size, 216), dtype=np.float32)
    total = np.zeros((size, 216), dtype=np.float32)

    class Docs:
        def select(self, _):
            return self

        def mapInArrow(self, run, _):  # noqa: N802
            self.counted = sum(len(x) for x in run(iter([batch])))
            return self

        def groupBy(self, _):  # noqa: N802
            raise InterruptedError

    assert batch.nbytes > 5_000_000
    tracemalloc.start()
    docs = Docs()
    try:
        dc.document_frequencies(docs, 20)
    except InterruptedError:
        assert docs.counted > 1000
    counted = tracemalloc.get_traced_memory()[1]
    tracemalloc.reset_peak()
    for w, _, at, lengths in dc.passage_lists([batch], 20):
        dc._Rows(dc._bucket(w.hashes)[at], lengths, 1.0, idf).add_product(total, basis)
    multiplied = tracemalloc.get_traced_memory()[1]
    tracemalloc.reset_peak()
    assert dc.directions(np.linalg.qr(basis + np.eye(size, 216, dtype=np.float32))[0], total, 192).shape == (size, 192)
    turned = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert counted < 20e6 and multiplied < 30e6 and turned < 110e6
