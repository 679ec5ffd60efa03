import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from siltlog.llm import substring_dedup as sd

from helpers import clashing, documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window=20, sort=True):
    """rows: (doc_id, text); gives doc_id, number of words, removed words, digest of the kept words."""
    seen, out = set(), []
    for doc_id, text in sorted(rows, key=lambda r: r[0]) if sort else rows:
        words = WORD.findall(text or "")
        gone = set()
        for i in range(len(words) - window + 1):
            part = tuple(words[i : i + window])
            if part in seen:
                gone.update(range(i, i + window))
            seen.add(part)
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((doc_id, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def result(df, **options):
    return sorted(tuple(r) for r in sd.digests(sd.dedup_passages(df, **options)).collect())


def made(seed, docs, vocabulary):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)]
    passages = [[rng.choice(words) for _ in range(rng.randint(15, 70))] for _ in range(6)]
    rows = []
    for i in range(docs):
        text = []
        for _ in range(rng.randint(0, 4)):
            text += [rng.choice(words) for _ in range(rng.randint(0, 40))] + rng.choice(passages)[rng.randint(0, 10) :]
        rows.append((i, " ".join(text)))
    return rows + [(docs + j, rows[j][1]) for j in range(5)]


@pytest.mark.parametrize("seed,vocabulary,hot,shard_rows", [(1, 3, 2000, 30000), (2, 2000, 2000, 40), (3, 40, 2, 30000), (4, 500, 1, 10)])
def test_against_brute_force(spark, seed, vocabulary, hot, shard_rows):
    rows = made(seed, 60, vocabulary)
    want = brute(rows)
    assert result(documents(spark, rows), hot=hot, shard_rows=shard_rows) == want and sum(r[2] for r in want) > 500


def test_on_given_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert result(docs) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_odd_cases(spark):
    long = " ".join(f"x{i}" for i in range(30))
    rows = [(1, None), (2, ""), (3, long), (3, long), (4, long), (5, "word " * 50000), (6, long + "\x0b" + long), (7, "é　b " + long)]
    got = result(clashing(documents(spark, rows)))
    want = brute([r for i, r in enumerate(rows) if i != 3])
    assert Counter(got) == Counter(want + [want[2]])
    assert sd.dedup_passages(documents(spark, rows).limit(0)).count() == 0


def test_index_counts_like_a_scan():
    rng = np.random.default_rng(0)
    text = np.append(rng.integers(1, 5, 400), 0)
    index = sd.FmIndex(text, 6)
    for _ in range(200):
        pattern = rng.integers(1, 5, rng.integers(1, 7))
        lo, hi = np.array([0]), np.array([len(text)])
        for c in pattern[::-1]:
            if hi[0] > lo[0]:
                lo, hi = index.extend(lo, hi, np.array([c]))
        want = sum((text[i : i + len(pattern)] == pattern).all() for i in range(len(text) - len(pattern) + 1) if len(text[i : i + len(pattern)]) == len(pattern))
        assert max(0, hi[0] - lo[0]) == want


def test_rows_without_id_and_texts_that_share_one(spark):
    rng = random.Random(7)
    words = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    shared = words(40)
    rows = [(None, f"{words(5)} {shared}"), (None, f"{shared} {words(6)}"), (None, None), (4, f"{words(3)} {shared} {words(3)}"), (4, words(60)), (4, f"{shared}"), (9, shared)]
    order = lambda r: (r[0] is not None, r[0] or 0, zlib.crc32((r[1] or "").encode()))
    want = brute(sorted(rows, key=order), sort=False)
    assert Counter(result_rows(documents(spark, rows))) == Counter(want) and sum(r[2] for r in want) == 40 * 4


def result_rows(df):
    return [tuple(r) for r in sd.digests(sd.dedup_passages(df)).collect()]


def test_hot_passage(spark):
    """A third of the documents hold one passage, many of them whole copies of each other."""
    rng = random.Random(3)
    words = lambda n: " ".join(f"w{rng.randrange(9000)}" for _ in range(n))
    passage, copy = words(35), words(120)
    rows = [(i, copy if i % 6 == 0 else f"{words(8)} {passage} {words(8)}" if i % 3 == 0 else words(40)) for i in range(600)]
    want = brute(rows)
    assert result(documents(spark, rows), hot=50) == want and sum(r[2] > 0 for r in want) == 198
