import hashlib
import json
import math
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from siltlog.llm import chat, common, line_dedup, mixing, queries, sharding

from helpers import clashing, documents

ODD = [(1, None), (2, ""), (3, "a b\nc"), (3, "a b\nc"), (4, "x " * 60000), (5, "é\n" * 5, None, None)]


# sharding


def test_curve_visits_neighbours_once(spark):
    cells = spark.range(4096).select(*[((F.col("id") / 16**i).cast("long") % 16).alias(f"x{i}") for i in range(3)])
    got = cells.select("*", sharding.hilbert([F.col(f"x{i}") for i in range(3)], 4).alias("h")).orderBy("h").collect()
    assert [r.h for r in got] == list(range(4096))
    steps = [sum(abs(a[i] - b[i]) for i in range(3)) for a, b in zip(got, got[1:])]
    assert set(steps) == {1}


def test_shards_hold_their_law(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = sharding.shard_documents(docs).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert sorted(r.doc_id for r in out) == sorted(texts)
    sizes = Counter(r["shard"] for r in out)
    assert set(sizes) == set(range(40)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s in range(40):
        assert sorted(r.slot for r in out if r["shard"] == s) == list(range(sizes[s]))
    for r in out:
        raw = texts[r.doc_id].encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "rows", None)
    cells = [r.cell for r in sorted(out, key=lambda r: (r["shard"], r.slot))]
    assert [max(r.cell for r in out if r["shard"] == s) <= min(r.cell for r in out if r["shard"] == s + 1) for s in range(39)] == [True] * 39 and cells


def test_shards_odd_cases(spark):
    out = sharding.shard_documents(clashing(documents(spark, ODD))).collect()
    assert len(out) == len(ODD) and {r["size"] for r in out if r.doc_id in (1, 2)} == {16}
    assert {r.text_crc32 for r in out if r.doc_id == 1} == {0}
    assert sharding.shard_documents(documents(spark, ODD).limit(0)).count() == 0


# chat


def brute_turns(rows):
    whole = "".join(f"{r}\n{t}\n" for r, t in rows)
    loss = "".join(t for r, t in rows if r == "assistant")
    return len(rows), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_chat_reads_back_everything(spark, sf):
    out = {r.conv_id: r for r in queries.op7_chat_fingerprint(spark, sf).collect()}
    want = defaultdict(list)
    for r in spark.read.parquet(f"{sf}/conversations.parquet").collect():
        want[r.conv_id].append((r.turn, r.role or "", r.text or ""))
    want[-7] = [(0, "user", r"\### Assistant: </turn> ok"), (1, "assistant", r"\### Assistant: </turn> ok")]
    assert set(out) == set(want)
    for k, rows in want.items():
        r = out[k]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == brute_turns([x[1:] for x in sorted(rows)])
    assert len({r.layout for r in out.values()}) >= 3


@pytest.mark.parametrize("text", ["", "</turn>\n", "\\l<\\b\\g>", "<turn user>\nhi</turn>\n", "a\nb", "é\U0001f600\\", "\\\\<<"])
def test_escapes_are_reversible(spark, text):
    rows = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", text), (1, 2, "a>b<\n", text), (1, 3, "assistant", text)], "conv_id long, turn long, role string, text string")
    r = chat.read_back(chat.formatted(chat.canonical(chat.records_of(rows)))).collect()[0]
    assert [(x.role, x.text) for x in r.back] == [("user", "q"), ("assistant", text), ("a>b<\n", text), ("assistant", text)]
    assert r.loss == text * 2


def test_layouts_and_unknown_records(spark):
    given = [{"messages": [{"role": "user", "content": None}]}, {"conversations": [{"from": "gpt", "value": "v"}]}, {"prompt": "p", "completion": "c"}, {"instruction": "i", "input": "u", "output": "o"}, {"other": 1}, None]
    rows = spark.createDataFrame([(i, json.dumps(g) if g else None) for i, g in enumerate(given)], "conv_id long, record string")
    out = {r.conv_id: r for r in chat.read_back(chat.formatted(chat.canonical(rows))).collect()}
    assert [out[i].layout for i in range(6)] == ["messages", "shared", "prompt", "instruction", None, None]
    assert [[(t.role, t.text) for t in out[i].back] for i in range(6)] == [[("user", "")], [("assistant", "v")], [("user", "p"), ("assistant", "c")], [("system", "i"), ("user", "u"), ("assistant", "o")], [], []]


def test_chat_odd_cases(spark):
    kind = "conv_id long, turn long, role string, text string"
    rows = spark.createDataFrame([(1, 0, None, None), (1, 0, None, None), (2, None, "assistant", "x" * 100000), (None, 0, "user", "n")], kind)
    out = {r.conv_id: r for r in chat.digests(chat.read_back(chat.formatted(chat.canonical(chat.records_of(clashing(rows)))))).collect()}
    assert {k: r.n_turns for k, r in out.items()} == {1: 2, 2: 1, None: 1} and out[2].loss_chars == 100000
    assert chat.records_of(rows.limit(0)).count() == 0


# lines


def brute_lines(docs, divisor=4):
    """From the operator's chunks (checked on their own): removes all but the first of equal chunks of two lines or more."""
    seen, out = {}, {}
    for doc_id, lines, chunks in sorted(docs, key=lambda d: d[0]):
        gone = set()
        for c in chunks:
            text = "\n".join(lines[c.start : c.start + c.n])
            if c.n >= 2 and seen.setdefault(text, (doc_id, c.start)) != (doc_id, c.start):
                gone |= set(range(c.start, c.start + c.n))
        out[doc_id] = "\n".join(x for i, x in enumerate(lines) if i not in gone), len(gone)
    return out


def test_lines_against_brute_force(spark):
    rng = random.Random(4)
    block = [f"shared line {i} {rng.random()}" for i in range(30)]
    rows = [(i, "\n".join([f"own {i} {rng.random()}" for _ in range(rng.randint(0, 4))] + (block[: rng.randint(5, 30)] if i % 2 else []) + [f"end {i}"])) for i in range(60)]
    docs = documents(spark, rows)
    chunked = [(r.doc_id, r.lines, r.chunks) for r in line_dedup.with_chunks(docs).collect()]
    for _, lines, chunks in chunked:
        assert [i for c in chunks for i in range(c.start, c.start + c.n)] == list(range(len(lines)))
    want = brute_lines(chunked)
    got = {r.doc_id: (r.kept, r.n_removed_lines) for r in line_dedup.dedup_lines(docs).collect()}
    assert got == want and sum(n for _, n in want.values()) > 200


def test_boundaries_move_with_the_lines(spark):
    lines = [f"l{i}" for i in range(200)]
    docs = documents(spark, [(1, "\n".join(lines)), (2, "\n".join(["new", "new2", *lines]))])
    a, b = [{"\n".join(r.lines[c.start : c.start + c.n]) for c in r.chunks} for r in line_dedup.with_chunks(docs).orderBy("doc_id").collect()]
    assert len(a - b) <= 2


def test_lines_odd_cases(spark):
    out = line_dedup.dedup_lines(clashing(documents(spark, ODD))).collect()
    assert len(out) == len(ODD)
    assert [(r.kept, r.n_lines) for r in out if r.doc_id in (1, 2)] == [(None, 0), ("", 1)]
    assert [r.kept for r in out if r.doc_id == 3] == ["a b\nc"] * 2
    assert line_dedup.dedup_lines(documents(spark, ODD).limit(0)).count() == 0


# mixing


def test_mixing_stays_within_a_block(spark):
    sizes = {"a": 500, "b": 300, "c": 150, None: 50}
    rows = [(i, "t", "en", s) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    weights = spark.createDataFrame([("a", 5), ("b", 3), ("c", 2), (None, 1)], "source string, parts int")
    out = sorted(mixing.mix_documents(documents(spark, rows), parts=weights, block_rows=4).collect(), key=lambda r: r.position)
    assert [r.position for r in out] == list(range(1000)) and sorted(r.doc_id for r in out) == list(range(1000))
    share, done, last = {"a": 5 / 11, "b": 3 / 11, "c": 2 / 11, None: 1 / 11}, Counter(), None
    slots = {}
    for r in out:
        slots.setdefault(r.slot, r.source)
        assert slots[r.slot] == r.source
    live = min(-(-n // 4) // share[s] for s, n in sizes.items())
    for t in range(int(live)):
        done[slots[t]] += 1
        assert all(abs(done[s] - share[s] * (t + 1)) < 1 for s in share)
    assert last is None


def test_mixing_default_weights_and_odd_cases(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = mixing.mix_documents(docs).collect()
    assert sorted(r.position for r in out) == list(range(docs.count()))
    odd = mixing.mix_documents(clashing(documents(spark, ODD))).collect()
    assert Counter(r.doc_id for r in odd) == Counter(r[0] for r in ODD) and [r.source for r in odd if r.doc_id == 5] == [None]
    assert mixing.mix_documents(docs.limit(0)).count() == 0


def test_runs_of_one_line_are_cut(spark):
    """Of runs of equal lines, whatever their line and length, about a chunk stays, and no line that stands once goes."""
    rows = [(i, "\n".join([f"top {i}"] + [f"again {i % 12}"] * (60 + i) + [f"end {i}"])) for i in range(36)]
    out = {r.doc_id: r for r in line_dedup.dedup_lines(documents(spark, rows)).collect()}
    assert all(r.n_lines - r.n_removed_lines <= 32 and f"top {i}" in r.kept and r.kept.endswith(f"end {i}") for i, r in out.items())
    for _, lines, chunks in ((r.doc_id, r.lines, r.chunks) for r in line_dedup.with_chunks(documents(spark, rows)).collect()):
        assert [i for c in chunks for i in range(c.start, c.start + c.n)] == list(range(len(lines))) and max(c.n for c in chunks) <= 9


def test_lines_of_rows_without_id_and_texts_that_share_one(spark):
    block = "\n".join(f"shared {i}" for i in range(40))
    rows = [(None, f"a\n{block}\nb"), (None, f"c\n{block}\nd"), (4, f"e\n{block}\nf"), (4, "\n".join(f"own {i}" for i in range(50)))]
    out = {r.kept[0] if r.kept[0] != "o" else "own": r for r in line_dedup.dedup_lines(documents(spark, rows)).collect()}
    assert out["own"].kept == rows[3][1] and out["own"].n_removed_lines == 0
    assert sorted(out[k].n_removed_lines > 20 for k in "ace") == [False, True, True] and out["e"].n_removed_lines > 20


# more of sharding, mixing and chat


def test_bounds_of_shards_prune(spark):
    """Few shards that do not hold a value are left by the shards' smallest and largest values."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = sharding.shard_documents(docs)
    bounds, rows = sharding.bounds_of(out).collect(), out.collect()
    assert sum(b.n_rows for b in bounds) == len(rows)
    for c in ("lang", "source"):
        for v in {r[c] for r in rows if r[c] is not None}:
            true = {r["shard"] for r in rows if r[c] == v}
            left = {b["shard"] for b in bounds if b[f"min_{c}"] is not None and b[f"min_{c}"] <= v <= b[f"max_{c}"]}
            assert true <= left and len(left) <= len(true) + 12, (c, v, len(true), len(left))
    sizes = sorted(r["size"] for r in rows)
    low, high = sizes[len(sizes) // 2], sizes[len(sizes) * 6 // 10]
    left = [b for b in bounds if b.max_size >= low and b.min_size <= high]
    assert len(left) <= 30


@pytest.mark.parametrize("levels", [4, 16])
def test_levels_keep_the_order(spark, levels):
    rng = random.Random(levels)
    rows = spark.createDataFrame([(rng.choice([None, "m", "m", "m", *map(str, range(100))]),) for _ in range(600)], "v string")
    starts = sharding.level_starts(rows, "v", levels)
    got = rows.select("v", sharding.ordered_level(F.col("v"), starts).alias("l")).collect()
    assert {r.l for r in got if r.v is None} == {0}
    order = [r.l for r in sorted((r for r in got if r.v is not None), key=lambda r: r.v)]
    assert order == sorted(order) and 0 <= order[0] and order[-1] < levels and len(set(order)) > levels // 2
    few = spark.createDataFrame([("a",), ("b",), ("c",)], "v string")
    assert sharding.level_starts(few, "v", 16) == [(5, "b"), (10, "c")] and sharding.level_starts(few.limit(0), "v", 16) == []


def test_rows_without_id_in_shards_and_mixing(spark):
    rows = [(None, "a", None, None), (None, "a", None, None), (None, "b", "en", ""), (-1, "c", "en", None), (7, None, None, "s")]
    out = sharding.shard_documents(documents(spark, rows)).collect()
    assert Counter(r.doc_id for r in out) == Counter(r[0] for r in rows)
    mixed = mixing.mix_documents(documents(spark, rows)).collect()
    assert Counter((r.doc_id, r.source) for r in mixed) == Counter((r[0], r[3] if len(r) > 3 else "s") for r in rows)
    assert sorted(r.position for r in mixed) == list(range(5))


def earliest_deadline_first(parts):
    """Slot by slot over all sources: of the released turns the one with the earliest deadline; ties as in `turns`."""
    cycle, done, out = sum(parts.values()), dict.fromkeys(parts, 0), []
    for t in range(cycle):
        ready = [(-(-(done[s] + 1) * cycle // p), -p, s) for s, p in parts.items() if done[s] < p and done[s] * cycle // p <= t]
        d, p = min((d, p) for d, p, _ in ready)
        s = max(s for x, y, s in ready if (x, y) == (d, p))
        out.append((s, done[s]))
        done[s] += 1
    return out


@pytest.mark.parametrize("parts", [{"a": 5, "b": 3, "c": 2, "d": 1}, {"a": 7, "b": 7, "c": 1, "e": 1, "f": 1}, {"x": 2, "y": 2, "z": 2}, {"one": 4}])
def test_turns_against_earliest_deadline_first(spark, parts):
    want = earliest_deadline_first(parts)
    heavy = spark.createDataFrame([(s, p) for s, p in parts.items() if p > 1], "source string, parts int")
    got = {r["slot"]: (r["source"], r["turn"]) for r in mixing.turns(heavy, "source", sum(parts.values()))}
    assert got == {t: x for t, x in enumerate(want) if parts[x[0]] > 1}


def test_many_sources(spark):
    """Thousands of sources of a few rows beside a heavy one: no fold over them, and the heavy one keeps its share."""
    rows = [(i, "t", "en", "heavy" if i % 3 == 0 else f"host{i % 4000}") for i in range(9000)]
    out = sorted(mixing.mix_documents(documents(spark, rows), block_rows=2).collect(), key=lambda r: r.position)
    assert [r.position for r in out] == list(range(9000)) and sorted(r.doc_id for r in out) == list(range(9000))
    slots = {}
    for r in out:
        assert slots.setdefault(r.slot, r.source) == r.source
    lights = len({r.source for r in out}) - 1
    by_source = Counter(r.source for r in out)
    weight = {x: math.ceil(n**0.7 * 1024) for x, n in by_source.items()}
    p = round(weight["heavy"] * 1000 / sum(weight.values()))
    cycle, done = p + lights, 0
    assert lights > 2000 and p > 1 and {s for s in slots if s < cycle} <= set(range(cycle))
    for t in range(min(cycle, -(-by_source["heavy"] // 2) * cycle // p)):
        done += slots.get(t) == "heavy"
        assert abs(done - p * (t + 1) / cycle) < 1


def test_turns_are_no_calls_of_the_driver(spark, monkeypatch):
    """A schedule of 1000 turns takes hardly more calls of the driver's JVM than one of 20, and both place all rows."""
    rows = documents(spark, [(i, "t", "en", f"s{i % 4}") for i in range(400)])
    client, calls = spark.sparkContext._gateway._gateway_client, []
    send = client.send_command
    monkeypatch.setattr(client, "send_command", lambda *a, **k: calls.append(1) or send(*a, **k))
    many = []
    for cycle in (20, 1000):
        calls.clear()
        out = mixing.mix_documents(rows, cycle=cycle)
        many.append(len(calls))
        assert sorted(r.position for r in out.collect()) == list(range(400))
    assert many[1] < many[0] + 300


def test_a_full_heap_of_the_driver_is_collected(spark, monkeypatch):
    """After a table is written, and only where more than the given share of the heap is taken."""
    calls = []
    monkeypatch.setattr(common, "release", lambda _: calls.append(1))
    for full, want in ((0, 1), (1, 1)):
        monkeypatch.setattr(common, "FULL", full)
        assert common.written(spark.range(5), "five").count() == 5 and len(calls) == want


def test_very_long_turns_are_kept(spark):
    n = 24_000_000
    rows = spark.range(2).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.when(F.col("id") == 0, F.lit("q")).otherwise(F.repeat(F.lit('a"\\<'), n // 4)).alias("text"))
    r = chat.digests(chat.read_back(chat.formatted(chat.canonical(chat.records_of(rows))))).collect()[0]
    assert (r.n_turns, r.loss_chars, r.layout) == (2, n, "prompt")
    assert r.loss_sha256 == hashlib.sha256(('a"\\<' * (n // 4)).encode()).hexdigest()


def test_optional_fields_and_odd_records(spark):
    given = [
        json.dumps({"id": 7, "messages": [{"role": "user", "content": 'say "x": \\ "y",'}, {"role": "assistant", "content": "ok", "name": "bot", "weight": 1.5}]}),
        json.dumps({"conversations": [{"from": "human", "value": "a\\\\\"b"}, {"from": "gpt", "value": "", "id": "z"}], "source": "s"}),
        '{"prompt": "unfinished', '{"prompt": "a"" , "completion": "b"}', "no json", "", '["prompt"]', '{"messages": "text", "role": 1}',
    ]
    rows = spark.createDataFrame([(i, g) for i, g in enumerate(given)], "conv_id long, record string")
    out = {r.conv_id: r for r in chat.read_back(chat.formatted(chat.canonical(rows))).collect()}
    assert [out[i].layout for i in range(len(given))] == ["messages", "shared", None, None, None, None, None, None]
    assert [(t.role, t.text) for t in out[0].back] == [("user", 'say "x": \\ "y",'), ("assistant", "ok")]
    assert [(t.role, t.text) for t in out[1].back] == [("user", 'a\\\\"b'), ("assistant", "")]


# boundaries of chunks


def brute_chunks(lines, hashes, divisor=4, window=3, longest=8):
    ends = []
    for i in range(len(lines)):
        total = 0
        for j in range(window):
            total += (hashes[i - j] if i >= j else 0) * pow(line_dedup.BASE, j, line_dedup.PRIME)
        alike = i >= window - 1 and len({hashes[i - j] for j in range(window)}) == 1
        if i == len(lines) - 1 or (total % line_dedup.PRIME % divisor == 0 and not alike):
            ends.append(i)
    out, at = [], 0
    for e in ends:
        while e + 1 - at > longest + 1:
            out.append((at, longest))
            at += longest
        out.append((at, e + 1 - at))
        at = e + 1
    return out


def test_chunks_against_brute_force(spark):
    rng = random.Random(9)
    texts = ["\n".join(rng.choice(["a", "b", "same", "same", str(rng.random())]) for _ in range(rng.randint(1, 60))) for _ in range(40)] + ["x\n" * 40, ""]
    docs = documents(spark, list(enumerate(texts)))
    for r in line_dedup.with_chunks(docs).collect():
        hashed = [int(hashlib.md5(x.encode()).hexdigest()[:7], 16) for x in r.lines]
        assert [(c.start, c.n) for c in r.chunks] == brute_chunks(r.lines, hashed)


def test_lines_of_small_and_large_tables_are_joined_alike(spark, monkeypatch):
    """Chunks and texts are merged with what is repeated or goes, not joined by a broadcast while that is small."""
    plans, write = [], line_dedup.written
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(line_dedup, "written", lambda df, name: plans.append(plan(df)) or write(df, name))
    rows = [(1, "a\nb\nc"), (2, "a\nb\nc"), (3, "x\ny"), (None, None)]
    out = line_dedup.dedup_lines(documents(spark, rows))
    got = {r.doc_id: (r.kept, r.n_removed_lines) for r in out.collect()}
    assert got[1] == ("a\nb\nc", 0) and got[3] == ("x\ny", 0) and got[None] == (None, 0) and got[2][1] == 3
    plans.append(plan(out))
    assert "SortMergeJoin" in plans[1] and "LeftOuter" in next(line for line in plans[-1].splitlines() if "SortMergeJoin" in line)
    assert not any("BroadcastHashJoin" in p for p in plans)
