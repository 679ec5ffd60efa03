import hashlib
import json
import logging
import os
import random

import pytest
from pyspark.sql import functions as F

from siltlog import catalogue, files
from siltlog import log as siltlog_log
from siltlog.functions import bloom, checksum
from siltlog.functions import records as fr
from siltlog.operators import headers, maintain, reads, segments, state
from siltlog.plans.store import Store, StoreConfig, free_space_error, id_of, key_of, next_defrag
from siltlog.sources import segment_file
from siltlog.streaming.fold import StateTable, current_from_stream

LOG = "seq long, key string, op string, offset long, size long, data binary, flags long"


def log(spark, ops):
    """ops: (key, op, offset, size, data)."""
    return spark.createDataFrame([(i, k, op, o, s, d, 0) for i, (k, op, o, s, d) in enumerate(ops)], LOG)


def step(s, op, offset, size, data):
    """Shadow model: s is (kind, buffer, reserve, length); gives the next state and an error."""
    kind, buf, cap, n = s
    cut = lambda b, k: b[:k].ljust(k, b"\0")
    if op == "write":
        return ("committed", cut(buf, offset) + data, 0, 0), None
    if op == "append":
        own = buf[:n] if kind == "uncommitted" else buf
        return ("committed", cut(own, len(own) + offset) + data, 0, 0), None
    if op == "prepare":
        return ("uncommitted", buf, max(size, len(buf)), n if kind == "uncommitted" else len(buf)), None
    if op == "remove":
        return (("absent", b"", 0, 0), None) if kind != "absent" else (s, "ENOENT")
    if kind != "uncommitted":
        return s, "ENOENT" if kind == "absent" else "EPERM"
    if op == "plain_write":
        if offset + len(data) > cap:
            return s, "ERANGE"
        return (kind, cut(buf, offset) + data + buf[offset + len(data) :], cap, n), None
    if size > cap:
        return s, "ERANGE"
    return ("committed", cut(buf, n if size < 0 else size), 0, 0), None


def test_fold_against_shadow_model(spark):
    rng = random.Random(5)
    ops = []
    for _ in range(4000):
        op = rng.choice(["write", "append", "prepare", "plain_write", "commit", "remove", "write", "plain_write"])
        ops.append((f"k{rng.randrange(250)}", op, rng.choice([0, 0, 1, 4, 9]), rng.choice([-1, 0, 3, 8, 20]), bytes(rng.randrange(256) for _ in range(rng.randrange(6)))))
    want, errors = {}, set()
    for i, (k, *o) in enumerate(ops):
        want[k], e = step(want.get(k, ("absent", b"", 0, 0)), *o)
        if e:
            errors.add((k, i, o[0], e))
    frame = log(spark, ops)
    got = {r.key: (r.state.kind, bytes(r.state.buf), r.state.cap, r.state.n) for r in state.fold(frame).collect()}
    assert got == want
    assert {(r.key, r.seq, r.op, r.error) for r in state.errors(frame).collect()} == errors
    live = {k: s[1] for k, s in want.items() if s[0] == "committed"}
    assert {r.key: bytes(r.data) for r in state.current(frame).collect()} == live


@pytest.mark.parametrize("ops,value", [
    ([("write", 0, -1, b"abcdef"), ("write", 2, -1, b"XX")], b"abXX"),
    ([("write", 0, -1, b"abcdef"), ("prepare", 0, 6, b""), ("plain_write", 1, -1, b"ZZ"), ("commit", 0, -1, b"")], b"aZZdef"),
    ([("prepare", 0, 10, b""), ("plain_write", 0, -1, b"hello"), ("commit", 0, 5, b"")], b"hello"),
    ([("write", 0, -1, b"ab"), ("remove", 0, -1, b"")], None),
])
def test_fold_cases(spark, ops, value):
    got = state.current(log(spark, [("k", *o) for o in ops])).collect()
    assert [bytes(r.data) for r in got] == ([] if value is None else [value])


def test_murmur_and_footers():
    for data, seed, want in [(b"", 0, "0000000000000000"), (b"a", 0, "071717d2d36b6b11"), (b"abcdefg", 0, "241aa52b0a62005d"), (b"abcdefghi", 0, "c9b9d84356146ac2"), (b"\0" * 64, 0, "510180d30e4ddf52"), (b"abc", 1, "b4b72636e1480c51")]:
        assert f"{checksum.murmur64a(data, seed):016x}" == want
    for data, chunks, final in [(b"data0", ["117e1242ae0d2b1c"], "ac06b8ea46628c66"), (b"x" * 4097, ["cb20d94fcef911a4"], "cafe713b7b438b7d"), (b"y" * (2**20 + 1), ["751217a2adf946db", "9a5db2cd2c1fd6ce"], "c502a8010b1c63b9")]:
        c, f = checksum.footer_of(data)
        assert ([f"{x:016x}" for x in c], f"{f:016x}") == (chunks, final)


def test_defrag_decisions_and_packing(spark):
    cases = [(10, 0, 500, 0, None, 0), (10, 3, 400, 100, None, 1), (2, 0, 80, 0, None, 3), (5, 5, 300, 300, None, 2), (5, 5, 300, 300, 576, 1), (1, 0, 3, 0, None, 1), (1, 2, 300, 10, None, None), (9, 9, 9, 9, None, 0)]
    rows = [(i, t, r, z, rz, x or t * 96) for i, (t, r, z, rz, x, _) in enumerate(cases)]
    stats = spark.createDataFrame(rows, "base long, total long, removed long, size long, removed_size long, index_size long")
    assert [r.code for r in maintain.want_defrag(stats, 1000).orderBy("base").collect()] == [c[-1] for c in cases]
    sizes = spark.createDataFrame([(i, z, 1) for i, z in enumerate([40, 50, 30, 0, 90, 20])], "base long, size long, live long")
    assert [r.grp for r in maintain.pack(sizes, 100, 1000).orderBy("base").collect()] == [0, 0, 1, 1, 2, 3]
    assert (segments.bloom_bytes(512), segments.index_block_bytes(512)) == (8320, 1872)


def test_ranges_find_each_key_once(spark):
    keys = spark.range(1000).withColumnRenamed("id", "key")
    rng = random.Random(2)
    for n in (3, 200):
        ranges = [(a, a + rng.randint(-2, 9)) for a in (rng.randrange(1000) for _ in range(n))]
        got = sorted(r.key for r in reads.multi_range(keys, ranges).collect())
        assert got == [k for k in range(1000) if any(a <= k <= b for a, b in ranges)]
    assert [r.key for r in reads.read_range(keys, 10, 20, 2, 3).collect()] == [12, 13, 14]


def test_range_predicates_reach_the_scan(spark, sf):
    rows = spark.read.parquet(f"{sf}/orders.parquet").withColumnRenamed("o_orderkey", "key").select("key")
    plan = reads.multi_range(rows, [(1, 5), (9, 12)])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(" in plan and "Python" not in plan


def test_segment_files_round_trip(spark, tmp_path):
    rows = [(b, i, key_of(f"{b}-{i}"), bytes([65 + i]) * (i * 700), 0) for b in range(3) for i in range(8)]
    frame = spark.createDataFrame(rows, "base long, idx long, key binary, data binary, flags long")
    segment_file.write_segments(frame, str(tmp_path / "s"))
    assert sorted(os.listdir(tmp_path / "s")) == sorted(f"data-0.{b}{e}" for b in range(3) for e in ("", ".index"))
    got = segment_file.read_data(spark, str(tmp_path / "s")).collect()
    assert {(r.base, r.idx, bytes(r.key), bytes(r.data)) for r in got} == {r[:4] for r in rows}
    assert all(r.validity == "ok" and r.flags == 256 for r in got)
    checked = segment_file.read_data(spark, str(tmp_path / "s")).select(checksum.verify(F.col("data"), F.col("chunks"), F.col("flags")).alias("ok")).collect()
    assert all(r.ok for r in checked)
    index = segment_file.read_index(spark, str(tmp_path / "s")).collect()
    assert {(r.base, r.idx, r.position) for r in index} == {(r.base, r.idx, r.position) for r in got}
    with open(tmp_path / "s" / "data-0.1", "r+b") as f:
        f.truncate(3000)
    bad = segment_file.read_data(spark, str(tmp_path / "s")).where("base = 1").orderBy("idx").collect()
    assert bad[-1].validity == "outside" and len(bad) < 8


def test_store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"), StoreConfig(records_in_blob=2))
    assert s.elements() == 0
    for i in range(5):
        s.write_hashed(f"keyi{i}", f"data{i}".encode())
    s.writev(key_of("v"), [(0, b"abc"), (3, b"de")])
    s.write(key_of("v"), b"!", flags=16)
    s.remove_hashed("keyi0")
    s.prepare(key_of("p"), 10)
    s.plain_write(key_of("p"), b"hello")
    assert s.read_hashed("keyi3") == b"data3" and s.read(key_of("v")) == b"abcde!" and s.read_hashed("keyi3", 1, 2) == b"at"
    for name in ("keyi0", "p"):
        with pytest.raises(KeyError):
            s.read_hashed(name)
    with pytest.raises(OSError):
        s.writev(b"k", [])
    assert s.elements() == 6
    s.commit(key_of("p"), 5)
    assert s.read_hashed("p") == b"hello"
    assert [bytes(r.key) for r in s.read_range(b"\0", b"\xff" * 64).collect()] == sorted(key_of(n) for n in ["keyi1", "keyi2", "keyi3", "keyi4", "v", "p"])
    summary = s.statistics().where("base is null").collect()[0]
    assert summary.records_total == 6 and s.statistics().count() == 4
    assert spark.read.parquet(s.start_defrag()).count() == 6


def test_small_functions(spark):
    assert id_of([1, 2]) == b"\1\2" + b"\0" * 62
    c = StoreConfig()
    assert next_defrag(1000, 1000, c) == 3 * 3600 - 1000 and next_defrag(3 * 3600 - 5, 0, c) == 60
    assert free_space_error(10, 100, 20, 0, c) == "ENOSPC" and free_space_error(1 << 40, 1 << 41, 20, 0, c) is None
    row = spark.range(1).select(fr.key_of(F.lit("keyi0")).alias("k"), fr.render_flags(F.lit(257)).alias("f"), fr.disk_size(F.lit(4097)).alias("d"), fr.disk_size(F.lit(0)).alias("z"), fr.stored_flags(F.lit(0), True).alias("s")).collect()[0]
    assert bytes(row.k) == hashlib.sha512(b"keyi0").digest() and (row.f, row.d, row.z, row.s) == ("0x101 [remove|chunked_csum]", 4209, 96, 258)


def test_stream_in_parts_equals_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    for part in range(3):
        (events.where(F.expr(f"event_id div 400 = {part}")) if part < 2 else events.where("event_id >= 800")).coalesce(1).write.parquet(str(tmp_path / f"p{part}"))
        os.rename(next((tmp_path / f"p{part}").glob("part-*")), tmp_path / f"events-{part}.parquet")
        os.utime(tmp_path / f"events-{part}.parquet", (part + 1, part + 1))
    got = {(r.key, bytes(r.data)) for r in current_from_stream(spark, events.schema, f"{tmp_path}/events-*.parquet").collect()}
    want = {(r.key, r.data.encode()) for r in catalogue.queries()["current_state"](spark, sf).collect()}
    assert got == want


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(catalogue.oracle_sql()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def plain_murmur(data, seed=0):
    m, mask = 0xC6A4A7935BD1E995, (1 << 64) - 1
    h = (seed ^ len(data) * m) & mask
    for i in range(0, len(data) & ~7, 8):
        k = int.from_bytes(data[i : i + 8], "little") * m & mask
        h = (h ^ (k ^ k >> 47) * m) * m & mask
    if len(data) & 7:
        h = (h ^ int.from_bytes(data[len(data) & ~7 :], "little")) * m & mask
    h = (h ^ h >> 47) * m & mask
    return h ^ h >> 47


def test_hashes_of_a_batch_against_one_by_one():
    rng = random.Random(1)
    values = [rng.randbytes(n) for n in [0, 1, 7, 8, 9, 4095, 4096, 4097, 9000, *(rng.randrange(300) for _ in range(60))]]
    assert checksum.hashes(values, 5).tolist() == [plain_murmur(v, 5) for v in values]

    def chain(v):
        h = 0
        for i in range(0, len(v), 4096):
            h = plain_murmur(v[i : i + 4096], h)
        return h

    big = values + [rng.randbytes((1 << 20) + 5000)]
    chunks, final = checksum.footers(big)
    for v, c, f in zip(big, chunks, final):
        want = [chain(v[i : i + (1 << 20)]) for i in range(0, len(v), 1 << 20)]
        assert c.tolist() == want and f == (plain_murmur(b"".join(x.to_bytes(8, "little") for x in want)) if want else 0)
    assert checksum.hashes([]).size == 0 and checksum.footers([])[0] == []


def test_verification_reads_only_touched_chunks(spark):
    whole = b"a" * (1 << 20) + b"b" * 500
    chunks = [checksum.signed(c) for c in checksum.footer_of(whole)[0]]
    bad = whole[:-1] + b"c"
    size = 96 + len(whole) + 24
    sha = hashlib.sha512(b"old").digest()
    rows = [(0, whole, size, 256, chunks, None), (1, bad, size, 256, chunks, None), (2, bad, size, 258, chunks, None), (3, bad, 96 + len(whole), 256, chunks, None), (4, b"", 96, 256, [], None), (5, b"old", 96 + 3 + 72, 0, [], sha), (6, b"new", 96 + 3 + 72, 0, [], sha), (7, b"old", 96 + 3 + 8, 0, [], sha), (8, whole, size, 256, chunks[:1], None)]
    df = spark.createDataFrame(rows, "i int, data binary, disk long, flags long, chunks array<long>, csum binary")
    args = [F.col(c) for c in ("data", "disk", "flags", "chunks", "csum")]
    get = lambda **kw: {r.i: r.e for r in df.select("i", checksum.verify_error(*args, **kw).alias("e")).collect()}
    assert get() == {0: None, 1: "EILSEQ", 2: None, 3: "EINVAL", 4: "EINVAL", 5: None, 6: "EILSEQ", 7: "EINVAL", 8: "EILSEQ"}
    assert get(offset=10, size=100)[1] is None and get(offset=1 << 20, size=1)[1] == "EILSEQ" and set(get(no_footer=True).values()) == {None}


def test_sha512_of_ranges(spark):
    rng = random.Random(2)
    data = rng.randbytes(3000)
    rows = [(i, data, rng.randrange(3000), rng.randrange(3000)) for i in range(200)]
    digest, error = checksum.sha512_range(F.col("d"), F.col("o"), F.col("n"))
    for r in spark.createDataFrame(rows, "i int, d binary, o long, n long").select("*", digest.alias("h"), error.alias("e")).collect():
        late = r.o + r.n > 3000
        assert (r.e, r.h) == (("ESPIPE", None) if late else (None, hashlib.sha512(data[r.o : r.o + r.n]).hexdigest()))


def test_ranges_as_a_table(spark):
    rng = random.Random(8)
    keys = [(rng.choice([None, *range(500)]), i) for i in range(2000)]
    ranges = [(a, a + rng.randint(-3, 12)) for a in (rng.randrange(500) for _ in range(60))]
    rows, table = spark.createDataFrame(keys, "key long, i int"), spark.createDataFrame(ranges, "start long, end long")
    want = sorted(i for k, i in keys if k is not None and any(a <= k <= b for a, b in ranges))
    for cuts in (1, 64):
        assert sorted(r.i for r in reads.in_ranges(rows, table, cuts=cuts).collect()) == want
    assert reads.in_ranges(rows, table.limit(0)).count() == 0 and reads.in_ranges(rows.limit(0), table).count() == 0


def random_log(rng, n=1500, keys=60):
    ops = ["write", "append", "append", "prepare", "plain_write", "commit", "remove", "write", "plain_write", "insert", "update"]
    return [(i, f"k{rng.randrange(keys)}", rng.choice(ops), rng.choice([0, 0, 0, 2, 5]), rng.choice([-1, 3, 8, 20]), rng.randbytes(rng.randrange(6)), 0) for i in range(n)]


def live_of(frame):
    return {r.key: (r.state.kind, bytes(r.state.buf), r.state.cap, r.state.n) for r in state.fold(frame).collect() if r.state.kind != "absent"}


def test_short_histories_give_the_same_states(spark):
    frame = spark.createDataFrame(random_log(random.Random(3)), LOG)
    short = {r.key: (r.state.kind, bytes(r.state.buf), r.state.cap, r.state.n) for r in state.states(frame).collect() if r.state.kind != "absent"}
    assert short == live_of(frame)


def test_batches_of_a_log_equal_the_whole(spark, tmp_path):
    """Batches cut anywhere, one of them run twice, and a table that is opened again between them."""
    rng = random.Random(4)
    rows = random_log(rng)
    frame = spark.createDataFrame(rows, LOG)
    want = {k: (kind, buf) for k, (kind, buf, _, _) in live_of(frame).items()}
    cuts = sorted(rng.sample(range(1500), 8))
    for b, (lo, hi) in enumerate(zip([0, *cuts], [*cuts, 1500])):
        part = spark.createDataFrame(rows[lo:hi], LOG)
        for _ in range(2 if b in (3, 4) else 1):
            StateTable(spark, str(tmp_path / "s"), every=4).apply(part, b)
    got = {r.key: (r.kind, bytes(r.data)) for r in StateTable(spark, str(tmp_path / "s")).current(True).collect()}
    assert got == want


def test_large_offsets_fail_alone(spark):
    got = state.fold(log(spark, [("k", "write", 1 << 40, -1, b"x"), ("k", "write", 0, -1, b"ok"), ("k", "commit", 0, -1, b""), ("j", "prepare", 0, 1 << 50, b""), ("j", "commit", 0, 1 << 45, b"")])).collect()
    by = {r.key: r.state for r in got}
    assert bytes(by["k"].buf) == b"ok" and [e.error for e in by["k"].errors] == ["EFBIG", "EPERM"] and [e.error for e in by["j"].errors] == ["EFBIG"]


def test_extended_headers(spark):
    kind = LOG + ", ext binary"
    rows = [(0, "a", "write", 0, -1, b"plain", 0, None), (1, "a", "append", 0, -1, b"+", 64, b"H"), (2, "a", "write", 0, -1, b"no", 0, None), (3, "b", "prepare", 0, 9, b"", 0, None), (4, "b", "plain_write", 0, -1, b"x", 64, b"H")]
    got = {r.key: r.state for r in state.fold(spark.createDataFrame(rows, kind)).collect()}
    assert (bytes(got["a"].ext), bytes(got["a"].buf)) == (b"H", b"plain+") and [e.error for e in got["a"].errors] == ["EINVAL"]
    assert got["b"].ext is None and [e.error for e in got["b"].errors] == ["ENOTSUP"]
    assert {r.key: (r.ext, bytes(r.data)) for r in state.current(spark.createDataFrame(rows, kind)).collect()} == {"a": (b"H", b"plain+")}


def test_seemingly_empty_base_is_not_removed(spark):
    stats = spark.createDataFrame([(0, 0, 0, 300, 0, 0), (1, 0, 0, 0, 0, 96), (2, 0, 0, 0, 0, 0), (3, 4, 2, -5, -9, 384), (4, 1, 0, 9, 0, 96)], "base long, total long, removed long, size long, removed_size long, index_size long")
    assert [r.decision for r in maintain.want_defrag(stats, 1000).orderBy("base").collect()] == ["EINVAL", "EINVAL", "can_be_removed", "EINVAL", "not_needed"]


def test_levels_of_compaction(spark):
    rows = [(0, 10, 0, 500, 0, 960, True), (1, 5, 5, 300, 300, 480, False), (2, 10, 5, 400, 200, 960, False), (3, 10, 0, 500, 0, 960, False), (4, 10, 9, 500, 400, 960, True), (5, 10, 0, 500, 0, 960, False)]
    decided = maintain.want_defrag(spark.createDataFrame(rows, "base long, total long, removed long, size long, removed_size long, index_size long, is_sorted boolean"), 1000)
    plan = lambda level: [(r.action, r.grp) for r in maintain.defrag_plan(decided, 1000, 1000, level).orderBy("base").collect()]
    assert plan("data_sort") == [("skip", None), ("remove", None), ("sort", 0), ("sort", 0), ("sort", 1), ("skip", None)]
    assert plan("compact") == [("skip", None), ("remove", None), ("sort", 0), ("skip", None), ("sort", 0), ("skip", None)]
    assert plan("index_sort") == [("skip", None), ("remove", None), ("sort", 2), ("sort", 3), ("skip", None), ("skip", None)]


def test_index_files(spark, tmp_path):
    folder = tmp_path / "s"
    rows = [(b, i, key_of(f"{b}-{i}"), bytes([65 + i]) * (i * 50), 0) for b in range(2) for i in range(6)]
    frame = spark.createDataFrame(rows, "base long, idx long, key binary, data binary, flags long")
    segment_file.write_segments(frame, str(folder))
    by_index = segment_file.read_records(spark, str(folder))
    walked = segment_file.read_data(spark, str(folder))
    assert sorted(map(str, by_index.collect())) == sorted(map(str, walked.collect()))
    index, data = segment_file.read_pairs(spark, str(folder))
    assert {r.pair for r in headers.header_pairs(index, data).collect()} == {"same"}
    # a removal that has reached the data file only
    at = {(r.base, r.idx): r.position for r in index.collect()}
    with open(folder / "data-0.1", "r+b") as f:
        f.seek(at[1, 2] + 64)
        f.write((257).to_bytes(8, "little"))
    index, data = segment_file.read_pairs(spark, str(folder))
    assert [(r.base, r.idx) for r in headers.header_pairs(index, data).where("pair = 'mismatch'").collect()] == [(1, 2)]
    assert [(r.base, r.idx, r.flags) for r in headers.reconcile_removed(index, data).where("fixed").collect()] == [(1, 2, 257)]
    # a hole of zeros between records is passed over
    raw = (folder / "data-0.0").read_bytes()
    cut = at[0, 3]
    moved = b"".join(segment_file.pack_record(r[2], r[3], cut + 200 + at[0, i] - cut)[1] for i, r in enumerate(rows[:6]) if i >= 3)
    (folder / "data-0.0").write_bytes(raw[:cut] + b"\0" * 200 + moved)
    got = segment_file.read_data(spark, str(folder)).where("base = 0").collect()
    assert sorted(bytes(r.key) for r in got) == sorted(r[2] for r in rows if r[0] == 0)
    # indexes of odd sizes, and empty sorted ones, are refused by themselves
    with open(folder / "data-0.1.index", "ab") as f:
        f.write(b"x")
    (folder / "data-0.0.index.sorted").write_bytes(b"")
    assert [(r.base, r.validity) for r in segment_file.read_index(spark, str(folder)).where("idx is null").collect()] == [(1, "EBADF")]
    assert [(r.base, r.validity) for r in segment_file.read_index(spark, str(folder), "sorted").collect()] == [(0, "EBADF")]
    assert {r.base: r.file.rsplit(".", 1)[1] for r in segment_file.files_of(spark, str(folder), "best").collect()} == {0: "sorted", 1: "index"}


def test_store_compaction_takes_effect(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"))
    for i in range(4):
        s.write_hashed(f"k{i}", b"old")
    s.prepare(key_of("p"), 10)
    s.plain_write(key_of("p"), b"half")
    s.remove_hashed("k0")
    before = {bytes(r.key): (bytes(r.data), r.kind) for r in s.current(True).collect()}
    assert s.defrag_status() == "not_started"
    s.start_defrag()
    assert s.generation() == 1 and {bytes(r.key): (bytes(r.data), r.kind) for r in s.current(True).collect()} == before
    assert s.oplog().where("op = 'write'").count() == 0
    s.commit(key_of("p"), 4)
    s.insert(key_of("k1"), b"x")
    s.update(key_of("k9"), b"x")
    s.upsert(key_of("k2"), b"new")
    assert s.read_hashed("p") == b"half" and s.read_hashed("k2") == b"new" and sorted(r.error for r in s.errors().collect()) == ["EEXIST", "ENOENT"]
    files.claim(spark, f"{s.path}/_defrag")  # as if another process were at it
    for _ in range(2):
        with pytest.raises(OSError, match="EALREADY"):
            s.start_defrag()
    s.stop_defrag()
    with pytest.raises(OSError, match="EALREADY"):
        s.stop_defrag()
    s.start_defrag("compact")
    assert len(s.vacuum()) == 1 and s.read_hashed("k2") == b"new" and s.elements() == 4
    # a writer whose clock is behind still comes last
    late = Store(spark, s.path)
    late._seq = 5
    late.write_hashed("k2", b"later")
    assert s.read_hashed("k2") == b"later"


def test_store_surface(spark, tmp_path):
    path = str(tmp_path / "store")
    with Store(spark, path, StoreConfig(records_in_blob=2), exclusive=True) as s:
        with pytest.raises(OSError, match="EB0000"):
            Store(spark, path, exclusive=True)
        for i in range(5):
            s.write(bytes([i]) * 64, b"v%d" % i)
        s.write(b"e" * 64, b"body", ext=b"head")
        assert s.read_extended(b"e" * 64) == (b"head", b"body") and s.read(b"e" * 64) == b"body"
        where = s.write_return(bytes([9]) * 64, b"ninth")
        assert where.data_size == 5 and where.data_offset == where.position + 96
        with pytest.raises(KeyError):
            s.locate(b"none")
        seen = []
        assert s.each_in_range(b"\0" * 64, b"\xff" * 64, lambda k, d: seen.append(d) or len(seen) == 3) == 3 and seen == [b"v0", b"v1", b"v2"]
        made = s.process(lambda own, k, d: own.append(d) or [(len(own), d)], "n int, d binary", start=list)
        assert sorted(bytes(r.d) for r in made.collect()) == sorted([b"v0", b"v1", b"v2", b"v3", b"v4", b"body", b"ninth"])
        assert s.verify_records().count() == 0
        doc = json.loads(s.statistics_json())
        assert doc["summary_stats"]["records_total"] == 7 and len(doc["base_stats"]) == 4 and doc["config"]["records_in_blob"] == 2 and "bsize" in doc["vfs"]
        doc["timestamp"]["tv_sec"] -= 100
        files.create_text(spark, f"{path}/data.stat.json", json.dumps(doc), overwrite=True)
        assert json.loads(s.statistics_json())["error"]["code"] == 110
        assert s.periodic() and not s.periodic()
        text = files.read_text(spark, f"{path}/data.stat")
        assert text.startswith("GLOBAL:\ndatasort_start_time: 0\n") and "\nBASE: data-0.3\nrecords_total: 1\n" in text
        assert s.size() > 0
        s.remove_blobs()
        assert s.elements() == 0 and files.exists(spark, f"{path}/_lock")
    Store(spark, path, exclusive=True).close()
    with pytest.raises(ValueError):
        Store(spark, path, StoreConfig(defrag_percentage=101))


def test_log_lines_carry_their_trace():
    lines = []

    class Kept(logging.Handler):
        def emit(self, record):
            lines.append(self.format(record))

    out = siltlog_log.logger("notice", Kept())
    with siltlog_log.trace(0xAB):
        out.log(siltlog_log.NOTICE, "seen")
        out.debug("not seen")
    assert len(lines) == 1 and " 00000000000000ab NOTICE: seen" in lines[0]


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_bloom_places_are_deduplicated_in_small_parts(spark, sf):
    made = catalogue.queries()["bloom_filter"](spark, sf)
    aggregate, *below = [line for line in plan_of(made).splitlines() if "HashAggregate" in line or "Exchange" in line]
    assert "HashAggregate" in aggregate and "HashAggregate" in below[0]
    # no table of places before they are dealt out, and none is sent to all
    assert all("REPARTITION_BY_NUM" in line for line in below[1:]) and len(below) == 3


def test_bloom_lookup_meets_by_base(spark):
    key = lambda i: bytes([i]) * 32
    rows = [(b, key(i), 0) for b in (1, 2) for i in range(b * 20, b * 20 + 20)] + [(3, key(1), 1), (None, key(2), 0)]
    filters = bloom.build(spark.createDataFrame(rows, "base long, key binary, flags long"))
    asked = spark.createDataFrame([(1, key(20)), (1, key(20)), (2, key(20)), (2, key(45)), (3, key(1)), (4, key(1)), (None, key(2))], "base long, key binary")
    found = bloom.may_contain(asked, filters)
    assert sorted((r.base, bytes(r.key)) for r in found.collect()) == [(1, key(20)), (2, key(45))]
    assert "Broadcast" not in plan_of(found)


def test_cuts_of_ranges_come_from_all_keys(spark, tmp_path):
    spark.range(0, 400_000, 1, 4).select(F.col("id").alias("k")).write.parquet(f"{tmp_path}/rows")
    rows = spark.read.parquet(f"{tmp_path}/rows")
    table = spark.createDataFrame([(0, 399_998), (5, 6)], "start long, end long")
    found = reads.in_ranges(rows, table, "k")
    found.write.parquet(f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 399_999
    many = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert max(many) < 250_000


def test_index_report_deals_records_out_once(spark, sf):
    plan = plan_of(catalogue.queries()["sorted_index_report"](spark, sf))
    shuffles = [line for line in plan.splitlines() if "Exchange" in line]
    assert len(shuffles) == 1 and "REPARTITION_BY_NUM" in shuffles[0]


def test_hashing_joins_only_pieces_of_a_batch():
    import tracemalloc

    rng = random.Random(5)
    values = [rng.randbytes(rng.choice([0, 7, 9000, 9001])) for _ in range(14_000)]
    want = [checksum.footer_of(v) for v in values[-3:]]
    tracemalloc.start()
    chunks, final = checksum.footers(values)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [(c.tolist(), int(f)) for c, f in zip(chunks[-3:], final[-3:])] == want
    assert peak < 32 << 20 < sum(map(len, values)) // 1.5
