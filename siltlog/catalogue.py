"""The registered queries of the record-log engine and the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import bloom, checksum
from .functions import records as fr
from .operators import headers, maintain, reads, segments, state, stats
from .plans.store import Store
from .sources import segment_file
from .sources.adapters import event_log, item_records, table
from .streaming import fold as streaming

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# SQL of the adapters, for the comparisons.
LOG = """log as (select event_id as seq, 'user-' || user_id as key, case event_type when 'click' then 'write' when 'view' then 'append' when 'purchase' then 'write' when 'signup' then 'append' else 'remove' end as op,
  case event_type when 'purchase' then 4 when 'signup' then 2 else 0 end as off, event_type || ':' || props as data from events)"""
STATE = LOG + """, st as (select key, list_reduce(list({'s': seq, 'op': op, 'off': off, 'd': data} order by seq), lambda a, o: {'s': o.s, 'op': case when o.op = 'remove' then 'gone' else 'live' end, 'off': 0,
  'd': case when o.op = 'remove' then '' when o.op = 'append' then rpad(a.d, (length(a.d) + o.off)::int, chr(0)) || o.d else rpad(a.d, o.off::int, chr(0)) || o.d end}, {'s': 0::bigint, 'op': 'gone', 'off': 0, 'd': ''}) as v from log group by key),
  cur as (select key, v.d as data, length(v.d)::bigint as data_size from st where v.op = 'live')"""
RECORDS = """rec as (select base, idx, key, flags, data_size, data_size + 96 + case when data_size = 0 then 0 else ((data_size - 1) // 1048576 + 2) * 8 end as disk_size from (
  select l_orderkey // 1000 as base, row_number() over (partition by l_orderkey // 1000 order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) - 1 as idx,
  l_orderkey || '-' || l_linenumber as key, case when l_returnflag = 'R' then 1 else 256 end::bigint as flags, l_quantity::bigint * 10 as data_size from lineitem))"""
STATS = RECORDS + """, bs as (select base, count(*) as records_total, count(*) filter (where flags & 1 <> 0) as records_removed, coalesce(sum(disk_size + 96) filter (where flags & 1 <> 0), 0)::bigint as records_removed_size, sum(disk_size + 96)::bigint as base_size from rec group by base)"""


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _log(spark, sf, machine=False):
    return event_log(table(spark, sf, "events"), machine)


def _state(spark, sf):
    return state.current(_log(spark, sf)).withColumn("data", F.decode("data", "UTF-8"))


def _records(spark, sf, dealt=False):
    return item_records(table(spark, sf, "lineitem"), dealt)


@query(f"with {STATE} select key, data, data_size from cur")
def current_state(spark, sf):
    return _state(spark, sf).select("key", "data", "data_size")


MACHINE = """log as (select event_id as seq, 'user-' || user_id as key, case event_type when 'click' then 'write' when 'view' then 'append' when 'error' then 'remove' when 'purchase' then 'commit' else case when event_id % 2 <> 0 then 'plain_write' else 'prepare' end end as op, event_type || ':' || props as d from events),
  st as (select key, list_reduce(list({'op': op, 'd': d, 'n': 0::bigint, 'e': 0::bigint} order by seq), lambda a, o: {
  'op': case o.op when 'remove' then 'absent' when 'prepare' then 'uncommitted' when 'plain_write' then a.op when 'commit' then case when a.op = 'uncommitted' then 'committed' else a.op end else 'committed' end,
  'd': case o.op when 'write' then o.d when 'append' then case when a.op = 'uncommitted' then left(a.d, a.n::int) else a.d end || o.d when 'remove' then '' when 'prepare' then a.d
    when 'plain_write' then case when a.op = 'uncommitted' then o.d || substr(a.d, length(o.d)::int + 1) else a.d end else case when a.op = 'uncommitted' then left(a.d, a.n::int) else a.d end end,
  'n': case when o.op = 'prepare' then case when a.op = 'uncommitted' then a.n else length(a.d)::bigint end when o.op = 'plain_write' and a.op = 'uncommitted' then a.n else 0 end,
  'e': a.e + case when o.op in ('plain_write', 'commit') and a.op <> 'uncommitted' then 1 when o.op = 'remove' and a.op = 'absent' then 1 else 0 end},
  {'op': 'absent', 'd': '', 'n': 0::bigint, 'e': 0::bigint}) as v from log group by key)"""


@query(f"with {MACHINE} select key, v.op as kind, v.d as buffer, v.n as reserved_length, v.e as n_errors from st")
def state_machine(spark, sf):
    s = state.fold(_log(spark, sf, True))
    return s.select("key", F.col("state.kind").alias("kind"), F.decode("state.buf", "UTF-8").alias("buffer"), F.col("state.n").alias("reserved_length"), F.size("state.errors").cast("long").alias("n_errors"))


@query(f"with {MACHINE} select sum(v.e)::bigint as n_errors, count(*) filter (where v.e > 0) as n_keys from st")
def op_errors(spark, sf):
    return state.errors(_log(spark, sf, True)).agg(F.count(F.lit(1)).alias("n_errors"), F.countDistinct("key").alias("n_keys"))


@query(f"with {LOG} select key, op, seq from (select key, op, seq, row_number() over (partition by key order by seq desc) as r from log) where r = 1")
def latest_version(spark, sf):
    return state.latest_version(_log(spark, sf), ["key"], [F.col("seq").desc()]).where("version_rank = 1").select("key", "op", "seq")


@query(f"with {LOG} select key, seq, version_rank from (select key, seq, row_number() over (partition by key order by seq desc) as version_rank from log) where version_rank > 1")
def superseded_versions(spark, sf):
    return state.latest_version(_log(spark, sf), ["key"], [F.col("seq").desc()]).where("version_rank > 1").select("key", "seq", F.col("version_rank").cast("long").alias("version_rank"))


@query("select o_orderkey, o_custkey, o_totalprice from orders where o_orderkey = 7")
def point_lookup(spark, sf):
    return reads.lookup(table(spark, sf, "orders").withColumnRenamed("o_orderkey", "key"), 7).select(F.col("key").alias("o_orderkey"), "o_custkey", "o_totalprice")


@query(f"with {STATE} select key, data_size from cur where key in (select 'user-' || c_custkey from customer where c_custkey % 3 = 0)")
def multi_get(spark, sf):
    keys = table(spark, sf, "customer").where("c_custkey % 3 = 0").select(F.concat(F.lit("user-"), F.col("c_custkey")).alias("key"))
    return reads.multi_get(_state(spark, sf), keys).select("key", "data_size")


@query(f"with {STATE} select key from (select 'user-' || c_custkey as key from customer) k where not exists (select 1 from cur where cur.key = k.key)")
def missing_keys(spark, sf):
    return reads.missing(_state(spark, sf), table(spark, sf, "customer").select(F.concat(F.lit("user-"), F.col("c_custkey")).alias("key")))


@query(f"with {STATE} select key, case when data_size > 3 then substr(data, 4, 10) end as slice, case when data_size <= 3 then 'E2BIG' end as error from cur")
def read_slice(spark, sf):
    part, error = reads.read_slice(F.encode("data", "UTF-8"), 3, 10)
    return _state(spark, sf).select("key", F.decode(part, "UTF-8").alias("slice"), error.alias("error"))


@query("select o_orderkey, o_totalprice from orders where o_orderkey between 100 and 900 order by o_orderkey limit 50 offset 20")
def range_read_limit(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("key"), "o_totalprice")
    return reads.read_range(rows, 100, 900, 20, 50).withColumnRenamed("key", "o_orderkey")


@query("select distinct sha256('user-' || user_id) as key from events where (sha256('user-' || user_id) between '00' and '40') or (sha256('user-' || user_id) between 'c0' and 'f0')")
def multi_range_scan(spark, sf):
    keys = table(spark, sf, "events").select("user_id").distinct().select(F.sha2(F.concat(F.lit("user-"), F.col("user_id")), 256).alias("key"))
    return reads.multi_range(keys, [("00", "40"), ("c0", "f0")])


@query("select count(*) as n, sum(o_orderkey)::bigint as s from orders where (o_orderkey % 100 <= 10) and o_orderkey // 100 < 90")
def many_ranges_scan(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("key"))
    return reads.multi_range(rows, [(100 * i, 100 * i + 10) for i in range(90)]).agg(F.count(F.lit(1)).alias("n"), F.sum("key").alias("s"))


@query(f"with {RECORDS} select base, idx, key, data_size from rec where flags & 1 = 0")
def scan_live_headers(spark, sf):
    return reads.scan(_records(spark, sf)).select("base", "idx", "key", "data_size")


@query(f"with {RECORDS} select base, idx, key, flags from rec where base >= 2 and base < 5")
def scan_base_window(spark, sf):
    return reads.scan(_records(spark, sf), True, (2, 5)).select("base", "idx", "key", "flags")


@query("select doc_id, n_chars from documents where starts_with(sha256(doc_id::varchar), 'a')")
def prefix_scan(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "n_chars", F.sha2(F.col("doc_id").cast("string"), 256).alias("key"))
    return reads.prefix(rows, "a").select("doc_id", "n_chars")


@query("select doc_id from documents where regexp_matches(text, '[A-Za-z0-9]+@[a-z]+')")
def regex_scan(spark, sf):
    return reads.matching(table(spark, sf, "documents"), "[A-Za-z0-9]+@[a-z]+", "text").select("doc_id")


@query("select c_custkey, sha256(c_name) as key_hex from customer")
def hashed_key(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", F.sha2("c_name", 256).alias("key_hex"))


@query()
def hashed_key_sha512(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", fr.key_of(F.col("c_name")).alias("key"), fr.hex_of(fr.key_of(F.col("c_name"))).alias("key_hex"))


@query(f"with {RECORDS} select count(*) as total, count(*) filter (where flags & 1 <> 0) as removed from rec")
def index_info(spark, sf):
    return _records(spark, sf).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("flags").bitwiseAND(F.lit(1)) != 0).alias("removed"))


@query(f"with {STATS} select * from bs")
def base_stats(spark, sf):
    return stats.base_stats(_records(spark, sf))


@query(f"with {STATS} select * from bs union all select null, sum(records_total)::bigint, sum(records_removed)::bigint, sum(records_removed_size)::bigint, sum(base_size)::bigint from bs")
def stats_rollup(spark, sf):
    return stats.with_summary(_records(spark, sf))


@query(f"with {LOG} select count(*) filter (where op in ('write', 'append')) as writes_number, coalesce(sum(length(data)) filter (where op in ('write', 'append')), 0)::bigint as writes_size, count(*) filter (where op = 'remove') as removes_number from log")
def global_stats(spark, sf):
    return stats.global_stats(_log(spark, sf))


DEFRAG = STATS + """, wd as (select base, case when base = max(base) over () then 0 when records_total = records_removed then 2 when records_removed_size >= base_size * 25 // 100 then 1
  when base_size - records_removed_size < 100000 then 3 else 0 end as code, base_size, records_total - records_removed as live from bs)"""


def _decisions(spark, sf):
    s = stats.base_stats(_records(spark, sf)).select("base", F.col("records_total").alias("total"), F.col("records_removed").alias("removed"), F.col("base_size").alias("size"), F.col("records_removed_size").alias("removed_size"))
    return maintain.want_defrag(s.withColumn("index_size", F.col("total") * 96), 1_000_000)


@query(f"with {DEFRAG} select base, code, case code when 0 then 'not_needed' when 1 then 'needed' when 2 then 'can_be_removed' else 'can_be_merged' end as decision from wd")
def want_defrag(spark, sf):
    return _decisions(spark, sf).select("base", "code", "decision")


@query(f"""with recursive {DEFRAG}, c as (select base, base_size as z, live, row_number() over (order by base) as r from wd),
  g as (select r, base, 0::bigint as grp, z::hugeint as z, live::hugeint as n from c where r = 1 union all
  select c.r, c.base, case when c.live = 0 or (g.n + c.live <= 9000 and g.z + c.z <= 3000000) then g.grp else g.grp + 1 end, case when c.live = 0 or (g.n + c.live <= 9000 and g.z + c.z <= 3000000) then g.z + c.z else c.z end,
  case when c.live = 0 or (g.n + c.live <= 9000 and g.z + c.z <= 3000000) then g.n + c.live else c.live end from g join c on c.r = g.r + 1)
  select base, grp from g""")  # fmt: skip
def defrag_groups(spark, sf):
    return maintain.pack(_decisions(spark, sf).select("base", "size", (F.col("total") - F.col("removed")).alias("live")), 3_000_000, 9000)


@query("select o_orderkey, (row_number() over (order by o_orderkey) - 1) // 700 as base from orders")
def segment_by_count(spark, sf):
    return segments.by_count(table(spark, sf, "orders").select("o_orderkey"), F.expr("o_orderkey div 5000"), ["o_orderkey"], 700).select("o_orderkey", "base")


@query("""with s as (select o_orderkey // 1000 as stream, list({'o': o_orderkey, 'z': o_totalprice::bigint, 'b': 0::bigint, 'u': 0::bigint} order by o_orderkey) as r from orders group by 1),
  f as (select stream, list_reduce(r, lambda a, o: list_append(a, {'o': o[1].o, 'z': o[1].z, 'b': case when a[-1].u >= 1000000 then a[-1].b + 1 else a[-1].b end, 'u': case when a[-1].u >= 1000000 then o[1].z else a[-1].u + o[1].z end}), [{'o': -1::bigint, 'z': 0::bigint, 'b': 0::bigint, 'u': 0::bigint}]) as x from (select stream, list_transform(r, lambda e: [e]) as r from s))
  select stream, y.o as o_orderkey, y.b as base from (select stream, unnest(x[2:]) as y from f)""")  # fmt: skip
def segment_by_bytes(spark, sf):
    rows = table(spark, sf, "orders").select(F.expr("o_orderkey div 1000").alias("stream"), "o_orderkey", F.round("o_totalprice").cast("long").alias("z"))
    return segments.by_bytes(rows, ["stream"], "o_orderkey", "z", 1_000_000)


@query(f"with {RECORDS} select base, idx, (sum(disk_size) over (partition by base order by idx) - disk_size)::bigint as position from rec")
def record_positions(spark, sf):
    return segments.positions(_records(spark, sf, True)).select("base", "idx", "position")


@query(f"with {RECORDS} select base, n // 40 as block, min(key) as start_key, max(key) as end_key, count(*) as n from (select base, key, row_number() over (partition by base order by key, idx) - 1 as n from rec) group by 1, 2")
def index_blocks(spark, sf):
    return segments.blocks(_records(spark, sf, True))


@query(f"with {RECORDS} select base, idx, key, p as previous_key from (select base, idx, key, lag(key) over (partition by base order by idx) as p from rec) where p > key")
def sort_check(spark, sf):
    return segments.unsorted_at(_records(spark, sf, True)).select("base", "idx", "key", "previous_key")


@query(f"with {RECORDS} select base, key, count(*) as n from rec group by 1, 2 having count(*) > 1")
def duplicate_keys(spark, sf):
    return segments.duplicates(_records(spark, sf))


@query(f"with {RECORDS} select base, idx, key from rec where flags & 1 = 0 and key not in (select o_orderkey || '-1' from orders where o_orderstatus = 'F')")
def compact_live(spark, sf):
    gone = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.concat(F.col("o_orderkey"), F.lit("-1")).alias("key"))
    return maintain.compact(_records(spark, sf), gone).select("base", "idx", "key")


@query(f"with {RECORDS} select base, idx, row_number() over (partition by base order by key, flags & 1 desc, idx) - 1 as pos from rec")
def index_sort(spark, sf):
    return maintain.index_order(_records(spark, sf, True)).select("base", "idx", F.col("pos").cast("long").alias("pos"))


MERGE = RECORDS + """, p as (select *, (sum(disk_size) over (partition by base order by idx) - disk_size)::bigint as position, (sum(disk_size) over (partition by base) - case when base % 2 = 0 then 200 else 0 end)::bigint as file_size from rec),
  m as (select *, case when (disk_size < data_size + 96 and disk_size <> 96) or position + disk_size > file_size then 'broken' when flags & 1 <> 0 then 'removed' when disk_size <= 96 then 'broken' else 'written' end as class from p)"""


def _merge_input(spark, sf):
    p = segments.positions(_records(spark, sf, True))
    size = F.sum("disk_size").over(Window.partitionBy("base")) - F.when(F.col("base") % 2 == 0, 200).otherwise(0)
    return p.withColumn("file_size", size).withColumn("input", F.col("base")).withColumn("target", F.expr("base div 4"))


@query(f"with {MERGE} select base // 4 as target, key, base, idx, (sum(disk_size) over (partition by base // 4 order by key, base, idx) - disk_size)::bigint as new_position from m where class = 'written'")
def merge_bases(spark, sf):
    return maintain.merge(_merge_input(spark, sf)).select("target", "key", "base", "idx", "new_position")


@query(f"with {MERGE} select class, count(*) as n from m group by 1")
def merge_report(spark, sf):
    return maintain.merge_class(_merge_input(spark, sf)).groupBy("class").agg(F.count(F.lit(1)).alias("n"))


@query("select doc_id, case when strlen(text) = 0 then 0 else ((strlen(text) - 1) // 1048576 + 2) * 8 end::bigint as footer, (96 + strlen(text) + case when strlen(text) = 0 then 0 else ((strlen(text) - 1) // 1048576 + 2) * 8 end)::bigint as disk_size from documents")
def footer_size(spark, sf):
    n = F.octet_length("text").cast("long")
    return table(spark, sf, "documents").select("doc_id", fr.footer_size(n).alias("footer"), fr.disk_size(n).alias("disk_size"))


@query("select p_partkey, '0x' || lower(hex(f)) || ' [' || array_to_string(list_filter([case when f & 1 <> 0 then 'remove' end, case when f & 2 <> 0 then 'nocsum' end, case when f & 4 <> 0 then 'compress' end, case when f & 8 <> 0 then 'write_return' end, case when f & 16 <> 0 then 'append' end, case when f & 32 <> 0 then 'overwrite' end, case when f & 64 <> 0 then 'exthdr' end, case when f & 128 <> 0 then 'uncommitted' end, case when f & 256 <> 0 then 'chunked_csum' end], lambda x: x is not null), '|') || ']' as flags from (select p_partkey, (p_partkey % 512)::bigint as f from part)")
def flag_render(spark, sf):
    return table(spark, sf, "part").select("p_partkey", fr.render_flags((F.col("p_partkey") % 512).cast("long")).alias("flags"))


# checksums and key hashes

# MurmurHash64A of the words w (little-endian), the tail t and the length n, in 128-bit numbers; fixed values of the hash.
TWO64, MUL = "18446744073709551616::uhugeint", "14313749767032793493::uhugeint"


def _murmur_sql(words: str, tail: str, n: str) -> str:
    mul = lambda x: f"((({x}) * {MUL}) % {TWO64})"
    word = lambda k: f"xor({mul(k)}, {mul(k)} >> 47)"
    body = f"list_reduce(list_concat([{mul(f'({n})::uhugeint')}], {words}), lambda h, k: {mul(f'xor(h, {mul(word("k"))})')})"
    whole = f"case when ({n}) % 8 = 0 then {body} else {mul(f'xor({body}, {tail})')} end"
    end = f"(select xor(y, y >> 47) from (select {mul('xor(x, x >> 47)')} as y from (select {whole} as x)))"
    return f"(select (case when z >= 9223372036854775808::uhugeint then z::hugeint - 18446744073709551616::hugeint else z::hugeint end)::bigint from (select {end} as z))"


def _words_sql(bytes_: str, count: str) -> str:
    """`count` little-endian 8-byte words of a list of byte values."""
    return f"list_transform(range(({count})::bigint), lambda i: list_sum(list_transform(range(8), lambda j: {bytes_}[i * 8 + j + 1]::hugeint * (1::hugeint << (8 * j)::int)))::uhugeint)"


ASCII = "list_transform(range(length(c_name)), lambda i: ascii(substr(c_name, i::int + 1, 1)))"
TAIL = "(coalesce(list_sum(list_transform(range(length(c_name) % 8), lambda j: b[length(c_name) // 8 * 8 + j + 1]::hugeint * (1::hugeint << (8 * j)::int))), 0)::uhugeint)"
CHUNK_SQL = f"c as (select c_custkey, {_murmur_sql(_words_sql('b', 'length(c_name) // 8'), TAIL, 'length(c_name)')} as chunk from (select *, {ASCII} as b from customer))"
AS_WORD = "[case when chunk < 0 then (chunk::hugeint + 18446744073709551616::hugeint)::uhugeint else chunk::uhugeint end]"


@query(f"with {CHUNK_SQL} select c_custkey, chunk, 1::bigint as n_chunks, {_murmur_sql(AS_WORD, '0::uhugeint', '8')} as final from c")
def record_footer(spark, sf):
    made = table(spark, sf, "customer").select("c_custkey", checksum.footer(F.encode("c_name", "UTF-8")).alias("f"))
    return made.select("c_custkey", F.get("f.chunks", F.lit(0)).alias("chunk"), F.size("f.chunks").cast("long").alias("n_chunks"), "f.final")


HEX_BYTES = "list_transform(range(64), lambda i: case when i < 32 then ('0x' || substr(h, (2 * i + 1)::int, 2))::int else 0 end)"
KEY_BYTES = f"kb as (select c_custkey, c_custkey // 200 as base, {HEX_BYTES} as b from (select c_custkey, sha256(c_name) as h from customer))"


def _customer_keys(spark, sf):
    key = F.rpad(F.unhex(F.sha2("c_name", 256)), 64, F.expr("X'00'"))
    return table(spark, sf, "customer").select("c_custkey", F.expr("c_custkey div 200").alias("base"), key.alias("key"), F.when(F.col("c_custkey") % 4 == 0, 1).otherwise(0).cast("long").alias("flags"))


@query(f"with {KEY_BYTES} select c_custkey, {_murmur_sql(_words_sql('b', '8'), '0::uhugeint', '64')} as hash from kb")
def key_hash(spark, sf):
    return _customer_keys(spark, sf).select("c_custkey", checksum.murmur("key").alias("hash"))


BLOOM_SIZE, BLOOM_FUNCS = "((n // 40 + 1) * 5120 // 8)", "greatest(1, least(20, floor(floor(8 * size / n) * 0.69)))::int"
BLOOM = f"""{KEY_BYTES}, nb as (select base, count(*) as n, {BLOOM_SIZE.replace('n //', 'count(*) //')} as size from kb group by base),
  hb as (select kb.c_custkey, kb.base, size, {BLOOM_FUNCS} as funcs, (list_sum(b[1:8]) % size)::hugeint as h1,
  (list_reduce(list_concat([14695981039346656037::uhugeint], list_transform(b, lambda x: x::uhugeint)), lambda h, x: (xor(h, x) * 1099511628211::uhugeint) % {TWO64}) % size::uhugeint)::hugeint as h2 from kb join nb on kb.base = nb.base),
  pb as (select c_custkey, base, size, funcs, unnest(list_concat([h1, h2], list_transform(range(2, funcs), lambda i: (h1 + i * h2) % size)))::bigint as place from hb)"""


@query(f"with {BLOOM} select distinct base, size::bigint as size, funcs, place from pb where c_custkey % 4 <> 0")
def bloom_filter(spark, sf):
    return bloom.build(_customer_keys(spark, sf))


@query(f"with {BLOOM}, f as (select distinct base, place from pb where c_custkey % 4 <> 0), held as (select c_custkey, pb.base, min(case when f.place is null then 0 else 1 end) as every from pb left join f on f.base = pb.base and f.place = pb.place group by 1, 2) select c_custkey from held where every = 1")
def bloom_lookup(spark, sf):
    keys = _customer_keys(spark, sf)
    return bloom.may_contain(keys.select("base", "key"), bloom.build(keys)).join(keys.select("base", "key", "c_custkey").hint("merge"), ["base", "key"]).select("c_custkey")


@query("select c_custkey, list_sum(list_transform(range(8), lambda i: ascii(substr(c_name, i::int + 1, 1))))::bigint as sum8 from customer")
def key_sum(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", bloom.column_sum8(F.encode("c_name", "UTF-8")).alias("sum8"))


@query()
def sha512_range(spark, sf):
    data = F.encode("text", "UTF-8")
    digest, error = checksum.sha512_range(data, (F.col("doc_id") % 50).cast("long"), (F.col("doc_id") % 700).cast("long"))
    return table(spark, sf, "documents").select("doc_id", digest.alias("sha512"), error.alias("error"))


def _stored(spark, sf):
    """Documents as records: every 5th has a byte changed, every 7th no checksum, every 11th no room for one, every 13th is removed, every 17th uncommitted."""
    d = F.col("doc_id")
    n = F.octet_length("text").cast("long")
    docs = table(spark, sf, "documents").where("text is not null").select(d, F.encode("text", "UTF-8").alias("whole"), n.alias("data_size"))
    flags = F.when(d % 7 == 0, 258).otherwise(256) + F.when(d % 13 == 0, 1).otherwise(0) + F.when(d % 17 == 0, 128).otherwise(0)
    docs = docs.select("doc_id", "whole", "data_size", flags.cast("long").alias("flags"), F.when(d % 11 == 0, F.col("data_size") + 96).otherwise(fr.disk_size(F.col("data_size"))).alias("disk_size"), checksum.footer("whole")["chunks"].alias("chunks"))
    broken = (d % 5 == 0) & (F.col("data_size") > 0)
    return docs.withColumn("data", F.when(broken, F.concat(F.expr("X'01'"), F.expr("substring(whole, 2)"))).otherwise(F.col("whole"))).drop("whole")


STORED = """sd as (select doc_id, strlen(text) as n, case when doc_id % 7 = 0 then null when strlen(text) = 0 or doc_id % 11 = 0 then 'EINVAL' when doc_id % 5 = 0 then 'EILSEQ' end as error from documents where text is not null)"""


@query(f"with {STORED} select doc_id, error from sd")
def verify_checksum(spark, sf):
    return _stored(spark, sf).select("doc_id", checksum.verify_error(F.col("data"), F.col("disk_size"), F.col("flags"), F.col("chunks")).alias("error"))


@query(f"with {STORED} select doc_id from sd where doc_id % 13 <> 0 and (error is null or doc_id % 17 = 0)")
def scan_verified(spark, sf):
    return reads.scan_verified(_stored(spark, sf)).select("doc_id")


@query(f"with {STORED} select doc_id, case when e is null then least(10, n - 3) end as size, e as error from (select doc_id, n, coalesce(error, case when n <= 3 then 'E2BIG' end) as e from sd where doc_id % 13 <> 0 and doc_id % 17 <> 0)")
def read_checked(spark, sf):
    return reads.read_checked(_stored(spark, sf), 3, 10).select("doc_id", F.length("part").cast("long").alias("size"), "error")


SEGMENTS = """sg as (select c_custkey // 400 as base, row_number() over (partition by c_custkey // 400 order by c_custkey) - 1 as idx, sha256(c_name) as h, c_name as data, strlen(c_name) as data_size, strlen(c_name) + 96 + 16 as disk_size from customer)"""


@query(f"with {SEGMENTS} select base, idx, h as key_hex, data, data_size, disk_size, (sum(disk_size) over (partition by base order by idx) - disk_size)::bigint as position, 'ok' as validity from sg")
def segment_files(spark, sf):
    """Customers written as segment files and read back by their indexes."""
    path = f"{streaming.shared_path(spark)}/segments"
    order = Window.partitionBy("base").orderBy("c_custkey")
    rows = table(spark, sf, "customer").withColumn("base", F.expr("c_custkey div 400"))
    rows = rows.select("base", (F.row_number().over(order) - 1).cast("long").alias("idx"), F.unhex(F.sha2("c_name", 256)).alias("key"), F.encode("c_name", "UTF-8").alias("data"), F.lit(0).cast("long").alias("flags"))
    segment_file.write_segments(rows, path)
    return segment_file.read_records(spark, path).select("base", "idx", F.lower(F.hex(F.substring("key", 1, 32))).alias("key_hex"), F.decode("data", "UTF-8").alias("data"), "data_size", "disk_size", "position", "validity")


# headers of index and data files

PAIRS = RECORDS + """, ix as (select *, (sum(disk_size) over (partition by base order by idx) - disk_size)::bigint as position, (sum(disk_size) over (partition by base))::bigint as whole from rec),
  dt as (select base, idx, key, case when idx % 17 = 0 then 1 else flags end as flags, case when idx % 19 = 0 then data_size + 1 else data_size end as data_size, case when idx % 29 = 0 then disk_size + 8 else disk_size end as disk_size, position from ix where idx % 23 <> 5),
  pr as (select ix.*, dt.key as d_key, dt.flags as d_flags, dt.data_size as d_data_size, dt.disk_size as d_disk_size from ix left join dt on dt.base = ix.base and dt.position = ix.position)"""


def _both_headers(spark, sf):
    index = segments.positions(_records(spark, sf, True))
    i = F.col("idx")
    data = index.where(i % 23 != 5).withColumns({"flags": F.when(i % 17 == 0, 1).otherwise(F.col("flags")).cast("long"), "data_size": F.when(i % 19 == 0, F.col("data_size") + 1).otherwise(F.col("data_size")), "disk_size": F.when(i % 29 == 0, F.col("disk_size") + 8).otherwise(F.col("disk_size"))})
    return index, data


@query(f"with {PAIRS} select base, idx, case when d_key is null then 'index_only' when key = d_key and flags = d_flags and data_size = d_data_size and disk_size = d_disk_size then 'same' else 'mismatch' end as pair from pr")
def header_pairs(spark, sf):
    return headers.header_pairs(*_both_headers(spark, sf)).select("base", "idx", "pair")


@query(f"with {PAIRS} select base, idx, case when d_flags & 1 <> 0 then flags | 1 else flags end as flags, coalesce(d_flags & 1 <> 0 and flags & 1 = 0, false) as fixed from pr")
def reconcile_removed(spark, sf):
    return headers.reconcile_removed(*_both_headers(spark, sf)).select("base", "idx", "flags", "fixed")


CHECKED = PAIRS + """, ck as (select *, case when disk_size <> 96 and disk_size < data_size + 96 then 'broken' when position + disk_size > whole - 300 then 'broken' when flags & 1 <> 0 then 'removed'
  when d_key is null or key <> d_key or d_disk_size <> disk_size or position + d_disk_size > whole - 300 then 'broken' when d_flags & 1 <> 0 then 'removed' when d_disk_size > 96 then 'written' else 'broken' end as class from pr)"""


def _checked(spark, sf):
    index, data = _both_headers(spark, sf)
    size = F.sum("disk_size").over(Window.partitionBy("base")) - 300
    return headers.merge_validated(index.withColumn("file_size", size).withColumn("input", F.col("base")).withColumn("target", F.expr("base div 4")), data)


@query(f"with {CHECKED} select base, class, count(*) as n from ck group by 1, 2")
def merge_validated(spark, sf):
    return _checked(spark, sf).groupBy("base", "class").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {CHECKED} select base, idx, key, (sum(d_disk_size) over (partition by base // 4 order by key, base, idx) - d_disk_size)::bigint as new_position from ck where class = 'written'")
def merged_positions(spark, sf):
    return headers.merged_positions(_checked(spark, sf)).select("base", "idx", "key", "new_position")


# Entry 90 of every third base is short, every 31st is a hole, and the files of even bases lack their last bytes.
DAMAGED = RECORDS + """, dm as (select base, idx, key, flags, case when idx % 31 = 7 then 0 else data_size end as data_size, case when idx % 31 = 7 then 0 when base % 3 = 0 and idx = 90 then 50 else disk_size end as disk_size,
  (sum(disk_size) over (partition by base order by idx) - disk_size)::bigint as position, (sum(disk_size) over (partition by base))::bigint - case when base % 2 = 0 then 500 else 0 end as file_size from rec),
  jd as (select *, case when data_size = 0 and disk_size = 0 then 'hole' when disk_size < data_size + 96 then 'short' when position + disk_size > file_size then 'outside' else 'ok' end as validity from dm)"""


def _damaged(spark, sf):
    whole = segments.positions(_records(spark, sf, True)).withColumn("file_size", F.sum("disk_size").over(Window.partitionBy("base")) - F.when(F.col("base") % 2 == 0, 500).otherwise(0))
    hole = F.col("idx") % 31 == 7
    short = (F.col("base") % 3 == 0) & (F.col("idx") == 90)
    return whole.withColumns({"data_size": F.when(hole, 0).otherwise(F.col("data_size")).cast("long"), "disk_size": F.when(hole, 0).when(short, 50).otherwise(F.col("disk_size")).cast("long")})


@query(f"with {DAMAGED} select base, idx from (select *, min(case when validity not in ('ok', 'hole') then idx end) over (partition by base) as bad from jd) where (bad is null or idx < bad) and validity <> 'hole'")
def walk_index(spark, sf):
    return headers.walk_index(_damaged(spark, sf)).select("base", "idx")


@query(f"with {DAMAGED} select base, count(*) as entries, count(*) filter (where validity not in ('ok', 'hole')) as corrupted, case when bool_or(validity not in ('ok', 'hole') and idx % 40 in (0, 39)) then 'EB0001' end as error from (select base, validity, row_number() over (partition by base order by key, idx) - 1 as idx from jd) group by base")
def sorted_index_report(spark, sf):
    ordered = maintain.index_order(_damaged(spark, sf).withColumn("flags", F.lit(256).cast("long")))
    return headers.sorted_index_report(ordered.withColumn("idx", F.col("pos").cast("long")))


@query(f"with {DAMAGED} select base, idx, validity from (select base, idx, case when idx % 5 = 0 and data_size > 0 then 'footer' when idx % 5 = 0 then 'hole' else validity end as validity, disk_size from jd) where validity <> 'ok'")
def validity_report(spark, sf):
    """Every fifth record of 20 MB has no room for the hashes of its chunks."""
    big = F.col("idx") % 5 == 0
    rows = _damaged(spark, sf)
    size = F.when(big & (F.col("data_size") > 0), 20_000_000).otherwise(F.col("data_size"))
    rows = rows.withColumns({"disk_size": F.when(big & (F.col("data_size") > 0), size + 96).otherwise(F.when(big, 0).otherwise(F.col("disk_size"))), "file_size": F.when(big, 1 << 40).otherwise(F.col("file_size")), "flags": F.lit(256).cast("long")}).withColumn("data_size", size)
    v = fr.validity(*(F.col(c) for c in ("data_size", "disk_size", "position", "file_size", "flags")))
    return rows.select("base", "idx", v.alias("validity")).where("validity <> 'ok'")


@query(f"with {RECORDS} select base, idx, lower(hex(encode(substr(key, 1, 6)))) || ': data_size: ' || data_size || ', disk_size: ' || disk_size || ', position: ' || position || ', flags: 0x' || lower(hex(flags)) || case when flags = 1 then ' [remove]' else ' [chunked_csum]' end as line from (select *, (sum(disk_size) over (partition by base order by idx) - disk_size)::bigint as position from rec)")
def header_lines(spark, sf):
    return segments.positions(_records(spark, sf, True)).select("base", "idx", fr.render_header(*(F.col(c) for c in ("key", "flags", "data_size", "disk_size", "position"))).alias("line"))


@query(f"with {RECORDS} select key, base, idx, position, position + 96 as data_offset, data_size, disk_size, flags from (select *, (sum(disk_size) over (partition by base order by idx) - disk_size)::bigint as position from rec) where flags & 1 = 0")
def record_locations(spark, sf):
    return reads.locations(reads.scan(segments.positions(_records(spark, sf, True))))


@query(f"with {RECORDS} select base, idx, key from rec where flags & 1 = 0 and base % 2 <> 0")
def scan_unsorted(spark, sf):
    return reads.scan(_records(spark, sf).withColumn("base_sorted", F.col("base") % 2 == 0), unsorted_only=True).select("base", "idx", "key")


@query(f"with {RECORDS} select count(*) filter (where flags & 1 = 0) as n from rec")
def total_elements(spark, sf):
    return reads.scan(_records(spark, sf)).agg(F.count(F.lit(1)).alias("n"))


@query(f"with {RECORDS}, b as (select base, base % 3 <> 0 as sorted, count(*) over (order by base desc) as loops, count(*) filter (where base % 3 = 0) over (order by base desc) as no_sort from (select distinct base from rec)), k as (select distinct 'x' as x, o_orderkey || '-1' as key from orders where o_orderkey % 40 < 20), h as (select k.key, max(rec.base) as base from k left join rec on rec.key = k.key and rec.flags & 1 = 0 and rec.base % 3 <> 0 group by 1) select h.key, coalesce(b.loops, (select count(*) from b)) as loops, coalesce(b.no_sort, (select count(*) from b where not sorted)) as no_sort, h.base is not null as found from h left join b on b.base = h.base")
def lookup_trace(spark, sf):
    records = _records(spark, sf)
    bases = records.select("base").distinct().withColumn("sorted", F.col("base") % 3 != 0)
    keys = table(spark, sf, "orders").where("o_orderkey % 40 < 20").select(F.concat(F.col("o_orderkey"), F.lit("-1")).alias("key"))
    return reads.lookup_trace(keys, records, bases)


@query("select o_orderkey from orders where exists (select 1 from (select c_custkey * 37 as s, c_custkey * 37 + c_custkey % 9 as e from customer) r where o_orderkey between s and e)")
def range_table_scan(spark, sf):
    ranges = table(spark, sf, "customer").select((F.col("c_custkey") * 37).alias("start"), (F.col("c_custkey") * 37 + F.col("c_custkey") % 9).alias("end"))
    return reads.in_ranges(table(spark, sf, "orders").select("o_orderkey"), ranges, "o_orderkey")


PIECES = "list({'o': l_linenumber * 100, 'z': l_quantity::bigint} order by l_linenumber)"


@query(f"select l_orderkey, list_min(list_transform(p, lambda x: x.o))::bigint as start_offset, list_max(list_transform(p, lambda x: x.o + x.z))::bigint as end_offset, len(p) < 2 or list_bool_and(list_transform(range(1, len(p)), lambda i: p[i + 1].o = p[i].o + p[i].z)) as contiguous from (select l_orderkey, {PIECES} as p from lineitem group by 1)")
def iovec_bounds(spark, sf):
    piece = F.struct((F.col("l_linenumber") * 100).cast("long").alias("offset"), F.col("l_quantity").cast("long").alias("size"))
    made = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(piece)).alias("p"))
    b = made.select("l_orderkey", fr.iovec_bounds(F.col("p")).alias("b")).where("b.error is null")
    return b.select("l_orderkey", F.col("b.start").alias("start_offset"), F.col("b.end").alias("end_offset"), "b.contiguous")


@query("select l_orderkey, l_linenumber, case when l_linenumber * 100 + l_quantity::bigint > 320 then 'ERANGE' end as error from lineitem")
def raw_write_check(spark, sf):
    error = fr.raw_write_error((F.col("l_linenumber") * 100).cast("long"), F.col("l_quantity").cast("long"), F.lit(320))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", error.alias("error"))


@query("with a as (select o_orderkey as key, o_totalprice as v from orders where o_orderkey % 7 <> 0), b as (select o_orderkey as key, case when o_orderkey % 11 = 0 then 0 else o_totalprice end as v from orders where o_orderkey % 13 <> 0) select coalesce(a.key, b.key) as key, case when a.key is null then 'unexpected' when b.key is null then 'missing' else 'different' end as verdict from a full join b on a.key = b.key where a.v is distinct from b.v or a.key is null or b.key is null")
def shadow_compare(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("v"))
    return reads.compare(orders.where("key % 7 <> 0"), orders.where("key % 13 <> 0").withColumn("v", F.when(F.col("key") % 11 == 0, 0).otherwise(F.col("v"))))


# writes of other kinds

CONDITIONAL = """lg as (select event_id as seq, 'user-' || user_id as key, case event_type when 'click' then 'insert' when 'view' then 'update' when 'purchase' then 'upsert' when 'error' then 'remove' else 'update' end as op, event_type || ':' || props as d from events),
  st as (select key, list_reduce(list({'op': op, 'd': d, 'e': 0::bigint} order by seq), lambda a, o: {'op': case when (o.op = 'insert' and a.op = 'there') or (o.op in ('update', 'remove') and a.op = 'gone') then a.op when o.op = 'remove' then 'gone' else 'there' end,
  'd': case when (o.op = 'insert' and a.op = 'there') or (o.op in ('update', 'remove') and a.op = 'gone') then a.d when o.op = 'remove' then '' else o.d end,
  'e': a.e + case when (o.op = 'insert' and a.op = 'there') or (o.op in ('update', 'remove') and a.op = 'gone') then 1 else 0 end}, {'op': 'gone', 'd': '', 'e': 0::bigint}) as v from lg group by key)"""


@query(f"with {CONDITIONAL} select key, v.op = 'there' as there, v.d as data, v.e as n_errors from st")
def conditional_writes(spark, sf):
    kind = F.col("event_type")
    op = F.when(kind == "click", "insert").when(kind == "purchase", "upsert").when(kind == "error", "remove").otherwise("update")
    ops = event_log(table(spark, sf, "events"), True).drop("op", "size").join(table(spark, sf, "events").select(F.col("event_id").alias("seq"), op.alias("op"), F.lit(-1).cast("long").alias("size")), "seq")
    s = state.fold(ops)
    return s.select("key", (F.col("state.kind") == "committed").alias("there"), F.decode("state.buf", "UTF-8").alias("data"), F.size("state.errors").cast("long").alias("n_errors"))


EXTENDED = """lg as (select event_id as seq, 'user-' || user_id as key, case event_type when 'error' then 'remove' when 'purchase' then 'append' else 'write' end as op, case when event_type in ('click', 'purchase') then 'h' || event_id end as x, event_type || ':' || props as d from events),
  st as (select key, list_reduce(list({'op': op, 'x': x, 'd': d, 'e': 0::bigint} order by seq), lambda a, o: {'op': case when o.op = 'remove' then 'gone' else 'there' end,
  'x': case when o.op = 'remove' then null else coalesce(o.x, a.x) end, 'd': case when o.op = 'remove' then '' when o.x is null and a.x is not null then a.d when o.op = 'append' then a.d || o.d else o.d end,
  'e': a.e + case when (o.op = 'remove' and a.op = 'gone') or (o.op <> 'remove' and o.x is null and a.x is not null) then 1 else 0 end}, {'op': 'gone', 'x': null::varchar, 'd': '', 'e': 0::bigint}) as v from lg group by key)"""


@query(f"with {EXTENDED} select key, v.op = 'there' as there, v.x as ext, v.d as data, v.e as n_errors from st")
def extended_headers(spark, sf):
    kind = F.col("event_type")
    with_ext = kind.isin("click", "purchase")
    op = F.when(kind == "error", "remove").when(kind == "purchase", "append").otherwise("write")
    ops = table(spark, sf, "events").select(F.col("event_id").alias("seq"), F.concat(F.lit("user-"), F.col("user_id")).alias("key"), op.alias("op"), F.lit(0).cast("long").alias("offset"), F.lit(-1).cast("long").alias("size"), F.encode(F.concat("event_type", F.lit(":"), "props"), "UTF-8").alias("data"), F.when(with_ext, fr.EXTHDR).otherwise(0).cast("long").alias("flags"), F.when(with_ext, F.encode(F.concat(F.lit("h"), F.col("event_id")), "UTF-8")).alias("ext"))
    s = state.fold(ops)
    return s.select("key", (F.col("state.kind") == "committed").alias("there"), F.decode("state.ext", "UTF-8").alias("ext"), F.decode("state.buf", "UTF-8").alias("data"), F.size("state.errors").cast("long").alias("n_errors"))


# maintenance and statistics

PLAN = DEFRAG + """, fp as (select wd.*, case when base = max(base) over () then 'skip' when code = 2 then 'remove' when code = 0 and base % 2 = 0 then 'skip' else 'sort' end as act from wd),
  c as (select base, base_size as z, live, row_number() over (order by base) as r from fp where act = 'sort'),
  g as (select r, base, 0::bigint as grp, z::hugeint as z, live::hugeint as n from c where r = 1 union all
  select c.r, c.base, case when c.live = 0 or (g.n + c.live <= 9000 and g.z + c.z <= 3000000) then g.grp else g.grp + 1 end, case when c.live = 0 or (g.n + c.live <= 9000 and g.z + c.z <= 3000000) then g.z + c.z else c.z end,
  case when c.live = 0 or (g.n + c.live <= 9000 and g.z + c.z <= 3000000) then g.n + c.live else c.live end from g join c on c.r = g.r + 1),
  gn as (select base, grp, count(*) over (partition by grp) as many from g),
  dp as (select fp.base, fp.live, case when act = 'sort' and many = 1 and fp.base % 2 = 0 and code is distinct from 1 then 'skip' else act end as action, gn.grp from fp left join gn on gn.base = fp.base)"""


def _plan(spark, sf):
    decided = _decisions(spark, sf).withColumn("is_sorted", F.col("base") % 2 == 0)
    return decided, maintain.defrag_plan(decided, 3_000_000, 9000)


@query(f"with recursive {PLAN} select base, action, case when action = 'sort' then grp end as grp from dp")
def defrag_plan(spark, sf):
    return _plan(spark, sf)[1]


@query(f"with recursive {PLAN} select grp, (sum(live) * 96)::bigint as index_size from dp where action = 'sort' group by grp")
def merged_index_size(spark, sf):
    decided, plan = _plan(spark, sf)
    return maintain.merged_index_bytes(plan, decided)


RUN = PLAN + """, ap as (select dp.base, action, case when action = 'sort' then min(dp.base) over (partition by action, case when action = 'sort' then grp end) else dp.base end as target from dp),
  rp as (select *, (sum(disk_size) over (partition by base order by idx) - disk_size)::bigint as position from rec),
  lv as (select ap.target, ap.action, rp.* from rp join ap on ap.base = rp.base where action <> 'remove' and (action <> 'sort' or flags & 1 = 0))"""


@query(f"with recursive {RUN} select target as base, base as from_base, key, idx, position, false as is_new from lv where action = 'skip' union all select target, base, key, row_number() over (partition by target order by key, base, idx) - 1, (sum(disk_size) over (partition by target order by key, base, idx) - disk_size)::bigint, true from lv where action = 'sort'")
def defrag_run(spark, sf):
    return maintain.apply_plan(segments.positions(_records(spark, sf, True)), _plan(spark, sf)[1]).select("base", "from_base", "key", "idx", "position", "is_new")


@query(f"with {RECORDS} select base, key, idx, (sum(disk_size) over (partition by base order by idx) - disk_size)::bigint as new_position from rec where flags & 1 = 0 and base in (select base from rec where flags & 1 <> 0)")
def compact_bases(spark, sf):
    return maintain.compact_bases(_records(spark, sf)).select("base", "key", "idx", "new_position")


# The nine counters of a base; the bases that 2 divides are sorted, and each 31st header is a corrupt one.
NINE = RECORDS + """, nine as (select base, records_total, records_removed, records_removed_size, records_corrupted, base_size, case when base % 2 = 0 then (records_total // 40 + 1) * 640 else 0 end::bigint as memory_bloom_filter,
  case when base % 2 = 0 then ceil(records_total / 40)::bigint * 144 else 0 end::bigint as memory_index_blocks, case when base = max(base) over () then 0 when records_total = records_removed then 2 when records_removed_size >= base_size * 25 // 100 then 1
  when base_size - records_removed_size < 100000 then 3 else 0 end::bigint as want_defrag, (base % 2 = 0)::int::bigint as is_sorted from (select base, count(*) as records_total, count(*) filter (where flags & 1 <> 0) as records_removed,
  coalesce(sum(disk_size + 96) filter (where flags & 1 <> 0), 0)::bigint as records_removed_size, count(*) filter (where idx % 31 = 3) as records_corrupted, sum(disk_size + 96)::bigint as base_size from rec group by base)),
  total as (select sum(records_total)::bigint as records_total, sum(records_removed)::bigint as records_removed, sum(records_removed_size)::bigint as records_removed_size, sum(records_corrupted)::bigint as records_corrupted, sum(base_size)::bigint as base_size, sum(memory_bloom_filter)::bigint as memory_bloom_filter,
  sum(memory_index_blocks)::bigint as memory_index_blocks, sum(want_defrag)::bigint as want_defrag, sum(is_sorted)::bigint as is_sorted from nine)"""
TWELVE = """lg as (select event_id as seq, 'user-' || user_id as key, case event_type when 'click' then 'write' when 'view' then 'append' when 'error' then 'remove' when 'purchase' then 'commit' else case when event_id % 2 <> 0 then 'plain_write' else 'prepare' end end as op, event_type || ':' || props as d from events),
  th as (select *, coalesce(max(case when op <> 'remove' then seq end) over w > coalesce(max(case when op = 'remove' then seq end) over w, -1), false) as there from lg window w as (partition by key order by seq rows between unbounded preceding and 1 preceding)),
  twelve as (select 11::bigint as datasort_start_time, count(*) filter (where there and op = 'append') as read_copy_updates, count(*) filter (where there and op = 'prepare') as prepare_reused, 72 * 1000::bigint as memory_index_tree, (select count(*) from orders) as lookup_reads_number,
  (select count(*) from orders where o_orderkey % 2 = 0) as data_reads_number, count(*) filter (where op in ('write', 'append', 'plain_write')) as writes_number, (select sum(o_orderkey) from orders where o_orderkey % 2 = 0)::bigint as reads_size,
  coalesce(sum(length(d)) filter (where op in ('write', 'append', 'plain_write')), 0)::bigint as writes_size, (select sum(o_orderkey % 5) from orders)::bigint as index_files_reads_number, 12::bigint as datasort_completion_time, 0::bigint as datasort_completion_status from th)"""
SECTIONS = "nine_long as (unpivot nine on columns(* exclude (base)) into name counter value value), total_long as (unpivot total on columns(*) into name counter value value), twelve_long as (unpivot twelve on columns(*) into name counter value value)"


def _nine(spark, sf):
    records = _records(spark, sf).withColumns({"base_sorted": F.col("base") % 2 == 0, "validity": F.when(F.col("idx") % 31 == 3, "short").otherwise("ok")})
    return stats.all_base_stats(records, 1_000_000)


def _twelve(spark, sf):
    k = F.col("o_orderkey")
    seen = table(spark, sf, "orders").select(F.when(k % 2 == 0, "data").otherwise("lookup").alias("kind"), k.cast("long").alias("size"), (k % 5).cast("long").alias("bases"))
    return stats.all_global_stats(_log(spark, sf, True), seen, 1000, 11, 12)


@query(f"with {NINE} select * from nine")
def all_base_stats(spark, sf):
    return _nine(spark, sf)


@query(f"with {NINE} select * from total")
def summary_stats(spark, sf):
    return stats.summary_of(_nine(spark, sf))


@query(f"with {TWELVE} select * from twelve")
def all_global_stats(spark, sf):
    return _twelve(spark, sf)


@query(f"with {NINE}, {TWELVE}, {SECTIONS} select 'global' as section, null::varchar as name, counter, value from twelve_long union all select 'summary', null, counter, value from total_long union all select 'base', 'data-0.' || base, counter, value from nine_long")
def stats_document(spark, sf):
    return stats.read_document(stats.document(_twelve(spark, sf), _nine(spark, sf)))


@query(f"with {NINE}, {TWELVE}, {SECTIONS} select -2::bigint as part, counter || ': ' || value as line from twelve_long union all select -1, counter || ': ' || value from total_long union all select base, counter || ': ' || value from nine_long union all select -2, 'GLOBAL:' union all select -1, 'SUMMARY:' union all select base, 'BASE: data-0.' || base from nine union all select -2, '' union all select -1, '' union all select base, '' from nine")
def stats_text(spark, sf):
    return stats.text_sections(_twelve(spark, sf), _nine(spark, sf)).select("part", "line")


@query("""select o_orderkey, case when o_orderkey % 60 > 30 then '{"a":1,"error":{"code":110,"message":"cached json is too old","lifetime":' || (o_orderkey % 60) * 1000000 || ',"lifetime_limit":30000000}}' else '{"a":1}' end as json from orders""")
def stats_staleness(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", stats.with_staleness(F.lit('{"a":1}'), F.col("o_orderkey") % 60).alias("json"))


# stream and store

LIVE = f"{MACHINE} select key, v.d as data, length(v.d)::bigint as data_size, v.op as kind from st where v.op <> 'absent'"


@query(f"with {STATE} select key, data, data_size from cur")
def stream_current_state(spark, sf):
    found = streaming.current_from_stream(spark, table(spark, sf, "events").schema, f"{sf}/events.parquet")
    return found.select("key", F.decode("data", "UTF-8").alias("data"), "data_size")


@query(f"with {LIVE}")
def stream_state_machine(spark, sf):
    """The log in batches of its own order: three-stage writes go over several of them."""
    table_ = streaming.StateTable(spark, streaming.shared_path(spark), every=2)
    log = _log(spark, sf, True)
    most = log.agg(F.max("seq")).first()[0] + 1
    for b in range(5):
        table_.apply(log.where((F.col("seq") * 5 >= b * most) & (F.col("seq") * 5 < (b + 1) * most)), b)
    return table_.current(True).withColumn("data", F.decode("data", "UTF-8"))


@query(f"with {LIVE}")
def store_after_defrag(spark, sf):
    """Half of the log, a compaction, the other half."""
    store = Store(spark, streaming.shared_path(spark))
    log = _log(spark, sf, True).withColumn("key", F.encode("key", "UTF-8"))
    half = log.agg(F.max("seq")).first()[0] // 2
    store.append_ops(log.where(F.col("seq") <= half))
    store.start_defrag()
    store.append_ops(log.where(F.col("seq") > half))
    return store.current(True).select(F.decode("key", "UTF-8").alias("key"), F.decode("data", "UTF-8").alias("data"), "data_size", "kind")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
