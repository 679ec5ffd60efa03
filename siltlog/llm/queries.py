"""The registered queries opN_<name> of this folder: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, compression_rules, decontaminate, jaccard_join, langid, line_dedup, mixing, quality, sharding, substring_dedup


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf_dir, "documents"))


def op2_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_grouped_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar(_table(spark, sf_dir, "documents"))


def op4_rff_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_fm_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digests(substring_dedup.dedup_passages(_table(spark, sf_dir, "documents")))


def op6_centroid_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op7_chat_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = r"\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(own).alias("text"))
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digests(chat.read_back(chat.formatted(chat.canonical(chat.records_of(rows)))))


def op8_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digests(line_dedup.dedup_lines(_table(spark, sf_dir, "documents")))


def op9_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(_table(spark, sf_dir, "documents"))


def op10_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression_rules.rate(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_hilbert_sharding, op2_latent_decontamination, op3_grouped_jaccard, op4_rff_quality, op5_fm_passages, op6_centroid_langid, op7_chat_fingerprint, op8_line_chunks, op9_pfair_mixing, op10_compression_bands]
    return {f.__name__: f for f in own}


PASSAGES = r"""with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
  g as (select doc_id, i, array_to_string(ws[i:i + 19], ' ') as win from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 18, 1))) as i from w)),
  f as (select doc_id, i from (select doc_id, i, row_number() over (partition by win order by doc_id, i) as r from g) where r > 1),
  c as (select distinct doc_id, p from (select doc_id, unnest(range(i, i + 20)) as p from f)),
  k as (select w.doc_id, t.p, w.ws[t.p] as word from w, unnest(range(1, len(ws) + 1)) as t(p)),
  s as (select k.doc_id, count(c.p) as n_removed, string_agg(k.word, ' ' order by k.p) filter (where c.p is null) as kept from k left join c on c.doc_id = k.doc_id and c.p = k.p group by 1)
  select w.doc_id, len(ws)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from w left join s on s.doc_id = w.doc_id"""

CHATS = r"""with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
  e as (select *, length(role) + length(role) - length(replace(replace(replace(role, '\', ''), '<', ''), '>', '')) + length(text) + length(text) - length(replace(replace(text, '\', ''), '<', '')) + 16 as size from t),
  c as (select conv_id, count(*) as n_turns, string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text) as whole, coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '') as loss, sum(size)::bigint as formatted_chars, list(role order by turn, role, text) as roles from e group by 1),
  l as (select *, case when roles = ['user', 'assistant'] then 'prompt' when roles = ['system', 'user', 'assistant'] then 'instruction' when conv_id % 2 <> 0 and not list_contains(roles, 'human') and not list_contains(roles, 'gpt') then 'shared' else 'messages' end as layout from c)
  select conv_id, n_turns, sha256(whole) as turns_sha256, length(loss)::bigint as loss_chars, sha256(loss) as loss_sha256, formatted_chars, layout, sha256(case layout when 'prompt' then 'OBJECT<completion: *, prompt: *>' when 'instruction' then 'OBJECT<input: *, instruction: *, output: *>'
  when 'shared' then 'OBJECT<conversations: ARRAY<OBJECT<from: *, value: *>>>' else 'OBJECT<messages: ARRAY<OBJECT<content: *, role: *>>>' end) as fingerprint from l"""


_P, _B = line_dedup.PRIME, line_dedup.BASE
LINES = f"""with l as (select doc_id, string_split(text, chr(10)) as ls from documents), h as (select doc_id, ls, list_transform(ls, lambda x: ('0x' || substr(md5(x), 1, 7))::bigint) as hs from l),
  r as (select doc_id, i, ls[i] as line, len(ls) as n, hs[i] as h0, case when i > 1 then hs[i - 1] end as h1, case when i > 2 then hs[i - 2] end as h2 from (select *, unnest(range(1, len(ls) + 1)) as i from h)),
  e as (select *, i = n or (((coalesce(h2, 0) * {_B * _B % _P} + (coalesce(h1, 0) * {_B} + h0) % {_P}) % {_P}) % 4 = 0 and not coalesce(h0 = h1 and h0 = h2, false)) as ends from r),
  k as (select *, coalesce(sum(ends::int) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) as k from e),
  o as (select *, row_number() over (partition by doc_id, k order by i) - 1 as o, count(*) over (partition by doc_id, k) as m from k),
  p as (select *, least(o // 8, greatest(1, (m - 1 + 7) // 8) - 1) as piece from o),
  g as (select doc_id, k, piece, min(i) as start, count(*) as c, string_agg(line, chr(10) order by i) as chunk from p group by 1, 2, 3),
  d as (select doc_id, k, piece from (select *, row_number() over (partition by chunk order by doc_id, start) as r from g where c >= 2) where r > 1),
  f as (select p.doc_id, count(*) as n_lines, count(d.k) as n_removed_lines, count(distinct case when d.k is not null then p.k * 100000 + p.piece end) as n_removed_chunks, string_agg(line, chr(10) order by i) filter (where d.k is null) as kept
  from p left join d on d.doc_id = p.doc_id and d.k = p.k and d.piece = p.piece group by 1)
  select doc.doc_id, coalesce(n_lines, 0) as n_lines, coalesce(n_removed_lines, 0) as n_removed_lines, coalesce(n_removed_chunks, 0) as n_removed_chunks, sha256(coalesce(kept, '')) as kept_sha256 from documents doc left join f on f.doc_id = doc.doc_id"""


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that SQL can express; the others are tested against brute force."""
    return {"op5_fm_passages": PASSAGES, "op7_chat_fingerprint": CHATS, "op8_line_chunks": LINES}
