"""The current state of a record store: an ordered fold of the operation log for each key.

oplog: seq, key, op, offset, size, data (binary), flags, and ext (binary, optional): the extended header of a write with flag EXTHDR.
Operations: write, append, prepare, plain_write, commit, remove; insert, update and upsert, which are writes that fail on a key that
is there (EEXIST), on one that is not (ENOENT), or never; and state, which sets a key to a state that an earlier fold has
left (data: buffer, size: reserve, offset: length, flag UNCOMMITTED: not committed).

A key has one of three states: absent, committed (a value) or uncommitted (a buffer, its reserve and its length). A failed
operation leaves the state and yields an error. Gaps are zero bytes. Records are binary values, so an operation that would
make one of 2 GiB or more fails with EFBIG.

A record with an extended header keeps it beside its payload: a write with EXTHDR sets or replaces it, turning a plain record into
an extended one; a write without it onto an extended record is EINVAL, and a plain_write with it onto a plain record ENOTSUP.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.records import EXTHDR, UNCOMMITTED

STATE = "struct<kind:string,buf:binary,cap:bigint,n:bigint,ext:binary,errors:array<struct<seq:bigint,op:string,error:string>>>"
_START = f"cast(named_struct('kind', 'absent', 'buf', X'', 'cap', 0L, 'n', 0L, 'ext', cast(null as binary), 'errors', array()) as {STATE})"
#: Longest value, a little less than a binary can hold.
LONGEST = (1 << 31) - (1 << 16)


def _to(kind: str, buf: str, cap: str = "0L", n: str = "0L", ext: str = "s.ext") -> str:
    return f"cast(named_struct('kind', {kind}, 'buf', {buf}, 'cap', {cap}, 'n', {n}, 'ext', {ext}, 'errors', s.errors) as {STATE})"


def _error(code: str) -> str:
    return f"cast(named_struct('kind', s.kind, 'buf', s.buf, 'cap', s.cap, 'n', s.n, 'ext', s.ext, 'errors', concat(s.errors, array(named_struct('seq', o.seq, 'op', o.op, 'error', {code})))) as {STATE})"


_NOW = "if(s.kind = 'uncommitted', substring(s.buf, 1, cast(s.n as int)), s.buf)"
_LATE = "case s.kind when 'absent' then 'ENOENT' else 'EPERM' end"
_EXT = f"(o.flags & {EXTHDR}) <> 0"
_KEPT = f"if({_EXT}, o.ext, if(s.kind = 'absent', null, s.ext))"
_STEP = f"""case
  when o.op = 'state' then {_to(f"if((o.flags & {UNCOMMITTED}) <> 0, 'uncommitted', 'committed')", "o.data", "greatest(o.size, 0L)", "o.offset", "o.ext")}
  when (o.flags & 13) <> 0 then {_error("'ENOTSUP'")}
  when o.op in ('write', 'append', 'insert', 'update', 'upsert') and s.kind <> 'absent' and s.ext is not null and not ({_EXT}) then {_error("'EINVAL'")}
  when greatest(o.offset, 0L) + length(s.buf) + length(o.data) >= {LONGEST}L and o.op <> 'remove' then {_error("'EFBIG'")}
  when o.op = 'insert' and s.kind <> 'absent' then {_error("'EEXIST'")}
  when o.op = 'update' and s.kind = 'absent' then {_error("'ENOENT'")}
  when o.op in ('write', 'insert', 'update', 'upsert') then {_to("'committed'", "concat(rpad(s.buf, cast(o.offset as int), X'00'), o.data)", ext=_KEPT)}
  when o.op = 'append' then {_to("'committed'", f"concat(rpad({_NOW}, cast(length({_NOW}) + o.offset as int), X'00'), o.data)", ext=_KEPT)}
  when o.op = 'prepare' then {_to("'uncommitted'", "s.buf", "greatest(o.size, cast(length(s.buf) as bigint))", "if(s.kind = 'uncommitted', s.n, cast(length(s.buf) as bigint))", _KEPT)}
  when o.op = 'plain_write' and s.kind <> 'uncommitted' then {_error(_LATE)}
  when o.op = 'plain_write' and {_EXT} and s.ext is null then {_error("'ENOTSUP'")}
  when o.op = 'plain_write' and o.offset + length(o.data) > s.cap then {_error("'ERANGE'")}
  when o.op = 'plain_write' then {_to("'uncommitted'", "concat(rpad(s.buf, cast(o.offset as int), X'00'), o.data, substring(s.buf, cast(o.offset + length(o.data) + 1 as int)))", "s.cap", "s.n")}
  when o.op = 'commit' and s.kind <> 'uncommitted' then {_error(_LATE)}
  when o.op = 'commit' and o.size > s.cap then {_error("'ERANGE'")}
  when o.op = 'commit' and o.size >= {LONGEST}L then {_error("'EFBIG'")}
  when o.op = 'commit' then {_to("'committed'", "rpad(s.buf, cast(if(o.size < 0, s.n, o.size) as int), X'00')")}
  when o.op = 'remove' and s.kind = 'absent' then {_error("'ENOENT'")}
  when o.op = 'remove' then {_to("'absent'", "X''", ext="cast(null as binary)")}
  else {_error("'EINVAL'")}
end"""


def _complete(oplog: DataFrame) -> DataFrame:
    """The log with all columns of its schema and no nulls in them."""
    column = lambda name, kind: F.col(name) if name in oplog.columns else F.lit(None).cast(kind)
    return oplog.select(
        "key", "seq", "op",
        F.coalesce("offset", F.lit(0)).cast("long").alias("offset"),
        F.coalesce("size", F.lit(-1)).cast("long").alias("size"),
        F.coalesce("data", F.expr("X''")).alias("data"),
        F.coalesce(column("flags", "long"), F.lit(0)).cast("long").alias("flags"),
        F.when(F.coalesce(column("flags", "long"), F.lit(0)).bitwiseAND(F.lit(EXTHDR)) != 0, F.coalesce(column("ext", "binary"), F.expr("X''"))).otherwise(F.when(F.col("op") == "state", column("ext", "binary"))).alias("ext"),
    )


def fold(oplog: DataFrame) -> DataFrame:
    """key, state (STATE), n_ops, last_seq. One shuffle, by key."""
    ops = _complete(oplog).select("key", F.struct("seq", "op", "offset", "size", "data", "flags", "ext").alias("o"))
    grouped = ops.groupBy("key").agg(F.array_sort(F.collect_list("o")).alias("ops"))
    return grouped.select("key", F.expr(f"aggregate(ops, {_START}, (s, o) -> {_STEP})").alias("state"), F.size("ops").cast("long").alias("n_ops"), F.element_at("ops", -1)["seq"].alias("last_seq"))


def since_reset(oplog: DataFrame) -> DataFrame:
    """Only operations from each key's last one that forgets the past (remove, state, or a plain write at offset 0) on.

    The window has the partitioning of the fold, so this costs a sort and no shuffle, and a hot key gathers a short history.
    """
    whole = F.col("op").isin("write", "upsert") & (F.coalesce("offset", F.lit(0)) == 0)
    if "flags" in oplog.columns:  # a plain write fails on a record with an extended header, so only a log without any can forget
        extended = F.max((F.coalesce("flags", F.lit(0)).bitwiseAND(F.lit(EXTHDR)) != 0).cast("int")).over(Window.partitionBy("key")) == 1
        if "ext" in oplog.columns:
            extended = extended | (F.max(F.col("ext").isNotNull().cast("int")).over(Window.partitionBy("key")) == 1)
        whole = whole & ~extended
    small = F.coalesce(F.length("data"), F.lit(0)) < LONGEST // 2
    resets = F.when(F.col("op").isin("remove", "state") | (whole & small), F.col("seq"))
    last = F.max(resets).over(Window.partitionBy("key"))
    return oplog.withColumn("_last", last).where(F.col("_last").isNull() | (F.col("seq") >= F.col("_last"))).drop("_last")


def joined_appends(oplog: DataFrame) -> DataFrame:
    """The log with each run of appends without offset and flags as one append, whose data are joined in time in proportion to their size.

    Appending never fails, and a run has the partitioning of the fold, so that this costs no shuffle.
    """
    ops = _complete(oplog)
    plain = (F.col("op") == "append") & (F.col("offset") == 0) & (F.col("flags") == 0)
    run = F.sum((~plain).cast("long")).over(Window.partitionBy("key").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ops = ops.withColumn("_plain", plain).withColumn("_run", run)
    first = ["op", "offset", "size", "flags", "ext"]
    grouped = ops.groupBy("key", "_run", "_plain").agg(F.max("seq").alias("seq"), *[F.first(c).alias(c) for c in first], F.expr("listagg(data) within group (order by seq)").alias("data"))
    return grouped.select("key", "seq", "op", "offset", "size", F.coalesce("data", F.expr("X''")).alias("data"), "flags", "ext")


def states(oplog: DataFrame) -> DataFrame:
    """key, state, last_seq of every key, from the shortest history that gives it; the errors of earlier operations are not in it."""
    plain = (F.coalesce("flags", F.lit(0)).bitwiseAND(F.lit(13)) == 0) if "flags" in oplog.columns else F.lit(True)
    return fold(joined_appends(since_reset(oplog.where(plain)))).select("key", "state", "last_seq")


def current(oplog: DataFrame, include_uncommitted: bool = False) -> DataFrame:
    """key, data, data_size, kind, ext of every live key."""
    kinds = ["committed", "uncommitted"] if include_uncommitted else ["committed"]
    return states(oplog).where(F.col("state.kind").isin(kinds)).select("key", F.col("state.buf").alias("data"), F.length("state.buf").cast("long").alias("data_size"), F.col("state.kind").alias("kind"), F.col("state.ext").alias("ext"), "last_seq")


def as_ops(found: DataFrame) -> DataFrame:
    """The states of `states` as operations (op `state`) that set them, so that a later fold goes on from there."""
    s = lambda name: F.col(f"state.{name}")
    flags = F.when(s("kind") == "uncommitted", F.lit(UNCOMMITTED)).otherwise(F.lit(0)).cast("long")
    live = found.where(s("kind") != "absent")
    return live.select(F.col("last_seq").alias("seq"), "key", F.lit("state").alias("op"), s("n").alias("offset"), s("cap").alias("size"), s("buf").alias("data"), flags.alias("flags"), s("ext").alias("ext"))


def errors(oplog: DataFrame) -> DataFrame:
    """key, seq, op, error of every failed operation."""
    return fold(oplog).select("key", F.explode("state.errors").alias("e")).select("key", "e.*")


def latest_version(versions: DataFrame, key: list[str], order: list[Column], n: str = "version_rank") -> DataFrame:
    """Adds the rank of each version of a key, 1 for the newest."""
    return versions.withColumn(n, F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
