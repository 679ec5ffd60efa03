"""Operator 9, native: an order of all rows in which each source has its target share of every prefix (Pfair scheduling).

The rows of a source are cut into blocks of `block_rows`. Block j (from 1) of a source of weight w may start at slot
floor((j - 1) / w) and must be over by slot ceil(j / w). In each slot the earliest deadline among the released blocks goes
first; with weights that sum to 1 this keeps each source within less than one block of w * t after any t slots.

Weights are whole parts of a cycle of as many slots as there are parts, and the schedule repeats after each cycle, so every
block finds its slot by arithmetic. A source of one part may stand anywhere in the cycle and has the last deadline: such sources
get, in order of a hash of their names, the slots that the others leave free. Only the sources of two parts and more are scheduled by
a fold, over their turns. Default weights make at most 1.5 * `cycle` of these turns, whatever the number of sources; their
table is collected and broadcast. Sources of one part may be as many as there are rows, and no task gets them all.

A source with no blocks left passes its slots: what remains keeps its proportions, and no row is dropped or repeated. The
bound holds in slots for all sources that still have blocks, and in positions until the first source ends.

Defined cases: a null source is a source of its own, other than the empty one; a weight below one part counts as one part;
equal rows are told apart by any order among themselves; a null doc_id stays null and comes before the others of its source;
the text, whatever its length, and extra columns, whatever their names, are not read; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, ranked, written

TURNS = "array<struct<source:string,parts:int,turn:int,slot:bigint>>"


def tempered_parts(rows: DataFrame, source: str, exponent: float, cycle: int) -> DataFrame:
    """(source, parts): target weights in proportion to the source's number of rows to the power `exponent`.

    Shares are whole numbers before they are summed, so that the order of summing changes nothing.
    """
    sizes = rows.groupBy(source).agg(F.count(F.lit(1)).alias("_n"))
    shares = written(sizes.select(source, F.ceil(F.pow(F.col("_n").cast("double"), F.lit(exponent)) * 1024).alias("_w")), "shares")
    total = shares.agg(F.sum("_w")).first()[0] or 1
    return shares.select(source, F.greatest(F.lit(1), F.round(F.col("_w") * F.lit(cycle) / F.lit(total))).cast("int").alias("parts"))


def turns(heavy: DataFrame, source: str, cycle: int) -> list:
    """(source, parts, turn, slot) for the turns (from 0) of the given sources in a cycle of `cycle` slots.

    Earliest pseudo-deadline first, whole-number arithmetic: turn j of p parts in a cycle of c slots has release
    floor(j * c / p) and deadline ceil((j + 1) * c / p). Ties go to the heavier source, then to the later name. Slots
    in which no source of these is released are left free.
    """
    kind = "array<struct<parts:int,source:string,done:int>>"
    one = heavy.agg(F.reverse(F.array_sort(F.collect_list(F.struct(F.col("parts").alias("parts"), F.col(source).alias("source"), F.lit(0).alias("done"))))).cast(kind).alias("all"), F.sum("parts").cast("int").alias("n")).where("n > 0")
    c = F.lit(cycle).cast("long")

    def step(state: Column, _: Column) -> Column:
        def window(x: Column, i: Column) -> Column:
            j, p = x["done"].cast("long"), x["parts"].cast("long")
            return F.when(j < p, F.struct(F.floor(j * c / p).cast("long").alias("r"), F.ceil((j + 1) * c / p).cast("long").alias("d"), i.alias("i")))

        def choose(open_: Column) -> Column:
            at = F.greatest(state["t"], F.array_min(F.transform(open_, lambda w: w["r"])))
            return let(at, lambda t: F.struct(t.alias("t"), F.array_min(F.transform(F.filter(open_, lambda w: w["r"] <= t), lambda w: F.struct(w["d"], w["i"])))["i"].alias("k")))

        def taken(go: Column) -> Column:
            k = go["k"]
            now = F.transform(state["all"], lambda x, i: F.struct(x["parts"].alias("parts"), x["source"].alias("source"), F.when(i == k, x["done"] + 1).otherwise(x["done"]).alias("done")))
            turn = F.struct(state["all"][k]["source"].alias("source"), state["all"][k]["parts"].alias("parts"), state["all"][k]["done"].alias("turn"), go["t"].alias("slot"))
            return F.struct(now.alias("all"), (go["t"] + 1).alias("t"), F.concat(state["out"], F.array(turn).cast(TURNS)).alias("out"))

        open_ = F.filter(F.transform(state["all"], window), lambda w: w.isNotNull())
        return let(let(open_, choose), taken)

    start = F.struct(F.col("all"), F.lit(0).cast("long").alias("t"), F.array().cast(TURNS).alias("out"))
    return one.select(F.inline(F.aggregate(F.sequence(F.lit(1), F.col("n")), start, step, lambda s: s["out"]))).collect()


def mix(rows: DataFrame, order: list[str], source: str = "source", parts: DataFrame | None = None, block_rows: int = 8, cycle: int = 1000, exponent: float = 0.7) -> DataFrame:
    """order, source, block (of the source, from 0), slot, position (gapless from 0 over all rows).

    order: columns without nulls. parts: (source, parts) with positive whole weights of not too many sources; without it
    `tempered_parts`. Sources that it lacks get one part.
    """
    spark = rows.sparkSession
    named = rows.select(*order, F.concat(F.col(source).isNull().cast("int").cast("string"), F.coalesce(F.col(source), F.lit(""))).alias("_source"), F.col(source).alias("_shown"))
    if parts is None:
        weights = tempered_parts(named, "_source", exponent, cycle)
    else:
        given = parts.select(F.concat(F.col(source).isNull().cast("int").cast("string"), F.coalesce(F.col(source), F.lit(""))).alias("_source"), F.greatest(F.lit(1), F.col("parts")).cast("int").alias("parts"))
        weights = written(named.select("_source").distinct().join(given, "_source", "left").select("_source", F.coalesce("parts", F.lit(1)).alias("parts")), "weights")
    slots = weights.agg(F.sum("parts")).first()[0] or 1
    heavy = turns(weights.where("parts > 1"), "_source", slots)
    # one literal for all of them: one each would be a call of the JVM and a node of every later plan
    free = sorted(r["slot"] - i for i, r in enumerate(sorted(heavy, key=lambda r: r["slot"])))
    free = F.split(F.lit(",".join(map(str, free))), ",").cast("array<bigint>") if heavy else F.array().cast("array<bigint>")
    light = ranked(weights.where("parts = 1").withColumn("_one", F.lit(1)), ["_one"], ["_source"], "_r").select("_source", F.lit(1).alias("_parts"), (F.col("_r") + F.size(F.filter(free, lambda s: s <= F.col("_r")))).alias("_alone"))
    about = light.unionByName(weights.where("parts > 1").select("_source", F.col("parts").alias("_parts"), F.lit(None).cast("long").alias("_alone")))
    table = spark.createDataFrame([(r["source"], r["turn"], r["slot"]) for r in heavy], "_source string, turn int, _slot long")
    at = ranked(named, ["_source"], order, "_rank", about=written(about, "sources"))
    at = at.withColumn("block", F.expr(f"_rank div {block_rows}")).withColumn("turn", F.expr("cast(block % _parts as int)"))
    at = at.join(F.broadcast(table), ["_source", "turn"], "left")
    at = at.withColumn("slot", F.expr(f"(block div _parts) * {slots}L + coalesce(_alone, _slot)")).withColumn("_at", F.expr(f"_rank % {block_rows}"))
    return placed(at, block_rows).select(*order, F.col("_shown").alias(source), "block", "slot", "position")


def placed(at: DataFrame, block_rows: int, span: int = 1024) -> DataFrame:
    """position: the rank by (slot, place in the block). A slot holds one block, so a span of slots has a bounded number of rows."""
    spans = at.withColumn("_span", F.expr(f"slot div {span}"))
    sizes = spans.groupBy("_span").agg(F.count(F.lit(1)).alias("_n"))
    # Spans are few (rows / (span * block_rows)); they are summed in two levels, so that no task gets them all.
    wide = sizes.withColumn("_wide", F.expr(f"_span div {span}"))
    tops = wide.groupBy("_wide").agg(F.sum("_n").alias("_m"))
    before = lambda *by: Window.partitionBy(*by).orderBy(F.col("_wide" if not by else "_span")).rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select("_wide", F.coalesce(F.sum("_m").over(before()), F.lit(0)).alias("_top"))
    starts = wide.select("_wide", "_span", F.coalesce(F.sum("_n").over(before("_wide")), F.lit(0)).alias("_low")).join(tops, "_wide").select("_span", (F.col("_top") + F.col("_low")).alias("_start"))
    own = Window.partitionBy("_span").orderBy("slot", "_at")
    return spans.withColumn("_own", F.row_number().over(own) - 1).join(starts, "_span").withColumn("position", F.col("_start") + F.col("_own"))


def mix_documents(documents: DataFrame, **options) -> DataFrame:
    """All documents: doc_id, source, block, slot, position."""
    rows = documents.select(F.coalesce(F.col("doc_id"), F.lit(-1 << 63)).alias("_tie"), F.col("doc_id").isNotNull().alias("_named"), "source")
    return mix(rows, ["_tie", "_named"], **options).select(F.when(F.col("_named"), F.col("_tie")).alias("doc_id"), "source", "block", "slot", "position")
