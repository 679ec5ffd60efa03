"""Operator 7, native: chat records of several layouts become canonical turns, one template and a loss mask.

A record is JSON. Its nested field paths, without scalar types, are hashed to a fingerprint; those of a layout's fields, without
the optional ones (OPTIONAL), select a declarative mapping (LAYOUTS), whose steps build the turns. A record of an unknown
layout is kept with its fingerprint, `layout` null and no turns.

The paths are read from the record's skeleton, in which every string value is empty, so texts of any length that a string of
Spark can hold are taken whole. A record whose skeleton alone is too long for a variant (some hundred thousand turns) raises an error.

Template: each turn is `<turn ROLE>` newline TEXT `</turn>` newline. Inside roles and texts a backslash is written `\\b`,
`<` is written `\\l` and (in roles) `>` is written `\\g`, so that no text can hold a control string; reading back undoes it.

Defined cases: null roles and texts are empty; turns come by (turn, role, text), equal rows stay as often as they are; an
empty table gives no records; a null conv_id is a conversation of its own; the turns of one conversation are one row, whose
size is that of the conversation; extra columns, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURNS = "array<struct<role:string,text:string>>"
#: Scalar fields that a record or message may have besides those of its layout.
OPTIONAL = ("id", "name", "weight", "source", "lang")


def _fields(kind: str) -> str:
    return f"from_json(record, '{kind}', map('maxStringLen', '2147483647'))"


#: name, field paths (see `paths_of`), SQL that makes TURNS from the column `record`.
LAYOUTS = (
    ("messages", "OBJECT<messages: ARRAY<OBJECT<content: *, role: *>>>", f"transform({_fields('messages array<struct<role:string,content:string>>')}.messages, x -> struct(x.role as role, x.content as text))"),
    ("shared", "OBJECT<conversations: ARRAY<OBJECT<from: *, value: *>>>", f"transform({_fields('conversations array<struct<`from`:string,value:string>>')}.conversations, x -> struct(case x.from when 'human' then 'user' when 'gpt' then 'assistant' else x.from end as role, x.value as text))"),
    ("prompt", "OBJECT<completion: *, prompt: *>", f"transform(array({_fields('prompt string, completion string')}), x -> array(struct('user' as role, x.prompt as text), struct('assistant' as role, x.completion as text)))[0]"),
    ("instruction", "OBJECT<input: *, instruction: *, output: *>", f"transform(array({_fields('instruction string, input string, output string')}), x -> array(struct('system' as role, x.instruction as text), struct('user' as role, x.input as text), struct('assistant' as role, x.output as text)))[0]"),
)
#: Characters of a skeleton up to which a null variant means that the record is no JSON.
SKELETON = 16_000_000


def skeleton(record: Column) -> Column:
    """The record with all its string values empty. Escapes of backslash and quote are written by code point first, so that a quote always ends a string."""
    coded = F.replace(F.replace(record, F.lit("\\\\"), F.lit("\\u005c")), F.lit('\\"'), F.lit("\\u0022"))
    pieces = F.regexp_extract_all(coded, F.lit(r'"[^"]*"(?:\s*:)?|[^"]+|"'), F.lit(0))
    return F.array_join(F.transform(pieces, lambda p: F.when(p.startswith('"') & p.endswith('"') & (p != '"'), F.lit('""')).otherwise(p)), "")


def paths_of(v: Column) -> Column:
    """The nested field names of a variant; scalars are all `*`."""
    return F.regexp_replace(F.schema_of_variant(v), r"\bDECIMAL\(\d+,\d+\)|\b(STRING|VOID|BIGINT|DOUBLE|FLOAT|BOOLEAN|DATE|TIMESTAMP|TIMESTAMP_NTZ)\b(?!:)", "*")


def needed(paths: Column) -> Column:
    """The paths without optional scalar fields."""
    without = F.regexp_replace(paths, rf"(?<=<|, )({'|'.join(OPTIONAL)}): \*(, )?", "")
    return F.replace(without, F.lit(", >"), F.lit(">"))


def canonical(records: DataFrame, record: str = "record") -> DataFrame:
    """Adds fingerprint, layout and turns."""
    out = records.withColumn("record", F.col(record)).withColumn("_bare", skeleton(F.col("record"))).withColumn("_v", F.try_parse_json("_bare"))
    lost = F.col("_v").isNull() & (F.length("_bare") > SKELETON) & F.col("_bare").startswith("{") & F.col("_bare").endswith("}")
    out = out.withColumn("_paths", F.when(lost, F.raise_error(F.lit("a chat record has too many fields to be parsed"))).otherwise(paths_of(F.col("_v"))))
    out = out.withColumn("fingerprint", F.sha2("_paths", 256)).withColumn("_needed", F.sha2(needed(F.col("_paths")), 256))
    named, made = F.lit(None).cast("string"), F.array().cast(TURNS)
    for name, paths, sql in reversed(LAYOUTS):
        this = F.col("_needed") == F.sha2(F.lit(paths), 256)
        named, made = F.when(this, F.lit(name)).otherwise(named), F.when(this, F.expr(sql).cast(TURNS)).otherwise(made)
    return out.withColumn("layout", named).withColumn("turns", made).drop("_bare", "_v", "_paths", "_needed")


def escaped(text: Column, role: bool = False) -> Column:
    out = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))
    return F.replace(out, F.lit(">"), F.lit("\\g")) if role else out


def plain(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\g"), F.lit(">")), F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def formatted(canonical_records: DataFrame) -> DataFrame:
    """Adds formatted (string) and loss_spans (array of start and length in code points: the assistant's texts)."""
    head = lambda x: F.concat(F.lit("<turn "), escaped(x["role"], True), F.lit(">\n"))
    out = canonical_records.withColumn("_parts", F.transform("turns", lambda x: F.struct(head(x).alias("head"), escaped(x["text"]).alias("body"), (x["role"] == "assistant").alias("loss"))))
    out = out.withColumn("formatted", F.array_join(F.transform("_parts", lambda p: F.concat(p["head"], p["body"], F.lit("</turn>\n"))), ""))
    spans = "array<struct<start:int,length:int>>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(spans).alias("spans"))

    def step(s: Column, p: Column) -> Column:
        a, n = F.length(p["head"]), F.length(p["body"])
        span = F.array(F.struct((s["at"] + a).alias("start"), n.alias("length"))).cast(spans)
        return F.struct((s["at"] + a + n + F.lit(8)).alias("at"), F.when(p["loss"], F.concat(s["spans"], span)).otherwise(s["spans"]).alias("spans"))

    return out.withColumn("loss_spans", F.aggregate("_parts", start, step, lambda s: s["spans"])).drop("_parts")


def read_back(formatted_records: DataFrame) -> DataFrame:
    """From formatted and loss_spans alone: back (TURNS) and loss (the unescaped text under the mask)."""
    pieces = F.slice(F.split("formatted", "</turn>\n"), 1, F.size(F.split("formatted", "</turn>\n")) - 1)
    turn = lambda p: F.struct(plain(F.regexp_extract(p, r"^<turn ([^>]*)>", 1)).alias("role"), plain(F.regexp_replace(p, r"^<turn [^>]*>\n", "")).alias("text"))
    out = formatted_records.withColumn("back", F.transform(pieces, turn))
    return out.withColumn("loss", F.array_join(F.transform("loss_spans", lambda s: plain(F.substring(F.col("formatted"), s["start"] + 1, s["length"]))), ""))


def records_of(rows: DataFrame) -> DataFrame:
    """conv_id, record: conversations as JSON in the layout that fits their turns, as sources deliver them.

    user, assistant: prompt; system, user, assistant: instruction; else shared for odd conv_id if no role is called like
    its names for roles, else messages.
    """
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    each = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t")).withColumn("roles", F.col("t.role"))
    to = lambda **cols: F.to_json(F.struct(*[c.alias(k) for k, c in cols.items()]), {"ignoreNullFields": "false"})
    is_ = lambda *names: F.col("roles") == F.array(*map(F.lit, names))
    odd = (F.col("conv_id") % 2 != 0) & ~F.exists("roles", lambda r: r.isin("human", "gpt"))
    shown = F.transform("t", lambda x: F.struct(F.when(x["role"] == "user", "human").when(x["role"] == "assistant", "gpt").otherwise(x["role"]).alias("from"), x["text"].alias("value")))
    text = lambda i: F.col("t")[i]["text"]
    record = (
        F.when(is_("user", "assistant"), to(prompt=text(0), completion=text(1)))
        .when(is_("system", "user", "assistant"), to(instruction=text(0), input=text(1), output=text(2)))
        .when(odd, to(conversations=shown))
        .otherwise(to(messages=F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content")))))
    )
    return each.select("conv_id", record.alias("record"))


def digests(read: DataFrame) -> DataFrame:
    whole = F.array_join(F.transform("back", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "layout",
        "fingerprint",
    )
