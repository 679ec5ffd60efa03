"""Small documents with the odd cases that every operator must take."""

from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, lang, source)."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or "")) for r in rows]
    return spark.createDataFrame(full, DOCS)


def clashing(df):
    """Extra columns named like the operators' own."""
    for name in ("_n", "_own", "key", "cell", "shard", "position", "score", "size", "m", "route", "_s", "lines", "kept", "block"):
        df = df.withColumn(name, F.lit("x"))
    return df
