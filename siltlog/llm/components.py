"""Connected components of a graph given as edges, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, tables, written


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """edges: a, b (long). Gives node, root (smallest node of its component) for every node of an edge.

    Each round hooks every root to the smallest root next to it, shortens the paths twice and keeps only edges between
    different roots; the graph shrinks by a factor at least. Tables are written between the rounds, and those that a later
    round has replaced are deleted.
    """
    both = edges.where("a <> b").select("a", "b")
    with tables() as old:
        both = written(both.union(both.select(F.col("b"), F.col("a"))).distinct(), "edges")
    label = None
    for _ in range(rounds):
        with tables() as made:
            both, label = _round(both, label)
        hooks, roots, rest = made
        done = both.isEmpty()
        discard(edges.sparkSession, [*old, hooks, *([rest] if done else [])])
        if done:
            return label
        old = [roots, rest]
    raise RuntimeError("components did not settle")


def _round(both: DataFrame, label: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(edges between different roots, label) after one round; writes hooks, roots and edges in this order."""
    hook = both.groupBy("a").agg(F.min("b").alias("_m")).select(F.col("a").alias("root"), F.least("a", "_m").alias("up"))
    for _ in range(2):
        above = hook.select(F.col("root").alias("up"), F.col("up").alias("_up"))
        hook = hook.join(above, "up", "left").select("root", F.coalesce("_up", "up").alias("up"))
    hook = written(hook, "hooks")
    if label is None:
        label = hook.select(F.col("root").alias("node"), F.col("up").alias("root"))
    else:
        label = label.join(hook, "root", "left").select("node", F.coalesce("up", "root").alias("root"))
    label = written(label, "roots")
    to = hook.select(F.col("root").alias("a"), F.col("up").alias("_a"))
    half = both.join(to, "a").select(F.col("_a").alias("a"), "b")
    to = hook.select(F.col("root").alias("b"), F.col("up").alias("_b"))
    return written(half.join(to, "b").select("a", F.col("_b").alias("b")).where("a <> b").distinct(), "edges"), label
