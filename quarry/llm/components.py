"""Connected components of a distributed graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """edges: a, b (long). Gives v, c: every vertex and the least vertex it is connected with, as a scratch table.

    Rounds of contraction: every root hooks to its least neighbour, hooks are followed four steps, and
    edges between what is then one root go. Aggregates combine before they shuffle, and nothing but
    counts reaches the driver. A path of n vertices takes about log4(n) rounds.
    """
    edges = edges.where("a <> b")
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = scratch.table(both.select(F.col("a").alias("v")).distinct().select("v", F.col("v").alias("c")))
    rest = scratch.table(both.distinct())
    while not rest.isEmpty():
        hook = scratch.table(rest.groupBy(F.col("a").alias("r")).agg(F.least(F.min("b"), F.first("a")).alias("to")))
        for _ in range(2):
            next_ = hook.select(F.col("r").alias("r2"), F.col("to").alias("to2"))
            hook = scratch.table(hook.join(next_, F.col("to") == F.col("r2"), "left").select("r", F.coalesce("to2", "to").alias("to")))
        labels = scratch.table(labels.join(hook, F.col("c") == F.col("r"), "left").select("v", F.coalesce("to", "c").alias("c")))
        a, b = (hook.select(F.col("r").alias(f"r{x}"), F.col("to").alias(f"to{x}")) for x in "ab")
        moved = rest.join(a, F.col("a") == F.col("ra")).join(b, F.col("b") == F.col("rb"))
        rest = scratch.table(moved.select(F.col("toa").alias("a"), F.col("tob").alias("b")).where("a <> b").distinct())
    return labels
