"""Reach over parent links: what commits lead to, and how far it is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.lineage import cut


def walk(tips: DataFrame, parents: DataFrame) -> DataFrame:
    """tips: node. parents: node, parent, without cycles. Gives node, depth: all that tips lead to, and the fewest links from one.

    Links are doubled: after k rounds they span 2^k parents, and what is reached is joined with them once
    a round. So a history of n commits in a row takes log2(n) rounds, where a recursive query takes n.
    Each round is checkpointed, so its plan doesn't grow and a lost executor costs no round again.
    """
    links = cut(parents.select("node", "parent").where("node is not null and parent is not null").distinct())
    found, span = cut(tips.select("node", F.lit(0).cast("long").alias("depth")).where("node is not null").distinct()), 1
    while not links.isEmpty():
        step = links.select(F.col("node").alias("__n"), F.col("parent").alias("__p"))
        both = F.explode(F.array(F.struct("node", "depth"), F.struct(F.col("__p").alias("node"), (F.col("depth") + span).alias("depth"))))
        found = found.join(step, F.col("node") == F.col("__n"), "left").select(both.alias("r")).select("r.*").where("node is not null")
        found = cut(found.groupBy("node").agg(F.min("depth").alias("depth")))
        links = cut(links.join(step, F.col("parent") == F.col("__n")).select("node", F.col("__p").alias("parent")).distinct())
        span *= 2
    return found
