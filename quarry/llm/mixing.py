"""Mixing of sources to target weights by hierarchical token budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.llm.common import WORD_RE, broadcast_if_small, checkpointed

#: Hex digits of the seeded order's key by which a leaf's documents are first summed.
BUCKET_DIGITS = 3

Weights = dict[tuple[str, ...], int]


def _weight(path: list[Column], weights: Weights) -> Column:
    out = F.lit(1)
    for key, w in weights.items():
        if len(key) == len(path):
            hit = F.lit(True)
            for c, v in zip(path, key, strict=True):
                hit = hit & (c == v if v != "*" else F.lit(True))
            out = F.when(hit, w).otherwise(out)
    return out.cast("long")


def _fill(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Adds `budget`: the parent's `given`, shared by `weight` but never beyond `cap`.

    Children are taken by cap / weight. A child is full if the share that is left, were all later ones
    to go on sharing, reaches its cap; what full children leave is shared by the others. So a shortage
    goes to siblings, and as a parent's cap is the sum of its children's, to ancestors only if no
    sibling can take it.
    """
    wide = "decimal(38,0)"
    by = W.partitionBy(*parent)
    order = by.orderBy((F.col("cap") / F.col("weight")).asc(), F.col(name).asc())
    nodes = (
        nodes.where("weight > 0")
        .withColumn("w_rest", F.sum("weight").over(order.rowsBetween(W.currentRow, W.unboundedFollowing)))
        .withColumn("c_before", F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("full", F.expr(f"cast(cap as {wide}) * w_rest <= cast(given - c_before as {wide}) * weight"))
        .withColumn("left", F.col("given") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(by))
        .withColumn("w_open", F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(by))
    )
    share = F.expr(f"cast(floor(cast(left as {wide}) * weight / w_open) as bigint)")
    budget = F.when(F.col("full"), F.col("cap")).otherwise(share)
    return nodes.withColumn("budget", budget).drop("w_rest", "c_before", "full", "left", "w_open")


def leaf_budgets(leaves: DataFrame, levels: list[str], weights: Weights, share: float, max_epochs: int) -> DataFrame:
    """leaves: `levels` and `supply`. Adds `budget`, at most supply * max_epochs; in all, at most share of the supply."""
    leaves = leaves.where("supply > 0").withColumn("cap", F.col("supply") * max_epochs)
    given = leaves.groupBy().agg(F.floor(F.sum("supply") * F.lit(share)).cast("long").alias("given"))
    upper = given.withColumn("__root", F.lit(0))
    parent = ["__root"]
    for depth, level in enumerate(levels):
        path = levels[: depth + 1]
        nodes = leaves.withColumn("__root", F.lit(0)).groupBy("__root", *path).agg(F.sum("cap").alias("cap"))
        nodes = nodes.withColumn("weight", _weight([F.col(c) for c in path], weights)).join(upper, parent)
        upper = _fill(nodes, parent, level).select("__root", *path, F.col("budget").alias("given"))
        parent = ["__root", *path]
    return leaves.join(upper.drop("__root").withColumnRenamed("given", "budget"), levels)


def mix(docs: DataFrame, levels: dict[str, Column], weights: Weights, share: float, max_epochs: int = 2, seed: int = 0) -> DataFrame:
    """doc_id, the levels, n_tokens, epochs, last_tokens: of the documents that are chosen, how often and how far.

    `levels` names the tree's columns from the root down and says how to get them from docs; `weights`
    gives nodes' weights by path ("*" fits any name, later entries win, 1 without entry). A token is a
    word. A leaf's documents are read in epochs; epoch e's order is md5(seed:e:doc_id). A leaf's budget
    is met by `epochs` whole epochs and a prefix of the next one, which may end inside a document:
    last_tokens of its n_tokens count.

    Prefix sums need no task that holds a leaf: tokens are summed by the first digits of the key, and
    only the documents of the one bucket in which a leaf's budget ends are put in order.

    * Null or empty text has no tokens and is never chosen. Null in a level is the node "none".
    * Null doc_id: not chosen. Repeated rows of a doc_id count as one document.
    * Ties of the key are broken by doc_id. An empty table gives an empty result.
    """
    names = list(levels)
    rows = docs.where("doc_id is not null").select(
        "doc_id",
        *[F.coalesce(c.cast("string"), F.lit("none")).alias(n) for n, c in levels.items()],
        F.coalesce(F.regexp_count("text", F.lit(WORD_RE)), F.lit(0)).cast("long").alias("n_tokens"),
    )
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("n_tokens", *names)).alias("r")).select("doc_id", "r.*")
    rows = checkpointed(rows.where("n_tokens > 0"))
    leaves = rows.groupBy(*names).agg(F.sum("n_tokens").alias("supply"))
    leaves = leaf_budgets(leaves, names, weights, share, max_epochs).select(
        *names,
        F.expr("budget div supply").alias("epochs"),
        F.expr("budget % supply").alias("rest"),
    )
    leaves = checkpointed(leaves.where("epochs > 0 or rest > 0"))
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), (F.col("epochs") + 1).cast("string"), F.col("doc_id").cast("string")).cast("binary"))
    keyed = rows.join(broadcast_if_small(leaves), names).withColumn("key", key).withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS))
    sums = keyed.groupBy(*names, "bucket", "rest").agg(F.sum("n_tokens").alias("n"))
    order = W.partitionBy(*names).orderBy("bucket")
    ends = sums.withColumn("upto", F.sum("n").over(order)).where("upto >= rest and upto - n < rest")
    ends = checkpointed(ends.select(*names, F.col("bucket").alias("end_bucket"), (F.col("upto") - F.col("n")).alias("before")))
    inside = keyed.join(broadcast_if_small(ends), names).where("bucket = end_bucket")
    order = W.partitionBy(*names).orderBy("key", "doc_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    cut = inside.withColumn("upto", F.col("before") + F.sum("n_tokens").over(order)).where("upto >= rest and upto - n_tokens < rest")
    cut = checkpointed(cut.select(*names, F.struct("key", "doc_id").alias("cut"), (F.col("rest") - F.col("upto") + F.col("n_tokens")).alias("cut_tokens")))
    at = F.struct("key", "doc_id")
    last = F.when(at < F.col("cut"), F.col("n_tokens")).when(at == F.col("cut"), F.col("cut_tokens")).otherwise(0)
    out = keyed.join(broadcast_if_small(cut), names, "left").withColumn("last_tokens", F.coalesce(last, F.lit(0)).cast("long"))
    return out.where("epochs > 0 or last_tokens > 0").select("doc_id", *names, "n_tokens", "epochs", "last_tokens")


def default_levels() -> dict[str, Column]:
    """The tree of `documents`: four domains by the number in a source's name, then languages, then sources."""
    number = F.regexp_extract(F.coalesce("source", F.lit("")), "([0-9]+)", 1)
    domain = F.when(number == "", "dx").otherwise(F.concat(F.lit("d"), (F.substring(number, -4, 4).cast("int") % 4).cast("string")))
    return {"domain": domain, "language": F.col("lang"), "source": F.col("source")}


#: Parameters of the query and of the pipeline.
WEIGHTS: Weights = {("d0",): 1, ("d1",): 3, ("d2",): 2, ("d3",): 2, ("*", "en"): 4, ("*", "fr"): 3, ("*", "de"): 2}
SHARE, EPOCHS, SEED = 0.6, 2, 17


def mix_default(docs: DataFrame) -> DataFrame:
    return mix(docs, default_levels(), WEIGHTS, SHARE, EPOCHS, SEED)


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs that the default mixture takes, with all their columns and n_tokens, epochs, last_tokens.

    Columns of docs with these names are replaced.
    """
    taken = mix_default(docs).select(F.col("doc_id").alias("__taken"), "n_tokens", "epochs", "last_tokens")
    own = docs.drop("n_tokens", "epochs", "last_tokens")
    return own.join(taken, F.col("doc_id") == F.col("__taken")).drop("__taken")


def _fill_sql(nodes: str, parent: str, name: str, out: str) -> str:
    by = f"PARTITION BY {parent}"
    order = f"{by} ORDER BY cap / weight, {name}"
    return f"""
{out}_a AS (SELECT *, sum(weight) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_rest,
  coalesce(sum(cap) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c_before FROM ({nodes})),
{out}_b AS (SELECT *, cap::HUGEINT * w_rest <= (given - c_before)::HUGEINT * weight AS f FROM {out}_a),
{out}_c AS (SELECT *, given - sum(CASE WHEN f THEN cap ELSE 0 END) OVER ({by}) AS rem,
  sum(CASE WHEN f THEN 0 ELSE weight END) OVER ({by}) AS w_open FROM {out}_b),
{out} AS (SELECT *, CASE WHEN f THEN cap ELSE (rem::HUGEINT * weight) // w_open END AS budget FROM {out}_c)"""


ORACLE = f"""
WITH d AS (SELECT doc_id, 'd' || ((regexp_extract(source, '([0-9]+)', 1)::INT % 4)::VARCHAR) AS domain, lang AS language, source,
  len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens FROM documents),
t AS (SELECT * FROM d WHERE n_tokens > 0),
leaf AS (SELECT domain, language, source, sum(n_tokens)::BIGINT AS supply, sum(n_tokens)::BIGINT * {EPOCHS} AS cap FROM t GROUP BY ALL),
root AS (SELECT floor(sum(supply) * {SHARE}::DOUBLE)::BIGINT AS given FROM leaf),
{_fill_sql("SELECT 0 AS r, domain, sum(cap)::BIGINT AS cap, CASE domain WHEN 'd1' THEN 3 WHEN 'd2' THEN 2 WHEN 'd3' THEN 2 ELSE 1 END AS weight, any_value(given) AS given FROM leaf, root GROUP BY domain", "r", "domain", "l1").lstrip()},
{_fill_sql("SELECT domain, language, sum(leaf.cap)::BIGINT AS cap, CASE language WHEN 'en' THEN 4 WHEN 'fr' THEN 3 WHEN 'de' THEN 2 ELSE 1 END AS weight, any_value(l1.budget) AS given FROM leaf JOIN l1 USING (domain) GROUP BY domain, language", "domain", "language", "l2").lstrip()},
{_fill_sql("SELECT leaf.domain, leaf.language, leaf.source, leaf.cap, 1 AS weight, leaf.supply, l2.budget AS given FROM leaf JOIN l2 ON leaf.domain = l2.domain AND leaf.language = l2.language", "domain, language", "source", "l3").lstrip()},
b AS (SELECT domain, language, source, budget // supply AS epochs, budget % supply AS rest FROM l3),
k AS (SELECT t.*, b.epochs, b.rest, md5('{SEED}:' || (b.epochs + 1)::VARCHAR || ':' || t.doc_id::VARCHAR) AS key
  FROM t JOIN b ON t.domain = b.domain AND t.language = b.language AND t.source = b.source),
c AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, language, source ORDER BY key, doc_id) - n_tokens AS before FROM k)
SELECT doc_id, domain, language, source, n_tokens, epochs::BIGINT AS epochs,
  greatest(0, least(n_tokens, rest - before))::BIGINT AS last_tokens
FROM c WHERE epochs > 0 OR rest > before
"""
