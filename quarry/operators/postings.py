"""Postings kept as tables: a search reads its own terms' rows instead of all texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.fts_query import Phrase, parse, phrases
from quarry.operators.search import _near_phrases, _scored, _weights, index


def write(items: DataFrame, path: str, columns: tuple[str, ...] = ("text", "author"), key: str = "item_id", keep: tuple[str, ...] = ()) -> None:
    """Writes path/postings (term, key, keep, dl, in_column, n, positions) and path/totals (n, total of dl: one row).

    key and keep together name an item. Texts are split once: their words are dealt out by (term, item,
    column) and meet there for their positions, and what comes of it is cut by ranges of the same. So a
    term of many items is many tasks' work, and a file's least and greatest term rule it out.
    """
    keys = [key, *keep]
    indexed = index(items.select(*keys, *[c for c in columns if c in items.columns]), columns)

    def places(c: str) -> Column:
        return F.transform(f"tok_{c}", lambda t, i: F.struct(t.alias("term"), F.lit(c).alias("in_column"), i.alias("at")))

    one = indexed.select(*keys, "dl", F.explode(F.concat(*map(places, columns))).alias("p")).select("p.term", *keys, "p.in_column", "dl", "p.at")
    by = ["term", *keys, "in_column", "dl"]
    # dealt out before the aggregate: lists that are begun in the task that splits texts would be sorted there
    rows = one.repartition(*by).groupBy(*by).agg(F.count(F.lit(1)).cast("int").alias("n"), F.sort_array(F.collect_list("at")).alias("positions"))
    rows.repartitionByRange(*by).sortWithinPartitions(*by).write.mode("overwrite").parquet(f"{path}/postings")
    total = items.sparkSession.read.parquet(f"{path}/postings").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    items.agg(F.count(F.lit(1)).alias("n")).join(total).write.mode("overwrite").parquet(f"{path}/totals")  # one row by one row


def _starts(p: Phrase, lists: list[Column]) -> Column:
    """Where a phrase stands, from its terms' positions."""
    if not lists:
        return F.array().cast("array<int>")

    def first(x: Column, j: int) -> Column:
        return F.transform(x, lambda i: i - j) if j else x

    found = reduce(F.array_intersect, [first(x, j) for j, x in enumerate(lists)])
    return F.filter(found, lambda i: i == 0) if p.initial else found


def bm25(spark: SparkSession, paths: str | list[str], query: str, columns: tuple[str, ...] = ("text", "author"), key: str = "item_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """key, keep and rank of the items that match: search.bm25's rows, from the tables at one path or several, of different items.

    The terms' rows meet by item, as counts where a phrase is one term and as positions where it is not.
    An item that has none of the terms can't match, whatever the query's tree.
    """
    tree = parse(query, columns)
    found, near = phrases(tree), _near_phrases(tree)
    wanted, parts, cols = [], {}, {}
    for k, p in enumerate(found):
        plain = len(p.terms) == 1 and not p.initial and id(p) not in near
        for c in p.columns if p.columns is not None else columns:
            lists = []
            for j, term in enumerate(p.terms):
                prefix = p.prefix and j == len(p.terms) - 1
                own = F.col("term").startswith(term) if prefix else F.col("term") == term
                here = own & (F.col("in_column") == c)
                wanted.append(own)
                slot = f"__{'n' if plain else 'p'}_{k}_{c}_{j}"
                parts[slot] = F.coalesce(F.sum(F.when(here, F.col("n"))), F.lit(0)) if plain else F.flatten(F.collect_list(F.when(here, F.col("positions"))))
                lists.append(F.col(slot))
            starts = _starts(p, lists)
            if id(p) in near:
                cols[f"__s{k}_{c}"] = starts
            else:
                cols[f"__n{k}_{c}"] = lists[0] if plain else F.size(starts)
    at = [paths] if isinstance(paths, str) else paths
    tables = spark.read.parquet(*[f"{p}/postings" for p in at])
    rows = tables.where(reduce(lambda a, b: a | b, wanted, F.lit(False)))
    rows = rows.groupBy(key, *keep).agg(F.max("dl").alias("dl"), *[x.alias(n) for n, x in parts.items()])
    match, tf, has = _weights(tree, found, columns)
    rows = rows.select(key, *keep, "dl", *[x.alias(n) for n, x in cols.items()])
    rows = rows.select(key, *keep, "dl", match.alias("__m"), *[x.alias(f"__f{k}") for k, x in tf.items()], *[x.alias(f"__d{k}") for k, x in has.items()])
    totals = spark.read.parquet(*[f"{p}/totals" for p in at]).agg(F.sum("n").alias("n"), F.try_divide(F.sum("total"), F.sum("n")).alias("avgdl"))
    return _scored(rows, list(tf), key, keep, totals)
