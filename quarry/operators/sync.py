"""Incremental sync: what is new, stale or changed, and upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def new_items(incoming: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    return incoming.join(existing.select(key), key, "left_anti")


def stale(registry: DataFrame, current: DataFrame, key: str = "file_path") -> DataFrame:
    return registry.join(current.select(key), key, "left_anti").select(key)


def classify(current: DataFrame, registry: DataFrame, key: str = "file_path", trust_mtime: bool = False) -> DataFrame:
    """key, state: new, unchanged, touched (other mtime, same hash) or changed. trust_mtime: an equal mtime is enough."""
    old = registry.select(F.col(key), F.col("mtime").alias("old_mtime"), F.col("content_hash").alias("old_hash"))
    same = F.col("content_hash") == F.col("old_hash")
    when = F.when(F.col("old_hash").isNull(), "new")
    if trust_mtime:
        when = when.when(F.col("mtime") == F.col("old_mtime"), "unchanged")
    state = when.when(same & (F.col("mtime") == F.col("old_mtime")), "unchanged").when(same, "touched").otherwise("changed")
    return current.join(old, key, "left").select(key, state.alias("state"))


def report(states: DataFrame, gone: DataFrame) -> DataFrame:
    """One row: scanned, changed (new ones too), touched, deleted."""
    counts = states.agg(F.count(F.lit(1)).alias("scanned"), F.count_if(F.col("state").isin("new", "changed")).alias("changed"), F.count_if(F.col("state") == "touched").alias("touched"))
    return counts.join(gone.agg(F.count(F.lit(1)).alias("deleted")))


def upsert(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key. max_by combines before the shuffle, so a hot key is no hot task."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__r")).select(*keys, "__r.*")


def item_id(source_type, identifier):
    return F.xxhash64(source_type, identifier)


def named_by_file(chunks: DataFrame) -> DataFrame:
    """chunks (file_path, ordinal, ...) with n, their file's number of chunks, and an identifier: the path, with the ordinal where n isn't 1."""
    n = chunks.groupBy("file_path").agg(F.count(F.lit(1)).alias("n"))
    name = F.when(F.col("n") == 1, F.col("file_path")).otherwise(F.concat_ws("::", "file_path", F.col("ordinal").cast("string")))
    return chunks.join(n, "file_path").withColumn("identifier", name)
