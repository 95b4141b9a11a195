"""Removal of lines inside three-line windows that occurred before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import checkpointed


def _windows(lines: Column, width: int) -> Column:
    """128-bit hashes of each run of `width` lines: lines are hashed once, runs over their lines' hashes."""
    hashed = F.transform(lines, F.md5)

    def window(i: Column) -> Column:
        return F.unhex(F.md5(F.array_join(F.slice(hashed, i, width), "")))

    starts = F.sequence(F.lit(1), F.size(lines) - (width - 1))
    return F.when(F.size(lines) >= width, F.transform(starts, window))


def repeated_windows(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, start (from 0): the later occurrences of every window that occurs more than once.

    Windows are ordered by doc_id, then start. Only hashes and positions are shuffled: the first
    occurrence of each hash is found by an aggregate that combines before its shuffle, and a common
    hash meets its first occurrence in a join whose large partitions Spark can split.
    """
    found = (
        docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
        .select("doc_id", F.split("text", "\n", -1).alias("lines"))
        .select("doc_id", F.posexplode(_windows(F.col("lines"), width)).alias("start", "h"))
    )
    first = found.groupBy("h").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.count(F.lit(1)).alias("n"))
    first = checkpointed(first.where("n > 1").select(F.col("h").alias("fh"), "first"))
    later = found.join(first, F.col("h") == F.col("fh")).where(F.struct("doc_id", "start") > F.col("first"))
    return later.select("doc_id", "start")


def line_dedup(docs: DataFrame, width: int = 3) -> DataFrame:
    """All rows and columns of docs, with `text` rid of repeated lines, plus n_lines and n_removed.

    Lines are what line feeds separate. Every window of `width` consecutive lines that occurred before,
    by (doc_id, line), has all its lines removed; the positions that overlapping windows cover are
    merged. The rest is joined with line feeds.

    * Null text: stays null, with n_lines and n_removed 0. Empty text: one empty line, kept.
    * Fewer lines than `width`: kept as they are. A text that is all repeats becomes empty; its row stays.
    * Null doc_id: the row is kept as it is, and is not an occurrence.
    * Repeated rows of a doc_id count as one document; each is returned.
    * Columns of docs named n_lines or n_removed are replaced; others are passed on.
    """
    starts = repeated_windows(docs.select("doc_id", "text"), width)
    gone = starts.groupBy(F.col("doc_id").alias("__ld_id")).agg(F.collect_set("start").alias("__ld_starts"))
    covered = F.array_distinct(F.flatten(F.transform("__ld_starts", lambda s: F.sequence(s, s + (width - 1)))))
    names = [c for c in docs.columns if c.lower() not in ("n_lines", "n_removed")]
    out = (
        docs.select(*names)
        .join(gone, F.col("doc_id") == F.col("__ld_id"), "left")
        .withColumn("__ld_lines", F.split("text", "\n", -1))
        .withColumn("__ld_gone", F.when(F.col("__ld_starts").isNotNull(), covered))
    )
    at = F.array_except(F.sequence(F.lit(0), F.size("__ld_lines") - 1), F.col("__ld_gone"))
    kept = F.transform(at, lambda i: F.get("__ld_lines", i))
    text = F.when(F.col("__ld_gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    return out.select(
        *[text.alias("text") if c == "text" else F.col(c) for c in names],
        F.when(F.col("text").isNull(), 0).otherwise(F.size("__ld_lines")).cast("long").alias("n_lines"),
        F.when(F.col("__ld_gone").isNull(), 0).otherwise(F.size("__ld_gone")).cast("long").alias("n_removed"),
    )


ORACLE = """
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS a FROM documents),
o AS (SELECT doc_id, a, unnest(range(0, len(a) - 2)) AS s FROM l WHERE text IS NOT NULL),
w AS (SELECT doc_id, s, md5(a[s + 1] || chr(10) || a[s + 2] || chr(10) || a[s + 3]) AS h FROM o),
r AS (SELECT doc_id, s, row_number() OVER (PARTITION BY h ORDER BY doc_id, s) AS k FROM w),
g AS (SELECT DISTINCT doc_id, s + d AS p FROM r, (VALUES (0), (1), (2)) v(d) WHERE k > 1),
e AS (SELECT doc_id, unnest(a) AS line, unnest(range(0, len(a))) AS p FROM l WHERE text IS NOT NULL),
j AS (SELECT e.doc_id, line, e.p, g.p IS NOT NULL AS gone FROM e LEFT JOIN g ON e.doc_id = g.doc_id AND e.p = g.p),
t AS (SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (WHERE NOT gone), '') AS text,
      count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed FROM j GROUP BY doc_id)
SELECT d.doc_id, t.text, d.lang, d.source, d.n_chars, coalesce(t.n_lines, 0) AS n_lines, coalesce(t.n_removed, 0) AS n_removed
FROM documents d LEFT JOIN t USING (doc_id)
"""
