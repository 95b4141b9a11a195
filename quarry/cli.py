"""Command line: index a repository, search it, list its commits."""

from __future__ import annotations

import argparse
import sys
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.engine import SOURCES, Engine
from quarry.operators import results
from quarry.operators.embed import encode
from quarry.sources import git


def lines(hits: DataFrame, numbered: bool = False) -> DataFrame:
    """line: each hit in its source's layout, best first; numbered: with its place."""
    parts = [results.line(s, results.RECORDS[s](hits.where(F.col("source_type") == s))) for s in SOURCES]
    every = reduce(DataFrame.unionByName, parts)
    # distances and full-text ranks are best when least, fused scores when greatest
    best = F.when(F.col("match_type").isin("fts", "vector"), F.col("score")).otherwise(-F.col("score"))
    if not numbered:
        return every.orderBy(best, "item_id").select("line")
    place = F.row_number().over(W.orderBy(best, "item_id"))  # k rows a source
    return every.select(F.format_string("%-3d %s", place, "line").alias("line"), place.alias("place")).orderBy("place").select("line")


def arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="quarry", description=__doc__)
    parser.add_argument("--repo", default=".")
    parser.add_argument("--warehouse", default="quarry-warehouse")
    parser.add_argument("--no-embed", action="store_true", help="full text only")
    does = parser.add_subparsers(dest="does", required=True)
    index = does.add_parser("index")
    index.add_argument("--source", choices=SOURCES, help="all, if not given")
    index.add_argument("--again", action="store_true", help="delete the source first")
    search = does.add_parser("search")
    search.add_argument("query")
    search.add_argument("--source", choices=SOURCES, help="all, if not given")
    search.add_argument("--mode", choices=("text", "similar", "hybrid"), default="hybrid")
    search.add_argument("-k", type=int, default=10)
    log = does.add_parser("log")
    log.add_argument("--count", type=int)
    log.add_argument("--all-branches", action="store_true")
    return parser


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = arguments()
    a = parser.parse_args(args)
    if a.does == "index" and a.again and not a.source:
        parser.error("--again needs --source")
    if a.does == "search" and not a.source and a.mode != "hybrid":
        parser.error("--mode needs --source")
    spark = spark or SparkSession.builder.appName("quarry").getOrCreate()
    try:
        if a.does == "log":
            found = git.commits(spark, a.repo, a.all_branches)
            for r in (found if a.count is None else found.limit(a.count)).toLocalIterator():
                print(f"{r.short_hash} {r.message_title} ({r.author_name}, {r.time})")
            return 0
        engine = Engine(spark, a.warehouse, a.repo, encoder=None if a.no_embed else encode)
        if a.does == "index":
            one = {"commit": engine.index_commits, "code": engine.index_code, "document": engine.index_documents}
            report = engine.index_all() if not a.source else {a.source: engine.reindex(a.source) if a.again else one[a.source]()}
            for source, counts in report.items():
                print(f"{source}: {counts}")
            return int(any(isinstance(c, dict) and "error" in c for c in report.values()))
        if a.source:
            hits = {"text": engine.search_text, "similar": engine.search_similar, "hybrid": engine.search_hybrid}[a.mode](a.query, a.source, a.k)
        else:
            hits = engine.search_all(a.query, a.k)
        for r in lines(hits, numbered=not a.source).collect():  # k hits of a source, at most
            print(r.line)
        return 0
    except (git.GitError, ValueError) as e:
        print(f"quarry: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
