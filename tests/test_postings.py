"""Stored postings against the same scores from texts, on generated queries."""

import pytest
from test_fts_language import ROWS as TEXTS
from test_fts_language import query

from quarry.operators import postings, search
from quarry.operators.fts_query import QuerySyntaxError, parse


def generated(n):
    import random

    rng, out = random.Random(11), []
    while len(out) < n:
        q = query(rng, 3)
        try:
            parse(q)
        except QuerySyntaxError:
            continue
        out.append(q)
    return out


def items(spark):
    rows = [(i, "a" if i % 2 else "b", *t) for i, t in enumerate(TEXTS, 1)] + [(90, "a", None, None)]
    return spark.createDataFrame(rows, "item_id long, source_type string, text string, author string")


def test_same_scores_as_from_texts(spark, tmp_path):
    every, path = items(spark), str(tmp_path / "all")
    postings.write(every, path, keep=("source_type",))
    indexed = search.index(every)
    near = ["NEAR(the day crash, 2)", "^ day OR da*", 'author : "alice bob"', "(crash NOT alice) OR NEAR(the crash)", '""', "nothing"]
    for q in generated(8) + near:
        want = {r.item_id: (r.source_type, round(r["rank"], 9)) for r in search.bm25(indexed, q, keep=("source_type",)).collect()}
        got = {r.item_id: (r.source_type, round(r["rank"], 9)) for r in postings.bm25(spark, path, q, keep=("source_type",)).collect()}
        assert got == want, q


def test_several_paths_are_one_index(spark, tmp_path):
    every, paths = items(spark), []
    for s in ("a", "b"):
        paths.append(str(tmp_path / s))
        postings.write(every.where(f"source_type = '{s}'"), paths[-1], keep=("source_type",))
    got = {r.item_id: r["rank"] for r in postings.bm25(spark, paths, "crash OR da*", keep=("source_type",)).collect()}
    assert got == pytest.approx({r.item_id: r["rank"] for r in search.bm25(search.index(every), "crash OR da*").collect()})


def test_no_items(spark, tmp_path):
    postings.write(items(spark).limit(0), str(tmp_path / "none"))
    assert postings.bm25(spark, str(tmp_path / "none"), "crash").collect() == []


def test_terms_reach_the_scan(spark, tmp_path, capsys):
    path = str(tmp_path / "all")
    postings.write(items(spark), path)
    postings.bm25(spark, path, "crash OR da*").explain("formatted")
    plan = capsys.readouterr().out
    assert "EqualTo(term,crash)" in plan and "StringStartsWith(term,da)" in plan
    assert "positions" not in plan  # single terms need their counts only
