import sqlite3

import pytest
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import chunking, search, symbols, sync
from quarry.operators.fts_query import QuerySyntaxError, parse
from quarry.plans import catalog

ROWS = [
    (1, "fix the render pipeline crash", "alice"),
    (2, "render, then fix: pipeline of café", "bob"),
    (3, "temporary limitation of rendering", "alice bob"),
    (4, "", "carol"),
    (5, "fix fix fix nothing else here", "dave"),
    (6, "a crash in the pipeline", None),
]
QUERIES = ["fix", "fix pipeline", "fix OR crash", "crash NOT alice", '"render pipeline"', "rend*", "^fix", "author : alice", "- text : bob", "{text author} : bob", "NEAR(fix pipeline, 2)", "fix OR crash AND pipeline", "(fix OR crash) AND pipeline", "render + pipeline", "cafe"]


@pytest.mark.parametrize("query", QUERIES)
def test_bm25_is_that_of_sqlite(spark, query):
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE f USING fts5(text, author)")
    db.executemany("INSERT INTO f(rowid, text, author) VALUES (?, ?, ?)", ROWS)
    want = {r: round(s, 9) for r, s in db.execute("SELECT rowid, rank FROM f WHERE f MATCH ?", (query,))}
    items = spark.createDataFrame(ROWS, "item_id long, text string, author string")
    got = {r.item_id: round(r["rank"], 9) for r in search.bm25(search.index(items), query).collect()}
    assert got == pytest.approx(want, abs=1e-8)


@pytest.mark.parametrize("query", ["", "fix-crash", "what?", "it's", "a::b", "NOT a", "(a", "none : a"])
def test_syntax_errors(query):
    with pytest.raises(QuerySyntaxError):
        parse(query)


def test_rrf_is_bounded_and_counts_lists(spark):
    a = spark.createDataFrame([(1, 1), (2, 2)], "item_id long, pos int")
    got = {r.item_id: (round(r.score, 9), r.n_lists) for r in search.rrf([a, a.where("item_id = 1")]).collect()}
    assert got == {1: (round(2 / 61, 9), 2), 2: (round(1 / 62, 9), 1)}


def test_chunks():
    assert chunking.chunk("a.txt", "x\ny\n", "txt") == [("a.txt", 0, "x\ny\n", 1, 2, None)]
    assert chunking.chunk("a.txt", "", "txt")[0][3:5] == (1, 1)
    part = "w" * 6000
    got = chunking.chunk("a.txt", "\n\n".join([part] * 3), "txt")
    assert [(c[1], c[3], c[4]) for c in got] == [(0, 1, 1), (1, 3, 3), (2, 5, 5)]
    md = chunking.chunk("a.md", f"# T\n{part}\n## A\n{part}\n## B\n{part}", "md")
    assert [c[5] for c in md] == ["# T", "# T > ## A", "# T > ## B"]
    long = chunking.chunk("a.txt", "\n".join(["z" * 100] * 400) + "\n\nnext", "txt")
    assert [c[1] for c in long] == list(range(len(long))) and all(len(c[2]) <= chunking.LIMIT for c in long)


RUST = '''use std::fmt;
use std::io::{
    Read,
};

// a "standalone" note
/// Makes it.
pub fn create(a: &str) -> u8 { /* { */ let s = "}"; 'x'; 1 }
pub mod pay {
    fn helper<'a>(x: &'a str) {}
}
pub struct Gate;
impl<T> fmt::Display for Gate<T> where T: Copy {
    fn fmt(&self) { }
}
impl Gate {
    pub fn run(&self) {
        fn nested() {}
    }
}
trait Tr { fn none(&self); fn some(&self) { } }
const MAX: u8 = 3;
'''


def test_symbols():
    got = {s[0]: (s[2], s[4], s[5], s[6]) for s in symbols.extract("a.rs", RUST)}
    assert got == {
        "a.rs::create": ("function", 8, 8, True),
        "a.rs::pay": ("module", 9, 11, True),
        "a.rs::pay::helper": ("function", 10, 10, True),
        "a.rs::Gate": ("struct", 12, 12, True),
        "a.rs::fmt::Display<Gate<T>>::fmt": ("implmethod", 14, 14, True),
        "a.rs::Gate::run": ("implmethod", 17, 19, True),
        "a.rs::Tr": ("trait", 21, 21, True),
        "a.rs::Tr::some": ("traitmethod", 21, 21, True),
        "a.rs::MAX": ("const", 22, 22, True),
        "a.rs::__comments__": ("comments", 1, 22, False),
        "a.rs::__imports__": ("imports", 1, 22, False),
    }


def test_content_hash_and_upsert(spark):
    df = spark.createDataFrame([("hello",), (None,)], "t string")
    assert [r[0] for r in df.select(T.content_hash("t")).collect()] == ["9555e8555c62dcfd", None]
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "k string, seq int, v string")
    assert sorted(map(tuple, sync.upsert(rows, ["k"], ["seq"]).collect())) == [("a", 2, "y"), ("b", 1, "z")]
    assert spark.range(1).select(T.kind_label(F.lit("implmethod"))).first()[0] == "fn"


def test_chunk_queries_cover_all_documents_and_others_are_registered(spark, tmp_path, monkeypatch):
    texts = [(1, "a\nb\n"), (2, ""), (3, "c\r\nd"), (4, "word " * 2000 + "\n" + "more " * 2000), (5, None)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    given = []
    chunks = catalog.chunking.chunks
    monkeypatch.setattr(catalog.chunking, "chunks", lambda d: given.extend(r.file_path for r in d.collect()) or chunks(d))
    small = catalog.QUERIES["doc_chunks_small"](spark, str(tmp_path)).collect()
    assert [(r.doc_id, r.ordinal, r.line_start, r.line_end) for r in sorted(small)] == [(1, 0, 1, 2), (2, 0, 1, 1), (3, 0, 1, 2)]
    assert {r.doc_id for r in catalog.QUERIES["doc_chunks_plain"](spark, str(tmp_path)).collect()} == {4}
    assert sorted(given) == ["1", "2", "3", "4"]
    assert {"src/shape.rs::Shape::sides", "src/lib.rs::inner::Kind"} <= {r.identifier for r in catalog.QUERIES["symbol_extract"](spark, str(tmp_path)).collect()}
    assert sorted((r.doc_id, len(r.embedding)) for r in catalog.QUERIES["embed_hashing"](spark, str(tmp_path)).collect()) == [(i, 256) for i in range(1, 6)]


def test_symbols_in_bodies():
    source = """fn outer() {
    const LIMIT: u32 = 3;
    use std::fs;
    fn inner() {}
    struct Local;
    impl Local {
        fn go(&self) { fn lost() {} static N: u8 = 1; }
    }
    if true { let x = 1; }
}
impl Cart {
    const SIZE: usize = 4;
    type Item = u8;
}
trait Shape {
    type Out;
    const SIDES: u32;
    fn area(&self) -> u32;
    fn name(&self) -> u32 { 1 }
}
extern "C" { fn ffi(); }
enum Kind {
    A,
}
"""
    rows = symbols.extract("a.rs", source)
    got = {(r[0].removeprefix("a.rs::"), r[2]) for r in rows}
    assert got == {("outer", "function"), ("LIMIT", "const"), ("inner", "function"), ("Local", "struct"), ("Local::go", "implmethod"), ("N", "static"), ("SIZE", "const"), ("Item", "typealias"), ("Shape", "trait"), ("SIDES", "const"), ("Shape::name", "traitmethod"), ("Kind", "enum"), ("__imports__", "imports")}
    text = {r[0]: r[1] for r in symbols.extract("a.rs", source, whole=True)}
    assert text["a.rs::Kind"] == "enum Kind {\n    A,\n}" and {r[0]: r[1] for r in rows}["a.rs::Kind"] == "enum Kind {"
