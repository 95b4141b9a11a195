"""All queries over the search engine's operators, and the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import chunking, embed, postings, results, search, store, symbols, sync
from quarry.operators.walk import walk

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
K = 20


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _ranks(spark, sf_dir, text: str) -> DataFrame:
    """item_id and rank of the documents that match."""
    items = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), "text")
    return postings.bm25(spark, store.indexed(spark, "documents", [f"{sf_dir}/documents.parquet"], items), text)


def _vectors(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding", "label")
    return v, v.where("item_id = 0").select("embedding")


_TOK = r"regexp_extract_all(lower(strip_accents({0})), '[\p{{L}}\p{{N}}]+')"


def _count(term: str, toks: str = "toks") -> str:
    """SQL for how often a phrase stands in a token list; term* is a prefix, ^term the first token."""
    words = term.strip("^*").split()
    if term.startswith("^"):
        return f"(CASE WHEN {toks}[1] = '{words[0]}' THEN 1 ELSE 0 END)"
    tests = [f"{toks}[i + {j}] = '{w}'" if not (term.endswith("*") and j == len(words) - 1) else f"starts_with({toks}[i + {j}], '{w}')" for j, w in enumerate(words)]
    return f"len(list_filter(range(1, len({toks}) + {2 - len(words)}), lambda i: {' AND '.join(tests)}))"


def _fts_sql(terms: list[str], match: str, source: str = "SELECT doc_id AS item_id, text FROM documents", where: str = "", limit: int | None = K, names: str = "t") -> str:
    """BM25 over `source`; f1, f2 ... are the terms' counts."""
    counts = ", ".join(f"{_count(t)} AS f{k}" for k, t in enumerate(terms, 1))
    ns = ", ".join(f"count(*) FILTER (WHERE f{k} > 0) AS n{k}" for k in range(1, len(terms) + 1))
    score = " + ".join(f"greatest(CASE WHEN ln((n - n{k} + 0.5) / (n{k} + 0.5)) > 0 THEN ln((n - n{k} + 0.5) / (n{k} + 0.5)) ELSE 1e-6 END, 0) * f{k} * 2.2 / (f{k} + 1.2 * (0.25 + 0.75 * dl / a))" for k in range(1, len(terms) + 1))
    tail = f"ORDER BY rank, item_id LIMIT {limit}" if limit else ""
    return f"""{names}0 AS (SELECT *, {_TOK.format("text")} AS toks FROM ({source})),
{names}1 AS (SELECT * EXCLUDE (text), len(toks) AS dl, {counts} FROM {names}0),
{names}s AS (SELECT count(*) AS n, avg(dl) AS a, {ns} FROM {names}1),
{names} AS (SELECT * FROM (SELECT {names}1.*, round(-({score}), 9) AS rank FROM {names}1, {names}s WHERE {match}) {where} {tail})"""


def _fts(name: str, text: str, terms: list[str], match: str) -> None:
    def run(spark, sf_dir):
        return search.top(_ranks(spark, sf_dir, text), "rank", K)

    QUERIES[name] = run
    ORACLE_SQL[name] = f"WITH {_fts_sql(terms, match)} SELECT item_id, rank FROM t"


_fts("fts_and_topk", "thtion worthless", ["thtion", "worthless"], "f1 > 0 AND f2 > 0")
_fts("fts_or_topk", "trash OR clown OR license", ["trash", "clown", "license"], "f1 > 0 OR f2 > 0 OR f3 > 0")
_fts("fts_not_topk", "trash NOT scum", ["trash"], "f1 > 0 AND len(list_filter(toks, lambda x: x = 'scum')) = 0")
_fts("fts_prefix_topk", "worth* OR licen*", ["worth*", "licen*"], "f1 > 0 OR f2 > 0")
_fts("fts_phrase_topk", '"of the"', ["of the"], "f1 > 0")
_fts("fts_initial_topk", "^anblewh OR ^les", ["^anblewh", "^les"], "f1 > 0 OR f2 > 0")


@query(
    f"""WITH d AS (SELECT doc_id AS item_id, {_TOK.format("text")} AS toks FROM documents),
p AS (SELECT item_id, len(toks) AS dl, list_filter(range(1, len(toks) + 1), lambda i: toks[i] = 'the') AS x,
  list_filter(range(1, len(toks) + 1), lambda i: toks[i] = 'trash') AS y FROM d),
m AS (SELECT item_id, dl, len(list_filter(x, lambda i: len(list_filter(y, lambda j: abs(i - j) <= 4)) > 0)) AS f1,
  len(list_filter(y, lambda j: len(list_filter(x, lambda i: abs(i - j) <= 4)) > 0)) AS f2, len(x) AS c1, len(y) AS c2 FROM p),
s AS (SELECT count(*) AS n, avg(dl) AS a, count(*) FILTER (WHERE c1 > 0) AS n1, count(*) FILTER (WHERE c2 > 0) AS n2 FROM m),
i AS (SELECT *, CASE WHEN n1 + 0.5 < n - n1 + 0.5 THEN ln((n - n1 + 0.5) / (n1 + 0.5)) ELSE 1e-6 END AS i1,
  CASE WHEN n2 + 0.5 < n - n2 + 0.5 THEN ln((n - n2 + 0.5) / (n2 + 0.5)) ELSE 1e-6 END AS i2 FROM s)
SELECT item_id, round(-(i1 * f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * dl / a)) + i2 * f2 * 2.2 / (f2 + 1.2 * (0.25 + 0.75 * dl / a))), 9) AS rank
FROM m, i WHERE f1 > 0 ORDER BY rank, item_id LIMIT {K}"""
)
def fts_near_topk(spark, sf_dir):
    return search.top(_ranks(spark, sf_dir, "NEAR(the trash, 3)"), "rank", K)


@query(
    f"""WITH c AS (SELECT conv_id * 1000 + turn AS item_id, {_TOK.format("text")} AS a, {_TOK.format("role")} AS b FROM conversations),
m AS (SELECT item_id, len(a) + len(b) AS dl, len(list_filter(b, lambda x: x = 'user')) AS f FROM c),
s AS (SELECT count(*) AS n, avg(dl) AS a, count(*) FILTER (WHERE f > 0) AS k FROM m)
SELECT item_id, round(-(CASE WHEN ln((n - k + 0.5) / (k + 0.5)) > 0 THEN ln((n - k + 0.5) / (k + 0.5)) ELSE 1e-6 END) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / a)), 9) AS rank
FROM m, s WHERE f > 0 ORDER BY rank, item_id LIMIT {K}"""
)
def fts_column_filter(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("item_id"), "text", F.col("role").alias("author"))
    path = store.indexed(spark, "conversations", [f"{sf_dir}/conversations.parquet"], c)
    return search.top(postings.bm25(spark, path, "author : user"), "rank", K)


def _sources(spark, sf_dir) -> DataFrame:
    """Three sources as one relation of items."""
    d = table(spark, sf_dir, "documents").select(F.lit("document").alias("source_type"), F.col("doc_id").alias("item_id"), "text")
    c = table(spark, sf_dir, "conversations").select(F.lit("commit"), F.col("conv_id") * 1000 + F.col("turn"), "text")
    p = table(spark, sf_dir, "pages").select(F.lit("code"), "page_id", "html")
    return d.union(c).union(p)


def _source_ranks(spark, sf_dir, text: str) -> DataFrame:
    files = [f"{sf_dir}/{n}.parquet" for n in ("documents", "conversations", "pages")]
    path = store.indexed(spark, "sources", files, _sources(spark, sf_dir), keep=("source_type",))
    return postings.bm25(spark, path, text, keep=("source_type",))


_SOURCES_SQL = "SELECT 'document' AS source_type, doc_id AS item_id, text FROM documents UNION ALL SELECT 'commit', conv_id * 1000 + turn, text FROM conversations UNION ALL SELECT 'code', page_id, html FROM pages"


@query("WITH " + _fts_sql(["the"], "f1 > 0", _SOURCES_SQL, "WHERE source_type = 'commit'") + " SELECT item_id, source_type, rank FROM t")
def fts_filtered_by_source(spark, sf_dir):
    scored = _source_ranks(spark, sf_dir, "the")
    return search.top(scored.where("source_type = 'commit'"), "rank", K).select("item_id", "source_type", "rank")


_KNN = "SELECT vec_id AS item_id, round(list_cosine_distance(embedding::DOUBLE[], (SELECT embedding FROM embeddings WHERE vec_id = 0)::DOUBLE[]), 9) AS distance FROM embeddings"


@query(f"{_KNN} ORDER BY distance, item_id LIMIT {K}")
def knn_topk(spark, sf_dir):
    return search.knn(*_vectors(spark, sf_dir), K)


@query(f"{_KNN} WHERE label = 3 ORDER BY distance, item_id LIMIT {K}")
def knn_isolated_by_label(spark, sf_dir):
    v, q = _vectors(spark, sf_dir)
    return search.knn(v.where("label = 3"), q, K)


_TERMS, _ANY = ["trash", "onthe", "license"], "f1 > 0 OR f2 > 0 OR f3 > 0"
_HYBRID = f"""WITH {_fts_sql(_TERMS, _ANY)},
v AS ({_KNN} ORDER BY distance, item_id LIMIT {K}),
l AS (SELECT item_id, row_number() OVER (ORDER BY rank, item_id) AS pos FROM t UNION ALL SELECT item_id, row_number() OVER (ORDER BY distance, item_id) FROM v),
h AS (SELECT item_id, round(sum(1.0::DOUBLE / (60 + pos)), 9) AS score FROM l GROUP BY item_id ORDER BY score DESC, item_id LIMIT {K})"""


@query(f"{_HYBRID} SELECT item_id, score, 'hybrid' AS match_type FROM h")
def hybrid_rrf(spark, sf_dir):
    return search.hybrid(_ranks(spark, sf_dir, " OR ".join(_TERMS)), *_vectors(spark, sf_dir), K)


@query(f"WITH {_fts_sql(_TERMS, _ANY)} SELECT item_id, rank AS score, 'fts' AS match_type FROM t")
def hybrid_fts_only_fallback(spark, sf_dir):
    return search.hybrid(_ranks(spark, sf_dir, " OR ".join(_TERMS)), None, None, K)


@query(f"{_HYBRID} SELECT h.item_id, score, quality, toxic, regexp_replace(split_part(text, chr(10), 1), '\\r$', '') AS title FROM h JOIN documents d ON d.doc_id = h.item_id LEFT JOIN labels l ON l.doc_id = h.item_id")
def late_materialised_results(spark, sf_dir):
    hits = F.broadcast(hybrid_rrf(spark, sf_dir).select("item_id", "score"))  # K rows
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = d.join(hits, d.doc_id == F.col("item_id")).select("item_id", "score", T.first_line(F.col("text")).alias("title"))
    return F.broadcast(out).join(lab, F.col("item_id") == lab.doc_id, "left").select("item_id", "score", "quality", "toxic", "title")


_ORDER = ("commit", "code", "document")


def _unified(spark, sf_dir, mode: str) -> DataFrame:
    v, q = _vectors(spark, sf_dir)
    sourced = v.withColumn("source_type", F.get(F.array(*map(F.lit, _ORDER)), (F.col("label") % 3).cast("int")))
    near = search.distances(sourced, q, ("item_id", "source_type"))
    return search.unified(_source_ranks(spark, sf_dir, "the OR of"), near, 10, _ORDER, mode)


def _unified_sql(mode: str) -> str:
    o = "o, " if mode == "concat" else ""
    case = "CASE source_type WHEN 'commit' THEN 0 WHEN 'code' THEN 1 ELSE 2 END"
    return f"""WITH {_fts_sql(["the", "of"], "f1 > 0 OR f2 > 0", _SOURCES_SQL, limit=None)},
f AS (SELECT * FROM (SELECT item_id, source_type, rank, {case} AS o, row_number() OVER (PARTITION BY source_type ORDER BY rank, item_id) AS k FROM t) WHERE k <= 10),
w AS (SELECT e.vec_id AS item_id, round(list_cosine_distance(e.embedding::DOUBLE[], (SELECT embedding FROM embeddings WHERE vec_id = 0)::DOUBLE[]), 9) AS distance, label % 3 AS o FROM embeddings e),
g AS (SELECT * FROM (SELECT *, CASE o WHEN 0 THEN 'commit' WHEN 1 THEN 'code' ELSE 'document' END AS source_type, row_number() OVER (PARTITION BY o ORDER BY distance, item_id) AS k FROM w) WHERE k <= 10),
l AS (SELECT item_id, source_type, row_number() OVER (ORDER BY {o}rank, item_id) AS pos FROM f UNION ALL SELECT item_id, source_type, row_number() OVER (ORDER BY {o}distance, item_id) FROM g),
u AS (SELECT item_id, source_type, round(sum(1.0::DOUBLE / (60 + pos)), 9) AS score, count(*) AS n_lists, source_type || ':' || item_id AS key FROM l GROUP BY item_id, source_type ORDER BY score DESC, key LIMIT 30)"""


@query(_unified_sql("concat") + " SELECT item_id, source_type, score, n_lists FROM u")
def unified_concat(spark, sf_dir):
    return _unified(spark, sf_dir, "concat")


@query(_unified_sql("global") + " SELECT item_id, source_type, score, n_lists FROM u")
def unified_global(spark, sf_dir):
    return _unified(spark, sf_dir, "global")


@query(_unified_sql("concat") + " SELECT source_type, count(*) AS n, max(score) AS best FROM u GROUP BY source_type")
def unified_groups(spark, sf_dir):
    return _unified(spark, sf_dir, "concat").groupBy("source_type").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("best"))


@query(f"SELECT doc_id, 0 AS ordinal, md5(text) AS text_md5, 1 AS line_start, greatest(1, len(string_split(regexp_replace(text, '\\n$', ''), chr(10)))) AS line_end FROM documents WHERE strlen(text) <= {chunking.LIMIT}")
def doc_chunks_small(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where(F.octet_length("text") <= chunking.LIMIT)
    c = chunking.chunks(d.select(F.col("doc_id").cast("string").alias("file_path"), F.col("text").alias("source"), F.lit("txt").alias("extension")))
    return c.select(F.col("file_path").cast("long").alias("doc_id"), "ordinal", F.md5("text").alias("text_md5"), "line_start", "line_end")


@query(f"""WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents WHERE strlen(replace(text, chr(10), chr(10) || chr(10))) > {chunking.LIMIT}),
e AS (SELECT doc_id, unnest(a) AS t, unnest(range(0, len(a))) AS i FROM d)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS ordinal, md5(t) AS text_md5, 2 * i + 1 AS line_start FROM e WHERE trim(t) <> ''""")
def doc_chunks_plain(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("file_path"), F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("source"), F.lit("txt").alias("extension"))
    c = chunking.chunks(d.where(F.octet_length("source") > chunking.LIMIT))
    return c.select(F.col("file_path").cast("long").alias("doc_id"), F.col("ordinal").cast("long").alias("ordinal"), F.md5("text").alias("text_md5"), F.col("line_start").cast("long").alias("line_start"))


@query()
def doc_chunks_markdown(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("file_path"), F.concat(F.lit("# "), F.replace("text", F.lit("\n"), F.lit("\n## "))).alias("source"), F.lit("md").alias("extension"))
    return chunking.chunks(d)


#: Files for symbol_extract; the driver's tables have no code.
RUST = [
    ("src/shape.rs", "/// A shape.\npub struct Shape {\n    sides: u32,\n}\n\nimpl Shape {\n    pub fn sides(&self) -> u32 {\n        self.sides\n    }\n}\n"),
    ("src/lib.rs", "pub mod shape;\n\nmod inner {\n    pub enum Kind {\n        A,\n    }\n\n    pub trait Named {\n        fn name(&self) -> String;\n    }\n}\n"),
]


@query()
def symbol_extract(spark, sf_dir):
    return symbols.symbols(spark.createDataFrame(RUST, "file_path string, content string"))


@query()
def embed_hashing(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", embed.embedding("text").alias("embedding"))


_EXPLODED = f"SELECT doc_id, unnest({_TOK.format('text')}) AS term FROM documents"


@query(f"SELECT term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM ({_EXPLODED}) GROUP BY term")
def term_stats(spark, sf_dir):
    # per document first: then a term's documents are a count, not a distinct
    t = table(spark, sf_dir, "documents").select("doc_id", F.explode(T.tokens(F.col("text"))).alias("term"))
    return t.groupBy("doc_id", "term").count().groupBy("term").agg(F.sum("count").alias("tf"), F.count(F.lit(1)).alias("df"))


@query(f"SELECT doc_id, len({_TOK.format('text')}) AS dl FROM documents")
def doc_lengths(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(T.tokens(F.col("text"))).cast("long").alias("dl"))


@query(f"SELECT count(*) AS n, sum(dl)::BIGINT AS total, round(avg(dl), 9) AS avgdl FROM (SELECT len({_TOK.format('text')}) AS dl FROM documents)")
def corpus_stats(spark, sf_dir):
    return doc_lengths(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), F.sum("dl").alias("total"), F.round(F.avg("dl"), 9).alias("avgdl"))


def _snapshots(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """An older and a newer listing of documents: some added, some gone, some touched, some changed."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("content_hash"))
    old = d.where("doc_id % 10 <> 0").select("doc_id", F.lit(1).alias("mtime"), "content_hash")
    new = d.where("doc_id % 10 <> 1").select("doc_id", F.when(F.expr("doc_id % 10 in (2, 3)"), 2).otherwise(1).alias("mtime"), F.when(F.expr("doc_id % 10 = 3"), F.reverse("content_hash")).otherwise(F.col("content_hash")).alias("content_hash"))
    return old, new


_SNAP = """WITH d AS (SELECT doc_id, md5(text) AS h FROM documents), o AS (SELECT doc_id, 1 AS mtime, h FROM d WHERE doc_id % 10 <> 0),
n AS (SELECT doc_id, CASE WHEN doc_id % 10 IN (2, 3) THEN 2 ELSE 1 END AS mtime, CASE WHEN doc_id % 10 = 3 THEN reverse(h) ELSE h END AS h FROM d WHERE doc_id % 10 <> 1),
c AS (SELECT n.doc_id, CASE WHEN o.h IS NULL THEN 'new' WHEN o.h = n.h AND o.mtime = n.mtime THEN 'unchanged' WHEN o.h = n.h THEN 'touched' ELSE 'changed' END AS state FROM n LEFT JOIN o USING (doc_id))"""


@query(f"{_SNAP} SELECT doc_id FROM n WHERE doc_id NOT IN (SELECT doc_id FROM o)")
def incremental_new(spark, sf_dir):
    old, new = _snapshots(spark, sf_dir)
    return sync.new_items(new, old, "doc_id").select("doc_id")


@query(f"{_SNAP} SELECT doc_id FROM o WHERE doc_id NOT IN (SELECT doc_id FROM n)")
def incremental_stale(spark, sf_dir):
    old, new = _snapshots(spark, sf_dir)
    return sync.stale(old, new, "doc_id")


@query(f"{_SNAP} SELECT * FROM c")
def incremental_classify(spark, sf_dir):
    old, new = _snapshots(spark, sf_dir)
    return sync.classify(new, old, "doc_id")


@query(f"{_SNAP} SELECT count(*) AS scanned, count(*) FILTER (WHERE state IN ('new', 'changed')) AS changed, count(*) FILTER (WHERE state = 'touched') AS touched, (SELECT count(*) FROM o WHERE doc_id NOT IN (SELECT doc_id FROM n)) AS deleted FROM c")
def sync_report(spark, sf_dir):
    old, new = _snapshots(spark, sf_dir)
    return sync.report(sync.classify(new, old, "doc_id"), sync.stale(old, new, "doc_id"))


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS k FROM events) WHERE k = 1")
def upsert_last_wins(spark, sf_dir):
    return sync.upsert(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], ["event_id"])


@query("SELECT event_id, coalesce(json_extract_string(props, '$.k'), '') AS k, coalesce(json_extract_string(props, '$.none'), 'none') AS absent FROM events")
def json_extract_defaults(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", T.json_or(F.col("props"), "$.k").alias("k"), T.json_or(F.col("props"), "$.none", "none").alias("absent"))


@query("""SELECT doc_id, '{"file_path":"' || source || '/' || doc_id || '","line_start":1,"heading_path":null}' AS metadata FROM documents""")
def json_build(spark, sf_dir):
    path = F.concat_ws("/", "source", F.col("doc_id").cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", F.to_json(F.struct(path.alias("file_path"), F.lit(1).alias("line_start"), F.lit(None).cast("string").alias("heading_path")), {"ignoreNullFields": "false"}).alias("metadata"))


@query(r"SELECT page_id, regexp_replace(replace('.\' || url, '\', '/'), '^\./', '') AS path FROM pages")
def path_canonicalise(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.canonical_path(F.concat(F.lit(".\\"), F.col("url"))).alias("path"))


@query("SELECT page_id, regexp_replace(lower(list_last(string_split(url, '/'))), '[^\\p{L}\\p{N}]', '_', 'g') || '_' || lpad(lower(format('{:x}', list_reduce(list_prepend(0::BIGINT, list_transform(range(1, length(url) + 1), lambda i: ascii(url[i])::BIGINT)), lambda a, b: (a * 31 + b) % 16777216))), 6, '0') AS slug FROM pages")
def slug_hash(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.slug(F.col("url")).alias("slug"))


@query(r"SELECT page_id, replace(replace(replace(url, '\', '\\'), '%', '\%'), '_', '\_') AS pattern FROM pages")
def like_escape(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.escape_like(F.col("url")).alias("pattern"))


@query("SELECT doc_id, split_part(text, chr(10), 1) AS title, len(string_split(regexp_replace(text, '\\n$', ''), chr(10))) AS n_lines FROM documents WHERE text <> ''")
def first_line(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text <> ''").select("doc_id", T.first_line(F.col("text")).alias("title"), T.line_count(F.col("text")).cast("long").alias("n_lines"))


@query("SELECT doc_id, 'f' || doc_id AS last FROM documents")
def last_segment(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.last_segment(F.concat(F.col("source"), F.lit("::f"), F.col("doc_id").cast("string"))).alias("last"))


@query("SELECT doc_id, split_part(text, chr(10), 1) AS title, source || chr(10) || 'Lang: ' || lang AS content FROM documents UNION ALL SELECT conv_id * 1000 + turn, split_part(text, chr(10), 1), 'Author: ' || role FROM conversations")
def card_projection(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", T.first_line(F.col("text")).alias("title"), F.concat(F.col("source"), F.lit("\nLang: "), F.col("lang")).alias("content"))
    c = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), T.first_line(F.col("text")).alias("title"), F.concat(F.lit("Author: "), F.col("role")).alias("content"))
    return d.unionByName(c)


def _hits(spark, sf_dir) -> DataFrame:
    """Documents as hits: a third without metadata, a third with broken metadata, a third with a record's fields."""
    kind = F.get(F.array(*map(F.lit, ("struct", "implmethod", "none such"))), F.expr("cast(doc_id % 9 / 3 as int)"))
    whole = F.to_json(F.struct(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("file_path"), F.lit(3).alias("line_start"), F.lit(9).alias("line_end"), kind.alias("symbol_kind"), F.format_string("%07d", "doc_id").alias("short_hash")))
    meta = F.when(F.expr("doc_id % 3 = 0"), whole).when(F.expr("doc_id % 3 = 1"), F.lit("{not json"))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), F.concat(F.lit("f::"), F.col("doc_id").cast("string")).alias("identifier"), "text", F.when(F.expr("doc_id % 2 = 0"), F.col("lang")).alias("author"), meta.alias("metadata"), F.lit(0.5).alias("score"), F.lit("fts").alias("match_type"))


_HIT = """WITH h AS (SELECT doc_id AS item_id, 'f::' || doc_id AS identifier, text, CASE WHEN doc_id % 2 = 0 THEN lang END AS author, 0.5::DOUBLE AS score, 'fts' AS match_type,
CASE WHEN doc_id % 3 = 0 THEN lpad(doc_id::VARCHAR, 7, '0') ELSE '' END AS short_hash, CASE WHEN doc_id % 3 = 0 THEN source || '/' || doc_id ELSE '' END AS file_path,
CASE WHEN doc_id % 3 = 0 THEN 3 ELSE 0 END::BIGINT AS line_start, CASE WHEN doc_id % 3 = 0 THEN 9 ELSE 0 END::BIGINT AS line_end,
CASE WHEN doc_id % 9 = 0 THEN 'struct' WHEN doc_id % 9 = 3 THEN 'implmethod' ELSE 'function' END AS symbol_kind,
regexp_replace(split_part(text, chr(10), 1), '\\r$', '') AS first FROM documents)"""


@query(f"{_HIT} SELECT item_id, identifier, short_hash, md5(text) AS text_md5, author, score, match_type FROM h")
def result_commits(spark, sf_dir):
    return results.commits(_hits(spark, sf_dir)).withColumn("text", F.md5("text")).withColumnRenamed("text", "text_md5")


@query(f"{_HIT} SELECT item_id, identifier, symbol_kind, file_path, line_start, line_end, md5(text) AS text_md5, score, match_type FROM h")
def result_code(spark, sf_dir):
    return results.code(_hits(spark, sf_dir)).withColumn("text", F.md5("text")).withColumnRenamed("text", "text_md5")


@query(f"{_HIT} SELECT item_id, identifier, file_path, md5(text) AS text_md5, score, match_type FROM h")
def result_documents(spark, sf_dir):
    return results.documents(_hits(spark, sf_dir)).withColumn("text", F.md5("text")).withColumnRenamed("text", "text_md5")


@query(f"""{_HIT} SELECT 'commit' AS source_type, first AS title, short_hash || chr(10) || 'Author: ' || coalesce(author, '') || chr(10) || 'Date: ' AS content FROM h
UNION ALL SELECT 'code', item_id::VARCHAR, file_path || chr(10) || line_start || ':' || line_end FROM h
UNION ALL SELECT 'document', file_path, first FROM h""")
def cards_by_source(spark, sf_dir):
    hits = _hits(spark, sf_dir)
    kinds = [("commit", results.commit_cards), ("code", results.code_cards), ("document", results.document_cards)]
    parts = [cards(results.RECORDS[s](hits)).select(F.lit(s).alias("source_type"), "title", "content") for s, cards in kinds]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"{_HIT} SELECT identifier, coalesce(nullif(first, ''), short_hash || chr(10) || 'Author: ' || coalesce(author, '') || chr(10) || 'Date: ') AS title, nullif(short_hash, '') AS hash, author, NULL::VARCHAR AS date FROM h")
def card_reparse(spark, sf_dir):
    hits = results.commits(_hits(spark, sf_dir))
    keys = hits.select(results.stable_key("identifier").alias("stable_key"), "identifier")
    return results.card_fields(results.commit_cards(hits)).join(keys, "stable_key").drop("stable_key")


@query(f"{_HIT} SELECT item_id, '[0.500] ' || rpad(CASE WHEN symbol_kind = 'struct' THEN 'struct' ELSE 'fn' END, 8, ' ') || ' ' || file_path || ':' || line_start || '       ' || item_id || ' — ' || first || ' [Code]' AS line FROM h")
def result_lines_code(spark, sf_dir):
    return results.line("code", results.code(_hits(spark, sf_dir))).select("item_id", "line")


@query(f"{_HIT} SELECT item_id, '[0.500] ' || CASE WHEN short_hash = '' THEN '       ' ELSE short_hash END || ' ' || coalesce(author, '') || ' — ' || first || ' [Git log]' AS line FROM h")
def result_lines_commit(spark, sf_dir):
    return results.line("commit", results.commits(_hits(spark, sf_dir))).select("item_id", "line")


@query(f"{_HIT} SELECT item_id, '[0.500] ' || file_path || ' — ' || first || ' [Documents]' AS line FROM h")
def result_lines_document(spark, sf_dir):
    return results.line("document", results.documents(_hits(spark, sf_dir))).select("item_id", "line")


@query("SELECT page_id, lower(regexp_extract(url, '\\.([^./]+)$', 1)) AS extension FROM pages")
def path_extension(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.extension(F.col("url")).alias("extension"))


@query("SELECT event_id, ts, event_type FROM events")
def log_by_time(spark, sf_dir):
    """A log, latest first."""
    return table(spark, sf_dir, "events").select("event_id", "ts", "event_type").orderBy(F.desc("ts"), "event_id")


@query("SELECT item_id, n, CASE WHEN n = 1 THEN path ELSE path || '::' || (turn - least_turn) END AS identifier FROM (SELECT conv_id * 1000 + turn AS item_id, turn, 'c' || conv_id AS path, count(*) OVER (PARTITION BY conv_id) AS n, min(turn) OVER (PARTITION BY conv_id) AS least_turn FROM conversations)")
def per_file_identifiers(spark, sf_dir):
    """Chunks named by their file, with an ordinal where it has several; counted by a combining shuffle."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("file_path"))
    rows = c.join(c.groupBy("conv_id").agg(F.min("turn").alias("first")), "conv_id").select((F.col("conv_id") * 1000 + F.col("turn")).alias("item_id"), "file_path", (F.col("turn") - F.col("first")).alias("ordinal"))
    return sync.named_by_file(rows).select("item_id", "n", "identifier")


@query("SELECT u.conv_id, u.turn, CASE WHEN coalesce(a.text, '') = '' THEN u.text ELSE u.text || chr(10) || chr(10) || a.text END AS text FROM conversations u LEFT JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user'")
def commit_text_projection(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    a = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("body"))
    return c.where("role = 'user'").join(a, ["conv_id", "turn"], "left").select("conv_id", "turn", T.commit_text(F.col("text"), F.col("body")).alias("text"))


@query("WITH RECURSIVE w AS (SELECT conv_id, turn, 0 AS depth FROM conversations c WHERE turn = (SELECT max(turn) FROM conversations m WHERE m.conv_id = c.conv_id) UNION ALL SELECT c.conv_id, c.turn, w.depth + 1 FROM w JOIN conversations c ON c.conv_id = w.conv_id AND c.turn = w.turn - 1) SELECT conv_id, turn, min(depth) AS depth FROM w GROUP BY ALL")
def recursive_walk(spark, sf_dir):
    """Commits from each tip along parents: a conversation's turns, each the parent of the next."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    node = lambda turn: F.struct("conv_id", F.expr(turn).cast("long").alias("turn")).alias
    tips = c.groupBy("conv_id").agg(F.max("turn").alias("turn")).select(node("turn")("node"))
    found = walk(tips, c.where("turn > 0").select(node("turn")("node"), node("turn - 1")("parent")))
    own = c.select(node("turn")("node")).distinct()
    return found.join(own, "node", "left_semi").select("node.conv_id", "node.turn", F.col("depth").cast("int").alias("depth"))


@query()
def content_hash_xxh3(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.content_hash("text").alias("content_hash"))
