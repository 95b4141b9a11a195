"""Full-text, vector and fused top-k."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions.text import tokens
from quarry.operators.fts_query import Near, Op, Phrase, parse, phrases

K1, B, RRF_K = 1.2, 0.75, 60


def computed_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """df with more columns that later expressions read and never recompute.

    The optimizer would copy their expressions into every use, inside lambdas once for each element; a
    generator of one row is a bound it doesn't move them over.
    """
    row = F.explode(F.array(F.struct(*[x.alias(n) for n, x in columns.items()]))).alias("__once")
    return df.select("*", row).select(*df.columns, *[F.col(f"__once.{n}").alias(n) for n in columns])


def index(items: DataFrame, columns: tuple[str, ...] = ("text", "author")) -> DataFrame:
    """items with the tokens of each column (tok_<column>) and their number, dl. What a store keeps."""
    toks = {f"tok_{c}": tokens(F.col(c)) if c in items.columns else F.array().cast("array<string>") for c in columns}
    out = computed_once(items, toks)
    return out.withColumn("dl", reduce(lambda a, b: a + b, [F.size(c) for c in toks]).cast("long"))


def _starts(p: Phrase, tok: Column) -> Column:
    """Positions in a column's tokens at which the phrase stands."""
    m = len(p.terms)
    if not m:
        return F.array().cast("array<int>")

    def stands(i: Column) -> Column:
        last = F.get(tok, i + (m - 1))
        hits = [F.get(tok, i + j) == t for j, t in enumerate(p.terms[:-1])]
        hits.append(last.startswith(p.terms[-1]) if p.prefix else last == p.terms[-1])
        return F.coalesce(reduce(lambda a, b: a & b, hits), F.lit(False))

    places = F.when(F.size(tok) >= m, F.sequence(F.lit(0), F.size(tok) - m)).otherwise(F.array().cast("array<int>"))
    if p.initial:
        places = F.slice(places, 1, 1)
    return F.filter(places, stands)


def _near(ps: list[Phrase], starts: list[Column], distance: int) -> list[Column]:
    """Of each phrase's positions those that a match has: each phrase stands at most its length and `distance` before the last one."""

    def inside(p: Phrase, x: Column, last: Column) -> Column:
        return (x >= last - (len(p.terms) + distance)) & (x <= last)

    def some(p: Phrase, s: Column, last: Column) -> Column:
        return F.exists(s, lambda x: inside(p, x, last))

    def held(last: Column) -> Column:
        return reduce(lambda a, b: a & b, [some(p, s, last) for p, s in zip(ps, starts, strict=True)])

    def matched(p: Phrase, own: Column) -> Column:
        return F.filter(own, lambda x: reduce(lambda a, b: a | b, [F.exists(s, lambda last: inside(p, x, last) & held(last)) for s in starts]))

    return [matched(p, s) for p, s in zip(ps, starts, strict=True)]


def _weights(tree, found: list[Phrase], columns: tuple[str, ...]) -> tuple[Column, dict[int, Column], dict[int, Column]]:
    """Whether a row of phrase counts matches; each scoring phrase's frequency; whether an item has it at all.

    Rows hold, by phrase k and column c, __n{k}_{c} (how often it stands there) or, of phrases in a NEAR,
    __s{k}_{c} (where).
    """
    place = {id(p): k for k, p in enumerate(found)}

    def names(p: Phrase) -> tuple[str, ...]:
        return tuple(p.columns) if p.columns is not None else columns

    def count(parts: list[Column]) -> Column:
        return reduce(lambda a, b: a + b, parts, F.lit(0))

    tf: dict[int, Column] = {}
    has: dict[int, Column] = {}

    def walk(node) -> tuple[Column, list[tuple[int, Column]]]:
        if isinstance(node, Phrase):
            k = place[id(node)]
            tf[k] = count([F.col(f"__n{k}_{c}") for c in names(node)])
            has[k] = tf[k] > 0
            return has[k], [(k, F.lit(True))]
        if isinstance(node, Near):
            per = [[] for _ in node.phrases]
            for c in columns:
                if all(c in names(p) for p in node.phrases):
                    for k, x in enumerate(_near(node.phrases, [F.col(f"__s{place[id(p)]}_{c}") for p in node.phrases], node.distance)):
                        per[k].append(F.size(x))
            for p, parts in zip(node.phrases, per, strict=True):
                k = place[id(p)]
                tf[k], has[k] = count(parts), count([F.size(f"__s{k}_{c}") for c in names(p)]) > 0
            return tf[place[id(node.phrases[0])]] > 0, [(place[id(p)], F.lit(True)) for p in node.phrases]
        seen = [walk(p) for p in node.parts]
        if node.kind == "and":
            return reduce(lambda a, b: a & b, [m for m, _ in seen]), [x for _, xs in seen for x in xs]
        if node.kind == "not":
            return seen[0][0] & ~seen[1][0], seen[0][1]
        return reduce(lambda a, b: a | b, [m for m, _ in seen]), [(k, on & m) for m, xs in seen for k, on in xs]

    match, active = walk(tree)
    return match, {k: F.when(on, tf[k]).otherwise(0) for k, on in active}, {k: has[k] for k, _ in active}


def _near_phrases(node) -> set[int]:
    if isinstance(node, Near):
        return {id(p) for p in node.phrases}
    return set().union(*[_near_phrases(p) for p in node.parts]) if isinstance(node, Op) else set()


def _scored(rows: DataFrame, ks: list[int], key: str, keep: tuple[str, ...], totals: DataFrame | None = None) -> DataFrame:
    """rows: key, keep, dl, __m, and of each scoring phrase __f{k} and __d{k}. totals: n and avgdl, if rows aren't all items."""
    rows = rows.persist()
    counts = [F.count_if(f"__d{k}").alias(f"__n{k}") for k in ks]
    if totals is None:
        stats = rows.agg(F.count(F.lit(1)).alias("__n"), F.avg("dl").alias("__avg"), *counts)
    else:  # one row by one row
        stats = rows.agg(F.count(F.lit(1)).alias("__found"), *counts).join(totals.select(F.col("n").alias("__n"), F.col("avgdl").alias("__avg")))
    scored = rows.where("__m").join(F.broadcast(stats))  # one row of statistics
    score = F.lit(0.0)
    for k in ks:
        idf = F.log((F.col("__n") - F.col(f"__n{k}") + 0.5) / (F.col(f"__n{k}") + 0.5))
        f = F.col(f"__f{k}")
        score = score + F.when(idf > 0, idf).otherwise(1e-6) * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("dl") / F.col("__avg")))
    return scored.select(key, *keep, (-score).alias("rank"))


def bm25(indexed: DataFrame, query: str, columns: tuple[str, ...] = ("text", "author"), key: str = "item_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """key, keep and rank (negative, lower is better) of the items that match, from their texts.

    For items without stored postings (postings.bm25 reads those). Each phrase's frequency is a column over
    the item's own tokens, the query's tree a boolean over those: nothing is joined or grouped. Statistics
    are of all items, in one aggregate; filter afterwards. The items' narrow counts are kept in Spark's
    cache, memory or disk, so that texts are read and split once for the statistics, the scores and all
    lists that are filtered from them; what is lost is computed again.
    """
    tree = parse(query, columns)
    found = phrases(tree)
    near, cols = _near_phrases(tree), {}
    for k, p in enumerate(found):
        for c in p.columns if p.columns is not None else columns:
            starts = _starts(p, F.col(f"tok_{c}"))
            cols |= {f"__s{k}_{c}": starts} if id(p) in near else {f"__n{k}_{c}": F.size(starts)}
    match, tf, has = _weights(tree, found, columns)
    scanned = computed_once(indexed, cols).select(key, *keep, "dl", *cols)
    rows = scanned.select(key, *keep, "dl", match.alias("__m"), *[x.alias(f"__f{k}") for k, x in tf.items()], *[x.alias(f"__d{k}") for k, x in has.items()])
    return _scored(rows, list(tf), key, keep)


def top(df: DataFrame, order: str, k: int, key: str = "item_id", ascending: bool = True) -> DataFrame:
    """The k best by `order`, rounded to nine places, then key."""
    by = F.round(order, 9)
    return df.withColumn(order, by).orderBy(F.col(order).asc() if ascending else F.col(order).desc(), key).limit(k)


def top_by(df: DataFrame, by: str, order: str, k: int, key: str = "item_id") -> DataFrame:
    """The k best of each value of `by`, as top() has them. Each task keeps k of a value before the shuffle."""
    place = F.row_number().over(W.partitionBy(by).orderBy(order, key))
    return df.withColumn(order, F.round(order, 9)).withColumn("__k", place).where(F.col("__k") <= k).drop("__k")


def ranked(df: DataFrame, order: str, key: str = "item_id", ascending: bool = True) -> DataFrame:
    """A short list with pos, from 1 without ties."""
    return df.withColumn("pos", F.row_number().over(W.orderBy(F.col(order).asc() if ascending else F.col(order).desc(), key)))


def cosine_distance(a: Column, b: Column) -> Column:
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    return 1 - F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b)))


def distances(vectors: DataFrame, query: DataFrame, keep: tuple[str, ...] = ("item_id",), vector: str = "embedding") -> DataFrame:
    """keep, and each vector's distance by cosine. query: one row with `embedding`; vectors of length 0 have none."""
    q = F.broadcast(query.select(F.col(vector).alias("__q")).limit(1))
    return vectors.join(q).select(*keep, cosine_distance(F.col(vector), F.col("__q")).alias("distance")).where("distance is not null")


def knn(vectors: DataFrame, query: DataFrame, k: int, key: str = "item_id", vector: str = "embedding") -> DataFrame:
    """key and distance of the k nearest by cosine; the scan is exact."""
    return top(distances(vectors, query, (key,), vector), "distance", k, key)


def rrf(lists: list[DataFrame], k: int = RRF_K, key: str = "item_id", weights: list[float] | None = None) -> DataFrame:
    """Reciprocal rank fusion of short ranked lists (key, pos): key, score, n_lists."""
    parts = [d.select(key, (F.lit(w) / (k + F.col("pos"))).alias("c")) for d, w in zip(lists, weights or [1.0] * len(lists), strict=True)]
    return reduce(DataFrame.unionByName, parts).groupBy(key).agg(F.sum("c").alias("score"), F.count(F.lit(1)).alias("n_lists"))


def hybrid(ranks: DataFrame, vectors: DataFrame | None, vector_query: DataFrame | None, k: int, key: str = "item_id") -> DataFrame:
    """key, score, match_type. ranks: key and rank of the items that match. Without vectors: full text only, with its own scores."""
    fts = top(ranks, "rank", k, key)
    if vectors is None or vector_query is None:
        return fts.select(key, F.col("rank").alias("score"), F.lit("fts").alias("match_type"))
    near = knn(vectors, vector_query, k, key)
    fused = rrf([ranked(fts, "rank", key), ranked(near, "distance", key)], key=key)
    return top(fused, "score", k, key, ascending=False).select(key, "score", F.lit("hybrid").alias("match_type"))


def unified(fts: DataFrame, near: DataFrame, k: int, order: tuple[str, ...], mode: str = "concat") -> DataFrame:
    """item_id, source_type, score, n_lists of 3 * k at most.

    fts: item_id, source_type, rank and near: item_id, source_type, distance, of all sources at once; the k
    best of each count. concat: positions run on from source to source as `order` names them; global: by
    rank or distance over all.
    """

    def one(found: DataFrame, by: str) -> DataFrame:
        best = top_by(found.where(F.col("source_type").isin(*order)).select("item_id", "source_type", by), "source_type", by, k)
        first = [F.array_position(F.array(*map(F.lit, order)), F.col("source_type"))] if mode == "concat" else []
        return best.withColumn("pos", F.row_number().over(W.orderBy(*first, by, "item_id")))  # k rows a source

    key = F.concat_ws(":", "source_type", F.col("item_id").cast("string")).alias("key")
    fused = rrf([d.select(key, "pos") for d in (one(fts, "rank"), one(near, "distance"))], key="key")
    out = top(fused, "score", 3 * k, "key", ascending=False)
    return out.select(F.split_part("key", F.lit(":"), F.lit(2)).cast("long").alias("item_id"), F.split_part("key", F.lit(":"), F.lit(1)).alias("source_type"), "score", "n_lists")
