"""Similarity join of documents on sets of word shingles, and the groups it makes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import Scratch, arrow_rows, broadcast_if_small, checkpointed
from quarry.llm.components import components
from quarry.llm.words import scramble, shingle_sets

#: Common shingles that come last in the order of prefixes, at most; and how many of a task's it reports.
COMMON, TASK_COMMON, TASK_LEAST, BATCH = 100_000, 20_000, 8, 2_000_000
#: Bits of the parity sketch of a set, as numbers of 64.
SKETCH = 8
#: Rows of one or two longs, pairs of documents to verify, up to which they are broadcast (32 MB).
PAIR_ROWS = 2_000_000
#: Pairs whose texts are unpacked at once.
UNPACKED = 32

BITS = [f"bits{i}" for i in range(SKETCH)]


def _runs(sorted_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]])) if len(sorted_) else np.zeros(0, int)
    return sorted_[at], np.diff(np.append(at, len(sorted_)))


def common_shingles(docs: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles, sorted, and the logarithm of how many documents have them.

    Any choice of them leaves the join exact: it only sets the order in which prefixes are taken. So
    tasks count shingles of all documents in the lower half of the hashes, from which prefixes are
    mostly taken, and report their most frequent ones; sums are cut to a fixed number.
    """

    def run(batches):
        for batch in batches:
            held, n = [], 0

            def told():
                names, counts = _runs(np.sort(np.concatenate(held)))
                keep = np.flatnonzero(counts >= TASK_LEAST)
                keep = keep[np.argsort(-counts[keep], kind="stable")[:TASK_COMMON]]
                return pa.RecordBatch.from_arrays([pa.array(names[keep].view(np.int64)), pa.array(counts[keep].astype(np.int64))], ["h", "n"])

            for s in shingle_sets(batch.column(0), size):
                held.append(s[: np.searchsorted(s, np.uint64(1 << 63))])
                n += len(held[-1])
                if n >= BATCH:
                    yield told()
                    held, n = [], 0
            if n:
                yield told()

    found = docs.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    top = found.orderBy(F.desc("n"), "h").limit(COMMON).toArrow()
    h, n = top.column("h").to_numpy().view(np.uint64), top.column("n").to_numpy()
    order = np.argsort(h)
    return h[order], np.log2(np.maximum(1, n[order])).astype(np.int64) + 1


def _parity(s: np.ndarray) -> np.ndarray:
    """For each bit of the sketch, whether an odd number of shingles has it."""
    bit = (s >> np.uint64(7)) % np.uint64(64 * SKETCH)
    odd = (np.bincount(bit.astype(np.int64), minlength=64 * SKETCH) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64)


def profiles(docs: DataFrame, size: int, percent: int, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id, n, s1, s2 (the set's fingerprint), g (hash of prefix and size), the sketch, prefix: of each text with a word."""
    sent = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, weight = sent.value
        for batch in batches:
            ids, ns, s1, s2, gs, sketches, prefixes = [], [], [], [], [], [], []
            for i, s in enumerate(shingle_sets(batch.column(1), size)):
                n = len(s)
                if not n:
                    continue
                if len(often):
                    at = np.minimum(np.searchsorted(often, s), len(often) - 1)
                    level = np.where(often[at] == s, weight[at], 0)
                    ordered = s[np.lexsort((s, level))] if level.any() else s
                else:
                    ordered = s
                prefix = ordered[: n - (-(-percent * n // 100)) + 1]
                ids.append(i)
                ns.append(n)
                s1.append(int(s.sum(dtype=np.uint64).view(np.int64)))
                s2.append(int(scramble(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).view(np.int64)))
                gs.append(int(scramble(scramble(prefix).sum(dtype=np.uint64, keepdims=True) + np.uint64(n)).view(np.int64)[0]))
                sketches.append(_parity(s))
                prefixes.append(prefix.view(np.int64))
            if not ids:
                continue
            offsets = np.append(0, np.cumsum([len(p) for p in prefixes])).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(ids)),
                    pa.array(ns, pa.int64()),
                    pa.array(s1, pa.int64()),
                    pa.array(s2, pa.int64()),
                    pa.array(gs, pa.int64()),
                    *(pa.array(column) for column in np.stack(sketches, axis=1)),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(prefixes))),
                ],
                ["doc_id", "n", "s1", "s2", "g", *BITS, "prefix"],
            )

    longs = ["doc_id", "n", "s1", "s2", "g", *BITS]
    return docs.select("doc_id", "text").mapInArrow(run, ", ".join(f"{c} long" for c in longs) + ", prefix array<long>")


def _packed(texts: DataFrame) -> DataFrame:
    """texts, whose last column is the text, with that column as compressed bytes."""
    schema = ", ".join([f"{c} long" for c in texts.columns[:-1]] + ["packed binary"])

    def run(batches):
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            packed = pa.array([pack(t.as_buffer()) for t in batch.column(batch.num_columns - 1)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], packed], [*batch.schema.names[:-1], "packed"])

    return texts.mapInArrow(run, schema)


def _verified(pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """a, packed_a, b, packed_b: the pairs a, b that link."""

    def run(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            same = []
            for at in range(0, batch.num_rows, UNPACKED):
                part = batch.slice(at, UNPACKED)
                left, right = (shingle_sets(pa.array([unpack(t.as_buffer()) for t in part.column(c)], pa.binary()), size) for c in (1, 3))
                for x, y in zip(left, right, strict=True):
                    i = len(np.intersect1d(x, y, assume_unique=True))
                    same.append(i > 0 and 100 * i >= percent * (len(x) + len(y) - i))
            keep = pa.array(same, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(2).filter(keep)], ["a", "b"])

    return pairs.mapInArrow(run, "a long, b long")


def _close(percent: int) -> str:
    """Without loss: sizes and sketches of a pair that can still be similar enough."""
    least = f"((x.n + y.n) * {percent} + {100 + percent} - 1) div {100 + percent}"
    apart = " + ".join(f"bit_count(x.{b} ^ y.{b})" for b in BITS)
    return f"100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n) and {apart} <= x.n + y.n - 2 * ({least})"


def _enough(percent: int) -> str:
    """Without loss: sizes n_x, n_y and the number k of common prefix shingles of a pair that can be similar enough.

    Of the two prefixes' last shingles one is first in the global order. That set's common shingles up to
    it are in both prefixes; beyond its prefix it has ceil(percent * n / 100) - 1 more.
    """
    beyond = f"({percent} * greatest(n_x, n_y) + 99) div 100 - 1"
    return f"100 * least(n_x, n_y) >= {percent} * greatest(n_x, n_y) and {100 + percent} * (k + {beyond}) >= {percent} * (n_x + n_y)"


def similar_groups(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id: which documents are linked, by sets of word shingles.

    A-Z are lower-cased; words are runs of other than space and tab to carriage return. Two documents
    link if 100 * |intersection| >= percent * |union| of their sets of distinct `size`-word shingles (a
    shorter text is one shingle as a whole). component_id is the least doc_id that links lead to.

    1. Equal sets are one representative, found by an aggregate on fingerprints.
    2. Representatives with the same prefix (the |A| - ceil(t|A|) + 1 first shingles of a global order,
       common shingles last) and size are one group; only groups are posted under the prefix's shingles.
    3. Each group meets the group with the least doc_id of each shingle it is posted under, and each
       member its group's least member. Of a group's pairs that sizes and parity sketches can't rule out,
       the one with most common prefix shingles is verified on whole texts, and components are found.
    4. Only shingles whose postings are then in different components are looked at again, and groups
       whose members are. Under such a shingle the groups outside its largest component meet, by bands
       of size, those of other components; so one large cluster under a shingle isn't paired with itself.
       Pairs of groups that sketches can't rule out, and with enough common prefix shingles, are expanded
       to members, which sketches rule out or whole sets verify.
    Steps 3 and 4 lose no link between components; links inside a component aren't needed.

    * Null or empty text, or only blanks: n_shingles 0, linked with nothing.
    * Null doc_id: left out. Repeated rows of a doc_id: one result row (of differing texts, the largest
      set and the least component). An empty table gives an empty result; other columns are left out.
    * Very long texts count as a whole: their words are hashed block by block, and their prefix grows with them.
    """
    spark = docs.sparkSession
    own = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts = own.where("text is not null")
    with arrow_rows(spark, 1000), Scratch(spark) as scratch:
        linked = checkpointed(_linked(texts, size, percent, scratch))
    all_ids = own.select("doc_id").distinct()
    return all_ids.join(linked.withColumnRenamed("doc_id", "__id"), F.col("doc_id") == F.col("__id"), "left").select(
        "doc_id", F.coalesce("n_shingles", F.lit(0)).cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")
    )


def _linked(texts: DataFrame, size: int, percent: int, scratch: Scratch) -> DataFrame:
    """doc_id, n_shingles, component_id of documents with a word. Sides that grow with the documents are always shuffled."""
    every = scratch.table(profiles(texts, size, percent, common_shingles(texts, size)))
    reps = every.groupBy("s1", "s2", "n", "g").agg(F.min("doc_id").alias("rep"), *[F.min(b).alias(b) for b in BITS])
    reps = scratch.table(reps)
    groups = scratch.table(reps.groupBy("g").agg(F.min("rep").alias("head"), F.max("n").alias("n"), F.count(F.lit(1)).alias("members")))
    heads = groups.select(F.col("head").alias("doc_id"), "g").hint("merge")
    posted = scratch.table(every.select("doc_id", "g", "prefix").join(heads, ["doc_id", "g"], "left_semi").select(F.col("doc_id").alias("head"), "prefix"))
    names = scratch.table(every.select("doc_id", "n", "s1", "s2"))
    scratch.drop(every)

    whole, posted = posted, posted.select(F.explode("prefix").alias("h"), "head")
    shared = posted.groupBy("h").agg(F.min("head").alias("lead"), F.max("head").alias("last")).where("lead <> last")
    shared = scratch.table(shared.select(F.col("h").alias("h2"), "lead"))
    posted = scratch.table(posted.join(shared.hint("merge"), F.col("h") == F.col("h2")).select("h", "head", "lead"))
    scratch.drop(whole)
    scratch.drop(shared)
    scratch.release()

    x, y = (groups.join(reps.hint("merge"), F.col("head") == F.col("rep")).select("head", reps.n, *BITS).alias(s).hint("merge") for s in "xy")
    first = posted.where("head <> lead").groupBy(F.col("head").alias("a"), F.col("lead").alias("b")).agg(F.count(F.lit(1)).alias("k"))
    first = first.join(x, F.col("a") == F.col("x.head")).join(y, F.col("b") == F.col("y.head")).where(_close(percent))
    first = first.groupBy("a").agg(F.max(F.struct("k", (-F.col("b")).alias("b"))).alias("best")).select("a", (-F.col("best.b")).alias("b"))
    x = reps.join(groups.where("members > 1").select("g", "head"), "g").where("rep <> head").alias("x")
    inside = x.join(reps.alias("y").hint("merge"), F.col("x.head") == F.col("y.rep")).where(f"x.g = y.g and {_close(percent)}")
    inside = inside.select(F.col("x.rep").alias("a"), F.col("x.head").alias("b"))

    def verified(pairs: DataFrame) -> DataFrame:
        """Texts go to pairs, once for each and packed, not sets of 64-bit numbers."""
        pairs = scratch.table(pairs)
        left = texts.join(broadcast_if_small(pairs, PAIR_ROWS), F.col("doc_id") == F.col("a")).select("a", F.col("b").alias("to"), "text")
        asked = scratch.table(pairs.select("b").distinct())
        right = texts.join(broadcast_if_small(asked, PAIR_ROWS), F.col("doc_id") == F.col("b")).select("b", "text")
        left, right = _packed(left).withColumnRenamed("packed", "packed_a"), _packed(right).withColumnRenamed("packed", "packed_b")
        both = left.join(right.hint("merge"), F.col("to") == F.col("b")).select("a", "packed_a", "b", "packed_b")
        found = scratch.table(_verified(both, size, percent))
        scratch.release()
        return found

    edges = verified(first.unionByName(inside))
    labels = components(edges, scratch)

    def labelled(df: DataFrame, key: str) -> DataFrame:
        c = labels.select(F.col("v").alias("__v"), F.col("c").alias("__c"))
        return df.join(c, F.col(key) == F.col("__v"), "left").withColumn("c", F.coalesce("__c", key)).drop("__v", "__c")

    member = scratch.table(labelled(reps.join(groups.select("g", "head"), "g").select("rep", "n", *BITS, "head"), "rep"))
    span = scratch.table(member.groupBy("head").agg(F.max("n").alias("n"), F.min("c").alias("c_min"), F.max("c").alias("c_max"), F.count(F.lit(1)).alias("members"), *[F.min(b).alias(b) for b in BITS]))
    seen = scratch.table(posted.select("h", "head").join(span.select("head", "c_min", "c_max").hint("merge"), "head"))
    parts = seen.groupBy("h", "c_min").agg(F.max("c_max").alias("c_max"), F.count(F.lit(1)).alias("k"))
    mixed = parts.groupBy("h").agg(F.max(F.struct("k", "c_min")).alias("most"), F.min("c_min").alias("lo"), F.max("c_max").alias("hi")).where("lo <> hi")
    mixed = scratch.table(mixed.select(F.col("h").alias("h2"), F.col("most.c_min").alias("largest")))
    size_log = F.log("n") / F.log(F.lit(100 / percent))
    open_ = seen.join(mixed.hint("merge"), F.col("h") == F.col("h2")).drop("h2").withColumn("within", F.expr("c_min = largest and c_max = largest"))
    sized = span.select("head", "n", "members", size_log.alias("size_log"), *BITS)  # a sketch holds for a group of one
    open_ = scratch.table(open_.drop("largest").join(sized.hint("merge"), "head"))  # by head, so that copies of a sketch pack well
    y = open_.withColumn("band", F.floor("size_log")).drop("size_log").alias("y")
    x = open_.where("not within").withColumn("band", F.explode(F.sequence(F.floor(F.col("size_log") - 1 - 1e-9), F.floor(F.col("size_log") + 1 + 1e-9)))).drop("size_log").alias("x").hint("merge")
    fits = f"100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n) and (y.within or x.head < y.head)"
    apart = "(x.c_min <> x.c_max or y.c_min <> y.c_max or x.c_min <> y.c_min)"
    met = y.join(x, (F.col("x.h") == F.col("y.h")) & (F.col("x.band") == F.col("y.band")) & F.expr(f"{fits} and {apart} and (x.members > 1 or y.members > 1 or {_close(percent)})"))
    met = met.select(F.col("x.head").alias("hx"), F.col("y.head").alias("hy"), F.col("x.n").alias("n_x"), F.col("y.n").alias("n_y"))
    met = met.groupBy("hx", "hy", "n_x", "n_y").agg(F.count(F.lit(1)).alias("k")).where(_enough(percent)).select("hx", "hy")
    same_group = span.where("c_min <> c_max").select(F.col("head").alias("hx"), F.col("head").alias("hy"))
    met = scratch.table(met.unionByName(same_group))
    x, y = member.alias("x").hint("merge"), member.alias("y").hint("merge")
    second = met.join(x, F.col("hx") == F.col("x.head")).join(y, (F.col("hy") == F.col("y.head")) & F.expr(f"(hx <> hy or x.rep < y.rep) and x.c <> y.c and {_close(percent)}"))
    second = scratch.table(second.select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct())
    if not second.isEmpty():
        labels = components(edges.unionByName(verified(second)), scratch)

    same = reps.select("s1", "s2", "n", "rep").hint("merge")
    names = names.join(same, ["s1", "s2", "n"]).select("doc_id", "n", "rep")
    return labelled(names, "rep").groupBy("doc_id").agg(F.max("n").alias("n_shingles"), F.min("c").alias("component_id"))


def keep_first(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, with all their columns, but of each group of linked documents only the least doc_id's. Null doc_ids stay."""
    later = similar_groups(docs, size, percent).where("component_id <> doc_id").select(F.col("doc_id").alias("__later"))
    return docs.join(broadcast_if_small(checkpointed(later)), F.col("doc_id") == F.col("__later"), "left_anti")
