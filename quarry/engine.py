"""One engine over a repository's commits, code and documents: index, sync, search."""

from __future__ import annotations

import json
import time
import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import chunking, postings, results, search, symbols, sync
from quarry.operators.embed import encode, embedding
from quarry.operators.store import path_of
from quarry.sources import git

ITEMS = "item_id long, source_type string, identifier string, text string, author string, metadata string, file_path string, embedding array<float>"
REGISTRY = "file_path string, mtime long, content_hash string, indexed_at timestamp"
SOURCES = ("commit", "code", "document")
COLUMNS = [c.split()[0] for c in ITEMS.split(", ")]
MATCH = {"rank": "fts", "distance": "vector", "score": "hybrid"}


class Engine:
    """Tables of a repository under a warehouse folder that Spark can write to, local or shared.

    Each source has its items, their postings and its files' state in a generation of its own: a new one is
    written whole, then a new pointer names it, so a reader never sees half of one, postings can't outlive
    their items, and a sync rewrites nothing of other sources. The generation before stays for readers that
    began with it; older ones go.

    encoder: texts to vectors; None for full text only. One that fails to start is a warning and the same.
    Vectors of another length than the encoder's are made anew with the next write or `settings`.
    """

    def __init__(self, spark: SparkSession, warehouse: str, repo: str, encoder: Callable | None = encode):
        self.spark, self.repo, self.encoder, self.dim = spark, git.root(repo), encoder, None
        if encoder is not None:
            try:
                self.dim = len(encoder(["dimension"])[0])
            except Exception as e:  # whatever a model's loader raises
                warnings.warn(f"no vectors, full text only: {e}", stacklevel=2)
                self.encoder = None
        name = spark.range(1).select(T.slug(F.lit(self.repo))).first()[0]
        self.path = f"{warehouse}/{name}"

    def _pointers(self) -> list[int]:
        folder, fs = path_of(self.spark, f"{self.path}/current")
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(folder) if s.getPath().getName().isdigit()) if fs.exists(folder) else []

    def meta(self) -> dict:
        """The settings: repo, each source's dim, indexed_at and generations (now and before)."""
        if not (found := self._pointers()):
            return {"repo": self.repo, "sources": {}}
        p, fs = path_of(self.spark, f"{self.path}/current/{found[-1]}")
        stream = fs.open(p)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _save(self, meta: dict) -> None:
        n = (self._pointers() or [0])[-1] + 1
        part, fs = path_of(self.spark, f"{self.path}/current/.{n}")
        out = fs.create(part, True)
        out.write(bytearray(json.dumps(meta).encode()))
        out.close()
        if not fs.rename(part, path_of(self.spark, f"{self.path}/current/{n}")[0]):
            raise RuntimeError("another process has written meanwhile")
        for old in self._pointers()[:-2]:
            fs.delete(path_of(self.spark, f"{self.path}/current/{old}")[0], False)

    def get(self, name: str, default: str | None = None) -> str | None:
        return self.meta().get("config", {}).get(name, default)

    def set(self, name: str, value: str) -> None:
        meta = self.meta()
        self._save(meta | {"config": meta.get("config", {}) | {name: value}})

    def _paths(self, sources: tuple[str, ...] = SOURCES) -> list[str]:
        known = self.meta()["sources"]
        return [f"{self.path}/{s}/gen={known[s]['generations'][0]}" for s in sources if s in known]

    def items(self, source_type: str | None = None) -> DataFrame:
        paths = [f"{p}/items" for p in self._paths((source_type,) if source_type else SOURCES)]
        return self.spark.read.schema(ITEMS).parquet(*paths) if paths else self.spark.createDataFrame([], ITEMS)

    def registry(self, source_type: str) -> DataFrame:
        paths = [f"{p}/file_state" for p in self._paths((source_type,))]
        return self.spark.read.schema(REGISTRY).parquet(*paths) if paths else self.spark.createDataFrame([], REGISTRY)

    def _write(self, source: str, items: DataFrame, registry: DataFrame | None = None) -> None:
        meta = self.meta()
        known = meta["sources"].get(source, {"generations": [], "dim": self.dim})
        if self.encoder is not None and known["dim"] not in (None, self.dim):
            asked = items.where("embedding is not null").withColumn("embedding", embedding("text", self.encoder))
            items = asked.unionByName(items.where("embedding is null"))
        g = max(known["generations"], default=0) + 1
        at = f"{self.path}/{source}/gen={g}"
        items.select(*COLUMNS).write.mode("overwrite").parquet(f"{at}/items")
        postings.write(self.spark.read.schema(ITEMS).parquet(f"{at}/items"), at, keep=("source_type",))
        if registry is not None:
            registry.write.mode("overwrite").parquet(f"{at}/file_state")
        kept = [g, *known["generations"][:1]]
        now = {"generations": kept, "dim": self.dim or known["dim"], "indexed_at": str(int(time.time()))}
        self._save(meta | {"sources": meta["sources"] | {source: now}})
        for old in set(known["generations"]) - set(kept):
            p, fs = path_of(self.spark, f"{self.path}/{source}/gen={old}")
            fs.delete(p, True)

    def _finish(self, source: str, rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("source_type", F.lit(source)).withColumn("item_id", sync.item_id("source_type", "identifier"))
        none = F.lit(None).cast("array<float>")
        if self.encoder is None:
            return rows.withColumn("embedding", none).select(*COLUMNS)
        # under when(), the encoder would run on every row
        asked = rows.where("embed").withColumn("embedding", embedding("text", self.encoder))
        return asked.select(*COLUMNS).unionByName(rows.where("not coalesce(embed, false)").withColumn("embedding", none).select(*COLUMNS))

    def index_commits(self, all_branches: bool = True) -> int:
        """Adds commits that aren't there; how many."""
        old = self.items("commit")
        new = sync.new_items(git.commits(self.spark, self.repo, all_branches), old.select(F.col("identifier").alias("sha")), "sha")
        if not (n := new.count()):
            return 0
        rows = new.select(F.col("sha").alias("identifier"), T.commit_text(F.col("message_title"), F.col("message_body")).alias("text"), F.col("author_name").alias("author"), F.to_json(F.struct("short_hash", "time")).alias("metadata"), F.lit(None).cast("string").alias("file_path"), F.lit(True).alias("embed"))
        self._write("commit", old.unionByName(self._finish("commit", rows)))
        return n

    def _index_files(self, kind: str, trust_mtime: bool) -> dict:
        """scanned, changed, touched, deleted, items (of changed files, before equal identifiers meet) and errors: files that couldn't be read, which keep what they had."""
        registry, old = self.registry(kind), self.items(kind)
        known = {r.file_path: r.mtime for r in registry.select("file_path", "mtime").collect()} if trust_mtime else None  # one row a tracked file, as the listing has
        listed = git.tracked(self.spark, self.repo, kind, known)
        errors = {r.file_path: r.error for r in listed.where("error is not null").select("file_path", "error").collect()}
        current = listed.where("error is null").withColumn("content_hash", T.content_hash("content"))
        states, gone = sync.classify(current, registry, trust_mtime=trust_mtime), sync.stale(registry, listed)
        report = sync.report(states, gone).first().asDict() | {"items": 0, "errors": errors}
        changed = current.join(states.where("state in ('new', 'changed')"), "file_path", "left_semi")
        if not report["changed"] + report["touched"] + report["deleted"]:
            return report
        if kind == "code":
            rows = symbols.symbols(changed)
            meta = F.to_json(F.struct("file_path", "line_start", "line_end", "symbol_kind", F.lit("rust").alias("language")))
            rows = rows.select("identifier", "text", "file_path", "embed", meta.alias("metadata"), F.col("line_start").alias("place"))
        else:
            rows = sync.named_by_file(chunking.chunks(changed.select("file_path", F.col("content").alias("source"), T.extension(F.col("file_path")).alias("extension"))))
            meta = F.to_json(F.struct("file_path", F.col("ordinal").alias("chunk_ordinal"), "line_start", "line_end", "heading_path"), {"ignoreNullFields": "false"})
            rows = rows.select("identifier", "text", "file_path", F.lit(True).alias("embed"), meta.alias("metadata"), F.col("ordinal").alias("place"))
        report["items"] = rows.count() if report["changed"] else 0
        last = sync.upsert(rows, ["identifier"], ["place", "text"]).drop("place").withColumn("author", F.lit(None).cast("string"))
        drop = changed.select("file_path").unionByName(gone)
        # a file that counts as unchanged by its time keeps the hash of what was indexed, and so does one with an error
        before = registry.select("file_path", F.col("mtime").alias("indexed_mtime"), F.col("content_hash").alias("indexed_hash"))
        kept_hash = F.when(F.col("state") == "unchanged", F.coalesce("indexed_hash", "content_hash")).otherwise(F.col("content_hash"))
        state = current.join(states, "file_path").join(before, "file_path", "left").select("file_path", "mtime", kept_hash.alias("content_hash"), F.current_timestamp().alias("indexed_at"))
        failed = registry.join(listed.where("error is not null"), "file_path", "left_semi").select("file_path", "mtime", "content_hash", "indexed_at")
        kept = old.join(drop, "file_path", "left_anti").select(*COLUMNS)
        self._write(kind, kept.unionByName(self._finish(kind, last)), state.unionByName(failed))
        return report

    def index_code(self) -> dict:
        return self._index_files("code", trust_mtime=False)

    def index_documents(self) -> dict:
        return self._index_files("document", trust_mtime=True)

    def index_all(self) -> dict:
        """Each source's report; a source that fails has its error, the others are indexed."""
        found: dict = {}
        for source, run in (("commit", self.index_commits), ("code", self.index_code), ("document", self.index_documents)):
            try:
                found[source] = run()
            except Exception as e:  # told to the caller
                found[source] = {"error": str(e)}
        return found

    def reindex(self, source_type: str):
        """Deletes a source, its vectors and its files' state, then indexes it again."""
        self._write(source_type, self.spark.createDataFrame([], ITEMS), self.spark.createDataFrame([], REGISTRY))
        return {"commit": self.index_commits, "code": self.index_code, "document": self.index_documents}[source_type]()

    def _hits(self, found: DataFrame) -> DataFrame:
        """Late materialisation: the few hits, then their texts."""
        items = self.items().select("item_id", "source_type", "identifier", "text", "author", "metadata")
        return items.join(F.broadcast(found.drop("source_type")), "item_id")

    def _ranks(self, query: str) -> DataFrame:
        paths = self._paths()
        if not paths:
            return self.spark.createDataFrame([], "item_id long, source_type string, rank double")
        return postings.bm25(self.spark, paths, query, keep=("source_type",))

    def _distances(self, query: str) -> DataFrame:
        """Of all items with a vector; none without an encoder, or when it fails on the query."""
        try:
            vector = self.encoder([query])[0] if self.encoder is not None else None
        except Exception as e:  # whatever a model raises
            warnings.warn(f"no vectors, full text only: {e}", stacklevel=2)
            vector = None
        if vector is None:
            return self.spark.createDataFrame([], "item_id long, source_type string, distance double")
        asked = self.spark.createDataFrame([([float(x) for x in vector],)], "embedding array<float>")
        vectors = self.items().where(F.col("embedding").isNotNull() & (F.size("embedding") == len(vector)))
        return search.distances(vectors, asked, ("item_id", "source_type"))

    def _best(self, found: DataFrame, order: str, source_type: str | None, k: int) -> DataFrame:
        own = found if source_type is None else found.where(F.col("source_type") == source_type)
        return search.top(own.select("item_id", order), order, k, ascending=order != "score")

    def _named(self, best: DataFrame, order: str) -> DataFrame:
        return self._hits(best.select("item_id", F.col(order).alias("score"), F.lit(MATCH[order]).alias("match_type")))

    def search_text(self, query: str, source_type: str | None, k: int = 10) -> DataFrame:
        """source_type None: of all sources."""
        return self._named(self._best(self._ranks(query), "rank", source_type, k), "rank")

    def search_similar(self, query: str, source_type: str, k: int = 10) -> DataFrame:
        return self._named(self._best(self._distances(query), "distance", source_type, k), "distance")

    def search_hybrid(self, query: str, source_type: str, k: int = 10, compat: bool = False) -> DataFrame:
        """compat: full text of all sources stands beside the source's vectors, as commits were searched once."""
        fts = self._best(self._ranks(query), "rank", None if compat else source_type, k)
        near = self._best(self._distances(query), "distance", source_type, k).persist()  # k rows
        if near.isEmpty():
            return self._named(fts, "rank")
        fused = search.rrf([search.ranked(fts, "rank"), search.ranked(near, "distance")])
        return self._named(self._best(fused, "score", None, k), "score")

    def search_all(self, query: str, k: int = 10, mode: str = "concat") -> DataFrame:
        """The k best of each source, fused: hits, and n_lists. Terms' postings and vectors are read once for all sources."""
        fused = search.unified(self._ranks(query), self._distances(query), k, SOURCES, mode)
        return self._hits(fused.withColumn("match_type", F.lit("hybrid")))

    def records(self, hits: DataFrame, source_type: str) -> DataFrame:
        """The hits of a source as its records."""
        return results.RECORDS[source_type](hits.where(F.col("source_type") == source_type))
