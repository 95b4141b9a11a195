"""Language identification by hyperdimensional profiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.llm.common import fold

#: Dimensions of the vectors, letters of an n-gram, documents to learn from per language, languages at most.
DIM, NGRAM, SAMPLE, LANGUAGES = 1024, 3, 600, 500
#: Parts of a unit vector's length that are summed, in whole numbers, so that the order of summing doesn't matter.
PARTS = 1 << 24
#: Letters that get vectors of their own are told apart by code modulo this; the sign between words is 0.
SLOTS = 1021
#: Documents and distinct n-grams that are turned into vectors at once; characters of a text that are read at once.
ROWS, COLUMNS, CHARS = 64, 4096, 1 << 20
UNKNOWN = "und"

_LETTER: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """For each code point its slot from 1, or 0 if it's no letter."""
    if not _LETTER:
        _LETTER.append(np.fromiter((1 + c % (SLOTS - 1) if chr(c).isalpha() else 0 for c in range(0x110000)), np.int32, 0x110000))
    return _LETTER[0]


def letter_vectors(dim: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2, (SLOTS, dim), np.int8) * 2 - 1


def ngram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of letters, with the sign between words, and how often they occur. Long texts are read in parts."""
    table, parts = letter_table(), []
    text = text.lower()
    for a in range(0, max(1, len(text)), CHARS):
        code = table[np.frombuffer(text[max(0, a - NGRAM + 1) : a + CHARS].encode("utf-32-le", "surrogatepass"), np.uint32)]
        code = code[(code > 0) | np.concatenate([[True], code[:-1] > 0])].astype(np.int32)
        if a == 0:
            code = np.concatenate([[0], code])
        if a + CHARS >= len(text):
            code = np.concatenate([code, [0]])
        if len(code) >= NGRAM:
            gram = code[: len(code) - NGRAM + 1].copy()
            for k in range(1, NGRAM):
                gram = gram * SLOTS + code[k : len(code) - NGRAM + 1 + k]
            gram = np.sort(gram[gram > 0])
            at = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]])) if len(gram) else np.zeros(0, int)
            parts.append((gram[at], np.diff(np.append(at, len(gram)))))
    if len(parts) == 1:
        return parts[0]
    if not parts:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    every = np.concatenate([p[0] for p in parts])
    names, back = np.unique(every, return_inverse=True)
    return names, np.bincount(back, np.concatenate([p[1] for p in parts])).astype(np.int64)


def ngram_vectors(grams: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """Binding: the product of the letters' vectors, each rotated by its distance from the n-gram's end."""
    out = np.ones((len(grams), letters.shape[1]), np.int8)
    rest = grams.astype(np.int64)
    for k in range(NGRAM):
        out *= np.roll(letters, k, axis=1)[rest % SLOTS]
        rest //= SLOTS
    return out


def bundle(counted: list[tuple[np.ndarray, np.ndarray]], letters: np.ndarray) -> np.ndarray:
    """Bundling: for each document the sum of its n-grams' vectors."""
    out = np.zeros((len(counted), letters.shape[1]), np.float32)
    names = np.unique(np.concatenate([g for g, _ in counted])) if counted else np.zeros(0)
    for a in range(0, len(names), COLUMNS):
        part = names[a : a + COLUMNS]
        weights = np.zeros((len(counted), len(part)), np.float32)
        for i, (g, n) in enumerate(counted):
            lo, hi = np.searchsorted(g, (part[0], part[-1] + 1))
            weights[i, np.searchsorted(part, g[lo:hi])] = n[lo:hi]
        out += weights @ ngram_vectors(part, letters).astype(np.float32)
    return out


def cosine(vectors: np.ndarray, prototypes: np.ndarray) -> np.ndarray:
    norm = np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    return (vectors / norm) @ (prototypes / np.maximum(np.linalg.norm(prototypes, axis=1, keepdims=True), 1e-9)).T


def unit_vectors(counted: list[tuple[np.ndarray, np.ndarray]], letters: np.ndarray) -> np.ndarray:
    vectors = bundle(counted, letters)
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)


class Profiles:
    """Prototypes of languages: the bundle of a language's n-grams, less what all have in common."""

    def __init__(self, langs: list[str], sums: np.ndarray, dim: int = DIM, seed: int = 7):
        """langs in order, and for each the sum of its documents' unit vectors."""
        self.dim, self.seed, self.langs = dim, seed, langs
        self.prototypes = (sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)).astype(np.float32)
        self.common = self.prototypes.mean(axis=0) if len(langs) > 1 else np.zeros(dim, np.float32)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        counted = [ngram_counts(t or "") for t in texts]
        some = [i for i, (g, _) in enumerate(counted) if len(g)]
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        letters = letter_vectors(self.dim, self.seed)
        for a in range(0, len(some), ROWS):
            rows = some[a : a + ROWS]
            if not self.langs:
                break
            vectors = unit_vectors([counted[i] for i in rows], letters)
            near = cosine(vectors - self.common, self.prototypes - self.common)
            best = near.argmax(axis=1)
            for i, b, s in zip(rows, best, near.max(axis=1), strict=True):
                names[i], scores[i] = self.langs[b], float(min(1.0, max(0.0, (s + 1) / 2)))
        return names, scores


def fit(pool: DataFrame, sample: int, languages: int, dim: int, seed: int) -> Profiles:
    """Profiles from at most `sample` documents of each of the `languages` most frequent values of lang.

    pool: doc_id, lang, text, all of them known. A language's documents are those whose seeded hash is
    least: a count says below which hash they must be, so no task sees more than about two samples of a
    language. Only the languages' vectors reach the driver.
    """
    counts = pool.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(languages)
    least = F.least(F.lit(1.0), F.lit(1.5 * sample + 60) / F.col("n")) * F.lit(float(1 << 53))
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 11)
    near = pool.select("doc_id", "lang", u.alias("u")).join(F.broadcast(counts), "lang").where(F.col("u") < least)
    order = W.partitionBy("lang").orderBy("u", "doc_id")
    chosen = near.select("doc_id", "lang", "u").distinct().withColumn("k", F.row_number().over(order)).where(F.col("k") <= sample).select("doc_id", "lang")
    texts = pool.join(F.broadcast(chosen), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = letter_vectors(dim, seed)
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                part = batch.slice(a, ROWS)
                vectors = np.rint(unit_vectors([ngram_counts(t) for t in part.column(1).to_pylist()], letters).astype(np.float64) * PARTS).astype(np.int64)
                names = np.array(part.column(0).to_pylist(), object)
                some = sorted(set(names))
                sums = [vectors[names == x].sum(axis=0) for x in some]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), pa.array(sums, pa.list_(pa.int64()))], ["lang", "v"])

    parts = texts.select("lang", "text").mapInArrow(run, "lang string, v array<long>").select("lang", F.posexplode("v").alias("d", "x"))
    total = parts.groupBy("lang", "d").agg(F.sum("x").alias("x")).groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("d", "x"))).getField("x").alias("v"))
    found = sorted((r.lang, r.v) for r in total.collect())  # `languages` rows at most
    return Profiles([x for x, _ in found], np.array([v for _, v in found], np.float64).reshape(len(found), dim), dim, seed)


def language_id(docs: DataFrame, sample: int = SAMPLE, dim: int = DIM, seed: int = 7, languages: int = LANGUAGES) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of docs, over its whole text.

    Prototypes are learned from at most `sample` texts per language (those whose seeded hash of doc_id is
    least) among rows with text and lang whose crc32(doc_id) mod 3 is not 1; the rest is held out. Of a
    column with more than `languages` values the most frequent ones are learned. score is (1 + cosine) / 2
    against the chosen prototype; all vectors are taken relative to the mean prototype.

    * Null text, or text without a letter: `und`, 0. So are all rows if there is nothing to learn from.
    * Null doc_id: not held out, never learned from. Repeated rows: a row each; a doc_id is learned from
      once per language, by the first of its texts in order. Very long texts are read in parts, as a whole.
    * Ties between languages go to the first in alphabetical order.
    * An empty table gives an empty result. Other columns are left out.
    """
    held = F.coalesce(fold("doc_id", 3) == 1, F.lit(False))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"))
    pool = own.where("doc_id is not null and lang is not null and text is not null").where(~held)
    sent = docs.sparkSession.sparkContext.broadcast(fit(pool, sample, languages, dim, seed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                part = batch.slice(a, ROWS)
                names, scores = model.predict(part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return own.select("doc_id", held.alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
