"""A quality classifier learned from positive and unlabelled texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import fold

#: Bounds of the samples that the model is fitted on: trusted positives, and unlabelled texts.
POSITIVES, UNLABELLED = 5000, 10000
THRESHOLD = 0.7
#: Bytes of a text that are counted at once.
CHUNK = 1 << 20

#: Punctuation that has a feature of its own.
MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def _classes() -> np.ndarray:
    """Bytes by kind: other, lower case, upper case, digit, blank, line feed, stop, comma, bang, other mark, beyond ASCII."""
    kind = np.zeros(256, np.int64)
    for kinds, code in ((range(97, 123), 1), (range(65, 91), 2), (range(48, 58), 3), ((32, 9, 11, 12, 13), 4), ((10,), 5), (MARKS, 9), (b".", 6), (b",;:", 7), (b"!?", 8), (range(128, 256), 10)):
        kind[list(kinds)] = code
    return kind


CLASS = _classes()
KINDS = 11
N_FEATURES = KINDS * KINDS + len(MARKS) + 8


def features(text: str | None) -> np.ndarray:
    """Rates of pairs of byte kinds and of marks, word and line statistics, all of the whole text."""
    raw = (text or "").encode()
    pairs, marks = np.zeros(KINDS * KINDS), np.zeros(256)
    for a in range(0, len(raw), CHUNK):
        b = np.frombuffer(raw[max(0, a - 1) : a + CHUNK], np.uint8)
        kind = CLASS[b]
        pairs += np.bincount(kind[:-1] * KINDS + kind[1:], minlength=KINDS * KINDS)
        marks += np.bincount(b, minlength=256)
    n = max(1, len(raw))
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x]
    distinct = len(set(words)) / max(1, len(words))
    stats = [
        np.log1p(len(raw)) / 10,
        n / max(1, len(words)) / 10,
        distinct,
        np.log1p(len(words) * (1 - distinct)) / 10,
        len(set(lines)) / max(1, len(lines)),
        np.log1p(len(lines)) / 5,
        np.log1p(n / max(1, len(lines))) / 10,
        float(not words),
    ]
    return np.concatenate([np.sqrt(pairs / n), np.sqrt(marks[list(MARKS)] / n), stats]).astype(np.float32)


#: Scores' steps to one, by which the unlabelled are counted.
STEPS = 64


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, counts: np.ndarray | None = None, slack: float = 1.0) -> float:
    """The share of positives among the unlabelled, from scores that put positives on top.

    No set of scores from t up can hold more of the unlabelled than prior * the positives' share of it
    plus negatives; so the least ratio of the two shares over t, with a bound for the samples' error,
    is an estimate from above. counts: how often each of the unlabelled scores occurs, once if not given.
    """
    if not len(positive) or not len(unlabelled):
        return 0.5
    counts = np.ones(len(unlabelled)) if counts is None else counts
    at = np.unique(np.quantile(positive, np.linspace(0.02, 0.95, 60)))
    p = (positive[None, :] >= at[:, None]).mean(axis=1)
    u = np.array([counts[unlabelled >= t].sum() for t in at]) / counts.sum()
    error = slack * (np.sqrt(1 / (4 * len(positive))) + np.sqrt(1 / (4 * counts.sum())))
    best = np.argmin((u + error) / np.maximum(p, 1e-6))
    return float(np.clip(u[best] / max(p[best], 1e-6), 0.05, 0.98))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class PuModel:
    """One hidden layer, fitted to positives and unlabelled rows by the non-negative risk.

    The risk is prior * R+(p) + max(0, R-(u) - prior * R-(p)), with logistic losses; when the second
    part is negative, the step goes up its slope instead, which undoes overfitting. The prior is
    estimated from the scores of a first classifier of positives against unlabelled rows, fitted on one
    half of both: those of the positives' other half against those that `everyone` gives for its logits,
    as scores and counts, or else of the unlabelled rows' other half.
    """

    def __init__(self, positive: np.ndarray, unlabelled: np.ndarray, everyone: Callable | None = None, hidden: int = 24, steps: int = 1500, seed: int = 3):
        every = np.concatenate([positive, unlabelled])
        self.mean, self.scale = every.mean(axis=0), every.std(axis=0) + 1e-3
        p, u = self._norm(positive), self._norm(unlabelled)
        rng = np.random.default_rng(seed)
        p, u = p[rng.permutation(len(p))], u[rng.permutation(len(u))]
        hp, hu = max(1, len(p) // 2), max(1, len(u) // 2)
        first = self._fit(p[:hp], u[:hu], None, hidden, steps // 2, rng)
        others = everyone(lambda x: self._logit(self._norm(x), first)) if everyone else (self._logit(u[hu:], first),)
        self.prior = class_prior(self._logit(p[hp:], first), *others)
        self.weights = self._fit(p, u, self.prior, hidden, steps, rng)

    def _norm(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6).astype(np.float32)

    @staticmethod
    def _logit(x: np.ndarray, w: list[np.ndarray]) -> np.ndarray:
        return np.tanh(x @ w[0] + w[1]) @ w[2] + x @ w[3] + w[4]

    def _fit(self, p: np.ndarray, u: np.ndarray, prior: float | None, hidden: int, steps: int, rng: np.random.Generator) -> list[np.ndarray]:
        d = p.shape[1]
        w = [rng.normal(0, 1 / np.sqrt(d), (d, hidden)), np.zeros(hidden), rng.normal(0, 0.1, hidden), np.zeros(d), np.zeros(1)]
        m, v = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w]
        for t in range(1, steps + 1):
            bp, bu = p[rng.integers(0, len(p), 256)], u[rng.integers(0, len(u), 512)]
            x = np.concatenate([bp, bu])
            h = np.tanh(x @ w[0] + w[1])
            z = h @ w[2] + x @ w[3] + w[4]
            zp, zu = z[: len(bp)], z[len(bp) :]
            gp, gu = np.zeros(len(zp)), np.zeros(len(zu))
            if prior is None:
                gp, gu = -_sigmoid(-zp) / len(zp), _sigmoid(zu) / len(zu)
            else:
                inner = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
                if inner >= 0:
                    gp = prior * (-_sigmoid(-zp) - _sigmoid(zp)) / len(zp)
                    gu = _sigmoid(zu) / len(zu)
                else:
                    gp = prior * _sigmoid(zp) / len(zp)
                    gu = -_sigmoid(zu) / len(zu)
            g = np.concatenate([gp, gu])
            back = np.outer(g, w[2]) * (1 - h * h)
            grads = [x.T @ back + 1e-3 * w[0], back.sum(axis=0), h.T @ g + 1e-3 * w[2], x.T @ g + 1e-3 * w[3], g.sum(keepdims=True)]
            for i, gr in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * gr
                v[i] = 0.999 * v[i] + 0.001 * gr * gr
                w[i] = w[i] - 0.004 * (1 - 0.9 * t / steps) * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
        return [x.astype(np.float32) for x in w]

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self._logit(self._norm(x), self.weights).astype(np.float64))


def _features_of(rows: DataFrame) -> DataFrame:
    """rows: kind, h, doc_id, text. Gives kind, h, doc_id, x."""

    def run(batches):
        for batch in batches:
            xs = [features(t.as_py()).tolist() for t in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(xs, pa.list_(pa.float32()))], ["kind", "h", "doc_id", "x"])

    return rows.mapInArrow(run, "kind int, h long, doc_id long, x array<float>")


def _counted(texts: DataFrame, logit: Callable) -> tuple[np.ndarray, np.ndarray]:
    """Scores of all texts, rounded to steps, and how many have each: a bounded histogram reaches the driver."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                z = logit(np.stack([features(t.as_py()) for t in batch.column(0)]))
                at, n = np.unique(np.rint(np.clip(z, -40, 40) * STEPS).astype(np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n, pa.int64())], ["z", "n"])

    found = texts.mapInArrow(run, "z long, n long").groupBy("z").agg(F.sum("n").alias("n")).toArrow()
    return found.column("z").to_numpy() / STEPS, found.column("n").to_numpy().astype(float)


def fit(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED, seed: int = 3) -> PuModel | None:
    """A model from bounded samples: rows whose seeded hash of doc_id is least. None if either kind is missing.

    Positives are labelled quality 1, unlabelled are any rows, whatever their label. Rows with
    crc32(doc_id) mod 4 of 2 give neither. A doc_id counts once, with the first of its texts in order.
    The class prior is estimated from the scores of all other rows, of which a histogram, and of the
    samples feature vectors, reach the driver. Rows are put in the order of their hashes: the fit
    doesn't depend on how the tables are dealt out.
    """
    own = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(fold("doc_id", 4) != 2)
    h = F.xxhash64(F.lit(seed), "doc_id")
    good = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("q"))
    good = good.where("q = 1").where(fold("doc_id", 4) != 2).orderBy(h, "doc_id").limit(positives).select("doc_id", F.lit(1).alias("kind"))
    web = own.select("doc_id").orderBy(h, "doc_id").limit(unlabelled).distinct().select("doc_id", F.lit(0).alias("kind"))
    sample = own.join(F.broadcast(good.unionByName(web)), "doc_id").groupBy("kind", "doc_id").agg(F.min("text").alias("text"))
    rows = _features_of(sample.select("kind", h.alias("h"), "doc_id", "text")).toArrow()
    kind = rows.column("kind").to_numpy()
    if not (kind == 1).any() or not (kind == 0).any():
        return None
    x = rows.column("x").combine_chunks().flatten().to_numpy().reshape(len(kind), -1)
    order = np.lexsort((rows.column("doc_id").to_numpy(), rows.column("h").to_numpy(), kind))
    kind, x = kind[order], x[order]
    return PuModel(x[kind == 1], x[kind == 0], lambda logit: _counted(own.select("text"), logit), seed=seed)


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs, over its whole text.

    * Null text counts as empty. Without positives or unlabelled rows to learn from, all scores are 1.
    * Null doc_id: not held out, never learned from. Null labels teach nothing; of several labels of a
      doc_id the least counts. Repeated rows: a row each. An empty table gives an empty result.
    * Very long texts are counted chunk by chunk, as a whole. Other columns are left out; ties don't occur.
    """
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    held = F.coalesce(fold("doc_id", 4) == 2, F.lit(False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            texts = batch.column(2)
            if model is None or not batch.num_rows:
                score = np.ones(batch.num_rows)
            else:
                score = model.score(np.stack([features(t.as_py()) for t in texts]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32), pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").select("doc_id", held.alias("held_out"), "text")
    return own.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, whose score reaches the threshold; nulls as in quality_scores."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            if model is None or not batch.num_rows:
                yield batch
            else:
                score = model.score(np.stack([features(t.as_py()) for t in batch.column(text)]))
                yield batch.filter(pa.array(score >= threshold))

    return docs.mapInArrow(run, docs.schema)
