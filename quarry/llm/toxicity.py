"""Toxicity scores by weak supervision."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import fold

#: Bounds of the sample that the model is fitted on: labelled toxic rows, and labelled other rows.
TOXIC, OTHER = 2500, 5000
THRESHOLD = 0.3
#: Entries of the mined lexicon, and letters of the word beginnings among them.
ENTRIES, STEMS = 120, (4, 5, 6)
#: Entries mined beside the fixed insults, without labels.
SEEDED = 40
WORDS = re.compile(r"[^\W\d_]+")
#: What is assumed of a voter's accuracy, and the weight of this.
ASSUMED, BELIEF = 0.8, 0.2
#: A word with letters hidden.
MASKED = re.compile(r"[a-z][*@#$]{2,}|[a-z][*@#$][a-z]")
#: An insult that is denied.
DENIED = re.compile(r"\b(?:not|never|no|isn't|aren't)(?: an?| the)? (\w+)")
#: Patterns. The first COUNTS of them only count entries, which vote already, and so have no vote; the last
#: AGAINST vote against.
PATTERNS = ("several entries", "many entries", "dense entries", "an entry and you", "shouting", "masked words", "exclamations", "no entry", "few entries in a long text", "denied insults")
COUNTS, AGAINST = 3, 3

# Common insults.
INSULTS = ["idiot", "stupid", "moron", "loser", "pathetic", "worthless", "disgusting", "trash", "scum", "clown", "dumb", "fool", "garbage", "ugly", "hate", "filthy", "vermin", "jerk", "freak", "imbecile", "bastard", "kill yourself", "shut up"]


def terms(text: str | None) -> set[str]:
    """A text's words in lower case, and with a hyphen after them the beginnings of its longer words."""
    words = set(WORDS.findall((text or "").lower()))
    out = set(words)
    for n in STEMS:
        out.update([w[:n] + "-" for w in words if len(w) > n])
    return out


def mine(texts: list[str], toxic: np.ndarray, limit: int = ENTRIES, cover: int = 3) -> list[str]:
    """Terms much more common in toxic texts that together cover these, each up to `cover` times.

    The term that adds most to the cover is taken first; terms that add little, such as the other words
    of a toxic text that was copied, never are. Only the toxic texts' counts of terms are held, and then
    which candidates each text has.
    """
    with_ = Counter()
    for t, y in zip(texts, toxic, strict=True):
        if y:
            with_.update(terms(t))
    n, m = max(1, int(toxic.sum())), max(1, int((~toxic).sum()))
    least = max(4, n // 150)
    often = {w: a for w, a in with_.items() if a >= least}
    del with_
    without, rows = Counter(), []
    for t, y in zip(texts, toxic, strict=True):
        known = terms(t) & often.keys()
        if y:
            rows.append(known)
        else:
            without.update(known)
    held: dict[str, list[int]] = {w: [] for w, a in often.items() if a / n > 8 * without[w] / m and a > 4 * without[w]}
    for i, f in enumerate(rows):
        for w in f & held.keys():
            held[w].append(i)
    need = np.full(len(rows), cover)
    out: list[str] = []
    gain = {w: float(len(x)) for w, x in held.items()}
    while gain and len(out) < limit:
        # a gain never grows, so the best of the old gains is the best if it is still as high
        w = max(gain, key=lambda w: (gain[w], -len(w), w))
        now = float((need[held[w]] > 0).sum())
        if now == gain[w]:
            if now < least:
                break
            out.append(w)
            need[held[w]] -= 1
            del gain[w]
        else:
            gain[w] = now
    return out


class LabelModel:
    """What votes say of hidden labels: accuracies and correlations by expectation and maximisation.

    Votes are 1 (toxic), -1 (not) or 0 (none). The model is a forest: P(label), and for each voter
    P(vote | label, vote of its parent), or P(vote | label) where it has none. Labels are hidden all
    along: expectation starts from the majority of votes and runs until posteriors rest. Then voters
    get parents, the forest of greatest mutual information given the label among ties above `tie`, so
    that voters that repeat each other count once; and expectation runs on until posteriors rest again.
    A voter that turns out no better than chance counts for nothing, and an abstention says nothing: that all
    abstain is a voter of its own, so that entries of one language aren't held against texts in others. Before any are counted, a voter is
    taken to be right in ASSUMED of its votes, which weighs BELIEF as much as the count.
    """

    def __init__(self, votes: np.ndarray, prior: float = 0.1, tie: float = 0.005, rounds: int = 200, rest: float = 1e-4):
        n, m = votes.shape
        self.parents = np.full(m, -1)
        self.prior, self.rounds = float(np.clip(prior, 1e-3, 0.5)), 0
        self.tables = np.zeros((m, 3, 3))
        up, down = (votes > 0).sum(axis=1), (votes < 0).sum(axis=1)
        post = np.where(up > down, 0.9, np.where((up < down) | (up == 0), 0.02, 0.3))
        if not n:
            return
        code = np.zeros((n, m, 3), np.float32)
        np.put_along_axis(code, (votes + 1).astype(int)[:, :, None], 1, axis=2)
        code = code.reshape(n, m * 3)
        post = self._run(votes, code, post, rounds, rest)
        independent = self.rounds
        self.parents = self._forest(self._joint(code, post), self._joint(code, 1 - post), tie)
        self._run(votes, code, post, rounds, rest)
        self.rounds += independent

    @staticmethod
    def _joint(code: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Weights of votes of all pairs of voters: voter, vote, voter, vote."""
        m = code.shape[1] // 3
        return ((code * weight[:, None].astype(np.float32)).T @ code).astype(float).reshape(m, 3, m, 3)

    @staticmethod
    def _forest(toxic: np.ndarray, other: np.ndarray, tie: float) -> np.ndarray:
        """Each voter's parent or -1: the maximum spanning forest over mutual information given the label."""
        m, total = len(toxic), toxic[0, :, 0].sum() + other[0, :, 0].sum()
        shared = np.zeros((m, m))
        for joint in (toxic, other):
            own = np.einsum("iaia->ia", joint)
            expected = own[:, :, None, None] * own[None, None] / max(own[0].sum(), 1e-9)
            shared += (joint * np.log(np.maximum(joint, 1e-9) / np.maximum(expected, 1e-9))).sum(axis=(1, 3)) / total
        parents, best, link = np.full(m, -1), np.full(m, -np.inf), np.full(m, -1)
        left = np.ones(m, bool)
        while left.any():  # Prim's method; a voter without a tie above the bound starts a tree
            j = int(np.argmax(np.where(left, best, -np.inf))) if (best[left] > tie).any() else int(np.argmax(left))
            parents[j], left[j] = (link[j] if best[j] > tie else -1), False
            nearer = left & (shared[j] > best)
            best[nearer], link[nearer] = shared[j][nearer], j
        return parents

    def _run(self, votes: np.ndarray, code: np.ndarray, post: np.ndarray, rounds: int, rest: float) -> np.ndarray:
        m = votes.shape[1]
        parent = np.where(self.parents < 0, np.arange(m), self.parents)
        pick = np.arange(m)
        said = code.reshape(len(code), m, 3)
        cast = said.sum(axis=0)
        for self.rounds in range(1, rounds + 1):
            logs, means = [], []
            both = said.mean(axis=0) + 1e-3
            for weight, right in ((post, 2), (1 - post, 0)):
                w = weight.astype(np.float32)
                own = np.tensordot(w, said, 1).astype(float) + 0.5 * both
                own[:, right] += BELIEF * ASSUMED * cast[:, right]
                own[:, 2 - right] += BELIEF * (1 - ASSUMED) * cast[:, 2 - right]
                means.append(own / own.sum(axis=1, keepdims=True))
                pairs = np.stack([(code[:, 3 * parent[j] : 3 * parent[j] + 3] * w[:, None]).T @ said[:, j] for j in pick[self.parents >= 0]]) if (self.parents >= 0).any() else np.zeros((0, 3, 3))
                table = np.repeat(means[-1][:, None, :], 3, axis=1)
                pairs = pairs + table[self.parents >= 0]
                table[self.parents >= 0] = pairs / pairs.sum(axis=2, keepdims=True)
                logs.append(np.log(table))
            useful = (means[0][:, 2] - means[0][:, 0]) > (means[1][:, 2] - means[1][:, 0])
            self.tables = np.where(useful[:, None, None], logs[0] - logs[1], 0.0)
            self.tables[:, :, 1] = 0
            before, post = post, self.posterior(votes)
            if np.abs(post - before).mean() < rest:
                break
        return post

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        m = votes.shape[1]
        parent = np.where(self.parents < 0, np.arange(m), self.parents)
        v = votes.astype(int) + 1
        z = np.log(self.prior / (1 - self.prior)) + self.tables[np.arange(m)[None, :], v[:, parent], v].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class ToxicityModel:
    """Voters from a fixed and a mined lexicon and patterns, a label model of their votes, and a linear classifier of its posteriors.

    Labels choose entries of the lexicon, and set slope and offset of the score; the label model and the
    classifier see none. share: that of toxic rows, which scores are calibrated to.
    """

    def __init__(self, texts: list[str], toxic: np.ndarray, share: float | None = None, steps: int = 40):
        single = [w for w in INSULTS if " " not in w]
        insulting = np.array([not set(single).isdisjoint(WORDS.findall((t or "").lower())) for t in texts], bool)
        beside = mine(texts, insulting, SEEDED) if insulting.any() else []
        lexicon = mine(texts, toxic) if toxic.any() else []
        self.lexicon = {w: i for i, w in enumerate(dict.fromkeys([*lexicon, *beside, *single]))}
        self.phrases = [w for w in INSULTS if " " in w]
        self.whole = frozenset(self.lexicon)
        self.stems = {n: frozenset(w[:-1] for w in self.lexicon if w[-1] == "-" and len(w) == n + 1) for n in STEMS}
        x = np.stack([self.features(t) for t in texts]) if texts else np.zeros((0, self.width))
        self.votes_model = LabelModel(self.votes(x), float(toxic.mean()) if toxic.any() else 0.1)
        soft = self.votes_model.posterior(self.votes(x))
        w = _logistic(x, soft, np.full(self.width, 0.3), steps)
        self.w, self.b = w[:-1], float(w[-1])
        if toxic.any() and not toxic.all():
            share = float(toxic.mean()) if share is None else share
            weight = np.where(toxic, share / toxic.mean(), (1 - share) / (1 - toxic.mean()))
            slope, offset = _logistic((x @ self.w + self.b)[:, None], toxic.astype(float), np.full(1, 1e-3), steps, weight)
            if slope > 0:
                self.w, self.b = self.w * slope, self.b * float(slope) + float(offset)

    @property
    def width(self) -> int:
        return len(self.lexicon) + len(self.phrases) + len(PATTERNS)

    def features(self, text: str | None) -> np.ndarray:
        """Which entries and phrases occur, and which PATTERNS hold."""
        out = np.zeros(self.width)
        text = text or ""
        low = text.lower()
        every = WORDS.findall(low)
        words = set(every)
        hits = words & self.whole
        for n, stems in self.stems.items():
            if stems:
                hits.update([w + "-" for w in stems & {w[:n] for w in words if len(w) > n}])
        for w in hits:
            out[self.lexicon[w]] = 1
        for k, phrase in enumerate(self.phrases):
            out[len(self.lexicon) + k] = phrase in low
        some = out.sum()
        out[-len(PATTERNS) :] = [
            some > 1,
            some > 2,
            some > 0 and 50 * some >= len(every),
            some > 0 and "you" in words,
            text.count("!") > 3 and text.isupper(),
            MASKED.search(low) is not None,
            "!!" in low,
            some == 0,
            0 < some and 1000 * some < len(every),
            some > 0 and any(w in self.whole for w in DENIED.findall(low)),
        ]
        return out

    def votes(self, x: np.ndarray) -> np.ndarray:
        """A voter for each entry, phrase and pattern but the COUNTS; the last AGAINST patterns vote against, all others for toxic."""
        v = (x > 0).astype(np.int8)
        v[:, -AGAINST:] *= -1
        return np.delete(v, np.s_[-len(PATTERNS) : COUNTS - len(PATTERNS)], axis=1)

    def score(self, texts: list[str | None]) -> np.ndarray:
        x = np.stack([self.features(t) for t in texts]) if texts else np.zeros((0, self.width))
        return 1 / (1 + np.exp(-np.clip(x @ self.w + self.b, -40, 40)))


def _logistic(x: np.ndarray, soft: np.ndarray, ridge: np.ndarray, steps: int, weight: np.ndarray | None = None) -> np.ndarray:
    """Weights and offset of a linear classifier of soft labels, by Newton's steps of the logistic loss."""
    z = np.column_stack([x, np.ones(len(x))])
    w = np.append(np.zeros(x.shape[1]), np.log(0.1 / 0.9))
    ridge = np.append(ridge, 1e-3)
    weight = np.ones(len(x)) if weight is None else weight

    def loss(w: np.ndarray) -> float:
        at = z @ w
        return float(weight @ (np.logaddexp(0, at) - soft * at) + 0.5 * ridge @ (w * w))

    now = loss(w)
    for _ in range(steps if len(x) else 0):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        slope = z.T @ (weight * (p - soft)) + ridge * w
        bend = (z * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z + np.diag(ridge)
        move = np.linalg.solve(bend, slope)
        while (then := loss(w - move)) > now and np.abs(move).max() > 1e-9:
            move = move / 2
        if then >= now:
            break
        w, now = w - move, then
    return w


def fit(docs: DataFrame, labels: DataFrame, toxic: int = TOXIC, other: int = OTHER, seed: int = 5) -> ToxicityModel:
    """A model from a bounded sample of labelled rows: those whose seeded hash of doc_id is least.

    Rows with crc32(doc_id) mod 4 of 2 are left out. Only the sample's texts reach the driver. The share
    of toxic rows is that of all labelled rows, not of the sample.
    """
    order = [F.xxhash64(F.lit(seed), "doc_id"), F.col("doc_id")]
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("y"))
    known = known.where("y in (0, 1)").where(fold("doc_id", 4) != 2)
    ids = known.where("y = 1").orderBy(*order).limit(toxic).unionByName(known.where("y = 0").orderBy(*order).limit(other))
    own = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = own.join(F.broadcast(ids), "doc_id").distinct().toLocalIterator()
    rows = sorted((r.doc_id, r.text, r.y) for r in rows)
    share = known.agg(F.avg("y")).first()[0]
    return ToxicityModel([r[1] for r in rows], np.array([r[2] == 1 for r in rows], bool), share)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs, over its whole text.

    * Null text counts as empty and gets the score of a text without any term of the lexicon.
    * Without labelled rows the lexicon is the fixed one. Null labels teach nothing; of several labels of
      a doc_id the greatest counts. Null doc_id: not held out, never learned from.
    * Repeated rows: a row each. An empty table gives an empty result. Other columns are left out.
    * Very long texts are read whole, word by word. Texts with the same votes tie and get the same score.
    """
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    held = F.coalesce(fold("doc_id", 4) == 2, F.lit(False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            score = model.score([t.as_py() for t in batch.column(2)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32), pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").select("doc_id", held.alias("held_out"), "text")
    return own.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
