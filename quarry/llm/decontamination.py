"""Benchmark decontamination: passages that ask a BM25 index of test items."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import broadcast_if_small, checkpointed
from quarry.llm.words import NOT_WORD, blocks, shingles, word_hashes

#: BM25's parameters; the least share of an item's own score that is retrieved; the least overlap of question and answer.
K1, B, RETRIEVE, OVERLAP = 1.2, 0.75, 0.5, 0.8
#: Words of a shingle; items of an index; indexes that one pass over the documents asks.
SHINGLE, INDEX_ITEMS, PASS_INDEXES = 5, 20_000, 8
#: Postings of a block; ranges of items for which a passage's score is bounded at once.
BLOCK, RANGES = 32, 64
#: Pairs of passage and term that are scored at once, and words of the shortest passages' half.
PAIRS, STEP = 1 << 15, 16


def step(n_words: int) -> int:
    """The least power of two of words, from STEP, that an item fits in: passages for it are twice as long and begin every so many words."""
    return max(STEP, 1 << (max(1, n_words) - 1).bit_length())


def question_and_answer(text: str) -> tuple[str, str]:
    """An item's parts: its last sentence is the answer, unless it has only one."""
    ends = [m.end() for m in re.finditer(r"[.?!](?=\s+\S)", text)]
    return (text[: ends[-1]], text[ends[-1] :]) if ends else (text, "")


class ItemIndex:
    """An inverted index of items of one step, with BM25 impacts as shares of each item's own score.

    Passages are bags of distinct terms. A passage's score for an item is the sum of the impacts of the
    terms they share, so an item scores 1 for itself. Statistics (number of items, mean length, and each
    term's number of items) are those of all items, whatever index they are in.

    `search` is block-max WAND: a cursor for each term over its postings by item, a pivot where the terms'
    greatest impacts reach the threshold, and maxima of blocks of postings that rule the pivot out or let
    all cursors skip. Before it, `possible` rules most passages out, many at once, by maxima over ranges of items.
    """

    def __init__(self, ids: list[int], texts: list[str], n_items: int, mean: float, frequency: dict[int, int], step: int):
        order = sorted(range(len(ids)), key=lambda i: (ids[i], texts[i]))
        self.ids, self.step = [ids[i] for i in order], step
        self.questions, self.answers = [], []
        rows, cols, vals = [], [], []
        for k, i in enumerate(order):
            q, a = question_and_answer(texts[i])
            w, at = word_hashes(pa.array([q, a], pa.string()), NOT_WORD)
            n = int(at[1])
            size = min(SHINGLE, n) if n else 0
            self.questions.append((size, np.unique(shingles(w[:n], SHINGLE))))
            self.answers.append(np.unique(w[n:]))
            t, tf = np.unique(w, return_counts=True)
            d = np.array([frequency[int(x)] for x in t.view(np.int64)])
            impact = np.log(1 + (n_items - d + 0.5) / (d + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(w) / mean))
            rows.append(t)
            cols.append(np.full(len(t), k))
            vals.append(impact / max(impact.sum(), 1e-12))
        self.terms, row = np.unique(np.concatenate(rows), return_inverse=True)
        col, val = np.concatenate(cols), np.concatenate(vals)
        by = np.lexsort((col, row))
        row, self.items, self.impacts = row[by], col[by], val[by]
        self.at = np.searchsorted(row, np.arange(len(self.terms) + 1))
        n_blocks = -(-np.diff(self.at) // BLOCK)
        self.block_at = np.append(0, np.cumsum(n_blocks))
        first = np.concatenate([np.arange(x, y, BLOCK) for x, y in zip(self.at, self.at[1:], strict=False)])
        self.block_max = np.maximum.reduceat(self.impacts, first)
        self.block_last = self.items[np.minimum(first + BLOCK, np.repeat(self.at[1:], n_blocks)) - 1]
        self.term_max = np.maximum.reduceat(self.impacts, self.at[:-1])
        width = -(-len(self.ids) // RANGES)
        self.maxima = np.zeros((len(self.terms), -(-len(self.ids) // width)), np.float32)
        np.maximum.at(self.maxima, (row, self.items // width), self.impacts.astype(np.float32))
        self.likely = np.zeros(1 << 20, bool)  # rules most other words out before the terms are searched
        self.likely[(self.terms & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        self._lists: tuple | None = None

    def term_ids(self, words: np.ndarray) -> np.ndarray:
        """The words' numbers among the terms, or -1."""
        out = np.full(len(words), -1, np.int64)
        maybe = np.flatnonzero(self.likely[(words & np.uint64((1 << 20) - 1)).astype(np.int64)])
        if len(maybe):
            k = np.minimum(np.searchsorted(self.terms, words[maybe]), len(self.terms) - 1)
            same = self.terms[k] == words[maybe]
            out[maybe[same]] = k[same]
        return out

    def search(self, terms: list[int], threshold: float) -> Iterator[tuple[int, float]]:
        """(item, score) of all items that score `threshold` or more, by item."""
        if self._lists is None:
            self._lists = tuple(x.tolist() for x in (self.items, self.impacts, self.at, self.block_at, self.block_max, self.block_last, self.term_max))
        items, impacts, at, block_at, block_max, block_last, term_max = self._lists
        threshold -= 1e-9
        place, end = [at[t] for t in terms], [at[t + 1] for t in terms]
        live = list(range(len(terms)))
        while live:
            live.sort(key=lambda k: items[place[k]])
            bound, pivot = 0.0, -1
            for i, k in enumerate(live):
                bound += term_max[terms[k]]
                if bound >= threshold:
                    pivot = i
                    break
            if pivot < 0:
                return
            item = items[place[live[pivot]]]
            while pivot + 1 < len(live) and items[place[live[pivot + 1]]] == item:
                pivot += 1
            before, bound, skip = live[: pivot + 1], 0.0, len(self.ids)
            for k in before:  # each cursor's block that can hold the item
                p = bisect_left(items, item, place[k], end[k])
                if p < end[k]:
                    block = block_at[terms[k]] + (p - at[terms[k]]) // BLOCK
                    bound += block_max[block]
                    skip = min(skip, block_last[block] + 1)
            if bound < threshold:
                if pivot + 1 < len(live):
                    skip = min(skip, items[place[live[pivot + 1]]])
                skip = max(skip, item + 1)
            elif items[place[live[0]]] == item:
                score = sum(impacts[place[k]] for k in before)
                if score >= threshold:
                    yield item, score
                skip = item + 1
            else:
                skip = item
            for k in before:
                place[k] = bisect_left(items, skip, place[k], end[k])
            live = [k for k in live if place[k] < end[k]]

    def possible(self, passages: np.ndarray, terms: np.ndarray, threshold: float) -> Iterator[tuple[int, list[int]]]:
        """(passage, its terms) of those whose score can reach the threshold in some range of items; pairs are distinct and sorted by passage."""
        cuts = [0]
        while cuts[-1] < len(passages):
            end = min(len(passages), cuts[-1] + PAIRS)
            while end < len(passages) and passages[end] == passages[end - 1]:
                end += 1
            cuts.append(end)
        for a, b in zip(cuts, cuts[1:], strict=False):
            p, t = passages[a:b], terms[a:b]
            first = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
            some = np.flatnonzero((np.add.reduceat(self.maxima[t], first, axis=0) >= threshold - 1e-4).any(axis=1))
            ends = np.append(first, len(p))
            for i in some:
                yield int(p[first[i]]), t[first[i] : ends[i + 1]].tolist()

    def verify(self, words: np.ndarray, item: int) -> tuple[float, float]:
        """The shares of an item's question shingles and of its answer's words that a passage has."""
        size, question = self.questions[item]
        has = np.isin(question, shingles(words, size)).mean() if size and len(words) >= size else float(not size)
        answer = self.answers[item]
        return float(has), float(np.isin(answer, words).mean()) if len(answer) else 1.0

    def hits(self, words: np.ndarray, at: np.ndarray, retrieve: float, overlap: float) -> Iterator[tuple[int, int, float, float, float]]:
        """(row, item, score, question overlap, answer overlap) of verified items, the best passage of each row and item.

        words: hashes of texts' words; at: where each text's begin. Any copy of an item lies in a passage.
        """
        term = self.term_ids(words)
        known = np.flatnonzero(term >= 0)
        if not len(known):
            return
        row = np.searchsorted(at, known, side="right") - 1
        base = np.append(0, np.cumsum(-(-np.diff(at) // self.step) + 1))  # a text's passages are numbered from here; -1 is the first
        here = base[row] + (known - at[row]) // self.step
        keys = np.concatenate([here + 1, here]) * len(self.terms) + np.tile(term[known], 2)
        keys.sort()
        keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])]
        best: dict[tuple[int, int], tuple[float, float, float]] = {}
        for p, terms in self.possible(keys // len(self.terms), keys % len(self.terms), retrieve):
            r = int(np.searchsorted(base, p, side="right") - 1)
            start = at[r] + (p - base[r] - 1) * self.step
            passage = words[max(start, at[r]) : min(start + 2 * self.step, at[r + 1])]
            for item, score in self.search(terms, retrieve):
                q, ans = self.verify(passage, item)
                if q >= overlap and ans >= overlap:
                    best[r, item] = max(best.get((r, item), (0.0, 0.0, 0.0)), (q, ans, score))
        for (r, item), (q, ans, score) in sorted(best.items()):
            yield r, item, score, q, ans


def _parsed(items: DataFrame) -> DataFrame:
    """item_id, text, step, n_words, terms of each distinct item with a word."""

    def run(batches):
        for batch in batches:
            rows = []
            for x, y in blocks(batch.column(1)):
                words, at = word_hashes(batch.column(1).slice(x, y - x), NOT_WORD)
                rows += [(x + i, step(n), n, np.unique(words[at[i] : at[i + 1]]).view(np.int64)) for i, n in enumerate(np.diff(at).tolist()) if n]
            if rows:
                at, steps, ns, terms = zip(*rows, strict=True)
                kept = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(steps, pa.int64()), pa.array(ns, pa.int64()), pa.array(terms, pa.list_(pa.int64()))], ["item_id", "text", "step", "n_words", "terms"])

    own = items.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    return own.mapInArrow(run, "item_id long, text string, step long, n_words long, terms array<long>")


def indexes(items: DataFrame) -> Iterator[ItemIndex]:
    """Indexes of at most about INDEX_ITEMS items of one step each, weighted by the statistics of all items."""
    parsed = checkpointed(_parsed(items))
    total = parsed.agg(F.count(F.lit(1)).alias("n"), F.avg("n_words").alias("mean")).first()
    term = F.explode("terms").alias("term")
    frequency = checkpointed(parsed.select(term).groupBy("term").agg(F.count(F.lit(1)).alias("df")))
    for size, n in sorted((r.step, r["count"]) for r in parsed.groupBy("step").count().collect()):  # a row for each power of two
        parts = -(-n // INDEX_ITEMS)
        for k in range(parts):
            part = parsed.where((F.col("step") == size) & (F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k))
            df = frequency.join(part.select(term).distinct(), "term").toArrow()
            rows = part.select("item_id", "text").toArrow()
            if rows.num_rows:
                yield ItemIndex(*(c.to_pylist() for c in rows.columns), total.n, total["mean"], dict(zip(*(c.to_pylist() for c in df.columns), strict=True)), size)


def contaminated(docs: DataFrame, items: DataFrame, retrieve: float = RETRIEVE, overlap: float = OVERLAP) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap: the items whose question and answer a document has.

    Every passage of every whole text asks an index for all items with at least `retrieve` of their own
    BM25 score; a passage then has to hold `overlap` of the question's five-word shingles and of the
    answer's words. How long passages are depends on the item's own length only (see `step`), and scores
    on statistics of all items. Indexes go to the executors; PASS_INDEXES of INDEX_ITEMS items are asked
    in one pass over the documents, whose words are hashed once in it; so what is sent is bounded.
    Words are runs of letters, digits and non-ASCII.

    * Null or empty texts, of documents or items, and items without words match nothing.
    * Null doc_id: searched, given with null. Null item_id: left out. Repeated rows of docs: repeated
      results; repeated items count once. Empty tables: empty result. Other columns are left out.
    * Very long texts are searched as a whole. Of a text's passages with equal overlaps the best score is given.
    """
    own = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
    names = [x.split()[0] for x in schema.split(", ")]

    def asked(some: list[ItemIndex]) -> DataFrame:
        sent = docs.sparkSession.sparkContext.broadcast(some)

        def run(batches):
            for batch in batches:
                texts, found = batch.column(1), []
                for x, y in blocks(texts):
                    words, at = word_hashes(texts.slice(x, y - x), NOT_WORD)
                    for index in sent.value:
                        found += [(x + r, index.ids[item], *rest) for r, item, *rest in index.hits(words, at, retrieve, overlap)]
                if found:
                    rows, ids, *rest = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(ids, pa.int64()), *(pa.array(c, pa.float64()) for c in rest)], names)

        return own.mapInArrow(run, schema)

    every = indexes(items)
    out = asked(list(islice(every, PASS_INDEXES)))
    while more := list(islice(every, PASS_INDEXES)):
        out = out.unionByName(asked(more))
    return out


def decontaminate(docs: DataFrame, items: DataFrame, **options: float) -> DataFrame:
    """The rows of docs, with all their columns, whose documents have no item. Rows with null doc_id stay."""
    bad = checkpointed(contaminated(docs, items, **options).where("doc_id is not null").select(F.col("doc_id").alias("__bad")).distinct())
    return docs.join(broadcast_if_small(bad), F.col("doc_id") == F.col("__bad"), "left_anti")
