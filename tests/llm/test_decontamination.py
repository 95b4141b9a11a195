import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from quarry.llm import decontamination

ROWS, ITEMS = "doc_id long, text string, item_id string", "item_id long, text string, score long"


def words(rng, n):
    return " ".join(rng.choice("abcdefghij") + rng.choice("klmnop") + rng.choice("qrstuv") for _ in range(n))


def split(text):
    return re.findall(r"[0-9a-z]+", (text or "").lower())


def holds(passage, text, share=0.8):
    """Whether a list of words has enough of an item's question's shingles and answer's words."""
    question, answer = (split(x) for x in re.match(r"(?s)(.*[.?!](?=\s)|)(.*)", text).groups())
    question, answer = (question, answer) if question else (answer, [])
    n = min(5, len(question))
    grams, there = ({tuple(x[i : i + n]) for i in range(len(x) - n + 1)} for x in (question, passage))
    return bool(question) and len(grams & there) >= share * len(grams) and len(set(answer) & set(passage)) >= share * len(set(answer))


def within(rows, items, length):
    """Pairs of documents and items for which some run of `length(item)` words holds the item: every run, not tiles."""
    out = set()
    for d, text in rows:
        w = split(text)
        for i, t in items:
            n = length(len(split(t)))
            if split(t) and any(holds(w[s : s + n], t) for s in range(max(1, len(w) - n + 1))):
                out.add((d, i))
    return out


def found(spark, rows, items):
    table = spark.createDataFrame([(i, t, 1) for i, t in items], ITEMS)
    return {(r.doc_id, r.item_id) for r in decontamination.contaminated(spark.createDataFrame([(d, t, "x") for d, t in rows], ROWS), table).collect()}


@pytest.fixture(scope="module")
def cases():
    rng = random.Random(4)
    items = [(i, words(rng, rng.choice([6, 20, 45])) + ". " + words(rng, 6) + ".") for i in range(30)] + [(90, None), (91, ""), (92, "!!")]
    rows = [(i, words(rng, 150)) for i in range(40)]
    rows += [(100 + i, f"{words(rng, 90)} {items[i][1]} {words(rng, 20)}") for i in range(10)] + [(200, None), (201, ""), (202, words(rng, 5000) + " " + items[3][1])]
    for i in range(10):  # a changed word, and a few words between question and answer
        q, a = items[i][1].split(". ")
        rows.append((300 + i, f"{words(rng, 30)} {q} {words(rng, 3)} {a} {words(rng, 30)}"))
    return rows, items


def test_decontamination_against_runs_of_words(spark, cases):
    """All items that a run of an item's length holds are found, and none that no run of twice its step holds."""
    rows, items = cases
    got = found(spark, rows, items)
    least = within(rows, items[:30], lambda n: n)
    most = within(rows, items[:30], lambda n: 2 * decontamination.step(n))
    assert least <= got <= most and len(least) >= 11 and {(202, 3)} <= got
    docs, table = spark.createDataFrame([(d, t, "x") for d, t in rows], ROWS), spark.createDataFrame([(i, t, 1) for i, t in items], ITEMS)
    left = decontamination.decontaminate(docs, table)
    assert {r.doc_id for r in left.collect()} == {d for d, _ in rows} - {d for d, _ in got} and left.columns == docs.columns
    assert decontamination.contaminated(docs, table.limit(0)).count() == 0 == decontamination.contaminated(docs.limit(0), table).count()


def test_results_do_not_depend_on_how_items_are_dealt(spark, cases, monkeypatch):
    rows, items = cases
    whole = found(spark, rows, items)
    monkeypatch.setattr(decontamination, "INDEX_ITEMS", 5)
    monkeypatch.setattr(decontamination, "PASS_INDEXES", 2)
    assert found(spark, rows, items) == whole


def test_a_long_item_changes_nothing_for_others(spark):
    rng = random.Random(5)
    item = (1, words(rng, 20) + ". " + "gamma delta.")
    rows = [(1, item[1].split(". ")[0] + ". " + words(rng, 200) + " gamma delta")]
    long = (2, words(rng, 1999) + ". yes.")
    assert found(spark, rows, [item]) == found(spark, rows, [item, long]) == set()


def test_block_max_wand_finds_all_above_the_threshold():
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choices(vocabulary, weights=[1 / (k + 1) for k in range(300)], k=rng.randint(5, 16))) for _ in range(400)]
    terms = [Counter(t.split()) for t in texts]
    ids = {w: int(h) for w, h in zip(vocabulary, decontamination.word_hashes(decontamination.pa.array([" ".join(vocabulary)]), decontamination.NOT_WORD)[0].view(np.int64), strict=True)}
    df, mean = Counter(w for t in terms for w in t), sum(len(t.split()) for t in texts) / len(texts)
    index = decontamination.ItemIndex(list(range(400)), texts, 400, mean, {ids[w]: n for w, n in df.items()}, 16)
    own = {w: math.log(1 + (400 - n + 0.5) / (n + 0.5)) for w, n in df.items()}
    impact = [{w: own[w] * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * sum(t.values()) / mean)) for w, f in t.items()} for t in terms]
    for _ in range(300):
        passage = set(rng.choices(vocabulary, k=rng.randint(1, 40))) | set(rng.choice(texts).split())
        numbers = [k for k in index.term_ids(np.array([ids[w] for w in sorted(passage)]).view(np.uint64)).tolist() if k >= 0]
        want = {i: sum(x for w, x in t.items() if w in passage) / sum(t.values()) for i, t in enumerate(impact)}
        got = dict(index.search(numbers, 0.5))
        assert got.keys() == {i for i, s in want.items() if s >= 0.5 - 1e-9}
        assert all(abs(want[i] - s) < 1e-9 for i, s in got.items())
