import random

import numpy as np

from quarry.llm import toxicity


def cast(rng, toxic, accurate):
    """A vote for each voter: for toxic with probability accurate[j][0], for others accurate[j][1]."""
    rate = np.where(toxic[:, None], [a for a, _ in accurate], [b for _, b in accurate])
    return (rng.random(rate.shape) < rate).astype(np.int8)


def test_label_model_finds_accuracies_without_labels():
    rng = np.random.default_rng(1)
    toxic = rng.random(6000) < 0.2
    accurate = [(0.6, 0.02), (0.5, 0.05), (0.7, 0.04), (0.4, 0.01), (0.2, 0.2), (0.55, 0.03)]
    votes = cast(rng, toxic, accurate)
    votes = np.column_stack([votes, -(votes.sum(axis=1) == 0).astype(np.int8)])
    model = toxicity.LabelModel(votes, 0.2)
    post = model.posterior(votes)
    assert model.rounds < 400 and ((post > 0.5) == toxic).mean() > 0.9
    strength = [model.tables[j, 0, 2] for j in range(6)]
    assert strength[4] < min(strength[k] for k in (0, 1, 2, 3, 5))


def test_label_model_ties_voters_that_repeat_each_other():
    rng = np.random.default_rng(2)
    toxic = rng.random(6000) < 0.2
    votes = cast(rng, toxic, [(0.6, 0.05)] * 5)
    copies = np.column_stack([votes, votes[:, :1], votes[:, :1]])
    copies[rng.random(copies.shape) < 0.01] = 0
    model = toxicity.LabelModel(copies)
    tied = {frozenset((j, int(p))) for j, p in enumerate(model.parents) if p >= 0}
    assert len({t for t in tied if t <= {0, 5, 6}}) == 2
    loose = toxicity.LabelModel(copies, tie=np.inf)
    alone = np.zeros((1, 7), np.int8)
    alone[0, [0, 5, 6]] = 1
    assert model.posterior(alone)[0] < loose.posterior(alone)[0]


def test_label_model_of_nothing():
    for votes in (np.zeros((0, 4), np.int8), np.zeros((5, 4), np.int8), np.ones((5, 1), np.int8)):
        post = toxicity.LabelModel(votes).posterior(votes)
        assert len(post) == len(votes) and np.isfinite(post).all()


def test_lexicon_needs_no_labels():
    rng = random.Random(4)
    plain = ["".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(300)]
    texts = [" ".join(rng.choices(plain, k=30)) for _ in range(500)]
    for i in range(0, 500, 10):
        texts[i] += " idiot zorblax" if i % 20 else " zorblax moron"
    model = toxicity.ToxicityModel(texts, np.zeros(500, bool))
    assert "zorblax" in model.lexicon
    score = model.score(["zorblax idiot " + texts[1], texts[1], "", None])
    assert score[0] > 0.3 > score[1] and score[2] == score[3] < 0.3


def test_scores_depend_on_the_share_of_toxic_rows_not_of_the_sample():
    rng = random.Random(6)
    texts = [" ".join(rng.choice("abcdefgh") * 3 + rng.choice("xyz") for _ in range(20)) + (" idiot" if i % 2 and i % 12 or i % 40 == 0 else "") for i in range(800)]
    toxic = np.array([i % 2 == 1 for i in range(800)])
    half, few = (toxicity.ToxicityModel(texts, toxic, share).score(texts[:40]) for share in (0.5, 0.05))
    assert (few < half).all()


def test_a_long_text_is_read_to_its_end():
    rng = random.Random(7)
    texts = [" ".join(rng.choice("abcdefgh") * 3 + rng.choice("xyz") for _ in range(20)) + (" idiot you moron" if i % 8 == 0 else "") for i in range(400)]
    model = toxicity.ToxicityModel(texts, np.array([i % 8 == 0 for i in range(400)]))
    long = "aaax " * 200000
    score = model.score([long + "idiot", long])
    assert score[0] > score[1]
