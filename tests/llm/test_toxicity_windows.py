"""Toxic phrases in long clean texts: no amount of clean text outvotes them."""

import random

import numpy as np

from tidegrid.llm import toxicity

WORDS = "the and of that with from their which would there".split()


def sentence(rng, n=14):
    return " ".join(rng.choice(WORDS) for _ in range(n)) + "."


def learned(rng):
    texts = [sentence(rng) for _ in range(120)] + [sentence(rng) + " you scum." for _ in range(60)]
    return toxicity.fit(texts, [0] * 120 + [1] * 60, fairness=50.0, l1=0.3)


def test_part_of_a_phrase_after_a_long_clean_text():
    rng = random.Random(3)
    model = learned(rng)
    clean = sentence(rng) * 400
    assert model.score(clean + " scum") > 0.5 > model.score(clean)


def test_a_phrase_counts_wherever_it_stands():
    rng = random.Random(4)
    model = learned(rng)
    clean = " ".join(sentence(rng) for _ in range(300))
    assert model.score(clean) < 0.5
    unpunctuated = clean.replace(".", "")
    for at in range(0, len(clean), 997):
        at = unpunctuated.rfind(" ", 0, at + 1) + 1
        assert model.score(unpunctuated[:at] + "you scum. " + unpunctuated[at:]) > 0.5


def test_windows_cover_all_stretches(monkeypatch):
    model = learned(random.Random(5))
    clean = sentence(random.Random(6)) * 20
    monkeypatch.setattr(toxicity, "STRETCH", 300)
    for at in range(200, 700, 7):
        assert model.score(clean[:at] + " you scum. " + clean[at:]) > 0.5


def test_highest_window_against_every_window():
    rng = np.random.default_rng(7)
    cells, sentences = rng.integers(0, 40, 300), np.sort(rng.integers(0, 9, 300))
    weights = rng.normal(size=300)
    sums = [weights[(cells >= c) & (cells < c + n)].sum() for n in toxicity.WINDOWS for c in range(cells.max() + 2 - n)]
    sums += [weights[sentences == i].sum() for i in range(sentences.max() + 1)]
    best, numbers, first, last = toxicity.highest_window(weights, cells, sentences)
    assert np.isclose(best, max(sums)) and np.isclose(best, weights[(numbers >= first) & (numbers < last)].sum())


def test_stretches_hold_no_words_of_their_own(monkeypatch):
    rng = random.Random(8)
    text = sentence(rng, 200) + " " + "x" * 700 + "\n" + sentence(rng, 100)
    for size in (301, 512):
        monkeypatch.setattr(toxicity, "STRETCH", size)
        spans = toxicity._stretches(text, 128)
        assert spans[0][0] == 0 and spans[-1][1] == len(text) and all(a < c <= b < d for (a, b), (c, d) in zip(spans, spans[1:]))
    monkeypatch.setattr(toxicity, "STRETCH", 512)
    spaced = sentence(rng, 400)
    monkeypatch.undo()
    whole = set(toxicity.features(spaced).tolist())
    monkeypatch.setattr(toxicity, "STRETCH", 512)
    assert set(toxicity.features(spaced).tolist()) == whole
