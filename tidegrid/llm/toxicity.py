"""Operator 9: toxicity classifier, regularised by counterfactuals.

Logistic regression on hashed words and character n-grams, counted in windows of 16, 32 and 128 bytes
that start every ``CELL`` bytes, so that they cover the whole text and overlap, and in sentences. The score
of a text is that of the highest of them: clean text around a toxic phrase cannot outvote it, however long. In the sentences of
labelled texts that name a group, the name is swapped for others of its kind, and the fit is penalised for
any change of the score, so that naming a group counts neither way. Trained by follow-the-regularised-leader
steps with an L1 penalty on a bounded sample of labelled texts: the first pass takes what is present in whole
texts, the others the highest window or sentence of each.

Defined cases: null and empty texts get the score of a text without features; a text without a label is
scored but not learned from; with one class only in the labels the score is constant; texts of any length
are scored whole, in stretches; repeated rows give repeated results.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from tidegrid.llm.quality import labelled_sample
from tidegrid.llm.words import mix, words_of

DIMENSIONS = 1 << 18
STRETCH = 1 << 18
CELL = 8
WINDOWS = (2, 4, 16)  # cells
GRAMS = (4, 5)

#: Names of groups that stand for one another in a counterfactual sentence.
IDENTITIES = (
    ("women", "men"),
    ("woman", "man"),
    ("girls", "boys"),
    ("gay", "straight", "lesbian", "bisexual"),
    ("black", "white", "asian", "latino"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("immigrants", "citizens", "refugees"),
    ("transgender", "cisgender"),
    ("disabled", "deaf", "blind"),
    ("old", "young"),
)
_sentence = re.compile(r"[^.!?\n]+[.!?\n]*")
_punctuation = re.compile(r"[.,;:!?\"'()]")


def _stretches(text: str, shared: int) -> list[tuple[int, int]]:
    """(start, stop) of overlapping parts of about ``STRETCH`` characters, cut at white space if there is any in half of one."""
    out, start = [], 0
    while start < len(text):
        stop = min(len(text), start + STRETCH)
        if stop < len(text):
            stop = 1 + (max(text.rfind(c, stop - STRETCH // 2, stop) for c in " \n\t") if any(c in text[stop - STRETCH // 2 : stop] for c in " \n\t") else stop - 1)
        out.append((start, stop))
        if stop == len(text):
            break
        back = max(text.rfind(c, start + 1, max(start + 2, stop - shared)) for c in " \n\t")
        start = back if back > start else max(start + 1, stop - shared)
    return out


def located(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed dimensions of the words and n-grams in the text, unsorted, and the cell and the sentence in which each starts.

    What equals one of the four before it is left out, so that rows of one character or word do not add up.
    Stretches begin and end at white space and share their last cells; the numbers of their cells are so far
    apart that windows do not.
    """
    text = (text or "").lower()
    most = max(WINDOWS)
    found, cells, sentences = [], [], []
    base = past = 0
    for start, stop in _stretches(text, most * CELL):
        stretch = text[start:stop]
        before, after = b" " * (start == 0), b" " * (stop == len(text))
        data = np.frombuffer(before + stretch.encode("utf-8", "replace") + after, np.uint8).astype(np.uint32)
        cell = base + np.arange(len(data)) // CELL
        ends = np.isin(data, np.frombuffer(b".!?\n", np.uint8))
        sentence = past + np.concatenate([[0], np.cumsum(ends[:-1] & ~ends[1:])])
        parts = []
        rolled = data
        for k in range(1, max(GRAMS)):
            rolled = rolled[:-1] * np.uint32(0x01000193) + data[k:]
            if k + 1 in GRAMS:
                parts.append(((rolled * np.uint32(0x9E3779B1)) >> np.uint32(14), np.arange(len(rolled))))
        words = words_of([_punctuation.sub(" ", stretch)])
        parts.append(((mix(words.hashes) >> np.uint64(46)).astype(np.uint32), words.starts + len(before)))
        for at, places in parts:
            new = np.ones(len(at), bool)
            for k in range(1, 5):
                new[k:] &= at[k:] != at[:-k]
            found.append(at[new])
            cells.append(cell[places[new]])
            sentences.append(sentence[places[new]])
        base, past = int(cell[-1]) + most, int(sentence[-1]) + 1
    if not found:
        return np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found).astype(np.int32), np.concatenate(cells), np.concatenate(sentences)


def features(text: str | None) -> np.ndarray:
    """Hashed dimensions of the words and n-grams in the text, each once per stretch at least, unsorted."""
    return located(text)[0]


def highest_window(weights: np.ndarray, cells: np.ndarray, sentences: np.ndarray) -> tuple[float, np.ndarray, int, int]:
    """Largest sum of the weights in a window or a sentence; which numbers it is counted by, its first and the one after it."""
    if not len(cells):
        return 0.0, cells, 0, 0
    out = []
    for numbers, widths in ((cells, WINDOWS), (sentences, (1,))):
        sums = np.concatenate([[0.0], np.cumsum(np.bincount(numbers, weights))])
        for n in widths:
            n = min(n, len(sums) - 1)
            of = sums[n:] - sums[:-n]
            at = int(of.argmax())
            out.append((float(of[at]), numbers, at, at + n))
    return max(out, key=lambda x: x[0])


@dataclass
class ToxicityModel:
    weights: np.ndarray  # float32 of each dimension, mostly 0
    bias: float

    def logit(self, present: np.ndarray) -> float:
        return float(self.weights[present].sum()) + self.bias

    def score(self, text: str | None) -> float:
        at, cells, sentences = located(text)
        highest = highest_window(self.weights[at], cells, sentences)[0] + self.bias
        return float(1 / (1 + np.exp(-np.clip(highest, -40, 40))))


def counterfactuals(text: str, identities=IDENTITIES) -> list[tuple[str, str]]:
    """(sentence, the same with every name of a group swapped for the next of its kind), where one occurs."""
    following = {name: group[(i + 1) % len(group)] for group in identities for i, name in enumerate(group)}
    named = re.compile(r"\b(" + "|".join(map(re.escape, following)) + r")\b", re.IGNORECASE)
    return [(s, named.sub(lambda m: following[m[0].lower()], s)) for s in _sentence.findall(text) if named.search(s)]


def fit(
    texts: list[str | None], labels: list[int], identities=IDENTITIES, fairness: float = 5.0, passes: int = 5,
    alpha: float = 0.3, beta: float = 1.0, l1: float = 2.0, l2: float = 0.01, most_weight: float = 6.0, seed: int = 3,
) -> ToxicityModel:
    """``fairness`` weighs the squared change of the logit between a sentence and its counterfactual.

    From the second pass on, a step is taken for the window or sentence with the highest logit of each text.

    Texts of the rarer class, if it is the toxic one, weigh up to ``most_weight`` times as much.
    """
    y = np.asarray(labels, float)
    if not len(y) or y.min() == y.max():
        return ToxicityModel(np.zeros(DIMENSIONS, np.float32), 0.0 if not len(y) else (3.0 if y[0] else -3.0))
    balance = np.where(y == 1, min(most_weight, max(1.0, (1 - y).sum() / y.sum())), 1.0)
    own = [located(t) for t in texts]
    swaps = []  # of each text: dimensions that only one side of a pair has, with their sign
    for t in texts:
        pairs = [(np.unique(features(a)), np.unique(features(b))) for a, b in counterfactuals(t or "", identities)]
        swaps.append([(np.concatenate([p := np.setdiff1d(a, b), q := np.setdiff1d(b, a)]), np.repeat([1.0, -1.0], [len(p), len(q)])) for a, b in pairs])
    z, n = np.zeros(DIMENSIONS + 1), np.zeros(DIMENSIONS + 1)

    def current(at):
        zs = z[at]
        penalty = np.where(at == DIMENSIONS, 0.0, l1)
        return np.where(np.abs(zs) <= penalty, 0.0, (np.sign(zs) * penalty - zs) / ((beta + np.sqrt(n[at])) / alpha + l2))

    def step(at, w, gradient):
        squared = gradient * gradient
        z[at] += gradient - (np.sqrt(n[at] + squared) - np.sqrt(n[at])) / alpha * w
        n[at] += squared

    rng = np.random.default_rng(seed)
    for turn in range(passes):
        for i in rng.permutation(len(y)):
            at, cells, sentences = own[i]
            if turn:
                _, numbers, first, last = highest_window(current(at), cells, sentences)
                at = at[(numbers >= first) & (numbers < last)]
            at, count = np.unique(at, return_counts=True)
            count = np.append(count if turn else np.ones(len(at)), 1.0)
            at = np.append(at, DIMENSIONS)
            w = current(at)
            step(at, w, balance[i] * (1 / (1 + np.exp(-np.clip(w @ count, -40, 40))) - y[i]) * count)
            for at, sign in swaps[i]:
                if len(at):
                    w = current(at)
                    step(at, w, fairness * float(sign @ w) / len(at) * sign)
    final = current(np.arange(DIMENSIONS + 1))
    return ToxicityModel(final[:-1].astype(np.float32), float(final[-1]))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = 2000, most_bytes: int = 1 << 16, **fit_options) -> ToxicityModel:
    """Fit to documents with a label; pass only those that may be learned from."""
    sample = labelled_sample(docs, labels, label, per_class, most_bytes)
    return fit(sample["text"].tolist(), sample["label"].tolist(), **fit_options)
