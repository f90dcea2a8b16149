"""Repeated passages that no punctuation sets apart."""

import random

import numpy as np
import pytest

from tidegrid.llm import substring
from tidegrid.llm.words import words_of


def fresh(rng, n):
    """Words that hardly ever occur twice."""
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(n)]


def test_windows_are_chosen_by_their_words_alone():
    rng = random.Random(1)
    passage = fresh(rng, substring.WINDOW + substring.CHOICE - 1)
    texts = [" ".join(fresh(rng, n) + passage + fresh(rng, 9)) for n in range(12)] + [None, "", " ".join(fresh(rng, 11)), " ".join(passage)]
    w = words_of(texts)
    chosen = substring.chosen_windows(w)
    assert (w.text[chosen] == w.text[chosen + substring.WINDOW - 1]).all() and len(np.unique(chosen)) == len(chosen)
    alone = [substring.chosen_windows(words_of([t])) for t in texts]
    assert np.array_equal(chosen, np.concatenate([a + w.first[i] for i, a in enumerate(alone)]))
    inside = [{int(p) - n for p in alone[n] if n <= p < n + substring.CHOICE} for n in range(12)]
    assert all(set.intersection(*inside) for _ in inside)


@pytest.mark.parametrize("kind", ["mid-sentence", "five-word lines", "without blanks"])
def test_passages_without_stops_are_found(spark, kind):
    rng = random.Random(2)
    passage = fresh(rng, 55)
    join = " ".join
    if kind == "five-word lines":
        join = lambda w: "\n".join(" ".join(w[i : i + 5]) for i in range(0, len(w), 5))
    if kind == "without blanks":
        han = lambda n: [chr(rng.randrange(0x4E00, 0x9F00)) for _ in range(n)]
        passage, join = han(55), "".join
    other = han if kind == "without blanks" else lambda n: fresh(rng, n)
    rows = [(i, join(other(40 + 5 * i) + passage + other(30))) for i in range(1, 4)] + [(4, join(other(120)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    passages = substring.repeated_passages(docs)
    found = {r["doc_id"]: r for r in passages.collect()}
    assert set(found) == {2, 3} and all(r["first_doc"] == 1 for r in found.values())
    lost = 2 * (substring.CHOICE - 1)
    for i, r in found.items():
        start = 40 + 5 * i
        assert start <= r["start"] < r["stop"] <= start + 55 and r["n_words"] == r["stop"] - r["start"] >= 55 - lost
    out = {r["doc_id"]: r["text"] for r in substring.without_passages(docs, passages).collect()}
    assert out[1] == rows[0][1] and out[4] == rows[3][1]
    for i in (2, 3):
        left = substring.spaced(out[i]).split()
        assert len(left) == 40 + 5 * i + 30 + 55 - found[i]["n_words"]


def test_a_changed_word_does_not_end_a_passage(spark):
    rng = random.Random(3)
    passage = fresh(rng, 60)
    changed = [*passage[:30], "other", *passage[31:]]
    docs = spark.createDataFrame([(1, " ".join(fresh(rng, 50) + passage + fresh(rng, 50))), (2, " ".join(fresh(rng, 50) + changed + fresh(rng, 50)))], "doc_id long, text string")
    (row,) = substring.repeated_passages(docs).collect()
    assert row["doc_id"] == 2 and 50 <= row["start"] <= 55 and 105 <= row["stop"] <= 110
