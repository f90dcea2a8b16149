"""Near copies, repeated passages and components against brute force."""

import random

import numpy as np
import pytest

from tidegrid.llm import minhash, substring, words
from tidegrid.llm.components import connected

VOCABULARY = [a + b for a in "ba ce di fo gu ha ki lo mu ne".split() for b in "ra se ti vo zu".split()]


def prose(rng, n):
    return " ".join(rng.choice(VOCABULARY) + rng.choice(["", "", "", "", "", ".", ","]) for _ in range(n))


def edited(rng, text, share):
    return " ".join(rng.choice(VOCABULARY) if rng.random() < share else w for w in text.split())


def shingle_set(text, width=5):
    w = (text or "").lower().split()
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def brute_classes(rows, threshold=0.8):
    sets = [(i, shingle_set(t)) for i, t in rows]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, (_, a) in enumerate(sets):
        for y in range(x):
            b = sets[y][1]
            if a and b and len(a & b) >= threshold * len(a | b):
                parent[find(x)] = find(y)
    least = {}
    for x, (i, _) in enumerate(sets):
        least[find(x)] = min(least.get(find(x), i), i)
    return sorted((i, least[find(x)]) for x, (i, _) in enumerate(sets))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    bases = [prose(rng, rng.choice([3, 20, 120, 400])) for _ in range(30)]
    texts = bases + [edited(rng, b, rng.choice([0.0, 0.01, 0.03, 0.06])) for b in bases for _ in range(4)]
    texts += [None, "", "  \n ", None, bases[0].upper(), bases[3]]
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_classes_equal_brute_force(spark, rows):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, key string, n int")
    got = minhash.near_duplicates(docs)
    assert sorted((r["doc_id"], r["class_id"]) for r in got.collect()) == brute_classes(rows)
    kept = {r["doc_id"] for r in minhash.deduplicated(docs).collect()}
    assert kept == {c for _, c in brute_classes(rows)}
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_repeated_ids_and_null_ids(spark):
    text = prose(random.Random(1), 60)
    docs = spark.createDataFrame([(1, text), (1, text), (None, text), (2, "x y"), (None, None)], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["class_id"], r["class_size"]) for r in minhash.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(1, 1, 3), (1, 1, 3), (None, 1, 3), (2, 2, 1), (None, None, 1)], key=str)


def test_one_row_of_each_class_stays(spark):
    rng = random.Random(9)
    a, b, c = prose(rng, 60), prose(rng, 60), prose(rng, 60)
    rows = [(1, a, "p"), (1, a, "p"), (1, b, "q"), (2, b, "q"), (None, c, "r"), (None, c, "r"), (None, None, "s"), (3, None, "t"), (3, " ", "u")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id string").selectExpr("doc_id", "text", "id", "1 AS digest", "2 AS no_id")
    got = minhash.deduplicated(docs)
    assert got.columns == docs.columns
    assert sorted((str(r["doc_id"]), r["id"]) for r in got.collect()) == [("1", "p"), ("1", "q"), ("3", "t"), ("3", "u"), ("None", "r"), ("None", "s")]
    assert minhash.deduplicated(docs.limit(0)).count() == 0


def test_one_bucket_of_many_components(spark):
    """Texts that share a long middle meet in one bucket without being similar: links across its components are found."""
    rng = random.Random(11)
    middle = prose(rng, 120)
    bases = [prose(rng, 60) + " " + middle for _ in range(12)]
    rows = list(enumerate(t for b in bases for t in (b, edited(rng, b, 0.015))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r["doc_id"], r["class_id"]) for r in minhash.near_duplicates(docs).collect()) == brute_classes(rows)


def test_counts_as_weights(spark):
    a = prose(random.Random(2), 50)
    docs = spark.createDataFrame([(1, a), (2, " ".join([a] * 6)), (3, a)], "doc_id long, text string")
    classes = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(docs, weights="count").collect()}
    assert classes == {1: 1, 2: 2, 3: 1}


@pytest.mark.parametrize("similarity", [0.5, 0.8, 0.95])
def test_signatures_agree_as_often_as_sets_are_similar(similarity):
    rng = np.random.default_rng(3)
    shared = rng.integers(1, 1 << 62, int(2000 * similarity), dtype=np.uint64)
    own = (2000 - len(shared)) // 2
    sets = [np.unique(np.concatenate([shared, rng.integers(1, 1 << 62, own, dtype=np.uint64)])) for _ in range(2)]
    h, t = np.concatenate(sets), np.repeat([0, 1], [len(s) for s in sets])
    s, filled = minhash.dart_signatures(h, t, np.ones(len(h)), 3, k=2048)
    assert filled.tolist() == [True, True, False]
    assert abs((s[0] == s[1]).mean() - similarity) < 0.05


def test_weighted_signatures():
    s, _ = minhash.dart_signatures(np.array([1, 2, 1, 2], np.uint64), np.array([0, 0, 1, 1]), np.array([3.5, 1, 1, 1.0]), 2, k=4096)
    assert abs((s[0] == s[1]).mean() - 2 / 4.5) < 0.04


@pytest.mark.parametrize("words_of_64", [4, 8])
def test_parity_sketches_never_differ_by_more_than_the_sets(spark, words_of_64):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(6)
    pool = rng.integers(1, 1 << 62, 900, dtype=np.uint64)
    sets = [rng.choice(pool, n, replace=False) for n in (0, 1, 40, 41, 300, 880, 900)] + [pool[:40], pool[1:41]]
    weights = [rng.integers(1, 4, len(s)).astype(float) for s in sets[:7]] + [np.ones(40)] * 2
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    sketch = minhash.parities(np.concatenate(sets), owner, np.concatenate(weights), len(sets), words_of_64).tolist()
    pairs = [(i, j, sketch[i], sketch[j]) for i in range(len(sets)) for j in range(len(sets))]
    frame = spark.createDataFrame(pairs, "i int, j int, a array<long>, b array<long>")
    for r in frame.select("i", "j", minhash.differing_bits(F.col("a"), F.col("b"), words_of_64).alias("bits")).collect():
        of = [dict(zip(sets[k].tolist(), weights[k])) for k in (r["i"], r["j"])]
        apart = sum(abs(of[0].get(x, 0) - of[1].get(x, 0)) for x in of[0].keys() | of[1].keys())
        assert r["bits"] <= apart and (r["bits"] - apart) % 2 == 0


def test_large_groups_of_near_copies_keep_every_link(spark):
    """Many edited copies of one text meet in the same buckets, also across components."""
    rng = random.Random(21)
    base = prose(rng, 70)
    rows = list(enumerate([edited(rng, base, 0.035) for _ in range(150)] + [edited(rng, base, 0.012) for _ in range(50)]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"], r["class_id"]) for r in minhash.near_duplicates(docs).collect())
    assert got == brute_classes(rows)


def test_components_equal_union_find(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 360)] + [(5, 5), (None, 3)]
    label = {r["node"]: r["component"] for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    assert label == {x: find(x) for x in parent}
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_that_are_stars_need_no_round(spark, monkeypatch):
    from tidegrid.llm import components

    rounds, step = [], components._large_star
    monkeypatch.setattr(components, "_large_star", lambda edges: rounds.append(1) or step(edges))
    star = [(1, i) for i in range(2, 40)] + [(i, 50) for i in range(60, 90)] + [(50, 60), (7, 7), (None, 7)]
    assert {r["node"]: r["component"] for r in connected(spark.createDataFrame(star, "a long, b long")).collect()} == {i: 1 for i in range(1, 40)} | {i: 50 for i in (50, *range(60, 90))}
    assert not rounds
    around_the_largest = [(99, i) for i in range(1, 40)]
    assert {r["component"] for r in connected(spark.createDataFrame(around_the_largest, "a long, b long")).collect()} == {1}
    assert len(rounds) == 1
    several_smaller, chain = [(9, 1), (9, 2), (8, 2)], [(3, 5), (5, 6)]
    got = {r["node"]: r["component"] for r in connected(spark.createDataFrame(several_smaller + chain, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 8: 1, 9: 1, 3: 3, 5: 3, 6: 3}


def test_words_and_places():
    w = words.words_of(["Aa bb  cc", "", None, "é aa\tbb"])
    assert w.text.tolist() == [0, 0, 0, 3, 3, 3] and w.first.tolist() == [0, 3, 3, 3, 6]
    assert w.starts.tolist() == [0, 3, 7, 0, 3, 6] and w.ends.tolist() == [2, 5, 9, 2, 5, 8]
    assert w.hashes[0] == w.hashes[4]


def test_paragraphs_are_cut_alike_anywhere():
    passage = "Ab cd ef. Gh ij kl mn! Op qr"
    for lead in ("", "Xx yy. ", "Xx yy zz\n"):
        text = lead + passage
        w = words.words_of([text])
        first, last = substring.paragraphs([text], w)
        spans = [text.encode()[w.starts[a] : w.ends[b - 1]].decode() for a, b in zip(first, last)]
        assert spans[-3:] == ["Ab cd ef.", "Gh ij kl mn!", "Op qr"]


def test_repeated_passages_are_cut_and_clean_texts_stay(spark):
    rng = random.Random(11)
    line = lambda n: prose(rng, n).replace(".", "").replace(",", "").capitalize() + "."
    passage = " ".join(line(n) for n in (14, 9, 21, 12))
    clean = [" ".join(line(12) for _ in range(4)) for _ in range(6)]
    rows = [(1, f"{clean[0]} {passage} {clean[1]}"), (2, f"{clean[2]} {passage}"), (3, f"{passage}\n{clean[3]}"), (4, clean[4]), (5, None), (6, ""), (7, clean[5] + " Short one here."), (8, "Short one here."), (None, passage), (9, passage)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, start string")
    passages = substring.repeated_passages(docs)
    found = {r["doc_id"]: r for r in passages.collect()}
    assert set(found) == {2, 3, 9} and all(r["n_words"] == 56 and r["first_doc"] == 1 for r in found.values())
    out = {r["doc_id"]: r["text"] for r in substring.without_passages(docs, passages).collect()}
    assert out[2] == clean[2] + " " and out[3] == clean[3] and 9 not in out
    assert all(out[i] == t for i, t in rows if i in (1, 4, 5, 6, 7, 8, None))
    assert substring.repeated_passages(docs.limit(0)).count() == 0


def test_near_copies_of_a_paragraph_are_found(spark):
    rng = random.Random(12)
    long = prose(rng, 60).replace(".", "").replace(",", "")
    other = long.rsplit(" ", 2)[0] + " other end"
    docs = spark.createDataFrame([(1, f"Start here now. {long}."), (2, f"{other}. Then more."), (3, prose(rng, 80))], "doc_id long, text string")
    assert [(r["doc_id"], r["first_doc"]) for r in substring.repeated_passages(docs).collect()] == [(2, 1)]
