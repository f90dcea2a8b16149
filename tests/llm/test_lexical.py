"""Block-Max WAND against scoring every document, for shards, parts and blocks of any size."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from tidegrid.llm import lexical, queries
from tidegrid.llm.words import terms_of

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n_docs, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    asked = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, own in asked.items():
        weights = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in own if df[t]}
        scored = []
        for i, b in bags:
            m = 10 + (90 * sum(b.values()) * n_docs) // total
            score = sum(w * ((10**9 * b[t]) // (1000 * b[t] + 8 * m)) for t, w in weights.items() if b[t])
            if score > 0 and i is not None:
                scored.append((-score, i))
        out += [(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def got(spark, docs, items, **more):
    d = spark.createDataFrame([(t, i, 1) for i, t in docs], "text string, doc_id long, item_id int")
    q = spark.createDataFrame([(t, i, 2) for i, t in items], "text string, item_id long, doc_id int")
    return sorted(map(tuple, lexical.best_documents(d, q, **more).collect()))


def made(seed, n=300):
    rng = random.Random(seed)
    common, rare = ["der", "die", "und", "été", "日本"], [f"w{i}" for i in range(400)]
    word = lambda: rng.choice(common) if rng.random() < 0.5 else rng.choice(rare)
    docs = [(i, " ".join(word() for _ in range(rng.choice([1, 5, 30, 200])))) for i in range(n)]
    docs += [(n + i, docs[7][1]) for i in range(20)] + [(3, docs[5][1]), (None, docs[9][1]), (900, None), (901, ""), (902, "?! \x7f{}"), (903, "DER, die-UND. Été")]
    rng.shuffle(docs)
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 3, 30])))) for i in range(12)]
    return docs, items + [(40, docs[7][1]), (41, None), (42, "nowhere-else"), (None, "der"), (0, "die w7"), (43, "und")]


@pytest.mark.parametrize("seed,shard_bytes,queries_,block", [(0, 1 << 24, 64, 128), (1, 2000, 3, 4), (2, 1, 1, 128), (3, 5000, 100, 2)])
def test_results_equal_scoring_every_document(spark, monkeypatch, seed, shard_bytes, queries_, block):
    monkeypatch.setattr(lexical, "BLOCK", block)
    monkeypatch.setattr(lexical, "FIRST_RANGES", 2)
    docs, items = made(seed)
    assert got(spark, docs, items, k=5, shard_bytes=shard_bytes, queries=queries_) == brute(docs, items, 5)


def test_blocks_under_the_kth_score_stay_compressed(monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK", 8)
    rng = random.Random(4)
    texts = ["und " * rng.randrange(1, 3) + "x" * rng.randrange(1, 4) for _ in range(4000)]
    texts[1000:1012] = ["und rare rare"] * 12
    shard = lexical.Shard(0, lexical.Statistics(4000, 10_000))
    shard.add(list(range(len(texts))), texts)
    head, *rest = list(shard.rows())
    payload, n = head["payload"][0], len(texts)
    import pandas as pd

    postings = lexical.Postings(pd.concat(rest), np.frombuffer(payload[8 * n : 16 * n], np.int64))
    und, rare = terms_of(["und rare"]).hashes.view(np.int64).tolist()
    docs, _ = lexical.Search(postings, np.arange(n), np.ones(n, bool), [und, rare], [10, 5000], 10).run()
    assert sorted(docs.tolist()) == list(range(1000, 1010))
    assert len(postings.open) < 20 < postings.lists[und][1] - postings.lists[und][0]


def test_numbers_survive_packing():
    rng = np.random.default_rng(0)
    values = np.concatenate([[0, 127, 128, 16383, 16384, (1 << 40) + 3], rng.integers(0, 1 << rng.integers(1, 50, 1000))])
    data, starts = lexical.packed(values)
    assert (lexical.unpacked(data) == values).all() and starts[-1] == len(data)
    assert len(lexical.unpacked(np.zeros(0, np.uint8))) == 0


def test_empty_sides_give_no_rows(spark):
    docs, items = made(5)
    assert got(spark, [], items) == [] and got(spark, docs, []) == [] and got(spark, [(1, None)], items) == []


def test_long_texts_are_read_whole(spark):
    docs = [(1, "filler " * 300_000 + "needle"), (2, "filler"), (3, "other words")]
    assert got(spark, docs, [(7, "Needle filler")]) == brute(docs, [(7, "Needle filler")], 10)


def test_the_query_equals_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    sql = queries.ORACLE_SQL["op13_lexical"]
    for t in ("documents", "benchmark"):
        sql = sql.replace(f"FROM {t}", f"FROM '{sf}/{t}.parquet'")
    want = duckdb.sql(sql)
    rows = queries.QUERIES["op13_lexical"](spark, sf)
    assert sorted(map(tuple, rows.select(*want.columns).collect())) == sorted(want.fetchall())
