"""Searches with every tier of matches against brute force."""

import os

import pytest

from tidegrid.operators import discovery
from tidegrid.plans import registry
from tidegrid.sources import adapters

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def score(q, text):
    t = text.lower()
    if t == q:
        return 1000.0
    if q in t:
        at = t.index(q)
        return 800.0 - len(t) if at == 0 else 600.0 - at - len(t) * 0.1
    total, run, last, k = 0.0, 0, -2, 0
    for at, c in enumerate(t):
        if k < len(q) and c == q[k]:
            run = run + 1 if at == last + 1 else 1
            total, last, k = total + run + (5 if at == 0 else 0), at, k + 1
    return 100 + total - len(t) * 0.1 if k == len(q) else -1.0


def brute_rank(entries, q, limit=60):
    """(id, score) of (id, symbol, market)."""
    scored = [(max(score(q, symbol), score(q, market) - 60), symbol, i) for i, symbol, market in entries]
    best = sorted((x for x in scored if x[0] >= 0), key=lambda x: (-round(x[0], 9), len(x[1]), x[2]))
    return [(i, pytest.approx(s, abs=1e-5)) for s, _, i in best[:limit]]


def test_search_with_loose_matches_and_markets(spark):
    rows = [(1, "ring", "x"), (2, "r-i-n-g", "x"), (3, "none", "ring"), (4, "none", "r.ing"), (5, "none", "x"), (6, "spring", "x")]
    docs = spark.createDataFrame(rows, "id long, symbol string, market string")
    got = [(r["id"], r["score"]) for r in discovery.fuzzy_rank(docs, "ring").collect()]
    assert got == brute_rank(rows, "ring") and {i for i, _ in got} == {1, 2, 3, 4, 6}


def test_queries_rank_all_matches(spark):
    entries = [(r["id"], r["symbol"], r["market"]) for r in adapters.directory(spark, SF).collect()]
    got = [(r["id"], r["score"]) for r in registry.QUERIES["fuzzy_rank_all"](spark, SF).collect()]
    assert sorted(i for i, _ in got) == sorted(i for i, _ in brute_rank(entries, "ring"))
    assert dict(got) == dict(brute_rank(entries, "ring"))
    markets = {m for _, _, m in entries}
    want = sorted((m for m in markets if score("venue1", m) >= 0), key=lambda m: (-round(score("venue1", m), 9), len(m), m))
    venues = sorted(registry.QUERIES["venue_rank_all"](spark, SF).collect(), key=lambda r: r["pos"])
    assert [r["market"] for r in venues] == want
    assert [r["id"] for r in venues] == [min(i for i, _, m in entries if m == x) for x in want]
    assert any("venue1" not in m for m in want)
