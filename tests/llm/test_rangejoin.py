"""The range join of vectors against brute force: random groups, hot groups, blocks of any size, odd rows."""

import math
import random

import duckdb
import numpy as np
import pytest

from tidegrid.llm import queries
from tidegrid.llm.rangejoin import choose_pivots, near_vectors


def brute(rows, threshold=0.9):
    """(n_links, component, kept) of each row by comparing all pairs."""
    width = max((len(v) for _, v in rows if v is not None), default=0)
    unit = []
    for _, v in rows:
        ok = v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)
        x = np.pad(np.array(v, float), (0, width - len(v))) if ok else None
        unit.append(None if x is None else x / np.linalg.norm(x))
    n = len(rows)
    links = [[j for j in range(n) if j != i and unit[i] is not None and unit[j] is not None and float(unit[i] @ unit[j]) >= threshold] for i in range(n)]
    out, seen = [None] * n, set()
    for i in range(n):
        if i in seen:
            continue
        group, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in group:
                    group.add(j)
                    todo.append(j)
        seen |= group
        least = min((rows[j][0] for j in group if rows[j][0] is not None), default=None)
        for j in group:
            out[j] = (rows[j][0], len(links[j]), least, rows[j][0] is not None and rows[j][0] == least)
    return sorted(out, key=repr)


def got(spark, rows, **more):
    df = spark.createDataFrame([(v, i, "x") for i, v in rows], "embedding array<float>, vec_id long, node string")
    return sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in near_vectors(df, **more).collect()), key=repr)


def made(seed, width=8):
    """Chains, tight groups, wide groups, copies and lone vectors."""
    rng = np.random.default_rng(seed)
    out = [rng.normal(size=width) for _ in range(60)]
    for spread, n in ((0.02, 50), (0.12, 40), (0.3, 30)):
        base = rng.normal(size=width)
        base /= np.linalg.norm(base)
        out += [base + rng.normal(size=width) * spread for _ in range(n)]
    out += [out[-1]] * 7 + [out[3] * 4] * 3
    a, b = out[0] / np.linalg.norm(out[0]), out[1] / np.linalg.norm(out[1])
    out += [a * math.cos(t) + b * math.sin(t) for t in np.linspace(0, 1.5, 9)]  # a chain
    order = rng.permutation(len(out))
    return [(int(i), [float(np.float32(x)) for x in out[j]]) for i, j in enumerate(order)]


@pytest.mark.parametrize("seed,block,pivots", [(0, 8192, None), (1, 16, 5), (2, 3, 20), (3, 40, 1), (4, 7, 60)])
def test_links_and_components_equal_brute_force(spark, seed, block, pivots):
    rows = made(seed)
    assert got(spark, rows, block=block, pivots=pivots) == brute(rows)


@pytest.mark.parametrize("threshold", [0.5, 0.99])
def test_other_thresholds(spark, threshold):
    rows = made(9, width=5)
    assert got(spark, rows, threshold=threshold, block=32, pivots=9) == brute(rows, threshold)


def test_odd_rows_have_defined_results(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0]), (8, [2.0, 0.0]), (9, [1e-30, 0.0]), (10, [-1.0, 0.0])]
    rows += [(11, [0.0, 3e38]), (11, [0.0, 1.0]), (None, [0.0, 2.0]), (None, [5.0, -5.0]), (None, None)]
    assert got(spark, rows) == brute(rows)
    assert got(spark, []) == [] and got(spark, [(1, None)]) == [(1, 0, 1, True)]


def test_a_dense_group_is_counted_and_pivots_lie_in_it():
    rng = np.random.default_rng(5)
    points = np.concatenate([rng.normal(size=(300, 16)), np.eye(16)[0] + rng.normal(size=(100, 16)) * 0.01])
    points /= np.linalg.norm(points, axis=1)[:, None]
    pivots = choose_pivots(points, 10, math.sqrt(0.2))
    assert len(pivots) == 10 and (pivots @ np.eye(16)[0]).max() > 0.99


def test_the_query_equals_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    want = duckdb.sql(queries.ORACLE_SQL["op11_vectors"].replace("FROM embeddings", f"FROM '{sf}/embeddings.parquet'"))
    rows = queries.QUERIES["op11_vectors"](spark, sf)
    assert sorted(map(tuple, rows.select(*want.columns).collect())) == sorted(want.fetchall())


def test_random_cuts_never_lose_a_link(spark):
    rng = random.Random(3)
    for _ in range(2):
        rows = made(rng.randrange(1000), width=3)
        assert got(spark, rows, block=rng.randrange(2, 30), pivots=rng.randrange(2, 40)) == brute(rows)
