"""The query over vectors of more than 64 components."""

import random

import numpy as np

from tidegrid.llm import hamming, queries


def test_all_components_count(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, [1.0] * 64 + [rng.choice((-1.0, 1.0)) for _ in range(rng.choice((10, 66)))]) for i in range(60)] + [(60, None), (61, [])]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {(r["query_id"], r["rank"]): (r["distance"], r["vec_id"]) for r in queries.op10_hamming(spark, str(tmp_path)).collect()}
    ones = {i: {k for k, x in enumerate(v) if x > 0} for i, v in rows if v is not None}
    for q in (0, 20, 40):
        near = sorted((len(ones[q] ^ ones[i]), i) for i in ones if i != q)[:10]
        assert [got[q, k + 1] for k in range(10)] == near


def test_one_code_of_many_rows_stays_in_memory():
    import tracemalloc

    import numpy as np

    from tidegrid.llm.hamming import MultiIndex

    rng = np.random.default_rng(2)
    codes = np.concatenate([np.full((20_000, 1), 77, np.uint64), rng.integers(0, 1 << 16, (20_000, 1), dtype=np.uint64)])
    ids = rng.permutation(len(codes))
    index = MultiIndex(codes, ids)
    tracemalloc.start()
    q, found, distance = index.search(codes[::40], ids[::40], 10)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 400 << 20 and len(q) == 10 * len(codes[::40])
    for i in (0, 3, 499, 500, 777, 999):
        near = sorted((int(d), int(j)) for d, j in zip(np.bitwise_count(codes[40 * i, 0] ^ codes[:, 0]), ids) if j != ids[40 * i])[:10]
        assert list(zip(distance[q == i].tolist(), found[q == i].tolist())) == near


def test_fewer_rows_than_neighbours(spark):
    from tidegrid.llm import hamming

    rows = spark.createDataFrame([(1, [5]), (2, [4]), (3, [5]), (3, [5]), (None, [5]), (4, None)], "vec_id long, code array<long>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["distance"]) for r in hamming.top_k(rows, rows.where("vec_id < 3"), k=9).collect())
    assert got == [(1, 1, 3, 0), (1, 2, 3, 0), (1, 3, 2, 1), (2, 1, 1, 1), (2, 2, 3, 1), (2, 3, 3, 1)]


def test_radii_grow_to_the_end_on_any_table():
    """Few far codes, many near ones, and a table in which the kth distance is near the number of bits."""
    rng = np.random.default_rng(6)
    for codes in (rng.integers(0, 1 << 63, (40, 1), dtype=np.uint64), rng.integers(0, 300, (500, 1), dtype=np.uint64), np.array([[0], [(1 << 64) - 1]], np.uint64), rng.integers(0, 1 << 63, (3000, 2), dtype=np.uint64)):
        ids = np.arange(len(codes))
        index = hamming.MultiIndex(codes, ids)
        own = np.arange(0, len(codes), max(1, len(codes) // 7))
        q, found, distance = index.search(codes[own], own, 10)
        for n, i in enumerate(own):
            d = np.bitwise_count(codes ^ codes[i]).sum(axis=1)
            want = sorted((int(x), int(j)) for j, x in enumerate(d) if j != i)[:10]
            assert list(zip(distance[q == n].tolist(), found[q == n].tolist())) == want


def test_a_query_id_of_several_rows_is_asked_by_each(spark):
    rows = spark.createDataFrame([(1, [0]), (2, [1]), (3, [255])], "vec_id long, code array<long>")
    twice = spark.createDataFrame([(7, [0]), (7, [255])], "vec_id long, code array<long>")
    got = [(r["rank"], r["vec_id"], r["distance"]) for r in hamming.top_k(rows, twice, k=3).orderBy("rank").collect()]
    assert got == [(1, 1, 0), (2, 3, 0), (3, 2, 1)]
