"""Running values in ranges against one pass in order, and frames of bands against the search one by one."""

import random

import pytest
from pyspark.sql import functions as F

from tidegrid.functions.scale import band_frame
from tidegrid.operators.running import running


@pytest.mark.parametrize("span", [1, 3, 1000])
@pytest.mark.parametrize("before", [False, True])
def test_running_values(spark, span, before):
    rng = random.Random(span)
    rows = [(s, i, rng.choice([None, -1.5, 2.0, 3.0]), "x") for s in ("a", "b", None) for i in rng.sample(range(-20, 40), 30)]
    df = spark.createDataFrame(rows, "stream string, seq long, v double, _range string")
    known = df.where("stream IS NOT NULL").drop("_range")
    got = running(known, ("seq",), {"top": ("max", F.col("v")), "total": ("sum", F.col("v")), "latest": ("last", F.col("v"))}, span=span, before=before)
    want = []
    for s in ("a", "b"):
        so_far = []
        for _, i, v, _ in sorted((r for r in rows if r[0] == s), key=lambda r: r[1]):
            seen = so_far if before else [*so_far, v]
            sound = [x for x in seen if x is not None]
            want.append((s, i, max(sound, default=None), sum(sound) if sound else None, sound[-1] if sound else None))
            so_far.append(v)
    assert sorted(((r["stream"], r["seq"], r["top"], r["total"], r["latest"]) for r in got.collect())) == sorted(want)
    assert running(known.limit(0), ("seq",), {"n": ("sum", F.lit(1))}).count() == 0


def test_rows_of_one_place_count_together(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 1, 9), ("a", 2, 1)], "stream string, seq long, v int")
    got = running(df, ("seq",), {"top": ("max", F.col("v"))}, span=1, peers=True)
    assert sorted((r["seq"], r["v"], r["top"]) for r in got.collect()) == [(1, 5, 9), (1, 9, 9), (2, 1, 9)]


@pytest.mark.parametrize("up,down,rows", [(0.5, 0.5, 128), (10.0, 0.9, 64), (3.0, 0.0, 7), (0.1, 0.9, 1000)])
def test_frames_of_bands(spark, up, down, rows):
    mids = [0.013, 1.0, 99.7, 60_123.4, 7.7e6]
    got = spark.createDataFrame([(m,) for m in mids], "m double").select("m", band_frame(F.col("m"), up, down, 0.5, rows).alias("f")).collect()
    for r in got:
        lo, hi = r["m"] * max(0.0, 1 - down), r["m"] * (1 + up)
        span, multiple = (hi - lo) * 1.25, 1
        while multiple * 0.5 * rows < span:
            multiple += 1
        while round((r["m"] - span / 2) / (0.5 * multiple)) * 0.5 * multiple + rows * 0.5 * multiple < hi:
            multiple += 1
        assert r["f"]["tick_multiple"] == multiple
