"""Odd cases of views, ladders and candle sources."""

import pytest
from pyspark.sql import functions as F

from tidegrid.functions.scale import Scale
from tidegrid.functions.text import duration, next_speed, percent_label, price_decimals, size_label
from tidegrid.operators import ladder, views
from tidegrid.sources import catalog


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_spark_paths(spark):
    doubles = lambda *v: F.array(*(F.lit(x).cast("double") for x in v)).cast("array<double>")
    got = one(spark, views.spark_path(doubles(1, 3, 2), 42, 22), views.spark_path(doubles(5), 42, 22), views.spark_path(doubles(), 42, 22))
    assert got == ("M1.0 21.0L21.0 1.0L41.0 11.0", "M1.0 21.0", "")
    ways = [views.spark_direction(doubles(*v)) for v in ((1, 5, 2), (2, 1), (1, 1), (1,), (1, float("nan")))]
    assert one(spark, *ways) == (1, -1, 0, 0, 0)


def test_strips(spark):
    points = spark.createDataFrame([("a", 0.0), ("a", float("nan")), ("b", -5.0), ("b", 20.0), ("c", None)], "stream string, cvd double")
    assert sorted(map(tuple, views.cvd_bounds(points).collect())) == [("a", -1.0, 1.0), ("b", -7.0, 22.0), ("c", -1.0, 1.0)]
    assert one(spark, views.strip_y(F.lit(22.0), F.lit(-7.0), F.lit(22.0), 100.0), views.strip_x(F.lit(0), F.lit(3), F.lit(3), 10.0)) == (4.0, -25.0)


def test_labels(spark):
    assert one(spark, *(next_speed(F.lit(x)) for x in (1, 7, 100, 0.1)), next_speed(F.lit(1), -1)) == (2, 10, 1, 2, 100)
    assert one(spark, *(price_decimals(F.lit(x)) for x in (0.5, 1.0, 1e-5, 1e-12, 0.0, 250.0))) == (1, 0, 5, 8, 2, 0)
    assert one(spark, *(size_label(F.lit(float(x))) for x in (0, 3.14159, 250.04, 1500, 2e6, 3.21e9))) == ("", "3.14", "250.0", "1.5K", "2M", "3.2B")
    assert one(spark, percent_label(F.lit(1.239)), percent_label(F.lit(-0.5)), duration(F.lit(3_723_004_000_000))) == ("+1.24%", "−0.50%", "01:02:03.004")


def test_ladder_without_one_side_and_with_a_quote(spark):
    scale = Scale.linear(0.0, 1.0, 20)
    cells = spark.createDataFrame([("a", 1, 5, 2.0, 0.0), ("a", 0, 9, 9.0, 9.0), ("b", 1, 7, 0.0, 4.0)], "stream string, col_idx long, row int, bid double, ask double")
    rows = {(r["stream"], r["row"]): r for r in ladder.dom_ladder(cells, scale, 20, visible=4).collect()}
    assert {k for k in rows if k[0] == "a"} == {("a", r) for r in range(4, 9)} and rows["a", 5]["bid_pct"] == 100 and rows["a", 6]["is_best_ask"]
    assert rows["b", 6]["is_best_bid"] and rows["b", 7]["ask"] == 4 and rows["b", 7]["spread"] is None
    quotes = spark.createDataFrame([("a", 3.0, 1.0, 4.0, 50.0), ("c", -9.0, 1.0, 99.0, 1.0)], "stream string, bid_px double, bid_sz double, ask_px double, ask_sz double")
    l1 = {(r["stream"], r["row"]): r for r in ladder.dom_ladder(cells, scale, 20, visible=4, shape="l1", quotes=quotes).collect()}
    assert l1["a", 3]["bid"] == 1 and l1["a", 3]["bid_pct"] == 2 and l1["a", 4]["ask_pct"] == 100 and l1["a", 4]["middle"] == 3.5
    assert ladder.dom_ladder(cells.limit(0), scale, 20).count() == 0


def test_sources_by_market(spark):
    built = {"sim": lambda m: spark.range(1), "crypto": lambda m: spark.range(2)}
    assert catalog.source_for("sim", spark, built).count() == 1 and catalog.source_for("x-linear", spark, built).count() == 2
    for odd in ("equity", "", "derive-spot"):
        with pytest.raises(ValueError):
            catalog.source_for(odd, spark, built)


def test_candles_of_providers(spark):
    rows = [("a", 1, 1.0, 2.0, 0.5, 1.5, None), ("a", 2, None, 2.0, 0.5, 1.5, 3.0), ("a", 3, 1.0, 2.0, 0.5, 1.5, 4.0), ("a", None, 1.0, 2.0, 0.5, 1.5, 4.0)]
    raw = spark.createDataFrame(rows, "stream string, ts long, o double, h double, l double, c double, volume double")
    assert sorted((r["t0_ns"], r["volume"]) for r in catalog.candles_from(raw, 9).collect()) == [(1_000_000, 0.0), (3_000_000, 4.0)]
    assert [r["t0_ns"] for r in catalog.candles_from(raw, 2).collect()] == [3_000_000]
    own = raw.selectExpr("stream", "ts AS t0_ns", "c").where("t0_ns = 3")
    other = raw.selectExpr("'b' AS stream", "ts AS t0_ns", "c").union(raw.selectExpr("stream", "ts AS t0_ns", "c"))
    got = catalog.candles_with_fallback(own, other, now_ns=4, most=3, span_ns=1).collect()
    assert sorted((r["stream"], r["t0_ns"], r["origin"]) for r in got) == [("a", 3, "native"), ("b", 1, "unified"), ("b", 2, "unified"), ("b", 3, "unified")]
