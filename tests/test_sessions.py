"""Smoothing, references as of each time, calendars and point probes in odd cases, and the plans of some of them."""

import random

import pytest
from pyspark.sql import functions as F

from tidegrid.operators import bars, density, ingest, normalize, profiles
from tidegrid.plans import registry
from tidegrid.sources import adapters, layout

SF = "/root/testdata/sf0.001"
DAY, HOUR = ingest.DAY_NS, 3_600_000_000_000


@pytest.mark.parametrize("alpha", [0.15, 0.9, 1.0, 0.002])
def test_smoothing_equals_one_pass_in_order(spark, alpha):
    rng = random.Random(4)
    rows = [(s, i, rng.choice([None, rng.uniform(0, 50), rng.uniform(5, 6)])) for s in "ab" for i in rng.sample(range(200_000), 1500)] + [("c", 1, None), ("d", 5, 9.0)]
    got = normalize.smoothed(spark.createDataFrame(rows, "stream string, col long, v double"), "v", "col", alpha).collect()
    want, state = {}, {}
    for s, i, v in sorted(rows, key=lambda r: (r[0], r[1])):
        if v is not None:
            state[s] = v if s not in state else state[s] + alpha * (v - state[s])
        want[s, i] = max(4.0, state[s]) if s in state else None
    assert len(got) == len(rows)
    for r in got:
        assert r["ema"] == (pytest.approx(want[r["stream"], r["col"]], rel=1e-12) if want[r["stream"], r["col"]] is not None else None)


def test_smoothing_is_linear_in_the_rows(spark):
    n = 300_000
    df = spark.range(n).select(F.lit("a").alias("stream"), F.col("id").alias("col"), (F.col("id") % 1000 + 10).cast("double").alias("v"))
    last = normalize.smoothed(df, "v", "col").where(F.col("col") == n - 1).first()["ema"]
    y = 10.0
    for i in range(n):
        y += 0.15 * (i % 1000 + 10 - y)
    assert last == pytest.approx(y, rel=1e-12)


def test_profiles_are_split_as_of_each_bar(spark):
    bar = "stream string, t0_ns long, o double, h double, l double, c double, volume double"
    b = spark.createDataFrame([("a", t, p, p, p, p, 1.0) for t, p in ((10, 5.0), (20, 8.0), (30, 5.0), (40, 6.0))] + [("b", 10, 3.0, 3.0, 3.0, 2.0, 1.0)], bar)
    prices = spark.createDataFrame([("a", 20, 7.0), ("a", 35, 5.5), ("a", 36, float("nan")), ("a", 37, None)], "stream string, ts_ns long, px double")
    got = sorted((r["stream"], r["t0_ns"], r["bucket"], r["volume"], r["side"]) for r in profiles.sided_profile(b, prices, tick=1.0, span_ns=7).collect())
    assert got == [("a", 10, 5, 1.0, 0), ("a", 20, 8, 1.0, 1), ("a", 30, 5, 2.0, 0), ("a", 40, 6, 1.0, 1), ("b", 10, 3, 1.0, 1)]
    assert profiles.sided_profile(b.limit(0), prices).count() == 0


def test_sessions_meet_rows_by_day(spark):
    c = spark.createDataFrame([("x", 9 * HOUR, 17 * HOUR), ("x", 9 * HOUR, 17 * HOUR), ("x", DAY + 9 * HOUR, 2 * DAY + 3 * HOUR), ("x", 40 * DAY, 40 * DAY + 5), ("y", 5, 5)], "market string, open_ns long, close_ns long")
    at = [("x", t) for t in (-11 * DAY, 0, 9 * HOUR, 17 * HOUR - 1, 17 * HOUR, 2 * DAY, 2 * DAY + 3 * HOUR, 30 * DAY, 30 * DAY - 1, 41 * DAY)] + [("y", 5), ("z", 1), (None, 3)]
    rows = spark.createDataFrame([(m, t, "keep") for m, t in at], "market string, ts_ns long, note string")
    got = {(r["market"], r["ts_ns"]): (r["open"], r["next_open_ns"]) for r in ingest.session_open(rows, c).collect()}
    assert len(got) == len(at)
    assert got["x", -11 * DAY] == (False, None) and got["x", 0] == (False, 9 * HOUR)
    assert got["x", 9 * HOUR] == (True, None) == got["x", 17 * HOUR - 1] == got["x", 2 * DAY]
    assert got["x", 17 * HOUR] == (False, DAY + 9 * HOUR) and got["x", 2 * DAY + 3 * HOUR] == (False, None)
    assert got["x", 30 * DAY] == (False, 40 * DAY) and got["x", 30 * DAY - 1] == (False, None)
    assert got["y", 5] == got["z", 1] == got[None, 3] == (False, None)
    breaks = sorted((r["market"], r["ts_ns"], r["next_open_ns"]) for r in ingest.session_breaks(c).collect())
    assert breaks == [("x", 17 * HOUR, DAY + 9 * HOUR), ("x", 2 * DAY + 3 * HOUR, None), ("x", 40 * DAY + 5, None), ("y", 5, None)]
    assert not [x for x in ingest.session_open(rows, c)._jdf.queryExecution().executedPlan().toString().split() if x == "Window"]


def leaf_metric(df, name):
    """Value of a metric of the scan after the frame ran without adaptive planning."""
    plan = df._jdf.queryExecution().executedPlan()
    df._jdf.collectToPython()
    return plan.collectLeaves().head().metrics().apply(name).value()


def test_a_probe_opens_the_files_of_its_tile_alone(spark, tmp_path):
    cells = spark.range(64 * 100).select(F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("stream"), F.floor(F.col("id") / 100).alias("col_idx"), (F.col("id") % 100).cast("int").alias("row"), F.col("id").cast("double").alias("bid"), F.lit(1.0).alias("ask"), F.lit(0).alias("epoch"))
    layout.write_cells(cells, str(tmp_path / "cells"), tile_columns=8)
    former = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        one = layout.cells_at(spark, str(tmp_path / "cells"), "a", 17, 17, 4, 7, tile_columns=8)
        every = spark.read.parquet(str(tmp_path / "cells"))
        assert leaf_metric(one, "numFiles") * 4 <= leaf_metric(every, "numFiles")
        assert "EqualTo(stream,a)" in one._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", former)
    assert sorted((r["row"], r["bid"]) for r in one.collect()) == [(4, 1704.0), (6, 1706.0)]


def test_probes_give_size_epoch_and_price(spark):
    cells = spark.createDataFrame([("a", 1, 4, 2.0, 0.0, 3), ("a", 1, 7, 1.0, 5.0, 3), ("a", 1, 8, 9.0, 9.0, 3)], "stream string, col_idx long, row int, bid double, ask double, epoch int")
    epochs = spark.createDataFrame([("a", 3, 0.5, 2, 10.0, 64, 0, *(None,) * 6)], "stream string, epoch int, tick double, tick_multiple int, p0 double, rows int, scale_kind int, dn_rows int, core_rows int, core_p0 double, core_step double, lo_price double, hi_price double")
    points = spark.createDataFrame([("a", 1, 5, "p"), ("a", 1, 5, "p"), ("a", 2, 5, "q"), ("b", 1, 5, "r")], "stream string, col_idx long, row int, epoch_note string")
    got = sorted((r["epoch_note"], r["bid"], r["ask"], r["epoch"], r["price"]) for r in density.probe(points, cells, epochs, 4).collect())
    assert got == [("p", 3.0, 5.0, 3, 15.0)] * 2 + [("q", 0.0, 0.0, None, None), ("r", 0.0, 0.0, None, None)]


def scans(df):
    """Scans that ran, after exchanges were reused."""
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return text.count("Scan parquet")


def test_nested_running_values_read_the_source_few_times(spark):
    assert scans(registry.quote_rule_side(spark, SF)) <= 8 and scans(registry.trade_column_asof(spark, SF)) <= 4
    t = adapters.trades(spark, SF)
    assert bars.quote_rule(t, registry.quotes_frame(spark, SF)).columns == [*t.columns, "side_src"]
