"""The live grid in a stream that stops and starts again, against the batch form over all events."""

import random

import pytest
from pyspark.sql import functions as F

from tidegrid.functions.scale import Scale
from tidegrid.operators import bars, density
from tidegrid.streaming.live import EVENTS, LiveGrid

DT = 1_000


def scale():
    return Scale.linear(0.0, 1.0, 30)


def made(seed, n=240):
    rng = random.Random(seed)
    rows, now = [], {"a": 5_000, "b": 0}
    for seq in range(n):
        s = rng.choice("ab")
        now[s] += rng.choice([0, 0, 90, 250, 700, 4_000])
        ts = max(0, now[s] - rng.choice([0, 0, 0, 120]))
        if rng.random() < 0.4:
            rows.append((s, seq, ts, "trade", rng.randrange(3), float(rng.randrange(5, 25)), float(rng.randrange(1, 9)), False))
        else:
            price = rng.choice([float("nan"), *map(float, range(1, 28))])
            rows.append((s, seq, ts, "level", int(price > 14), price, float(rng.choice([0, 1, 2, 3])), rng.random() < 0.08))
    return rows


def batch_form(spark, rows):
    e = spark.createDataFrame(rows, EVENTS)
    updates = e.where("kind = 'level'").withColumnRenamed("size", "amount").drop("kind")
    cells = density.density(density.close_open(density.level_intervals(updates), updates), scale(), DT)
    open_col = {r["stream"]: r["t"] // DT for r in updates.groupBy("stream").agg(F.max("ts_ns").alias("t")).collect()}
    finished = sorted((r["stream"], r["col_idx"], r["row"], round(r["bid"], 9), round(r["ask"], 9)) for r in cells.collect() if r["col_idx"] < open_col[r["stream"]])
    trades = bars.trade_columns(e.where("kind = 'trade'").drop("kind", "is_snapshot"), updates, DT)
    own = [r for r in bars.trade_bars(trades, DT, "col_idx").collect() if r["col_idx"] < open_col[r["stream"]]]
    return finished, {(r["stream"], r["col_idx"]): r for r in own}


def got_of(grid, spark):
    cells = sorted((r["stream"], r["col_idx"], r["row"], round(r["bid"], 9), round(r["ask"], 9)) for r in grid.cells(spark).collect())
    return cells, {(r["stream"], r["col_idx"]): r for r in grid.bars(spark).collect()}


def compare(cells, got_bars, rows, spark):
    want_cells, want_bars = batch_form(spark, rows)
    assert cells == want_cells
    cvd, close, last = {}, {}, {}
    for (s, k), r in sorted(got_bars.items()):
        assert s not in last or k == last[s] + 1  # every column once, in a row
        w, last[s] = want_bars.get((s, k)), k
        if w:
            cvd[s], close[s] = cvd.get(s, 0.0) + w["delta"], w["c"]
            assert [r[x] for x in ("o", "h", "l", "c", "vol_buy", "vol_sell")] == [w[x] for x in ("o", "h", "l", "c", "vol_buy", "vol_sell")]
        else:
            assert [r[x] for x in "ohlc"] == [close.get(s)] * 4 and r["vol_buy"] == r["vol_sell"] == 0
        assert r["cvd_cum"] == pytest.approx(cvd.get(s, 0.0))
    assert set(want_bars) <= set(got_bars)


def test_a_stream_that_starts_again_equals_the_batch_form(spark, tmp_path):
    rows = made(1)
    grid, source = LiveGrid(f"file://{tmp_path}/grid", scale(), DT), f"{tmp_path}/in"

    def run():
        events = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(source)
        events.writeStream.foreachBatch(lambda df, n: grid(df, n)).option("checkpointLocation", f"{tmp_path}/at").trigger(availableNow=True).start().awaitTermination()

    for part, (a, b) in enumerate(((0, 70), (70, 150), (150, 240))):
        spark.createDataFrame(rows[a:b], EVENTS).coalesce(1).write.mode("append").parquet(source)
        run()  # a new query each time, from its checkpoint
    compare(*got_of(grid, spark), rows, spark)


def test_a_batch_that_is_tried_again_changes_nothing(spark, tmp_path):
    rows = made(2, 120)
    grid = LiveGrid(f"file://{tmp_path}/grid", scale(), DT)
    for n, (a, b) in enumerate(((0, 40), (40, 41), (41, 120))):
        events = spark.createDataFrame(rows[a:b], EVENTS)
        grid(events, n)
        grid(events, n)
    compare(*got_of(grid, spark), rows, spark)
    assert grid.open_column(spark, 2).count() > 0
