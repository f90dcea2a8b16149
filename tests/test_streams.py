"""Streams of trades, ids, tiles and recordings against the batch form, under random cuts and batches tried again."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from tests.test_live_frames import small_plans  # noqa: F401
from tidegrid.functions.scale import Scale
from tidegrid.operators import bars, density, normalize
from tidegrid.sources import store
from tidegrid.streaming import live, sides, tiles
from tidegrid.streaming.recording import record
from tidegrid.streaming.state import children

KEY = {"market": "x-spot", "symbol": "A", "band": "native"}


def cut(rows, seed, n):
    rng = random.Random(seed)
    at = sorted(rng.sample(range(1, len(rows)), n))
    return [rows[a:b] for a, b in zip([0, *at], [*at, len(rows)])]


@pytest.mark.parametrize("seed", range(2))
def test_sides_equal_the_quote_rule_for_every_cut(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = []
    for seq in range(120):
        s, p = rng.choice("ab"), float(rng.randrange(8, 13))
        if rng.random() < 0.2:
            rows.append((s, seq, seq, "quote", None, None, rng.choice([p - 1, float("nan")]), p + 1))
        else:
            rows.append((s, seq, seq, "trade", rng.choice([p, p, None]), 1.0, None, None))
    grid = sides.LiveSides(f"file://{tmp_path}/sides")
    parts = cut(rows, seed, 3)
    for n, part in enumerate([*parts, []]):
        grid(spark.createDataFrame(part, sides.EVENTS), n)
    grid(spark.createDataFrame([], sides.EVENTS), len(parts))  # tried again
    e = spark.createDataFrame(rows, sides.EVENTS)
    want = bars.quote_rule(e.where("kind = 'trade'").select("stream", "seq", "price"), e.where("kind = 'quote'").select("stream", "seq", "bid_px", "ask_px"))
    key = lambda df: sorted((r["stream"], r["seq"], r["side"]) for r in df.collect())
    assert key(grid.trades(spark)) == key(want) and len({s for _, _, s in key(want)}) == 2


def accepted(rows, window):
    """Trades kept by a queue of the last ``window`` ids accepted, one by one."""
    held, order, out = {}, {}, []
    for stream, seq, trade_id in rows:
        own, queue = held.setdefault(stream, set()), order.setdefault(stream, deque())
        if trade_id:
            if trade_id in own:
                continue
            own.add(trade_id)
            queue.append(trade_id)
            if len(queue) > window:
                own.discard(queue.popleft())
        out.append((stream, seq))
    return out


@pytest.mark.parametrize("window,ids", [(5, 12), (4096, 40), (1, 3)])
def test_ids_are_dropped_while_they_are_in_the_window_only(spark, tmp_path, window, ids):
    rng = random.Random(window)
    rows = [(rng.choice("ab"), seq, rng.choice(["", None, *[f"t{rng.randrange(ids)}"] * 6])) for seq in range(150)]
    stream = sides.LiveIds(f"file://{tmp_path}/ids", window)
    schema = "stream string, seq long, trade_id string"
    parts = cut(rows, 1, 2)
    for n, part in enumerate(parts):
        stream(spark.createDataFrame(part, schema), n)
    got = sorted((r["stream"], r["seq"]) for r in stream.trades(spark).collect())
    assert got == sorted(accepted(rows, window))
    if window > ids:  # no id returns after it left: the batch form says the same
        assert got == sorted((r["stream"], r["seq"]) for r in bars.seen_before(spark.createDataFrame(rows, schema), window).select("stream", "seq").collect())
    state = stream.state.read(spark, "ids", len(parts)).groupBy("stream").count().collect()
    assert state and max(r["count"] for r in state) <= window


def test_tiles_and_levels_follow_the_finished_columns(spark, tmp_path):
    rng = random.Random(3)
    cells = [(s, k, r, float(rng.randrange(4)) * 9_000, float(rng.randrange(3))) for s, n in (("a", 43), ("b", 6)) for k in range(n) for r in range(9) if rng.random() < 0.4 and k % 7]
    schema = "stream string, col_idx long, row int, bid double, ask double"
    all_cells, last = spark.createDataFrame(cells, schema), spark.createDataFrame([("a", 42), ("b", 5)], "stream string, last_col long")
    grid = tiles.LiveTiles(f"file://{tmp_path}/tiles")
    edges = [(0, 0), (3, 2), (19, 6), (20, 6), (43, 6)]
    for n, ((a0, b0), (a1, b1)) in enumerate(zip(edges, edges[1:])):
        own = [c for c in cells if (a0 <= c[1] < a1 if c[0] == "a" else b0 <= c[1] < b1)]
        bar = spark.createDataFrame([("a", k) for k in range(a0, a1)] + [("b", k) for k in range(b0, b1)], "stream string, col_idx long")
        for _ in range(2 if n == 1 else 1):
            grid(tiles.finished(bar, spark.createDataFrame(own, schema)), n)
    rows = lambda df: sorted((r["stream"], r["col_idx"], r["row"], r["bid"], r["ask"]) for r in df.collect())
    level1 = density.pyramid(all_cells, last=last)
    assert rows(grid.level(spark, 1)) == rows(level1) and max(r[1] for r in rows(level1)) == 9
    assert rows(grid.level(spark, 2)) == rows(density.pyramid(level1, last=density.coarser(last))) != []
    assert max(r[3] for r in rows(level1)) == 60_000
    assert sorted(map(tuple, grid.histogram(spark).collect())) == sorted(map(tuple, normalize.log_histogram(all_cells).collect()))
    assert {n for n in children(spark, f"{grid.base}/state/waiting1")} == {"at=3", "at=4"}


def test_a_recording_that_fails_ends_alone(spark, tmp_path):
    grid = live.LiveGrid(f"file://{tmp_path}/grid", Scale.linear(0.0, 1.0, 30), 1_000)
    rows = [("a", i, i * 700, "level", 0, 10.0 + i % 2, 1.0, i == 0) for i in range(8)]
    grid(spark.createDataFrame(rows[:4], live.EVENTS), 0)

    def broken(base, kind):
        def each(df, batch):
            raise OSError("disk full")

        return each

    run = lambda sink, at: record(spark, grid, f"{tmp_path}/store", KEY, f"{tmp_path}/{at}", {"availableNow": True}, sink)
    for query in run(broken, "broken").values():
        with pytest.raises(Exception, match="disk full"):
            query.awaitTermination()
    grid(spark.createDataFrame(rows[4:], live.EVENTS), 1)  # the grid goes on
    for n in range(2):  # a recording goes on where it ended
        for query in run(store.sink, "sound").values():
            query.awaitTermination()
        if n == 0:
            grid(spark.createDataFrame([("a", 9, 9_000, "level", 0, 10.0, 1.0, False)], live.EVENTS), 2)
    stored = store.read(spark, f"{tmp_path}/store", "bars").select("col_seq", "t0_ns").orderBy("col_seq").collect()
    assert stored == grid.bars(spark).select("col_seq", "t0_ns").orderBy("col_seq").collect() and len(stored) == 9
    cells = store.read(spark, f"{tmp_path}/store", "columns")
    assert cells.count() == grid.cells(spark).count() and cells.where(F.col("market") == "x-spot").count() == cells.count()
