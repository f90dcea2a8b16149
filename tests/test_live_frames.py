"""The live grid under any cut into batches: jumps over many columns, frames that move, restarts, the open column."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_grid import brute_density
from tidegrid.functions.scale import Scale
from tidegrid.operators.epochs import Frame
from tidegrid.sources import store
from tidegrid.streaming.live import EVENTS, LiveGrid
from tidegrid.streaming.state import children

DT = 1_000
KEY = {"market": "x-spot", "symbol": "A", "band": "native"}


@pytest.fixture(autouse=True)
def small_plans(spark):
    """Plans of a few rows: less time goes to compiling them."""
    own = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "1", "spark.sql.codegen.wholeStage": "false"}
    former = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    yield
    for k, v in former.items():
        spark.conf.set(k, v)


def run(grid, spark, rows, cuts):
    for n, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(rows)])):
        grid(spark.createDataFrame(rows[a:b], EVENTS), n)
    return len(cuts)


def whole_books(seed, n=30, band=False):
    """(books, middles) of one stream, as full books with late times and long jumps."""
    rng = random.Random(seed)
    books, middles, t, mid = [], [], 0, 96.0
    for seq in range(n):
        t += rng.choice([-200, 0, 150, 400, DT, 3 * DT, 12 * DT])
        mid = max(20.0, mid + rng.choice([-4, -1, 0, 0, 1, 4]) * (4 if band else 1))
        own = [(s, mid + d * 0.5, float(rng.randrange(1, 9))) for s, d in ((0, -2), (0, -1), (1, 1), (1, 3))]
        books.append((max(0, t), own))
        middles.append((seq, (own[1][1] + own[2][1]) / 2))
    return books, middles


def events_of(books, stream="a"):
    return [(stream, seq, t, "level", s, p, z, True) for seq, (t, own) in enumerate(books) for s, p, z in own]


def cells_of(grid, spark):
    return {(r["epoch"], r["col_idx"], r["row"]): (float(np.float16(r["bid"])), float(np.float16(r["ask"]))) for r in grid.cells(spark).collect()}


@pytest.mark.parametrize("seed,band", [(0, None), (1, (0.5, 0.5))])
def test_frames_move_as_in_the_batch_form_however_events_are_cut(spark, tmp_path, seed, band):
    frame = Frame(p0=90.0, tick=0.5, rows=24, band=band)
    books, middles = whole_books(seed, band=bool(band))
    rows = events_of(books)
    rng = random.Random(seed)
    cuts = sorted(rng.sample(range(1, len(rows)), 2))
    cuts = [c - next(i for i in range(5) if rows[c - i][1] != rows[c - i - 1][1]) if c > 4 else 4 for c in cuts]  # a book is not torn
    grid = LiveGrid(f"file://{tmp_path}/grid", None, DT, ring=5, frame=frame)
    run(grid, spark, rows, sorted(set(cuts)))
    want = brute_density(frame, DT, books, middles, ring=5)
    open_col = max(t for t, _ in books) // DT
    got = cells_of(grid, spark)
    assert {k: v for k, v in want.items() if k[1] < open_col} == got and len({e for e, _, _ in got}) > 1
    announced = [(r["epoch"], r["from_seq"]) for r in grid.epochs(spark).orderBy("epoch").collect()]
    assert [e for e, _ in announced] == list(range(len(announced))) and announced[0][1] is None


def test_only_a_jump_between_two_books_is_capped(spark, tmp_path):
    rows = [("a", i, i * DT + 10, "level", 0, 10.0 + i % 3, 1.0, i == 0) for i in range(40)]
    rows += [("a", 40 + i, (200 + i) * DT, "level", 0, 10.0, 2.0, False) for i in range(3)] + [("a", 50, 208 * DT + 1, "level", 0, 11.0, 0.0, False)]
    grids = [LiveGrid(f"file://{tmp_path}/{name}", Scale.linear(0.0, 1.0, 30), DT, ring=8) for name in "xy"]
    run(grids[0], spark, rows, [])
    run(grids[1], spark, rows, [11, 39, 41])
    want = [*range(40), *range(192, 208)]  # from column 39 to 200
    for grid in grids:
        bars = grid.bars(spark).orderBy("col_idx").collect()
        assert [r["col_idx"] for r in bars] == want and [r["col_seq"] for r in bars] == want
        assert sorted({r["col_idx"] for r in grid.cells(spark).collect()}) == want
    assert sorted(map(repr, grids[0].cells(spark).collect())) == sorted(map(repr, grids[1].cells(spark).collect()))


def test_state_that_is_missing_is_an_error_and_old_state_goes(spark, tmp_path):
    grid = LiveGrid(f"file://{tmp_path}/grid", Scale.linear(0.0, 1.0, 30), DT)
    rows = [("a", i, i * 700, "level", 0, 10.0, 1.0, i == 0) for i in range(12)]
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    run(grid, spark, rows, [3, 6, 9])
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before
    assert {n for kind in ("clock", "levels", "frames") for n in children(spark, f"{grid.base}/state/{kind}")} == {"at=3", "at=4"}
    with pytest.raises(ValueError, match="no state"):
        grid(spark.createDataFrame(rows[:1], EVENTS), 7)
    with pytest.raises(ValueError, match="scale or a frame"):
        LiveGrid("x", None, DT)


def test_the_open_column_is_given_until_it_is_finished(spark, tmp_path):
    grid = LiveGrid(f"file://{tmp_path}/grid", Scale.linear(0.0, 1.0, 30), DT)
    rows = [("a", 0, 0, "level", 0, 10.0, 4.0, True), ("a", 1, 300, "trade", 0, 10.0, 2.0, False), ("a", 2, 500, "level", 1, 11.0, 0.0, False), ("a", 3, 1_200, "level", 0, 10.0, 8.0, False)]
    run(grid, spark, rows[:3], [])
    part = grid.depth(spark).collect()
    assert [(r["col_seq"], r["row"], r["bid"], r["final"]) for r in part] == [(0, 10, 2.0, False)]
    assert [(r["col_seq"], r["c"], r["vol_buy"], r["final"]) for r in grid.all_bars(spark).collect()] == [(0, 10.0, 2.0, False)]
    grid(spark.createDataFrame(rows[3:], EVENTS), 1)
    both = sorted((r["col_seq"], r["row"], round(r["bid"], 9), r["final"]) for r in grid.depth(spark).collect())
    assert both == [(0, 10, 4.0, True), (1, 10, 0.8, False)]
    assert sorted((r["col_seq"], r["cvd_cum"], r["final"]) for r in grid.all_bars(spark).collect()) == [(0, 2.0, True), (1, 2.0, False)]
    grid(spark.createDataFrame([], EVENTS), 2)  # nothing happens: the open column stays
    assert both == sorted((r["col_seq"], r["row"], round(r["bid"], 9), r["final"]) for r in grid.depth(spark).collect())


def test_a_hybrid_band_is_installed_once(spark, tmp_path):
    frame = Frame(p0=0.0, tick=0.5, rows=64, band=(4.0, 0.9), core_rows=32)
    books = [(i * 400, [(0, m - 0.5, 2.0), (1, m + 0.5, 3.0)]) for i, m in enumerate((100.0, 100.0, 101.0, 150.0, 150.0, 100.0, 30.0, 100.0))]
    grid = LiveGrid(f"file://{tmp_path}/grid", None, DT, frame=frame)
    run(grid, spark, [("a", -1, 0, "anchor", None, float("nan"), None, None), *events_of(books)], [3, 9])
    e = grid.epochs(spark).orderBy("epoch").collect()
    assert [(r["epoch"], r["scale_kind"], r["core_rows"]) for r in e] == [(0, 0, None), (1, 1, 32)] and e[1]["core_p0"] == 92.0
    cells = grid.cells(spark).collect()
    assert {r["epoch"] for r in cells} == {1} and {r["row"] for r in cells if r["col_idx"] == 0 and r["bid"] > 0} == {e[1]["dn_rows"] + 15, e[1]["dn_rows"] + 17}
    assert max(r["row"] for r in cells) > e[1]["dn_rows"] + 32  # 150 lies in the upper wing


def recorded(grid, spark, base):
    keyed = lambda df: df.withColumns({k: F.lit(v) for k, v in KEY.items()})
    store.write(keyed(grid.cells(spark)), base, "columns")
    store.write(keyed(grid.bars(spark)), base, "bars")
    store.write(keyed(grid.epochs(spark)), base, "epochs")


@pytest.mark.parametrize("band", [None, (0.5, 0.5)])
def test_a_grid_starts_from_the_recorded_tail_alone(spark, tmp_path, band):
    frame = Frame(p0=90.0, tick=0.5, rows=24, band=band)
    books, _ = whole_books(5, 24, bool(band))
    rows = events_of(books) + [("a", 100 + i, books[-1][0] + i, "trade", i % 2, 50.0 + i, 3.0, False) for i in range(3)]
    first = LiveGrid(f"file://{tmp_path}/first", None, DT, ring=50, frame=frame)
    run(first, spark, rows + [("a", 200, books[-1][0] + 2 * DT, "level", 0, 50.0, 1.0, False)], [])
    recorded(first, spark, f"{tmp_path}/store")
    bars = first.bars(spark).orderBy(F.desc("col_seq")).first()
    tail = store.tail(spark, f"{tmp_path}/store", *KEY.values(), bars["t0_ns"] + DT, 1 << 60, 5)
    # What comes after the restart, with the frame that was in force.
    last = first.epochs(spark).orderBy(F.desc("epoch")).first()
    centre = last["p0"] + 24 * last["tick"] * last["tick_multiple"] / 2
    later = [(t + 10**9, [(0, centre - 0.5, 2.0), (1, centre + 0.5, 1.0)]) for t in (100, 900, 2_500)]
    second = LiveGrid(f"file://{tmp_path}/second", None, DT, ring=50, frame=frame)
    gap = second.start_from(tail).collect()
    assert [(r["kind"], r["ts_ns"]) for r in gap] == [("gap", bars["t0_ns"] + DT - 1)]
    run(second, spark, [(*e[:1], e[1] + 1000, *e[2:]) for e in events_of(later)], [4])
    got = second.bars(spark).orderBy("col_seq").collect()
    assert [(r["col_seq"], r["t0_ns"]) for r in got] == [(bars["col_seq"] + 1 + i, 10**9 + i * DT) for i in range(2)]
    assert all((r["c"], r["cvd_cum"], r["vwap_num_cum"], r["epoch"]) == (bars["c"], bars["cvd_cum"], bars["vwap_num_cum"], last["epoch"]) for r in got)
    assert {r["epoch"] for r in second.cells(spark).collect()} == {last["epoch"]} and {r["row"] for r in second.cells(spark).collect()} <= {11, 12, 13}


def test_a_tail_that_is_torn_is_refused(spark, tmp_path):
    bar = "stream string, epoch int, col_seq long, t0_ns long, c double, cvd_cum double, vwap_num_cum double, vwap_den_cum double"
    seqs = {"whole": [4, 5, 6], "torn": [4, 5, 7], "unknown": [1, 2], "shape": [1, 2]}
    bars = spark.createDataFrame([(s, 3 if s == "unknown" else 0, k, k * DT, 1.0, 0.0, 0.0, 0.0) for s, own in seqs.items() for k in own], bar)
    epochs = spark.createDataFrame([(s, 0, 0.5, 1, DT if s != "shape" else 7, 90.0, 24, *(None,) * 7) for s in seqs], "stream string, epoch int, tick double, tick_multiple int, dt_ns long, p0 double, rows int, scale_kind int, dn_rows int, core_rows int, core_p0 double, core_step double, lo_price double, hi_price double")
    grid = LiveGrid(f"file://{tmp_path}/grid", None, DT, frame=Frame(p0=90.0, tick=0.5, rows=24))
    assert [r["stream"] for r in grid.start_from({"bars": bars, "epochs": epochs}).collect()] == ["whole"]
    assert [(r["stream"], r["next_seq"]) for r in grid.state.read(spark, "clock", 0).collect()] == [("whole", 7)]
