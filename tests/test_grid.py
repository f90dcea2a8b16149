"""Invariants of the grid: the sequential processor, the set-wise form, and both against each other."""

import random

import numpy as np
import pytest

from tidegrid.functions.scale import Scale, band_frame, half_float, make_hybrid
from tidegrid.operators import bars, density, epochs, ingest
from tidegrid.operators.epochs import Frame

NS = 1_000_000_000
FRAME = Frame(p0=90.0, tick=0.5, rows=64)
LEVELS = "stream string, seq long, ts_ns long, side int, price double, size double"


def book(mid, size):
    mid, size = float(mid), float(size)
    return [(0, mid - 1.0, size), (0, mid - 0.5, size), (0, mid, size), (1, mid + 0.5, size), (1, mid + 1.0, size), (1, mid + 1.5, size)]


def moves(frame, middles, p0=None, multiple=None):
    """(epoch, from seq, p0, multiple) of frames, middle by middle."""
    p0, multiple, anchor, out = frame.p0, frame.tick_multiple, None, [(0, -1, frame.p0, frame.tick_multiple)]
    for seq, m in middles:
        step = frame.tick * multiple
        if m is None or not np.isfinite(m):
            continue
        if frame.band and anchor is None:
            lo, hi, multiple = m * max(0, 1 - frame.band[1]), m * (1 + frame.band[0]), 1
            span = (hi - lo) * 1.25
            while frame.rows * frame.tick * multiple < span or round((m - span / 2) / (frame.tick * multiple)) * frame.tick * multiple + frame.rows * frame.tick * multiple < hi:
                multiple += 1
            p0, anchor = round((m - span / 2) / (frame.tick * multiple)) * frame.tick * multiple, m
        elif frame.band and (m > anchor * 1.25 or m < anchor / 1.25):
            p0, anchor = round((m - frame.rows * step / 2) / step) * step, m
        elif not frame.band and not p0 + 0.15 * frame.rows * step <= m <= p0 + 0.85 * frame.rows * step:
            p0 = round((m - frame.rows * step / 2) / step) * step
        else:
            continue
        out.append((len(out), seq, p0, multiple))
    return out


def brute_density(frame, dt, books, middles, ring=None):
    """{(epoch, column, row): (bid, ask)} of the full books (ts, levels) of one stream, level by level and column by column."""
    frames = moves(frame, middles)
    epoch_at = [max(e for e, s, *_ in frames if s <= seq) for seq in range(len(books))]
    times = list(np.maximum.accumulate([t for t, _ in books]))
    out = {}
    for i, (a, b) in enumerate(zip(times, times[1:])):
        for k in range(a // dt, -(-b // dt)):
            if ring is not None and b // dt - a // dt > ring + 1 and k != a // dt and k < b // dt - ring:
                continue
            closing = [j for j, (x, y) in enumerate(zip(times, times[1:])) if x < (k + 1) * dt <= y]
            if not closing or min(b, (k + 1) * dt) <= max(a, k * dt):
                continue
            passed = frames[epoch_at[i] : epoch_at[closing[0]] + 1]
            if len({m for *_, m in passed}) > 1:
                continue
            for side, price, size in books[i][1]:
                step = frame.tick * passed[0][3]
                first = round((price - passed[0][2]) / step) if np.isfinite(price) and np.isfinite(size) else -1
                rows = [first - round((p0 - passed[0][2]) / step) for _, _, p0, _ in passed]
                if all(0 <= r < frame.rows for r in rows):
                    cell = out.setdefault((passed[-1][0], k, rows[-1]), [0.0, 0.0])
                    cell[side] += size * (min(b, (k + 1) * dt) - max(a, k * dt)) / dt
    return {key: tuple(float(np.float16(x)) for x in v) for key, v in out.items()}


def set_density(spark, frame, dt, books, middles, ring=None):
    levels = spark.createDataFrame([("a", i, t, s, p, z) for i, (t, own) in enumerate(books) for s, p, z in own], LEVELS)
    table = epochs.epoch_table(spark.createDataFrame([("a", s, m) for s, m in middles], "stream string, seq long, ref double"), frame)
    got = epochs.moving_density(levels, table, frame.tick, frame.rows, dt, ring)
    return {(r["epoch"], r["col_idx"], r["row"]): (r["bid"], r["ask"]) for r in got.collect()}


def at(*events):
    return [(int(t * NS), levels) for t, levels in events]


def test_cadence_weighting_lateness_and_gaps(spark):
    still = [(0, 100.0)]
    one = set_density(spark, FRAME, NS, at((0, book(100, 4)), (1, book(100, 4))), still)
    ten = set_density(spark, FRAME, NS, at(*((i / 10, book(100, 4)) for i in range(11))), still)
    assert one == ten and one[0, 0, 20] == (4.0, 0.0)
    assert set_density(spark, FRAME, NS, at((0, book(100, 4)), (0.5, book(100, 8)), (1, book(100, 8))), still)[0, 0, 20] == (6.0, 0.0)
    assert set_density(spark, FRAME, NS, at((0, book(100, 4)), (0.5, book(100, 8)), (0.4, book(100, 2)), (1, book(100, 2))), still)[0, 0, 20] == (3.0, 0.0)
    assert {k for _, k, _ in set_density(spark, FRAME, NS, at((0, book(100, 4)), (3.5, book(100, 4))), still)} == {0, 1, 2}
    capped = {k for _, k, _ in set_density(spark, FRAME, NS // 4, at((0, book(100, 1)), (3600, book(100, 1))), still, ring=128)}
    assert capped == {0, *range(14_272, 14_400)}
    odd = [(0, float("nan"), 1.0), (0, 100.0, float("inf")), (1, 5000.0, 1.0), (1, 101.0, 2.0)]
    assert set_density(spark, FRAME, NS, at((0, odd), (1, odd)), still) == {(0, 0, 22): (0.0, 2.0)}


@pytest.mark.parametrize("frame", [FRAME, Frame(p0=0.0, tick=0.5, rows=64, band=(0.5, 0.5)), Frame(p0=90.0, tick=0.5, rows=24)])
def test_frames_move_as_middle_by_middle(spark, frame):
    rng = random.Random(4)
    m, middles = 100.0, [(-1, None), (0, float("inf"))]
    for seq in range(1, 300):
        m = max(5.0, m + rng.choice([-7, -1, 0, 0, 1, 8]))
        middles.append((seq, m if rng.random() < 0.9 else rng.choice([None, float("nan")])))
    rows = [(s, seq, m) for s in ("a", "b") for seq, m in middles]
    got = epochs.epoch_table(spark.createDataFrame(rows, "stream string, seq long, ref double"), frame).where("stream = 'b'")
    assert sorted(tuple(r)[1:] for r in got.collect()) == moves(frame, middles)
    assert len(moves(frame, middles)) > 3


@pytest.mark.parametrize("band", [None, (0.5, 0.5)])
@pytest.mark.parametrize("seed", range(2))
def test_density_under_moving_frames_equals_brute_force(spark, seed, band):
    rng = random.Random(seed)
    frame = Frame(p0=90.0, tick=0.5, rows=24, band=band)
    books, middles, t, mid = [], [], 0, 96.0
    for seq in range(60):
        t += rng.choice([-200_000_000, 0, 150_000_000, 400_000_000, NS, 3 * NS, 12 * NS])
        mid += rng.choice([-4, -1, 0, 0, 1, 4]) * (4 if band else 1)
        mid = max(20.0, mid)
        own = [(s, mid + d * 0.5, float(rng.randrange(1, 9))) for s, d in ((0, -2), (0, -1), (1, 1), (1, 3)) if rng.random() < 0.9]
        books.append((max(0, t), own or [(0, mid, 1.0)]))
        middles.append((seq, mid))
    assert set_density(spark, frame, NS, books, middles, ring=5) == brute_density(frame, NS, books, middles, ring=5)


@pytest.mark.parametrize("seed", range(3))
def test_level_intervals_equal_whole_books(spark, seed):
    rng = random.Random(seed)
    rows, standing, spans, now, started = [], {}, [], 0, False
    for seq in range(300):
        ts = seq * 10 + rng.choice([-25, 0, 0, 5])
        snapshot = rng.random() < 0.03
        now = max(now, ts)
        if snapshot:
            spans += [(s, p, z, a, now) for (s, p), (z, a) in standing.items()]
            standing, started = {}, True
        side, price, amount = rng.randrange(2), float(rng.randrange(1, 12)), float(rng.choice([0, 1, 2, 3]))
        rows.append(("a", seq, ts, side, price, amount, snapshot))
        if started:
            if (side, price) in standing:
                z, a = standing.pop((side, price))
                spans.append((side, price, z, a, now))
            if amount > 0:
                standing[side, price] = (amount, now)
    spans += [(s, p, z, a, now) for (s, p), (z, a) in standing.items()]
    updates = spark.createDataFrame(rows, "stream string, seq long, ts_ns long, side int, price double, amount double, is_snapshot boolean")
    got = density.close_open(density.level_intervals(updates), updates)
    area = lambda xs: sorted((s, p, z, a, b) for s, p, z, a, b in xs if b > a)
    assert area((r["side"], r["price"], r["size"], r["from_ns"], r["till_ns"]) for r in got.collect()) == area(spans)


def test_half_floats(spark):
    from pyspark.sql import functions as F

    xs = [0.0, 1e-9, 6e-8, 1.0, 1.0009765625, 2049.0, 65504.0, 65519.999, 65520.0, 1e9, -3.14159, 0.1] + [float(x) for x in np.random.default_rng(0).lognormal(0, 4, 500)]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(half_float(F.col("x"))).collect()]
    with np.errstate(over="ignore"):
        assert got == [float(np.float16(x)) for x in xs]


def test_scales_are_inverse_and_degenerate_ones_are_null(spark):
    from pyspark.sql import functions as F

    s = Scale.hybrid(rows=128, dn_rows=20, core_rows=64, core_p0=84.0, core_step=0.5, lo_price=40.0, hi_price=250.0)
    rows = spark.range(-30, 160).select(F.col("id").cast("double").alias("r"))
    back = rows.select("r", s.price_to_row(s.row_to_price(F.col("r"))).alias("b")).collect()
    assert max(abs(x["r"] - x["b"]) for x in back) < 1e-9
    one = spark.range(1)
    assert one.select(s.price_to_row(F.lit(-1.0)).alias("x")).first()["x"] != one.select(F.lit(0.0).alias("x")).first()["x"]
    assert one.select(make_hybrid(F.lit(float("nan")), 128, 64, 0.5, 3.0, 0.1).alias("x")).first()["x"] is None
    frame = one.select(band_frame(F.lit(100.0), 0.5, 0.5, 0.5, 128).alias("x")).first()["x"]
    assert frame["p0"] <= 50 and frame["p0"] + 128 * 0.5 * frame["tick_multiple"] >= 150


def test_exact_columns_at_the_last_nanosecond(spark):
    t = 1_704_067_200_000_000_000
    trades = spark.createDataFrame([("a", 1, t - 1, 1.0, 1.0, 0), ("a", 2, t, 2.0, 1.0, 0)], "stream string, seq long, ts_ns long, price double, size double, side int")
    assert sorted(r["col_idx"] for r in bars.trade_bars(trades, NS).collect()) == [t // NS - 1, t // NS]


def test_exchange_records(spark):
    schema = "stream string, seq long, kind string, source_ts long, local_ts long, bids array<struct<price:double,amount:double>>, asks array<struct<price:double,amount:double>>, price double, amount double, side string, id string"
    rows = [
        ("a", 1, "BookSnapshot", None, 10, [(1.0, 2.0)], [(2.0, 1.0)], None, None, None, None), ("a", 2, "BookDelta", 11, 12, [(1.0, 0.0)], [], None, None, None, None),
        ("a", 3, "Trade", 13, 14, None, None, 1.5, 2.0, "buy", "x"), ("a", 4, "Trade", 13, 14, None, None, 1.5, 2.0, None, ""),
        ("a", 5, "BookSnapshot", 15, 16, None, None, None, None, None, None), ("a", 6, "Liquidation", 17, 18, None, None, 1.0, 1.0, "sell", None),
        ("a", 7, "BookTicker", 19, 19, [(1.0, 1.0)], [(2.0, 1.0)], None, None, None, None), ("a", 8, "BookTicker", 19, 19, [(-1.0, 1.0)], [(2.0, 1.0)], None, None, None, None),
    ]
    records = spark.createDataFrame(rows, schema)
    assert sorted((r["seq"], r["ts_ns"], r["side"]) for r in ingest.levels(records).collect() if r["side"] is not None) == [(1, 10, 0), (1, 10, 1), (2, 11, 0)]
    assert [(r["side"], r["side_src"]) for r in ingest.trades(records).orderBy("seq").collect()] == [(0, 0), (2, 2)]
    assert sorted((r["seq"], r["kind"]) for r in ingest.markers(records).collect()) == [(5, "gap"), (6, "liquidation")]
    assert ingest.markers(records, polled=True).count() == 1 and ingest.tickers(records).count() == 1
