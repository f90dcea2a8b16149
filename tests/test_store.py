"""The recorded store in a temporary folder: batches tried again, restarts, retention."""

from pyspark.sql import functions as F

from tidegrid.operators import ladder
from tidegrid.sources import store

HOUR = 3_600_000_000_000
T0 = 1_704_067_200_000_000_000
KEY = {"market": "x-spot", "symbol": "A/B", "band": "native"}


def keyed(df):
    return df.withColumns({k: F.lit(v) for k, v in KEY.items()})


def bars(spark, lo, hi, stream="s", epoch=0):
    rows = [(stream, epoch, i, T0 + i * HOUR // 4, float(i)) for i in range(lo, hi)]
    return keyed(spark.createDataFrame(rows, "stream string, epoch int, col_seq long, t0_ns long, c double"))


def test_a_batch_that_is_tried_again_is_stored_once(spark, tmp_path):
    each = store.sink(str(tmp_path), "bars")
    each(bars(spark, 0, 6), 0)
    each(bars(spark, 6, 9), 1)
    each(bars(spark, 6, 9), 1)
    each(bars(spark, 0, 6), 0)
    got = store.read(spark, str(tmp_path), "bars").collect()
    assert sorted((r["batch"], r["col_seq"]) for r in got) == [(0, i) for i in range(6)] + [(1, i) for i in range(6, 9)]
    assert {(r["market"], r["symbol"]) for r in got} == {("x-spot", "A_B")}


def test_hours_are_read_by_folder(spark, tmp_path):
    store.write(bars(spark, 0, 40), str(tmp_path), "bars", 0)
    rows = store.read(spark, str(tmp_path), "bars")
    inside = store.in_hours(rows, "bars", T0 + HOUR, T0 + 2 * HOUR)
    assert sorted(r["col_seq"] for r in inside.collect()) == [4, 5, 6, 7]
    assert "PartitionFilters: [isnotnull(hour" in inside._jdf.queryExecution().toString()


def test_a_restart_gets_the_newest_columns_with_their_epochs(spark, tmp_path):
    base = str(tmp_path)
    store.write(bars(spark, 0, 8), base, "bars", 0)
    store.write(bars(spark, 6, 12), base, "bars", 1)
    epochs = keyed(spark.createDataFrame([("s", 0, HOUR // 4, 0.5, 70.0, 64, 1)], "stream string, epoch int, dt_ns long, tick double, p0 double, rows int, tick_multiple int"))
    store.write(epochs, base, "epochs", 0)
    trades = keyed(spark.createDataFrame([("s", i, T0 + i * HOUR, 1.0, 1.0, 0) for i in range(4)], "stream string, seq long, ts_ns long, price double, size double, side int"))
    store.write(trades, base, "trades", 0)
    out = store.tail(spark, base, "x-spot", "A_B", "native", T0 + 3 * HOUR, 10 * HOUR, 5)
    assert sorted((r["col_seq"], r["batch"]) for r in out["bars"].collect()) == [(i, 1) for i in range(7, 12)]
    assert [r["seq"] for r in out["trades"].collect()] == [2]
    assert out["epochs"].count() == 1 and out["markers"].count() == 0


def test_retention_takes_the_oldest_files_first(spark, tmp_path):
    files = [("m", "a", "columns", f"20240101-{h:02}-p{i}", 10) for h in range(4) for i in range(2)] + [("m", "a", "epochs", "all-p", 10), ("m", "b", "columns", "20240101-00-q", 10)]
    df = spark.createDataFrame(files, "market string, symbol string, kind string, name string, size long")
    gone = sorted(r["name"] for r in ladder.retained(df, 65).collect())
    order, total, want = sorted(files, key=lambda f: (f[3], f[0], f[1])), 100, []
    before = 0
    for m, s, kind, name, size in order:
        newest = max(f[3] for f in files if (f[0], f[1], f[2]) == (m, s, kind))
        if total - before > 65 and kind != "epochs" and not (kind == "columns" and name == newest):
            want.append(name)
        before += size
    assert gone == sorted(want) and gone
    assert ladder.retained(df, 1000).count() == 0 == ladder.retained(df.limit(0), 0).count()
