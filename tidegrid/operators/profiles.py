"""Depth made of bars where no book is known: volume at price, and columns rebuilt from candles. Both are flagged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegrid.functions.ints import floor_div
from tidegrid.functions.scale import finite, half_float
from tidegrid.operators.bars import as_of

PEAK = 1000.0


def sound_bars(bars: DataFrame) -> DataFrame:
    """Bars of finite prices and a finite volume that is not negative."""
    good = finite(F.col("volume")) & (F.col("volume") >= 0)
    for c in "ohlc":
        good &= finite(F.col(c))
    return bars.where(good)


def typical_price():
    return (F.col("h") + F.col("l") + F.col("c")) / 3


def volume_at_price(bars: DataFrame, tick: float = 0.01) -> DataFrame:
    """(stream, px, size, side): whole volumes at typical prices, the peak scaled to 1000, split at the last close."""
    sound = sound_bars(bars).where(typical_price() > 0)
    ref = sound.groupBy("stream").agg(F.max_by("c", "t0_ns").alias("ref"))
    buckets = sound.groupBy("stream", F.rint(typical_price() / tick).cast("long").alias("bucket")).agg(F.sum("volume").alias("volume"))
    peaks = buckets.groupBy("stream").agg(F.max("volume").alias("peak"))
    px, peak = F.col("bucket") * tick, F.col("peak")
    out = buckets.join(ref.join(peaks, "stream"), "stream").withColumn("size", F.when(peak > 0, F.col("volume") * (PEAK / peak)).otherwise(F.col("volume")))
    return out.select("stream", px.alias("px"), "size", F.when(px <= F.col("ref"), 0).otherwise(1).alias("side"))


def running_profile(bars: DataFrame, tick: float = 0.01) -> DataFrame:
    """(stream, t0_ns, bucket, volume): the profile as it stood after each bar that changed a bucket."""
    sound = sound_bars(bars).where(typical_price() > 0).withColumn("bucket", F.rint(typical_price() / tick).cast("long"))
    return sound.select("stream", "t0_ns", "bucket", F.sum("volume").over(Window.partitionBy("stream", "bucket").orderBy("t0_ns").rowsBetween(Window.unboundedPreceding, 0)).alias("volume"))


def sided_profile(bars: DataFrame, prices: DataFrame, tick: float = 0.01, span_ns: int = 86_400_000_000_000) -> DataFrame:
    """``running_profile`` with ``side`` as of each time: buckets up to the reference price are bids, the others asks.

    The reference is the last of ``prices`` (stream, ts_ns, px) by the bar's time, before any its own close. Bars with
    no bucket of their own still move it. ``span_ns`` is the time that one task orders.
    """
    closes = sound_bars(bars).where(typical_price() > 0).select("stream", F.col("t0_ns").alias("ts_ns"), "c")
    known = as_of(closes, prices.where(finite(F.col("px")) & (F.col("px") > 0)), ["px"], ("ts_ns",), span=span_ns)
    refs = known.groupBy("stream", F.col("ts_ns").alias("t0_ns")).agg(F.max(F.coalesce("px", "c")).alias("ref"))
    out = running_profile(bars, tick).join(refs, ["stream", "t0_ns"])
    return out.withColumn("side", F.when(F.col("bucket") * tick <= F.col("ref"), 0).otherwise(1))


def _on_grid(candles: DataFrame, dt_ns: int) -> DataFrame:
    """Sound candles with ``t0`` on the grid and strictly rising, and their number ``n`` from 0."""
    order = Window.partitionBy("stream").orderBy("t0_ns")
    sound = sound_bars(candles).where("c > 0").withColumn("n", F.row_number().over(order) - 1)
    base = floor_div(F.col("t0_ns"), dt_ns) * dt_ns - F.col("n") * dt_ns
    return sound.withColumn("t0", F.max(base).over(order.rowsBetween(Window.unboundedPreceding, 0)) + F.col("n") * dt_ns)


def columns_from_candles(candles: DataFrame, tick: float, rows: int, dt_ns: int) -> DataFrame:
    """(stream, col_seq, t0_ns, row, bid, ask, provenance): each volume spread evenly over its rows from low to high.

    Rows up to the close are bids; one factor brings the largest cell of a stream to 1000. The frame is centred
    on the last close.
    """
    on_grid = _on_grid(candles, dt_ns)
    span = rows * tick
    last = on_grid.groupBy("stream").agg((F.rint((F.max_by("c", "n") - span / 2) / tick) * tick).alias("p0"))
    framed = on_grid.join(last, "stream")
    row_of = lambda px: F.rint((px - F.col("p0")) / tick).cast("long")
    low, high = row_of(F.least("l", "h")), row_of(F.greatest("l", "h"))
    inside = F.sequence(F.greatest(low, F.lit(0)), F.least(high, F.lit(rows - 1)))
    some = F.greatest(low, F.lit(0)) <= F.least(high, F.lit(rows - 1))
    spread = framed.where(some).withColumn("cells", inside).select("stream", F.col("n").alias("col_seq"), F.col("t0").alias("t0_ns"), row_of(F.col("c")).alias("close_row"), (F.col("volume") / F.size("cells")).alias("per"), "cells")
    peaks = spread.groupBy("stream").agg(F.max("per").alias("peak"))
    cells = spread.join(peaks, "stream").withColumn("row", F.explode("cells"))
    peak = F.col("peak")
    size = half_float(F.when(peak > 0, F.col("per") * (PEAK / peak)).otherwise(F.col("per")))
    at = F.col("row") <= F.col("close_row")
    return cells.select("stream", "col_seq", "t0_ns", F.col("row").cast("int").alias("row"), F.when(at, size).otherwise(0.0).alias("bid"), F.when(~at, size).otherwise(0.0).alias("ask"), F.lit("reconstructed").alias("provenance"))


def bars_from_candles(candles: DataFrame, dt_ns: int) -> DataFrame:
    """Bars of the same columns: CVD from taker volumes only where both are known, VWAP from typical prices."""
    on_grid = _on_grid(candles, dt_ns)
    so_far = Window.partitionBy("stream").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    split = F.lit(False)
    if {"buy_volume", "sell_volume"} <= set(candles.columns):
        split = finite(F.col("buy_volume")) & finite(F.col("sell_volume"))
    buy, sell = (F.when(split, F.col(c)).otherwise(0.0) if c in candles.columns else F.lit(0.0) for c in ("buy_volume", "sell_volume"))
    return on_grid.select(
        "stream", F.col("n").alias("col_seq"), F.col("t0").alias("t0_ns"), "o", "h", "l", "c", buy.alias("vol_buy"), sell.alias("vol_sell"),
        F.sum(buy - sell).over(so_far).alias("cvd_cum"), F.sum(typical_price() * F.col("volume")).over(so_far).alias("vwap_num_cum"), F.sum("volume").over(so_far).alias("vwap_den_cum"),
    )


def latest_session(bars: DataFrame, zone: str = "America/New_York") -> DataFrame:
    """Bars of the most recent session date in the zone, per stream."""
    date = F.to_date(F.convert_timezone(F.current_timezone(), F.lit(zone), F.timestamp_micros(floor_div(F.col("t0_ns"), 1000)).cast("timestamp_ntz")))
    dated = bars.withColumn("session", date)
    newest = dated.groupBy("stream").agg(F.max("session").alias("session"))
    return dated.join(newest, ["stream", "session"], "left_semi").select(*bars.columns, "session")
