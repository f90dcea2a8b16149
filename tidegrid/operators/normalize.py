"""Normalisation of density: seeds, log histograms, percentiles from them, and the display curve."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegrid.functions.ints import floor_div
from tidegrid.operators.running import running

BINS, LOW, HIGH = 256, 1 / 64, 65_536.0
TILE_COLUMNS = 256
_SCALE = BINS / (math.log(HIGH) - math.log(LOW))
#: The display curve.
GAMMA_LOW, GAMMA_SPAN = 0.28, 0.44
MOST_FLOOR, FLOOR_CURVE = 0.85, 1.4


def norm_seed(cells: DataFrame, last: int = 64, quantile: float = 0.99) -> DataFrame:
    """(stream, seed): percentile of the nonzero density of the last columns; 1 without any."""
    newest = cells.groupBy("stream").agg(F.max("col_idx").alias("_new"))
    values = cells.join(newest, "stream").where(F.col("col_idx") > F.col("_new") - last).select("stream", F.explode(F.array("bid", "ask")).alias("v")).where("v > 0")
    seeds = values.groupBy("stream").agg(F.percentile("v", quantile).alias("seed"))
    return newest.select("stream").join(seeds, "stream", "left").select("stream", F.coalesce("seed", F.lit(1.0)).alias("seed"))


def bin_of(v: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor((F.log(v) - math.log(LOW)) * _SCALE))).cast("int")


def log_histogram(cells: DataFrame, tile_columns: int = TILE_COLUMNS) -> DataFrame:
    """(stream, tile, bin, n) of the nonzero density of both sides."""
    values = cells.select("stream", floor_div(F.col("col_idx"), tile_columns).alias("tile"), F.explode(F.array("bid", "ask")).alias("v")).where("v > 0")
    return values.groupBy("stream", "tile", bin_of(F.col("v")).alias("bin")).agg(F.count("*").alias("n"))


def viewport_percentile(histogram: DataFrame, tile_lo: int, tile_hi: int, percent: float = 99.0, floor: float = 4.0, level_scale: float = 1.0) -> DataFrame:
    """(stream, value): percentile of the merged tiles, logarithmic within its bin, ``floor`` at least."""
    merged = histogram.where(F.col("tile").between(tile_lo, tile_hi)).groupBy("stream", "bin").agg(F.sum("n").alias("n"))
    all_bins, up_to = Window.partitionBy("stream"), Window.partitionBy("stream").orderBy("bin")
    counted = merged.withColumn("rank", F.sum("n").over(all_bins) * (percent / 100)).withColumn("cum", F.sum("n").over(up_to))
    hit = counted.where("cum >= rank").groupBy("stream").agg(F.min(F.struct("bin", "n", "cum", "rank")).alias("x"))
    inside = (F.col("x.rank") - (F.col("x.cum") - F.col("x.n"))) / F.col("x.n")
    value = F.exp(F.lit(math.log(LOW)) + (F.col("x.bin") + inside) / _SCALE)
    return hit.select("stream", (F.greatest(value, F.lit(floor)) * level_scale).alias("value"))


def smoothed(series: DataFrame, value: str, order: str, alpha: float = 0.15, floor: float = 4.0) -> DataFrame:
    """Adds ``ema``: exponential smoothing in order, seeded by the first value, ``floor`` at least; per stream.

    A null value leaves the average as it is. The average of n values is a sum with powers of 1 - alpha as weights, so
    it is made of sums over stretches of values in which these powers stay within doubles, and of what the two
    stretches before carry on: what lies farther back weighs less than the last bit. No rows are listed, and time is
    linear in them.
    """
    keep = 1.0 - alpha
    stretch = int(min(1 << 16, max(1, -69 / math.log(keep)))) if keep > 0 else 1  # keep ** stretch is about 1e-30
    counted = running(series, (order,), {"_k": ("sum", F.when(F.col(value).isNotNull(), 1))}).withColumn("_k", F.col("_k") - 1)
    placed = counted.withColumn("_part", floor_div(F.col("_k"), stretch)).withColumn("_place", F.pmod(F.col("_k"), F.lit(stretch)))
    weight = F.when(F.col("_k") == 0, 1.0).otherwise(alpha)
    placed = placed.withColumn("_term", F.col(value) * weight * F.pow(F.lit(keep), -F.col("_place")))
    ends = placed.where("_k >= 0").groupBy("stream", "_part").agg((F.sum("_term") * keep ** (stretch - 1)).alias("_end"))
    by_part = Window.partitionBy("stream").orderBy("_part")  # one row for a stretch of values
    before = F.coalesce(F.lag("_end").over(by_part), F.lit(0.0)) + F.coalesce(F.lag("_end", 2).over(by_part), F.lit(0.0)) * keep**stretch
    carried = ends.select("stream", "_part", before.alias("_carried"))
    so_far = Window.partitionBy("stream", "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    joined = placed.join(carried, ["stream", "_part"], "left")
    ema = F.pow(F.lit(keep), F.col("_place")) * (F.sum("_term").over(so_far) + F.col("_carried") * keep)
    return joined.withColumn("ema", F.when(F.col("_k") >= 0, F.greatest(ema, F.lit(floor)))).select(*series.columns, "ema")


def gamma_for_contrast(contrast: Column) -> Column:
    return GAMMA_LOW + F.greatest(F.lit(0.0), F.least(F.lit(100.0), contrast)) / 100 * GAMMA_SPAN


def floor_for_tolerance(tolerance: Column) -> Column:
    bounded = F.greatest(F.lit(0.0), F.least(F.lit(100.0), tolerance)) / 100
    return F.when(tolerance.isNull() | F.isnan(tolerance) | (F.abs(tolerance) == float("inf")), 0.0).otherwise(MOST_FLOOR * F.pow(bounded, F.lit(FLOOR_CURVE)))


def lut_index(intensity: Column, norm: Column, black: Column, gamma: Column) -> Column:
    """Colour index 0..255: normalised, cut at the black point, then the display curve."""
    unit = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    t = unit(intensity / F.greatest(norm, F.lit(1e-9)))
    t = unit((t - black) / (1 - black))
    return F.floor(F.pow(t, gamma) * 255 + 0.5).cast("int")


def level_of_detail(rows_per_pixel: Column, most_level: int) -> Column:
    """Struct (level, blk, taps): the coarsest pyramid level whose block fits a pixel, and the finer taps left over."""
    level = F.greatest(F.lit(0), F.least(F.lit(most_level), F.floor(F.log(rows_per_pixel) / F.log(F.lit(4.0))))).cast("int")
    block = F.pow(F.lit(4.0), level).cast("int")
    taps = F.greatest(F.lit(1), F.least(F.lit(4), F.floor(rows_per_pixel / block + 0.5))).cast("int")
    plain = F.struct(F.lit(0).alias("level"), F.lit(1).alias("blk"), F.lit(1).alias("taps"))
    return F.when((rows_per_pixel <= 1) | F.lit(most_level <= 0), plain).otherwise(F.struct(level.alias("level"), block.alias("blk"), taps.alias("taps")))


def ramp(stops: list[tuple[float, int, int, int]], size: int = 256) -> Column:
    """Array of (r, g, b) structs: a colour ramp interpolated between its stops."""
    at = lambda i: i / F.lit(float(size - 1))

    def colour(i: Column) -> Column:
        t, found = at(i), None
        for (a, *low), (b, *high) in zip(stops, stops[1:]):
            parts = [F.floor(x + (y - x) * (t - a) / (b - a) + 0.5).cast("int").alias(n) for x, y, n in zip(low, high, "rgb")]
            found = F.when(t <= b, F.struct(*parts)) if found is None else found.when(t <= b, F.struct(*parts))
        return found

    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), colour)
