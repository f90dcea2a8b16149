"""What a client shows: extents and windows of columns, series, strips, spark lines, attach snapshots, admission."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegrid.functions.scale import finite
from tidegrid.operators import ladder

#: Widths of a column and of a window in a view, columns kept, and sizes of an attach snapshot.
COLUMN_PX, LEAST_VISIBLE, MOST_VISIBLE = 3, 32, 512
RING_COLUMNS = 32_768
SNAPSHOT_COLUMNS, SNAPSHOT_TRADES = 512, 500
STRIP_PAD = 0.08


def cvd_bounds(points: DataFrame) -> DataFrame:
    """(stream, lo, hi): bounds of a CVD strip: 0 and every finite value with 8 % around, or -1 to 1 if all are 0."""
    value = F.when(finite(F.col("cvd")), F.col("cvd"))
    out = points.groupBy("stream").agg(F.least(F.min(value), F.lit(0.0)).alias("a"), F.greatest(F.max(value), F.lit(0.0)).alias("b"))
    pad, flat = (F.col("b") - F.col("a")) * STRIP_PAD, (F.col("a") == 0) & (F.col("b") == 0)
    return out.select("stream", F.when(flat, -1.0).otherwise(F.col("a") - pad).alias("lo"), F.when(flat, 1.0).otherwise(F.col("b") + pad).alias("hi"))


def strip_y(value: Column, lo: Column, hi: Column, height: float, pad: float = 4.0) -> Column:
    """Distance from the top of a strip; larger values are higher."""
    span = F.when(hi - lo == 0, 1.0).otherwise(hi - lo)
    return pad + (1 - (value - lo) / span) * max(1.0, height - 2 * pad)


def strip_x(col: Column, start: Column, end: Column, width: float) -> Column:
    """Place of a column's centre in a view of columns start..end."""
    return (col + 0.5 - start) / F.when(end - start == 0, 1).otherwise(end - start) * width


def spark_path(values: Column, width: float, height: float, pad: float = 1.0) -> Column:
    """Drawing commands of a spark line over an array of numbers; empty without a finite one."""
    sound = F.filter(values, finite)
    lo, span = F.array_min(sound), F.array_max(sound) - F.array_min(sound)
    step = F.when(F.size(values) > 1, max(1.0, width - 2 * pad) / (F.size(values) - 1)).otherwise(0.0)
    y = lambda v: pad + (1 - (v - lo) / F.when(span == 0, 1.0).otherwise(span)) * max(1.0, height - 2 * pad)
    point = lambda v, i: F.concat(F.when(i == 0, "M").otherwise("L"), F.format_string("%.1f %.1f", pad + i * step, y(v)))
    return F.when(F.size(sound) > 0, F.array_join(F.transform(values, point), "")).otherwise("")


def spark_direction(values: Column) -> Column:
    """1, -1 or 0: whether the last of an array is over, under or at the first; 0 for fewer than two."""
    first, last = F.try_element_at(values, F.lit(1)), F.try_element_at(values, F.lit(-1))
    sound = (F.size(values) > 1) & finite(first) & finite(last)
    return F.when(sound, F.signum(last - first)).otherwise(0).cast("int")


def session_extent(columns: DataFrame) -> DataFrame:
    """(stream, oldest, newest, n) of the columns there are."""
    return columns.groupBy("stream").agg(F.min("col_seq").alias("oldest"), F.max("col_seq").alias("newest"), F.count("*").alias("n"))


def minimap(extents: DataFrame, start: Column, end: Column, dt_ns: int) -> DataFrame:
    """``extents`` with left_pct and right_pct of a view start..end, and how far it trails the newest column."""
    span = F.greatest(F.lit(1), F.col("newest") - F.col("oldest"))
    pct = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), (c - F.col("oldest")) / span)) * 100
    behind = F.greatest(F.lit(0), F.col("newest") + 1 - end)
    return extents.withColumns({"left_pct": pct(start), "right_pct": pct(end), "behind_cols": behind, "behind_ns": F.floor(behind * dt_ns + 0.5).cast("long")})


def default_window(extents: DataFrame, width_px: float, column_px: float = COLUMN_PX, most: int = MOST_VISIBLE, ring: int = RING_COLUMNS) -> DataFrame:
    """(stream, first, visible): the newest columns that fill a width, as many as there are at most."""
    fits = max(LEAST_VISIBLE, min(most, int(max(1.0, width_px) / column_px + 0.5)))
    visible = F.least(F.lit(fits), F.lit(ring), F.col("n"))
    return extents.select("stream", (F.col("newest") - visible + 1).alias("first"), visible.alias("visible"))


def series(points: DataFrame, value: str, lo: float, hi: float) -> DataFrame:
    """(stream, col_seq, value, place): finite points with lo <= col_seq <= hi, numbered in order from 0."""
    inside = points.where((F.col("col_seq") >= lo) & (F.col("col_seq") <= hi) & finite(F.col(value)))
    place = F.row_number().over(Window.partitionBy("stream").orderBy("col_seq")) - 1  # of the columns in view
    return inside.select("stream", "col_seq", value, place.alias("place"))


def within_ring(columns: DataFrame, ring: int = RING_COLUMNS) -> DataFrame:
    """Columns that a ring of ``ring`` would still hold: those within that many of the newest."""
    newest = columns.groupBy("stream").agg(F.max("col_seq").alias("_newest"))
    return columns.join(newest, "stream").where(F.col("col_seq") > F.col("_newest") - ring).drop("_newest")


def announced(columns: DataFrame, epochs: DataFrame) -> DataFrame:
    """(stream, place, kind, epoch, col_seq): each epoch before the first column that needs it, then its columns.

    Epochs that no column has yet are announced after the columns, as the current one is.
    """
    first = columns.groupBy("stream", "epoch").agg(F.min("col_seq").alias("col_seq"))
    starts = epochs.select("stream", "epoch").distinct().join(first, ["stream", "epoch"], "left").withColumn("kind", F.lit("epoch"))
    both = starts.unionByName(columns.select("stream", "epoch", "col_seq").withColumn("kind", F.lit("column")))
    order = Window.partitionBy("stream").orderBy(F.col("col_seq").asc_nulls_last(), F.col("kind") == "column", "epoch")
    return both.select("stream", F.row_number().over(order).alias("place"), "kind", "epoch", "col_seq")


def admitted(columns: DataFrame, sessions: DataFrame, epochs: DataFrame) -> DataFrame:
    """Columns with ``action``: what a view does with each of them.

    ``columns`` have stream, session, epoch, col_seq, n_rows; ``sessions`` are (stream, session, ring_rows) now on
    view, ring_rows null before the first column; ``epochs`` are (stream, session, epoch, epoch_rows). A column of
    another session without a known epoch, or of other rows than its epoch, is dropped; else it makes a ring,
    remakes one of another height, or is written.
    """
    known = columns.join(epochs, ["stream", "session", "epoch"], "left").join(sessions.select("stream", F.col("session").alias("_now"), "ring_rows"), "stream")
    foreign = ~F.col("session").eqNullSafe(F.col("_now")) & F.col("epoch_rows").isNull()
    rows = F.coalesce("epoch_rows", "n_rows")
    action = F.when(foreign | (F.col("n_rows") != rows), "drop").when(F.col("ring_rows").isNull(), "create").when(F.col("ring_rows") != rows, "rebuild").otherwise("write")
    return known.withColumn("action", action).drop("_now", "epoch_rows", "ring_rows")


def attach_snapshot(columns: DataFrame, epochs: DataFrame, current: DataFrame, markers: DataFrame, trades: DataFrame, quotes: DataFrame, dt_ns: int) -> dict[str, DataFrame]:
    """What a client that joins is sent: the last columns, their epochs and the ``current`` one (stream, epoch), the markers in
    their time, the last trades and the latest quote."""
    last = ladder.newest_of(columns, SNAPSHOT_COLUMNS, ("t0_ns", "col_seq")).drop("rank")
    needed = last.select("stream", "epoch").union(current.select("stream", "epoch")).distinct()
    return {
        "epochs": epochs.join(needed, ["stream", "epoch"], "left_semi"),
        "columns": last,
        "markers": ladder.in_range_of(markers, last, dt_ns),
        "trades": ladder.newest_of(trades, SNAPSHOT_TRADES).drop("rank"),
        "quote": ladder.newest_of(quotes, 1).drop("rank"),
    }


def seeded(live: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """Live columns and, before the first of each stream, the rebuilt ones; ``provenance`` tells which, and only live ones are recorded."""
    first = live.groupBy("stream").agg(F.min("t0_ns").alias("_first"))
    earlier = rebuilt.join(first, "stream", "left").where(F.col("_first").isNull() | (F.col("t0_ns") < F.col("_first"))).drop("_first")
    return live.withColumn("provenance", F.lit("live")).unionByName(earlier.withColumn("provenance", F.lit("reconstructed")), allowMissingColumns=True)
