"""Books to the density grid: level intervals, time-weighted cells, pyramids, extents and inside quotes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegrid.functions.ints import floor_div
from tidegrid.functions.scale import Scale, bin_row, finite, half_float
from tidegrid.operators.running import running


def clamp_time(updates: DataFrame) -> DataFrame:
    """Adds ``eff_ns``: late timestamps count as the latest one so far."""
    return running(updates, ("seq",), {"eff_ns": ("max", F.col("ts_ns"))}, peers=True)


def level_intervals(updates: DataFrame, carried: str | None = None) -> DataFrame:
    """(stream, seq, side, price, size, from_ns, till_ns) while each level stands; open ends are null.

    ``updates`` are (stream, seq, ts_ns, side, price, amount, is_snapshot): an amount sets its level, 0 removes it,
    a snapshot row first empties the book, and what comes before the first snapshot is ignored. Malformed
    levels are dropped. Rows of one ``seq`` belong together. A level ends with its next update or with the next
    snapshot, so no book is ever put together, and only the updates between two snapshots meet, level by level.

    ``carried`` names a column of ``updates`` whose largest value so far is given at both ends, as ``carried_from``
    and ``carried_till``.
    """
    snap = F.when(F.col("is_snapshot"), F.col("seq"))
    values = {"eff_ns": ("max", F.col("ts_ns")), "_snap": ("max", snap)} | ({"_carried": ("max", F.col(carried))} if carried else {})
    timed = running(updates, ("seq",), values, peers=True).where("_snap IS NOT NULL").withColumn("_now", F.struct("eff_ns", *(["_carried"] if carried else [])))
    snapshots = timed.where("seq = _snap").groupBy("stream", "_snap").agg(F.max("_now").alias("_at"))
    ends = snapshots.select("stream", "_snap", F.lead("_at").over(Window.partitionBy("stream").orderBy("_snap")).alias("_end"))
    sound = timed.where(finite(F.col("price")) & finite(F.col("amount")) & (F.col("price") > 0) & (F.col("amount") >= 0))
    level = Window.partitionBy("stream", "_snap", "side", "price").orderBy("seq")
    spans = sound.withColumn("_follow", F.lead("_now").over(level)).where("amount > 0").join(ends, ["stream", "_snap"]).withColumn("_till", F.coalesce("_follow", "_end"))
    more = [F.col("_carried").alias("carried_from"), F.col("_till._carried").alias("carried_till")] if carried else []
    return spans.select("stream", "seq", "side", "price", F.col("amount").alias("size"), F.col("eff_ns").alias("from_ns"), F.col("_till.eff_ns").alias("till_ns"), *more)


def close_open(intervals: DataFrame, updates: DataFrame) -> DataFrame:
    """Intervals with open ends closed at the stream's last time."""
    last = updates.groupBy("stream").agg(F.max("ts_ns").alias("_last"))
    return intervals.join(last, "stream").withColumn("till_ns", F.coalesce("till_ns", "_last")).drop("_last")


def density(intervals: DataFrame, scale: Scale, dt_ns: int, as_half: bool = False) -> DataFrame:
    """(stream, col_idx, row, bid, ask): size times the share of the column during which it stood.

    Each interval is spread over its own columns by generated keys; there is no range join.
    """
    row = bin_row(scale, F.col("price"))
    spans = intervals.where("till_ns > from_ns").withColumn("row", row).where("row IS NOT NULL")
    first, last = floor_div(F.col("from_ns"), dt_ns), floor_div(F.col("till_ns") - 1, dt_ns)
    cut = spans.withColumn("col_idx", F.explode(F.sequence(first, last)))
    start = F.col("col_idx") * dt_ns
    overlap = F.least(F.col("till_ns"), start + dt_ns) - F.greatest(F.col("from_ns"), start)
    share = F.col("size") * overlap / F.lit(float(dt_ns))
    side = lambda s: F.sum(F.when(F.col("side") == s, share).otherwise(0.0))
    out = cut.groupBy("stream", "col_idx", "row").agg(side(0).alias("bid"), side(1).alias("ask"))
    return out.withColumns({c: half_float(F.col(c)) for c in ("bid", "ask")}) if as_half else out


def gap_capped(cells: DataFrame, col: str, jumps: DataFrame, ring: int) -> DataFrame:
    """Cells without the columns that a capped jump leaves out.

    ``jumps`` are (stream, k_prev, k_next) of successive books more than ring+1 columns apart: only the column
    the jump leaves and the last ``ring`` before the one it reaches exist.
    """
    dropped = jumps.where(F.col("k_next") - F.col("k_prev") > ring + 1).select("stream", F.explode(F.sequence(F.col("k_prev") + 1, F.col("k_next") - ring - 1)).alias(col))
    return cells.join(dropped, ["stream", col], "left_anti")


def whole_blocks(cells: DataFrame, last: DataFrame, factor: int = 4) -> DataFrame:
    """Cells of blocks of ``factor`` columns that are finished whole; ``last`` is (stream, last_col) of the last finished column."""
    ended = (floor_div(F.col("col_idx"), factor) + 1) * factor <= F.col("last_col") + 1
    return cells.join(last.select("stream", "last_col"), "stream").where(ended).drop("last_col")


def pyramid(cells: DataFrame, factor: int = 4, most: float = 60_000.0, last: DataFrame | None = None) -> DataFrame:
    """Sums of blocks of ``factor`` columns and rows, at most ``most``; with ``last``, of ``whole_blocks`` only."""
    col, row = (floor_div(F.col(c), factor).cast(t).alias(c) for c, t in (("col_idx", "long"), ("row", "int")))
    capped = lambda c: F.least(F.sum(c), F.lit(most)).alias(c)
    return (cells if last is None else whole_blocks(cells, last, factor)).groupBy("stream", col, row).agg(capped("bid"), capped("ask"))


def coarser(last: DataFrame, factor: int = 4) -> DataFrame:
    """``last`` of the level above: the last whole block."""
    return last.select("stream", (floor_div(F.col("last_col") + 1, factor) - 1).alias("last_col"))


def extent(cells: DataFrame) -> DataFrame:
    """(stream, col_idx, lo, hi, bid_top, ask_bot, tracked) of each column: its rows with size, and the middle followed."""
    on = lambda c: F.when(F.col(c) > 0, F.col("row"))
    any_side = F.when((F.col("bid") > 0) | (F.col("ask") > 0), F.col("row"))
    out = cells.groupBy("stream", "col_idx").agg(F.min(any_side).alias("lo"), F.max(any_side).alias("hi"), F.max(on("bid")).alias("bid_top"), F.min(on("ask")).alias("ask_bot"))
    tracked = F.when(F.col("ask_bot") > F.col("bid_top"), (F.col("bid_top") + F.col("ask_bot") + 1) / 2).otherwise((F.col("lo") + F.col("hi") + 1) / 2)
    return out.withColumn("tracked", tracked)


def price_frame(extents: DataFrame, rows: int, pad: float, least_pad: int) -> DataFrame:
    """(stream, row_bottom, row_span) that show all rows with size of the given columns, with padding."""
    lo, hi = F.min("lo"), F.max("hi")
    out = extents.groupBy("stream").agg(lo.alias("lo"), hi.alias("hi"))
    by = F.greatest(F.lit(least_pad), F.round((F.col("hi") - F.col("lo")) * pad)).cast("int")
    bottom, top = F.greatest(F.lit(0), F.col("lo") - by), F.least(F.lit(rows), F.col("hi") + by + 1)
    return out.select("stream", bottom.alias("row_bottom"), F.greatest(F.lit(1), top - bottom).alias("row_span"))


def inside_quote(cells: DataFrame, scale: Scale) -> DataFrame:
    """(stream, col_idx, bid_row, bid_px, bid_sz, ask_row, ask_px, ask_sz) of each column: its highest bid and lowest ask."""
    bid, ask = (F.when(F.col(c) > 0, F.struct("row", F.col(c).alias("size"))) for c in ("bid", "ask"))
    out = cells.groupBy("stream", "col_idx").agg(F.max(bid).alias("b"), F.min(ask).alias("a"))
    return out.select("stream", "col_idx", *(F.expr(f"{x}.row").alias(f"{n}_row") for x, n in (("b", "bid"), ("a", "ask"))),
                      scale.row_to_price(F.col("b.row")).alias("bid_px"), F.col("b.size").alias("bid_sz"), scale.row_to_price(F.col("a.row")).alias("ask_px"), F.col("a.size").alias("ask_sz"))


def profile(cells: DataFrame, col_lo: int, col_hi: int, row_lo: int, row_hi: int, width: Scale | None = None, most_columns: int = 1024) -> DataFrame:
    """(stream, row, value, is_poc): resting size by row over a window of at most ``most_columns`` newest columns.

    On a hybrid grid pass the scale as ``width``, so that values are per unit of price. The point of control is
    the row with the most, the lowest of equals.
    """
    inside = cells.where(F.col("col_idx").between(max(col_lo, col_hi - most_columns + 1), col_hi) & F.col("row").between(row_lo, row_hi))
    return _profile(inside, width)


def newest_profile(cells: DataFrame, columns: int, row_lo: int, row_hi: int, width: Scale | None = None) -> DataFrame:
    """``profile`` over the newest ``columns`` columns of all streams together."""
    newest = cells.agg(F.max("col_idx").alias("_newest"))  # one row
    inside = cells.join(F.broadcast(newest), F.col("col_idx") > F.col("_newest") - columns)
    return _profile(inside.where(F.col("row").between(row_lo, row_hi)), width)


def _profile(inside: DataFrame, width: Scale | None) -> DataFrame:
    value = F.sum(F.col("bid") + F.col("ask"))
    out = inside.groupBy("stream", "row").agg(value.alias("value"))
    if width is not None:
        out = out.withColumn("value", F.col("value") / width.step_at_row(F.col("row").cast("double")))
    first = F.row_number().over(Window.partitionBy("stream").orderBy(F.desc("value"), "row"))
    return out.withColumn("is_poc", first == 1)


def cell_size(cells: DataFrame, row_start: int, group_rows: int) -> DataFrame:
    """(stream, col_idx, size) of a block of rows."""
    return cells.where(F.col("row").between(row_start, row_start + group_rows - 1)).groupBy("stream", "col_idx").agg(F.sum(F.col("bid") + F.col("ask")).alias("size"))


def probe(points: DataFrame, cells: DataFrame, epochs: DataFrame, group_rows: int = 1) -> DataFrame:
    """``points`` (stream, col_idx, row) with the exact size, epoch and price of the block of rows that each lies in.

    Blocks of ``group_rows`` rows start at multiples of it. ``cells`` have an epoch, and ``epochs`` its scale; where
    nothing rests the size is 0 and the epoch null.
    """
    block = lambda c: (floor_div(F.col(c), group_rows) * group_rows).cast("int")
    sizes = cells.groupBy("stream", "col_idx", block("row").alias("block")).agg(F.sum("bid").alias("bid"), F.sum("ask").alias("ask"), F.max("epoch").alias("epoch"))
    found = points.withColumn("block", block("row")).join(sizes, ["stream", "col_idx", "block"], "left")
    scaled = found.join(epochs.select("stream", "epoch", F.struct(*(c for c in epochs.columns if c not in ("stream", "epoch"))).alias("_e")), ["stream", "epoch"], "left")
    price = Scale.of("_e.").row_to_price(F.col("row").cast("double"))
    return scaled.select(*points.columns, F.coalesce("bid", F.lit(0.0)).alias("bid"), F.coalesce("ask", F.lit(0.0)).alias("ask"), "epoch", price.alias("price"))
