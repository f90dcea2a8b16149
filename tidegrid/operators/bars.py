"""Trades to bars: attribution to columns, open-high-low-close, side volumes, cumulative sums, inferred sides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegrid.functions.ints import floor_div
from tidegrid.functions.scale import finite
from tidegrid.operators.running import RANGE, running


def signed_size() -> Column:
    return F.when(F.col("side") == 0, F.col("size")).when(F.col("side") == 1, -F.col("size")).otherwise(0.0)


def trade_bars(trades: DataFrame, dt_ns: int, column: str | None = None) -> DataFrame:
    """One row per stream and column with trades (stream, col_idx, o, h, l, c, vol_buy, vol_sell, delta, num, den).

    ``column`` names the column index of a trade; else it is its own timestamp's.
    """
    col = F.col(column) if column else floor_div(F.col("ts_ns"), dt_ns)
    return trades.groupBy("stream", col.alias("col_idx")).agg(
        F.min_by("price", "seq").alias("o"), F.max("price").alias("h"), F.min("price").alias("l"), F.max_by("price", "seq").alias("c"),
        F.sum(F.when(F.col("side") == 0, F.col("size")).otherwise(0.0)).alias("vol_buy"),
        F.sum(F.when(F.col("side") == 1, F.col("size")).otherwise(0.0)).alias("vol_sell"),
        F.sum(signed_size()).alias("delta"), F.sum(F.col("price") * F.col("size")).alias("num"), F.sum("size").alias("den"),
    )


def complete_columns(bars: DataFrame) -> DataFrame:
    """Every column between the first and the last of each stream; those without trades have null sums."""
    span = bars.groupBy("stream").agg(F.min("col_idx").alias("lo"), F.max("col_idx").alias("hi"))
    grid = span.select("stream", F.explode(F.sequence("lo", "hi")).alias("col_idx"))
    return grid.join(bars, ["stream", "col_idx"], "left")


def cumulate(bars: DataFrame, dt_ns: int) -> DataFrame:
    """Bars with carried closes and session sums (cvd_cum, vwap_num_cum, vwap_den_cum, vwap), numbered from 0 by stream."""
    so_far = Window.partitionBy("stream").orderBy("col_idx").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("stream")
    close = F.last("c", ignorenulls=True).over(so_far)
    num, den = (F.sum(F.coalesce(x, F.lit(0.0))).over(so_far) for x in ("num", "den"))
    return bars.select(
        "stream", (F.col("col_idx") - F.min("col_idx").over(whole)).alias("col_seq"), (F.col("col_idx") * dt_ns).alias("t0_ns"),
        F.coalesce("o", close).alias("o"), F.coalesce("h", close).alias("h"), F.coalesce("l", close).alias("l"), close.alias("c"),
        F.coalesce("vol_buy", F.lit(0.0)).alias("vol_buy"), F.coalesce("vol_sell", F.lit(0.0)).alias("vol_sell"),
        F.sum(F.coalesce("delta", F.lit(0.0))).over(so_far).alias("cvd_cum"), num.alias("vwap_num_cum"), den.alias("vwap_den_cum"),
        F.when(den > 0, num / den).alias("vwap"),
    )


def as_of(left: DataFrame, right: DataFrame, values: list[str], order: tuple[str, ...], key: str = "stream", span: int = RANGE) -> DataFrame:
    """``left`` with the values of the latest row of ``right`` before it; rows of ``right`` come first on ties of ``order[0]``.

    A union and running values over ranges of ``span`` numbers of ``order[0]``: rows are sorted once and never paired.
    For an order in nanoseconds pass the time that one task may order.
    """
    tagged = left.withColumn("_right", F.lit(None).cast(right.select(F.struct(*values)).schema[0].dataType)).withColumn("_rank", F.lit(1))
    source = right.select(*(F.col(c) for c in (key, *order)), F.struct(*values).alias("_right"), F.lit(0).alias("_rank"))
    both = tagged.unionByName(source, allowMissingColumns=True)
    filled = running(both, (order[0], "_rank", *order[1:]), {"_found": ("last", F.col("_right"))}, key, span)
    return filled.where("_rank = 1").select(*left.columns, *(F.col(f"_found.{v}").alias(v) for v in values))


def trade_columns(trades: DataFrame, books: DataFrame, dt_ns: int) -> DataFrame:
    """Column of each trade: that of the latest book before it, as only books move time; before any book, its own."""
    tagged = trades.withColumn("_time", F.lit(None).cast("long")).withColumn("_rank", F.lit(1))
    source = books.select("stream", "seq", F.col("ts_ns").alias("_time"), F.lit(0).alias("_rank"))
    reached = running(tagged.unionByName(source, allowMissingColumns=True), ("seq", "_rank"), {"_eff": ("max", F.col("_time"))}).where("_rank = 1")
    return reached.withColumn("col_idx", floor_div(F.coalesce("_eff", "ts_ns"), dt_ns)).select(*trades.columns, "col_idx")


def _moved(price: Column, before: Column) -> Column:
    return F.when(price > before, 0).when(price < before, 1)


def _assigned(trades: DataFrame, own: Column) -> DataFrame:
    """Trades with the last side of their own that any had so far; the first buys."""
    sided = running(trades.withColumn("_own", own), ("seq",), {"_side": ("last", F.col("_own"))})
    return sided.withColumn("side", F.coalesce("_side", F.lit(0))).withColumn("side_src", F.lit(1)).drop("_own", "_side", "_before")


def tick_rule(trades: DataFrame) -> DataFrame:
    """Trades with ``side`` inferred from the price: up buys, down sells, flat as before, the first buys."""
    priced = running(trades, ("seq",), {"_before": ("last", F.col("price"))}, before=True)
    return _assigned(priced, _moved(F.col("price"), F.col("_before")))


def quote_rule(trades: DataFrame, quotes: DataFrame, former: DataFrame | None = None) -> DataFrame:
    """Trades with ``side`` inferred from the latest quote: over its middle buys, under it sells.

    Prints at the middle, or before any finite quote, follow the tick rule; a flat one takes the last side assigned.
    ``former`` are prints (stream, seq, price, side) whose side is known already, and are not given again.
    """
    tagged = trades.withColumn("_known", F.lit(None).cast("int")).withColumn("_new", F.lit(True))
    if former is not None:
        tagged = tagged.unionByName(former.select("stream", "seq", "price", F.col("side").alias("_known"), F.lit(False).alias("_new")), allowMissingColumns=True)
    tagged = tagged.withColumn("_quote", F.lit(None).cast("struct<bid_px:double,ask_px:double>")).withColumn("_rank", F.lit(1))
    source = quotes.select("stream", "seq", F.struct(F.col("bid_px").cast("double").alias("bid_px"), F.col("ask_px").cast("double").alias("ask_px")).alias("_quote"), F.lit(0).alias("_rank"))
    both = tagged.unionByName(source, allowMissingColumns=True)
    seen = running(both, ("seq", "_rank"), {"_latest": ("last", F.col("_quote")), "_before": ("last", F.when(F.col("_rank") == 1, F.col("price")))}, before=True).where("_rank = 1")
    bid, ask = F.col("_latest.bid_px"), F.col("_latest.ask_px")
    middle = F.when(finite(bid) & finite(ask), (bid + ask) / 2)
    own = F.coalesce("_known", _moved(F.col("price"), middle), _moved(F.col("price"), F.col("_before")))
    return _assigned(seen, own).where("_new").drop("_known", "_new", "_quote", "_latest", "_rank")


def large_threshold(trades: DataFrame, last: int = 200, quantile: float = 0.9, least: int = 12) -> DataFrame:
    """(stream, n, threshold): the size at place floor(quantile·n) of the last trades in order; null for too few."""
    recent = trades.withColumn("_n", F.row_number().over(Window.partitionBy("stream").orderBy(F.desc("seq")))).where(F.col("_n") <= last)
    sizes = F.sort_array(F.collect_list("size"))  # at most ``last`` of each stream
    out = recent.groupBy("stream").agg(sizes.alias("sizes"))
    n = F.size("sizes")
    place = F.least(F.floor(n * quantile).cast("int") + 1, n)
    return out.select("stream", n.cast("long").alias("n"), F.when(n >= least, F.element_at("sizes", place)).alias("threshold"))


def seen_before(trades: DataFrame, window: int = 4096, id_col: str = "trade_id") -> DataFrame:
    """Trades without those whose id was among the ``window`` ids before; an empty id is never a repeat."""
    named = F.coalesce(F.col(id_col), F.lit("")) != ""
    fresh = trades.where(named).withColumn("_n", F.row_number().over(Window.partitionBy("stream", id_col).orderBy("seq")))
    # Within a stream of distinct ids the window is counted in ids: place of the id among first sightings.
    firsts = running(fresh.where("_n = 1"), ("seq",), {"_place": ("sum", F.lit(1))}).select("stream", id_col, F.col("seq").alias("_first"), "_place")
    placed = fresh.join(firsts, ["stream", id_col])
    passed = as_of(placed.drop("_n"), firsts.select("stream", F.col("_first").alias("seq"), F.col("_place").alias("_now")), ["_now"], ("seq",))
    kept = passed.where((F.col("seq") == F.col("_first")) | (F.col("_now") - F.col("_place") >= window)).drop("_first", "_place", "_now")
    return kept.unionByName(trades.where(~named))


def time_merge(books: DataFrame, trades: DataFrame, span_ns: int = 3_600_000_000_000) -> DataFrame:
    """One stream of both in order of time; on ties books come first. ``span_ns`` is the time that one task orders."""
    both = books.withColumn("type_rank", F.lit(0)).unionByName(trades.withColumn("type_rank", F.lit(1)), allowMissingColumns=True)
    return running(both, ("ts_ns", "type_rank", "seq"), {"place": ("sum", F.lit(1))}, span=span_ns)
