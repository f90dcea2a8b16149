"""Depth ladder, book tops and history pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegrid.functions.scale import Scale


#: Fixed value: what counts as size in a cell.
LEAST_SIZE = 1e-6


def dom_ladder(
    cells: DataFrame, scale: Scale, rows: int, visible: int = 20, shape: str = "book", quotes: DataFrame | None = None, locked: int | None = None,
) -> DataFrame:
    """(stream, row, price, bid, ask, profile, their _pct, is_best_bid, is_best_ask, middle, spread) around a middle, of the newest column.

    ``shape``: ``book`` shows both sides, ``profile`` the bids alone around the row with most, ``l1`` nothing but the
    quote's own sizes. ``quotes`` are (stream, bid_px, bid_sz, ask_px, ask_sz) and, but in a profile, give best rows,
    middle and spread; else these are the column's own, the spread only if both sides are there. ``locked`` is a
    row to stay around. Bars are per cent of the largest size shown, 2 at least where there is any.
    """
    newest = cells.groupBy("stream").agg(F.max("col_idx").alias("col_idx"))
    book = cells.join(newest, ["stream", "col_idx"]).select("stream", "row", "bid", "ask")
    on = lambda c: F.col(c) > LEAST_SIZE
    top = book.groupBy("stream").agg(
        F.max(F.when(on("bid"), F.col("row"))).alias("b"), F.min(F.when(on("ask"), F.col("row"))).alias("a"),
        F.max(F.when(on("bid"), F.struct("bid", (-F.col("row")).alias("below")))).alias("most"),
    )
    nothing = F.lit(None).cast("double")
    if quotes is not None and shape != "profile":
        top = quotes.select("stream", F.struct("bid_px", "bid_sz", "ask_px", "ask_sz").alias("q")).join(top, "stream", "full" if shape == "l1" else "right")
    else:
        top = top.withColumn("q", F.lit(None).cast("struct<bid_px:double,bid_sz:double,ask_px:double,ask_sz:double>"))
    best_bid = F.coalesce("b", F.col("a") - 1)
    best_ask = F.greatest(F.coalesce("a", F.col("b") + 1), best_bid + 1)
    price = lambda r: scale.row_to_price(r.cast("double"))
    place = lambda px: F.greatest(F.lit(0), F.least(F.lit(rows - 1), F.coalesce(F.floor(scale.price_to_row(px) + 0.5), F.lit(-1)))).cast("int")
    quoted = F.col("q").isNotNull()
    if shape == "profile":
        own = [F.lit(-1).alias("best_bid"), F.lit(-1).alias("best_ask"), (-F.col("most.below")).cast("double").alias("middle"), nothing.alias("spread")]
    else:
        own = [
            F.when(quoted, place(F.col("q.bid_px"))).otherwise(best_bid).alias("best_bid"), F.when(quoted, place(F.col("q.ask_px"))).otherwise(best_ask).alias("best_ask"),
            F.when(quoted, scale.price_to_row((F.col("q.bid_px") + F.col("q.ask_px")) / 2)).otherwise((best_bid + best_ask) / 2).alias("middle"),
            F.when(quoted, F.col("q.ask_px") - F.col("q.bid_px")).otherwise(price(F.col("a")) - price(F.col("b"))).alias("spread"),
        ]
    shown = top.select("stream", "q", *own)
    half = max(1, visible) // 2
    center = F.coalesce(F.lit(locked).cast("int"), F.floor(F.coalesce("middle", F.lit((rows - 1) / 2)) + 0.5).cast("int"))
    shown = shown.withColumn("row", F.explode(F.sequence(center - half, center + half)))
    sizes = shown.join(book, ["stream", "row"], "left")
    zero = F.lit(0.0)
    if shape == "profile":
        bid, ask, profile = zero, zero, F.coalesce("bid", zero)
    elif shape == "l1":
        at = lambda best, size: F.coalesce(F.when(F.col("row") == F.col(best), F.col(size)), zero)
        bid, ask, profile = at("best_bid", "q.bid_sz"), at("best_ask", "q.ask_sz"), zero
    else:
        bid, ask, profile = F.coalesce("bid", zero), F.coalesce("ask", zero), zero
    sized = sizes.select("stream", "row", bid.alias("bid"), ask.alias("ask"), profile.alias("profile"), "best_bid", "best_ask", "middle", "spread")
    most = F.greatest(F.lit(LEAST_SIZE), *(F.max(c).over(Window.partitionBy("stream")) for c in ("bid", "ask", "profile")))  # of the rows shown
    pct = lambda c: F.when(F.col(c) > 0, F.greatest(F.lit(2.0), F.col(c) / most * 100)).otherwise(0.0).alias(f"{c}_pct")
    best = lambda c: ((F.lit(shape != "profile")) & F.coalesce(F.col("row") == F.col(c), F.lit(False))).alias(f"is_{c}")
    return sized.select("stream", "row", price(F.col("row")).alias("price"), "bid", "ask", "profile", pct("bid"), pct("ask"), pct("profile"), best("best_bid"), best("best_ask"), "middle", "spread")


def effective_bbo(feed: DataFrame, derived: DataFrame, depth: DataFrame) -> DataFrame:
    """(stream, bid_px, ask_px, source): the feed's quote if it ever had one, else the derived one on depth tier L2."""
    quote = lambda df, name: df.select("stream", F.struct("bid_px", "ask_px").alias(name))
    both = depth.join(quote(feed, "f"), "stream", "left").join(quote(derived, "d"), "stream", "left")
    chosen = F.coalesce("f", F.when(F.col("depth") == "L2", F.col("d")))
    source = F.when(F.col("f").isNotNull(), "feed").when(chosen.isNotNull(), "derived").otherwise("none")
    return both.select("stream", chosen["bid_px"].alias("bid_px"), chosen["ask_px"].alias("ask_px"), source.alias("source"))


def book_top(levels: DataFrame, n: int = 20_000) -> DataFrame:
    """The ``n`` best levels of each side of a book, best first, as ``rank``."""
    best_first = Window.partitionBy("stream", "seq", "side").orderBy(F.when(F.col("side") == 0, -F.col("price")).otherwise(F.col("price")))
    return levels.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= n)


def history_page(columns: DataFrame, before_ns: int, n: int = 256, most: int = 256) -> DataFrame:
    """The newest ``n`` columns of each stream that start before ``before_ns``, with ``pos`` from 0 in ascending order."""
    n = max(1, min(n, most))
    newest = columns.where(F.col("t0_ns") < before_ns).withColumn("_r", F.row_number().over(Window.partitionBy("stream").orderBy(F.desc("t0_ns"))))
    page = newest.where(F.col("_r") <= n)
    return page.withColumn("pos", F.row_number().over(Window.partitionBy("stream").orderBy("t0_ns")) - 1).drop("_r")


def newest_of(rows: DataFrame, n: int, order: tuple[str, ...] = ("ts_ns", "seq")) -> DataFrame:
    """The last ``n`` rows of each stream, newest first, as ``rank``."""
    rank = F.row_number().over(Window.partitionBy("stream").orderBy(*(F.desc(c) for c in order)))
    return rows.withColumn("rank", rank).where(F.col("rank") <= n)


def tail(columns: DataFrame, n: int, file_col: str = "file") -> DataFrame:
    """One row per stream and column, of the newest file, and of these the last ``n``."""
    latest = F.row_number().over(Window.partitionBy("stream", "col_seq").orderBy(F.desc(file_col)))
    unique = columns.withColumn("_r", latest).where("_r = 1")
    last = F.row_number().over(Window.partitionBy("stream").orderBy(F.desc("col_seq")))
    return unique.withColumn("_r", last).where(F.col("_r") <= n).drop("_r")


def contiguous(columns: DataFrame) -> DataFrame:
    """(stream, contiguous): whether column numbers rise by one and their times rise."""
    order = Window.partitionBy("stream").orderBy("col_seq")
    good = (F.col("col_seq") == F.lag("col_seq").over(order) + 1) & (F.col("t0_ns") > F.lag("t0_ns").over(order))
    return columns.select("stream", F.coalesce(good, F.lit(True)).alias("g")).groupBy("stream").agg(F.bool_and("g").alias("contiguous"))


def gap_runs(columns: DataFrame) -> DataFrame:
    """(stream, from_seq, till_seq, n): runs of missing column numbers, each as one row."""
    follow = F.lead("col_seq").over(Window.partitionBy("stream").orderBy("col_seq"))
    gaps = columns.select("stream", (F.col("col_seq") + 1).alias("from_seq"), (follow - 1).alias("till_seq"))
    return gaps.where("till_seq >= from_seq").withColumn("n", F.col("till_seq") - F.col("from_seq") + 1)


def dropped_runs(dropped: DataFrame) -> DataFrame:
    """(stream, from_seq, till_seq, n): dropped columns merged into runs without a hole."""
    order = Window.partitionBy("stream").orderBy("col_seq")
    run = F.col("col_seq") - F.row_number().over(order)
    return dropped.withColumn("_run", run).groupBy("stream", "_run").agg(F.min("col_seq").alias("from_seq"), F.max("col_seq").alias("till_seq"), F.count("*").alias("n")).drop("_run")


def in_range_of(rows: DataFrame, columns: DataFrame, dt_ns: int) -> DataFrame:
    """Rows with ``ts_ns`` in [first t0, last t0 + dt) of the stream's columns."""
    span = columns.groupBy("stream").agg(F.min("t0_ns").alias("_lo"), (F.max("t0_ns") + dt_ns).alias("_hi"))
    return rows.join(span, "stream").where((F.col("ts_ns") >= F.col("_lo")) & (F.col("ts_ns") < F.col("_hi"))).drop("_lo", "_hi")


def with_epochs(columns: DataFrame, epochs: DataFrame) -> DataFrame:
    """Columns joined to their epochs; a stream of which any epoch is missing is left out."""
    missing = columns.select("stream", "epoch").distinct().join(epochs, ["stream", "epoch"], "left_anti").select("stream").distinct()
    return columns.join(missing, "stream", "left_anti").join(epochs, ["stream", "epoch"])


def retained(files: DataFrame, most_bytes: int) -> DataFrame:
    """Files to delete, oldest name first, until what is left fits; epochs and the newest columns part of a symbol stay.

    ``files`` are (market, symbol, kind, name, size).
    """
    newest = F.row_number().over(Window.partitionBy("market", "symbol", "kind").orderBy(F.desc("name"))) == 1
    exempt = (F.col("kind") == "epochs") | ((F.col("kind") == "columns") & newest)
    # Names start with their hour: hours are summed up first, so that no task orders all files.
    named = files.withColumn("_exempt", exempt).withColumn("_hour", F.substring("name", 1, 11))
    so_far = Window.orderBy("_hour").rowsBetween(Window.unboundedPreceding, -1)
    hours = named.groupBy("_hour").agg(F.sum("size").alias("_sum"))
    hours = hours.select("_hour", F.coalesce(F.sum("_sum").over(so_far), F.lit(0)).alias("_earlier"), F.sum("_sum").over(Window.partitionBy(F.lit(0))).alias("_total"))  # a row an hour
    here = F.coalesce(F.sum("size").over(Window.partitionBy("_hour").orderBy("name", "market", "symbol").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = named.withColumn("_before", here).join(hours, "_hour")
    return placed.where(~F.col("_exempt") & (F.col("_total") - F.col("_before") - F.col("_earlier") > most_bytes)).select(*files.columns)
