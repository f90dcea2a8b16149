"""Exchange records to canonical events: levels, trades, quotes and markers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegrid.functions.ints import floor_div
from tidegrid.functions.scale import finite

#: Kinds of records that come from exchanges.
SNAPSHOT, DELTA, TRADE, TICKER, LIQUIDATION = "BookSnapshot", "BookDelta", "Trade", "BookTicker", "Liquidation"


def timestamp(records: DataFrame) -> Column:
    """The source's time if it gave one, else the local one."""
    return F.coalesce("source_ts", "local_ts")


def levels(records: DataFrame) -> DataFrame:
    """(stream, seq, ts_ns, side, price, amount, is_snapshot) of book records; a snapshot without levels still empties the book."""
    books = records.where(F.col("kind").isin(SNAPSHOT, DELTA))
    tag = lambda c, side: F.transform(F.coalesce(F.col(c), F.array()), lambda x: F.struct(F.lit(side).alias("side"), x["price"].alias("price"), x["amount"].alias("amount")))
    each = F.explode_outer(F.concat(tag("bids", 0), tag("asks", 1)))
    out = books.select("stream", "seq", timestamp(records).alias("ts_ns"), (F.col("kind") == SNAPSHOT).alias("is_snapshot"), each.alias("x"))
    return out.select("stream", "seq", "ts_ns", F.col("x.side").alias("side"), F.col("x.price").alias("price"), F.col("x.amount").alias("amount"), "is_snapshot")


def trades(records: DataFrame) -> DataFrame:
    """(stream, seq, ts_ns, price, size, side, side_src, id): a side the exchange did not name is unknown, never guessed."""
    t = records.where(F.col("kind") == TRADE)
    named = F.lower("side")
    side = F.when(named.isin("buy", "b"), 0).when(named.isin("sell", "s"), 1).otherwise(2)
    return t.select("stream", "seq", timestamp(t).alias("ts_ns"), "price", F.col("amount").alias("size"), side.alias("side"), F.when(side == 2, 2).otherwise(0).alias("side_src"), "id")


def tickers(records: DataFrame) -> DataFrame:
    """(stream, seq, ts_ns, bid_px, bid_sz, ask_px, ask_sz) of sound quotes: positive finite prices and sizes not below 0."""
    t = records.where(F.col("kind") == TICKER)
    best = lambda side, f: F.expr(f"{side}[0].{f}")
    out = t.select("stream", "seq", timestamp(t).alias("ts_ns"), *(best(s, f).alias(f"{n}_{m}") for s, n in (("bids", "bid"), ("asks", "ask")) for f, m in (("price", "px"), ("amount", "sz"))))
    return sound_quotes(out)


def sound_quotes(quotes: DataFrame) -> DataFrame:
    good = F.lit(True)
    for side in ("bid", "ask"):
        good &= finite(F.col(f"{side}_px")) & (F.col(f"{side}_px") > 0) & (F.col(f"{side}_sz") >= 0)
    return quotes.where(good)


def markers(records: DataFrame, polled: bool = False) -> DataFrame:
    """(stream, seq, ts_ns, kind, text, price, size): liquidations, and a gap at every snapshot of a running book kept by deltas."""
    hit = records.where(F.col("kind") == LIQUIDATION)
    out = hit.select("stream", "seq", timestamp(hit).alias("ts_ns"), F.lit("liquidation").alias("kind"), F.coalesce("side", F.lit("")).alias("text"), "price", F.col("amount").alias("size"))
    if polled:
        return out
    nothing = F.lit(None).cast("double")
    snaps = records.where(F.col("kind") == SNAPSHOT).withColumn("_n", F.row_number().over(Window.partitionBy("stream").orderBy("seq"))).where("_n > 1")
    gaps = snaps.select("stream", "seq", timestamp(snaps).alias("ts_ns"), F.lit("gap").alias("kind"), F.lit("resync").alias("text"), nothing.alias("price"), nothing.alias("size"))
    return out.unionByName(gaps)


def anchor_reference(levels_at: DataFrame) -> DataFrame:
    """(stream, seq, ref) of each book: its middle, else the centre of the one side it has, else null."""
    sound = finite(F.col("price")) & finite(F.col("size")) & (F.col("size") > 0)
    px = lambda side: F.when(sound & (F.col("side") == side), F.col("price"))
    g = levels_at.groupBy("stream", "seq").agg(F.max(px(0)).alias("bb"), F.min(px(0)).alias("bl"), F.min(px(1)).alias("ba"), F.max(px(1)).alias("ah"))
    ref = F.coalesce((F.col("bb") + F.col("ba")) / 2, (F.col("bb") + F.col("bl")) / 2, (F.col("ba") + F.col("ah")) / 2)
    return g.select("stream", "seq", ref.alias("ref"))


DAY_NS = 86_400_000_000_000
NEXT_OPEN_DAYS = 10


def session_open(rows: DataFrame, calendar: DataFrame) -> DataFrame:
    """Rows with ``open`` and ``next_open_ns``: whether the market's calendar (market, open_ns, close_ns) has them inside a session.

    The next opening counts within ten days, and is null inside a session. Sessions are listed by the days at which
    they matter, so a row meets those of its own day by key: a few, whatever the length of the calendar.
    """
    known = calendar.where(F.col("open_ns") < F.col("close_ns")).select("market", "open_ns", "close_ns").distinct()
    day = lambda c: floor_div(c, DAY_NS)
    days = F.sequence(day(F.col("open_ns")) - NEXT_OPEN_DAYS, day(F.col("close_ns") - 1))
    of_day = known.withColumn("_day", F.explode(days)).groupBy("market", "_day").agg(F.collect_list(F.struct("open_ns", "close_ns")).alias("_sessions"))
    met = rows.withColumn("_day", day(F.col("ts_ns"))).join(of_day, ["market", "_day"], "left")
    now = F.col("ts_ns")
    is_open = F.coalesce(F.exists("_sessions", lambda x: (x["open_ns"] <= now) & (now < x["close_ns"])), F.lit(False))
    later = F.filter("_sessions", lambda x: (x["open_ns"] > now) & (x["open_ns"] - now <= NEXT_OPEN_DAYS * DAY_NS))
    following = F.array_min(F.transform(later, lambda x: x["open_ns"]))
    return met.withColumn("open", is_open).withColumn("next_open_ns", F.when(~is_open, following)).select(*rows.columns, "open", "next_open_ns")


def session_breaks(calendar: DataFrame) -> DataFrame:
    """(market, ts_ns, kind, text, next_open_ns): a marker where a session ends, with the opening that follows within ten days."""
    ends = calendar.select("market", F.col("close_ns").alias("ts_ns")).distinct()
    closed = session_open(ends, calendar).where("NOT open")  # a session that another one continues has no break
    return closed.select("market", "ts_ns", F.lit("session_break").alias("kind"), F.lit("session closed").alias("text"), "next_open_ns")
