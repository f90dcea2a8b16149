"""Queries of smoothing, references as of each time, sessions and point probes, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.functions import text as ft
from tidegrid.functions.ints import floor_div
from tidegrid.functions.scale import bin_row, remap_row, remap_span
from tidegrid.operators import density as od
from tidegrid.operators import discovery as oq
from tidegrid.operators import ingest as oi
from tidegrid.operators import normalize as on
from tidegrid.operators import profiles as op
from tidegrid.plans.registry import HOUR, WEEKS2, cells, hybrid, linear, query, r6
from tidegrid.sources import adapters as sa

DAY = 24 * HOUR


@query(
    """SELECT stream, col_idx, round(greatest(ema, 4), 6) AS ema FROM (
      WITH RECURSIVE numbered AS (SELECT stream, col_idx, sum(bid + ask) AS v, row_number() OVER (PARTITION BY stream ORDER BY col_idx) AS n FROM cells GROUP BY stream, col_idx),
      smooth(stream, col_idx, n, ema) AS (
        SELECT stream, col_idx, n, v FROM numbered WHERE n = 1
        UNION ALL SELECT k.stream, k.col_idx, k.n, s.ema + 0.15::DOUBLE * (k.v - s.ema) FROM smooth s JOIN numbered k ON k.stream = s.stream AND k.n = s.n + 1)
      SELECT * FROM smooth)""",
    "cells",
)
def density_ema(spark, sf_dir):
    """What rests in each column, smoothed."""
    sums = cells(spark, sf_dir).groupBy("stream", "col_idx").agg(F.sum(F.col("bid") + F.col("ask")).alias("v"))
    return on.smoothed(sums, "v", "col_idx").select("stream", "col_idx", *r6("ema"))


def polled_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stream, ts_ns, px): the last order of a day gives the price of its priority."""
    o = sa.table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("stream"), sa.nanos(F.col("o_orderdate").cast("timestamp_ntz")).alias("ts_ns"), (F.col("o_totalprice") / 1000).alias("px"), "o_orderkey")
    return o.groupBy("stream", "ts_ns").agg(F.max_by("px", "o_orderkey").alias("px"))


@query(
    """, prices AS (SELECT o_orderpriority AS stream, CAST(epoch_us(o_orderdate::TIMESTAMP) * 1000 AS BIGINT) AS ts_ns, arg_max(o_totalprice / 1000, o_orderkey) AS px FROM orders GROUP BY 1, 2),
    filled AS (SELECT stream, t0_ns, c, CAST(round_even((h + l + c) / 3 / 10.0, 0) AS BIGINT) AS bucket, volume FROM candles)
    SELECT f.stream, t0_ns, bucket, sum(volume) OVER (PARTITION BY f.stream, bucket ORDER BY t0_ns) AS volume, CASE WHEN bucket * 10.0 <= coalesce(px, c) THEN 0 ELSE 1 END AS side
    FROM filled f ASOF LEFT JOIN prices p ON f.stream = p.stream AND f.t0_ns >= p.ts_ns""",
    "candles",
)
def profile_sides(spark, sf_dir):
    """The running profile, split at the price as of each bar."""
    out = op.sided_profile(sa.candles(spark, sf_dir), polled_prices(spark, sf_dir), tick=10.0, span_ns=64 * DAY)
    return out.select("stream", "t0_ns", "bucket", "volume", "side")


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(market, open_ns, close_ns): a priority trades from 14:30 to 21:00 on working days on which it has orders; one day in four it opens once more, overnight."""
    days = sa.table(spark, sf_dir, "orders").where("dayofweek(o_orderdate) BETWEEN 2 AND 6").select(F.col("o_orderpriority").alias("market"), sa.nanos(F.col("o_orderdate").cast("timestamp_ntz")).alias("day")).distinct()
    late = F.when(floor_div(F.col("day"), DAY) % 4 == 0, F.array(F.struct(F.lit(22 * HOUR).alias("a"), F.lit(30 * HOUR).alias("b")))).otherwise(F.array())
    times = F.concat(F.array(F.struct(F.lit(29 * HOUR // 2).alias("a"), F.lit(21 * HOUR).alias("b"))), late)
    return days.withColumn("x", F.explode(times)).select("market", (F.col("day") + F.col("x.a")).alias("open_ns"), (F.col("day") + F.col("x.b")).alias("close_ns"))


CALENDAR = """WITH days AS (SELECT DISTINCT o_orderpriority AS market, CAST(epoch_us(o_orderdate::TIMESTAMP) * 1000 AS BIGINT) AS day FROM orders WHERE dayofweek(o_orderdate) BETWEEN 1 AND 5),
    calendar AS (SELECT market, day + 52200000000000 AS open_ns, day + 75600000000000 AS close_ns FROM days
      UNION ALL SELECT market, day + 79200000000000, day + 108000000000000 FROM days WHERE day // 86400000000000 % 4 = 0)"""


@query(
    CALENDAR
    + """, given AS (SELECT o_orderkey, o_orderpriority AS market, CAST(epoch_us(o_orderdate::TIMESTAMP) * 1000 AS BIGINT) + o_orderkey % 24 * 3600000000000 AS ts_ns FROM orders),
    met AS (SELECT o_orderkey, ts_ns, coalesce(bool_or(open_ns <= ts_ns AND ts_ns < close_ns), false) AS open, min(open_ns) FILTER (open_ns > ts_ns AND open_ns - ts_ns <= 864000000000000) AS following
      FROM given LEFT JOIN calendar USING (market) GROUP BY o_orderkey, ts_ns)
    SELECT o_orderkey, ts_ns, open, CASE WHEN NOT open THEN following END AS next_open_ns FROM met"""
)
def session_gate(spark, sf_dir):
    """Whether the market is open at each order, and when it opens next."""
    o = sa.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("market"), (sa.nanos(F.col("o_orderdate").cast("timestamp_ntz")) + F.col("o_orderkey") % 24 * HOUR).alias("ts_ns"))
    return oi.session_open(o, calendar(spark, sf_dir)).select("o_orderkey", "ts_ns", "open", "next_open_ns")


@query(
    CALENDAR
    + """, ends AS (SELECT DISTINCT market, close_ns AS ts_ns FROM calendar)
    SELECT market, ts_ns, 'session_break' AS kind, min(open_ns) FILTER (open_ns > ts_ns AND open_ns - ts_ns <= 864000000000000) AS next_open_ns FROM ends JOIN calendar USING (market)
    GROUP BY market, ts_ns HAVING NOT bool_or(open_ns <= ts_ns AND ts_ns < close_ns)"""
)
def session_break_markers(spark, sf_dir):
    """Markers where sessions end."""
    return oi.session_breaks(calendar(spark, sf_dir)).select("market", "ts_ns", "kind", "next_open_ns")


@query(
    """, points AS (SELECT stream, seq, ts_ns // 3600000000000 AS col_idx, CAST(round_even((price - 70) / 0.5, 0) AS INTEGER) AS row FROM trades),
    blocks AS (SELECT stream, col_idx, row // 4 AS block, sum(bid) AS bid, sum(ask) AS ask FROM cells GROUP BY 1, 2, 3)
    SELECT p.stream, seq, p.col_idx, row, round(coalesce(bid, 0), 6) AS bid, round(coalesce(ask, 0), 6) AS ask, CASE WHEN bid IS NOT NULL THEN 0 END AS epoch, CASE WHEN bid IS NOT NULL THEN 70 + 0.5::DOUBLE * row END AS price
    FROM points p LEFT JOIN blocks b ON p.stream = b.stream AND p.col_idx = b.col_idx AND p.row // 4 = b.block WHERE row BETWEEN 0 AND 127""",
    "trades", "cells",
)
def point_probe(spark, sf_dir):
    """Size, epoch and price of the four rows around each print, in its own column."""
    t = sa.trades(spark, sf_dir).select("stream", "seq", floor_div(F.col("ts_ns"), HOUR).alias("col_idx"), bin_row(linear(), F.col("price")).alias("row")).where("row IS NOT NULL")
    grid = cells(spark, sf_dir).withColumn("epoch", F.lit(0))
    nothing = {c: F.lit(None).cast("double") for c in ("dn_rows", "core_rows", "core_p0", "core_step", "lo_price", "hi_price")}
    epochs = t.select("stream").distinct().withColumns({"epoch": F.lit(0), "tick": F.lit(sa.TICK), "tick_multiple": F.lit(1), "p0": F.lit(sa.P0), "rows": F.lit(sa.ROWS), "scale_kind": F.lit(0), **nothing})
    return od.probe(t, grid, epochs, 4).select("stream", "seq", "col_idx", "row", *r6("bid", "ask"), "epoch", "price")


# Markets, taker volumes, other frames, axes and times


@query(
    """SELECT DISTINCT split_part(market, '-', 1) AS id, CASE WHEN contains(market, '-') THEN split_part(market, '-', 1) || '-' || substr(market, instr(market, '-') + 1) ELSE market END AS market FROM directory""",
    "directory",
)
def venue_segments(spark, sf_dir):
    """Markets of each venue, from the segments that its markets name."""
    parts = sa.directory(spark, sf_dir).select(oq.market_parts(F.col("market")).alias("x")).select("x.exchange", "x.segment")
    # The segments of one venue are a few.
    venues = parts.groupBy("exchange").agg(F.collect_set("segment").alias("segments")).withColumnRenamed("exchange", "id")
    return oq.venue_markets(venues)


@query(
    """, split AS (SELECT *, CASE WHEN t0_ns // 604800000000000 % 3 <> 0 THEN volume * 0.75 END AS buy, volume * 0.25 AS sell FROM gridded)
    SELECT stream, n AS col_seq, coalesce(buy, 0) AS vol_buy, CASE WHEN buy IS NULL THEN 0 ELSE sell END AS vol_sell, sum(CASE WHEN buy IS NULL THEN 0 ELSE buy - sell END) OVER (PARTITION BY stream ORDER BY n ROWS UNBOUNDED PRECEDING) AS cvd_cum FROM split""",
    "gridded",
)
def taker_bars(spark, sf_dir):
    """Bars of candles with taker volumes; where one is not known both count as none."""
    known = F.when(floor_div(F.col("t0_ns"), 7 * DAY) % 3 != 0, F.col("volume") * 0.75)
    candles = sa.candles(spark, sf_dir).withColumns({"buy_volume": known, "sell_volume": F.col("volume") * 0.25})
    return op.bars_from_candles(candles, WEEKS2).select("stream", "col_seq", "vol_buy", "vol_sell", "cvd_cum")


_ROW_OF = "CASE WHEN {p} < 84 THEN 20 * (1 + ln({p} / 84) / ln(84 / 40.0::DOUBLE)) WHEN {p} <= 116 THEN 20 + ({p} - 84) / 0.5 ELSE 84 + 44 * (ln({p} / 116) / ln(250 / 116.0::DOUBLE)) END"


@query(
    f"""SELECT event_id, round({_ROW_OF.format(p='(70 + 0.5 * r)')}, 6) AS row, round({_ROW_OF.format(p='(70 + 0.5 * (r + 4))')} - ({_ROW_OF.format(p='(70 + 0.5 * (r - 4))')}), 6) AS span
    FROM (SELECT event_id, (event_id % 128)::DOUBLE AS r FROM events)"""
)
def hybrid_remap(spark, sf_dir):
    """A row and a span of a linear frame on a hybrid scale."""
    row = (F.col("event_id") % 128).cast("double")
    return sa.table(spark, sf_dir, "events").select("event_id", F.round(remap_row(row, linear(), hybrid()), 6).alias("row"), F.round(remap_span(F.lit(8.0), linear(), hybrid(), row), 6).alias("span"))


@query(
    """, steps AS (SELECT event_id, lo, hi, greatest(CASE WHEN f <= 1 THEN 1 WHEN f <= 2 THEN 2 WHEN f <= 5 THEN 5 ELSE 10 END * p, 0.5) AS step FROM (SELECT *, rough / p AS f FROM (SELECT *, power(10.0, floor(log10(rough))) AS p
      FROM (SELECT event_id, 75 + value AS lo, 76 + value * 3 AS hi, (1 + value * 2) / 6 AS rough FROM events))))
    SELECT event_id, CAST(greatest(0, floor((hi + step * 1e-9) / step) - ceil(lo / step) + 1) AS INTEGER) AS n, CASE WHEN floor((hi + step * 1e-9) / step) >= ceil(lo / step) THEN round(ceil(lo / step) * step, 6) END AS first FROM steps""".replace(", steps AS", "WITH steps AS")
)
def axis_ticks(spark, sf_dir):
    """Nice prices between two prices: how many, and the first."""
    ticks = ft.price_ticks(75 + F.col("value"), 76 + F.col("value") * 3, 6, F.lit(0.5)).alias("t")
    return sa.table(spark, sf_dir, "events").select("event_id", ticks).select("event_id", F.size("t").alias("n"), F.round(F.get("t", F.lit(0)), 6).alias("first"))


@query(
    """SELECT event_id, CAST(ns // 1000000 % 200000000 AS BIGINT) AS left_ms,
      CASE WHEN s >= 86400 THEN CAST(s // 86400 AS VARCHAR) || 'd ' ELSE '' END || CASE WHEN s <= 0 AND ns // 1000000 % 200000000 = 0 THEN '00:00:00' ELSE printf('%02d:%02d:%02d', s % 86400 // 3600, s % 3600 // 60, s % 60) END AS shown,
      round(least(1, greatest(0, (ns - 1704067200000000000) / 2592000000000000.0::DOUBLE)), 9) AS fraction, CAST(1704067200000000000 + (event_id % 11) * 259200000000000 AS BIGINT) AS seek
    FROM (SELECT event_id, epoch_us(ts) * 1000 AS ns, epoch_us(ts) // 1000 % 200000000 // 1000 AS s FROM events)"""
)
def replay_times(spark, sf_dir):
    """Countdowns, places in a recording, and times at tenths of it."""
    ns, start, end = sa.nanos(F.col("ts")), F.lit(1_704_067_200_000_000_000), F.lit(1_704_067_200_000_000_000 + 30 * DAY)
    left = floor_div(ns, 1_000_000) % 200_000_000
    return sa.table(spark, sf_dir, "events").select(
        "event_id", left.alias("left_ms"), ft.countdown(left).alias("shown"), F.round(ft.fraction_of(ns, start, end), 9).alias("fraction"), ft.seek_target(F.col("event_id") % 11 / 10, start, end).alias("seek")
    )
