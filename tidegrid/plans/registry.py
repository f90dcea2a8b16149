"""Registered queries over the test tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegrid.functions import scale as fs
from tidegrid.functions import text as ft
from tidegrid.operators import bars as ob
from tidegrid.operators import density as od
from tidegrid.operators import discovery as oq
from tidegrid.operators import ladder as ol
from tidegrid.operators import normalize as on
from tidegrid.operators import profiles as op
from tidegrid.plans.sql import CTES, score_sql
from tidegrid.sources import adapters as sa

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

HOUR = sa.HOUR_NS
GRID = (sa.P0, sa.TICK, sa.ROWS)


def query(sql: str | None, *ctes: str):
    """Register a query under its function's name; ``ctes`` name the common tables its SQL starts from, in order."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            needed: list[str] = []
            for name in ctes:
                needed += [c for c in (*CTES[name][0], name) if c not in needed]
            head = "WITH " + ", ".join(f"{c} AS ({CTES[c][1]})" for c in needed) if needed else ""
            ORACLE_SQL[f.__name__] = f"{head} {sql}".strip()  # the SQL may go on with tables of its own
        return f

    return add


def r6(*names: str) -> list:
    """Doubles rounded to six digits, so that the order of a sum does not show."""
    return [F.round(n, 6).alias(n) for n in names]


def s6(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


def linear() -> fs.Scale:
    return fs.Scale.linear(*GRID)


def hybrid() -> fs.Scale:
    return fs.Scale.hybrid(rows=128, dn_rows=20, core_rows=64, core_p0=84.0, core_step=0.5, lo_price=40.0, hi_price=250.0)


def closed_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    updates = sa.level_updates(spark, sf_dir)
    return od.close_open(od.level_intervals(updates), updates)


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return od.density(closed_intervals(spark, sf_dir), linear(), HOUR)


# Bars and trades


@query(f"SELECT stream, col_seq, t0_ns, {s6('o', 'h', 'l', 'c', 'vol_buy', 'vol_sell', 'cvd_cum', 'vwap_num_cum', 'vwap_den_cum', 'vwap')} FROM bars", "bars")
def bars_hourly(spark, sf_dir):
    """Hourly bars with carried closes, CVD and VWAP."""
    out = ob.cumulate(ob.complete_columns(ob.trade_bars(sa.trades(spark, sf_dir), HOUR)), HOUR)
    return out.select("stream", "col_seq", "t0_ns", *r6("o", "h", "l", "c", "vol_buy", "vol_sell", "cvd_cum", "vwap_num_cum", "vwap_den_cum", "vwap"))


@query("SELECT t.stream, t.seq, CAST(coalesce(b.eff, t.ts_ns) // 3600000000000 AS BIGINT) AS col_idx FROM trades t ASOF LEFT JOIN books b ON t.stream = b.stream AND t.seq >= b.seq", "trades", "books")
def trade_column_asof(spark, sf_dir):
    """C4: a trade belongs to the column of the latest book before it. Every fifth event is a book."""
    books = sa.level_updates(spark, sf_dir).where("seq % 5 = 0")
    return ob.trade_columns(sa.trades(spark, sf_dir), books, HOUR).select("stream", "seq", "col_idx")


@query(
    """SELECT stream, seq, CAST(coalesce(last_value(m IGNORE NULLS) OVER (PARTITION BY stream ORDER BY seq ROWS UNBOUNDED PRECEDING), 0) AS INTEGER) AS side
    FROM (SELECT *, CASE WHEN price > p THEN 0 WHEN price < p THEN 1 END AS m FROM (SELECT *, lag(price) OVER (PARTITION BY stream ORDER BY seq) AS p FROM trades))""",
    "trades",
)
def tick_rule_side(spark, sf_dir):
    """Sides from the direction of the price."""
    return ob.tick_rule(sa.trades(spark, sf_dir)).select("stream", "seq", "side")


def quotes_frame(spark, sf_dir):
    """A quote at every seventh event: half a tick under and over its price."""
    t = sa.trades(spark, sf_dir).where("seq % 7 = 0")
    return t.select("stream", "seq", "ts_ns", (F.col("price") - 0.25).alias("bid_px"), (F.col("price") + 0.25).alias("ask_px"))


@query(
    """SELECT stream, seq, CAST(coalesce(last_value(m IGNORE NULLS) OVER (PARTITION BY stream ORDER BY seq ROWS UNBOUNDED PRECEDING), 0) AS INTEGER) AS side
    FROM (SELECT *, CASE WHEN price > mid THEN 0 WHEN price < mid THEN 1 WHEN price > p THEN 0 WHEN price < p THEN 1 END AS m
      FROM (SELECT t.stream, t.seq, t.price, q.price AS mid, lag(t.price) OVER (PARTITION BY t.stream ORDER BY t.seq) AS p
        FROM trades t ASOF LEFT JOIN (SELECT * FROM trades WHERE seq % 7 = 0) q ON t.stream = q.stream AND t.seq >= q.seq))""",
    "trades",
)
def quote_rule_side(spark, sf_dir):
    """Sides from the latest quote, else from the price."""
    return ob.quote_rule(sa.trades(spark, sf_dir), quotes_frame(spark, sf_dir)).select("stream", "seq", "side")


@query(
    """SELECT stream, count(*) AS n, CASE WHEN count(*) >= 12 THEN round(list_sort(list(size))[least(CAST(floor(count(*) * 0.9) AS BIGINT) + 1, count(*))], 6) END AS threshold
    FROM (SELECT * FROM trades QUALIFY row_number() OVER (PARTITION BY stream ORDER BY seq DESC) <= 200) GROUP BY stream""",
    "trades",
)
def large_prints(spark, sf_dir):
    """What counts as a large print."""
    return ob.large_threshold(sa.trades(spark, sf_dir)).select("stream", "n", *r6("threshold"))


@query(
    """SELECT stream, seq FROM (SELECT *, CASE WHEN seq % 10 = 0 THEN '' ELSE 't' || CAST(seq // 3 AS VARCHAR) END AS id FROM trades)
    QUALIFY id = '' OR row_number() OVER (PARTITION BY stream, id ORDER BY seq) = 1""",
    "trades",
)
def seen_id_dedup(spark, sf_dir):
    """C11: repeats of trade ids go, empty ids stay. Every three events share an id."""
    trade_id = F.when(F.col("seq") % 10 == 0, "").otherwise(F.concat(F.lit("t"), F.floor(F.col("seq") / 3).cast("string")))
    return ob.seen_before(sa.trades(spark, sf_dir).withColumn("trade_id", trade_id)).select("stream", "seq")


@query(
    """SELECT stream, kind, seq, CAST(row_number() OVER (PARTITION BY stream ORDER BY h, kind, seq) AS INTEGER) AS place
    FROM (SELECT stream, seq, ts_ns // 3600000000000 AS h, 1 AS kind FROM trades UNION ALL SELECT stream, seq, eff // 3600000000000, 0 FROM books)""",
    "trades", "books",
)
def time_merge(spark, sf_dir):
    """Books and trades as one stream; books come first on ties."""
    hour = lambda df: df.select("stream", "seq", F.floor(F.col("ts_ns") / HOUR).alias("ts_ns"))
    out = ob.time_merge(hour(sa.level_updates(spark, sf_dir).where("seq % 5 = 0")), hour(sa.trades(spark, sf_dir)), span_ns=24)
    return out.select("stream", F.col("type_rank").alias("kind"), "seq", F.col("place").cast("int").alias("place"))


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id % 4) AS streams FROM events GROUP BY event_type")
def event_counts(spark, sf_dir):
    """Events by type, and how many streams have them."""
    return sa.table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct(F.col("user_id") % 4).alias("streams"))


@query("SELECT stream, seq, CAST(rank AS INTEGER) AS rank FROM (SELECT stream, seq, row_number() OVER (PARTITION BY stream ORDER BY ts_ns DESC, seq DESC) AS rank FROM trades) WHERE rank <= 200", "trades")
def tape(spark, sf_dir):
    """the newest prints first."""
    return ol.newest_of(sa.trades(spark, sf_dir), 200).select("stream", "seq", "rank")


# Density


@query("SELECT stream, seq, side, price, round(size, 6) AS size, from_ns, till_ns FROM intervals", "intervals")
def book_levels_intervals(spark, sf_dir):
    """How long each level of a book kept by deltas and snapshots stood."""
    return closed_intervals(spark, sf_dir).select("stream", "seq", "side", "price", *r6("size"), "from_ns", "till_ns")


@query(f"SELECT stream, col_idx, row, {s6('bid', 'ask')} FROM cells", "cells")
def density_tw(spark, sf_dir):
    """Time-weighted density."""
    return cells(spark, sf_dir).select("stream", "col_idx", "row", *r6("bid", "ask"))


HALF = "CASE WHEN {x} = 0 THEN 0.0 ELSE round_even({x} / power(2.0, greatest(floor(log2({x})), -14) - 10), 0) * power(2.0, greatest(floor(log2({x})), -14) - 10) END"


@query(f"SELECT event_id, {HALF.format(x='v')} AS half FROM (SELECT event_id, abs(value) * 37.0 + event_id % 11 AS v FROM events)")
def density_f16(spark, sf_dir):
    """Values of half precision."""
    v = F.abs("value") * 37.0 + F.col("event_id") % 11
    return sa.table(spark, sf_dir, "events").select("event_id", fs.half_float(v).alias("half"))


@query(f"SELECT stream, col_idx, row, {s6('bid', 'ask')} FROM level1", "level1")
def sum_pyramid_l1(spark, sf_dir):
    """Sums of four columns by four rows, of blocks that are finished whole."""
    own = cells(spark, sf_dir)
    return od.pyramid(own, last=last_columns(own)).select("stream", "col_idx", "row", *r6("bid", "ask"))


def last_columns(own: DataFrame) -> DataFrame:
    return own.groupBy("stream").agg(F.max("col_idx").alias("last_col"))


@query(f"SELECT stream, CAST(floor(col_idx / 4) AS BIGINT) AS col_idx, CAST(row // 4 AS INTEGER) AS row, round(least(sum(bid), 60000), 6) AS bid, round(least(sum(ask), 60000), 6) AS ask FROM level1 JOIN (SELECT stream, max(col_idx) AS last FROM cells GROUP BY stream) USING (stream) WHERE (col_idx // 4 + 1) * 16 <= last + 1 GROUP BY 1, 2, 3", "level1")
def sum_pyramid_l2(spark, sf_dir):
    """The same of the first level."""
    own = cells(spark, sf_dir)
    last = last_columns(own)
    return od.pyramid(od.pyramid(own, last=last), last=od.coarser(last)).select("stream", "col_idx", "row", *r6("bid", "ask"))


@query("SELECT stream, col_idx, lo, hi, bid_top, ask_bot, CAST(CASE WHEN ask_bot > bid_top THEN (bid_top + ask_bot + 1) / 2 ELSE (lo + hi + 1) / 2 END AS DOUBLE) AS tracked FROM extents", "extents")
def column_extent(spark, sf_dir):
    """Rows in use of each column, and the row to follow."""
    return od.extent(cells(spark, sf_dir)).select("stream", "col_idx", "lo", "hi", "bid_top", "ask_bot", "tracked")


@query(
    """SELECT stream, greatest(0, lo - pad) AS row_bottom, greatest(1, least(128, hi + pad + 1) - greatest(0, lo - pad)) AS row_span
    FROM (SELECT stream, min(lo) AS lo, max(hi) AS hi, greatest(4, CAST(round((max(hi) - min(lo)) * 0.1) AS INTEGER)) AS pad FROM extents GROUP BY stream)""",
    "extents",
)
def visible_extent(spark, sf_dir):
    """The frame that shows all rows in use."""
    return od.price_frame(od.extent(cells(spark, sf_dir)), 128, 0.1, 4)


@query(
    """SELECT stream, col_idx, max(row) FILTER (bid > 0) AS bid_row, 70 + 0.5::DOUBLE * max(row) FILTER (bid > 0) AS bid_px, round(arg_max(bid, row) FILTER (bid > 0), 6) AS bid_sz,
    min(row) FILTER (ask > 0) AS ask_row, 70 + 0.5::DOUBLE * min(row) FILTER (ask > 0) AS ask_px, round(arg_min(ask, row) FILTER (ask > 0), 6) AS ask_sz FROM cells GROUP BY stream, col_idx""",
    "cells",
)
def inside_quote(spark, sf_dir):
    """The quote that a column shows."""
    return od.inside_quote(cells(spark, sf_dir), linear()).select("stream", "col_idx", "bid_row", "bid_px", *r6("bid_sz"), "ask_row", "ask_px", *r6("ask_sz"))


@query(
    """SELECT stream, row, round(v, 6) AS value, row_number() OVER (PARTITION BY stream ORDER BY v DESC, row) = 1 AS is_poc
    FROM (SELECT c.stream, row, sum(bid + ask) AS v FROM cells c JOIN (SELECT max(col_idx) AS hi FROM cells) ON col_idx BETWEEN hi - 199 AND hi WHERE row BETWEEN 10 AND 110 GROUP BY 1, 2)""",
    "cells",
)
def profile_poc(spark, sf_dir):
    """Resting liquidity by row over the last 200 columns, and its point of control."""
    return od.newest_profile(cells(spark, sf_dir), 200, 10, 110).select("stream", "row", *r6("value"), "is_poc")


@query("SELECT stream, col_idx, round(sum(bid + ask), 6) AS size FROM cells WHERE row BETWEEN 40 AND 47 GROUP BY stream, col_idx", "cells")
def grouped_cell_size(spark, sf_dir):
    """Size in a block of rows."""
    return od.cell_size(cells(spark, sf_dir), 40, 8).select("stream", "col_idx", *r6("size"))


# Normalisation


@query("SELECT stream, round(quantile_cont(v, 0.99), 6) AS seed FROM (SELECT c.stream, unnest([bid, ask]) AS v FROM cells c JOIN (SELECT stream, max(col_idx) AS hi FROM cells GROUP BY stream) n ON c.stream = n.stream AND col_idx > hi - 64) WHERE v > 0 GROUP BY stream", "cells")
def norm_seed(spark, sf_dir):
    """The first norm of a view."""
    return on.norm_seed(cells(spark, sf_dir)).select("stream", *r6("seed"))


@query("SELECT stream, tile, bin, n FROM histogram", "histogram")
def log_histogram(spark, sf_dir):
    """Log histograms by tile of columns."""
    return on.log_histogram(cells(spark, sf_dir).select("stream", "col_idx", *r6("bid", "ask")))


@query(
    """SELECT stream, round(greatest(exp(ln(1/64.0::DOUBLE) + (bin + (rank - (cum - n)) / n) / (256 / (ln(65536.0::DOUBLE) - ln(1/64.0::DOUBLE)))), 4.0), 6) AS value
    FROM (SELECT *, sum(n) OVER (PARTITION BY stream) * 0.99::DOUBLE AS rank, sum(n) OVER (PARTITION BY stream ORDER BY bin) AS cum FROM (SELECT stream, bin, sum(n)::DOUBLE AS n FROM histogram GROUP BY 1, 2))
    WHERE cum >= rank QUALIFY row_number() OVER (PARTITION BY stream ORDER BY bin) = 1""",
    "histogram",
)
def viewport_percentile(spark, sf_dir):
    """Percentile of all tiles in view."""
    histogram = on.log_histogram(cells(spark, sf_dir).select("stream", "col_idx", *r6("bid", "ask")))
    return on.viewport_percentile(histogram, 0, 1 << 40).select("stream", *r6("value"))


@query(
    """SELECT event_id, CAST(floor(power(greatest(0.0, least(1.0, (greatest(0.0, least(1.0, value / 80.0)) - f) / (1 - f))), g) * 255 + 0.5) AS INTEGER) AS idx
    FROM (SELECT event_id, value, 0.28 + (event_id % 101) / 100.0 * 0.44 AS g, 0.85 * power((event_id % 60) / 100.0, 1.4) AS f FROM events)"""
)
def tone_map(spark, sf_dir):
    """From density to the index of a colour."""
    gamma, floor = on.gamma_for_contrast(F.col("event_id") % 101), on.floor_for_tolerance((F.col("event_id") % 60).cast("double"))
    return sa.table(spark, sf_dir, "events").select("event_id", on.lut_index(F.col("value"), F.lit(80.0), floor, gamma).alias("idx"))


@query(
    """SELECT event_id, level, CAST(power(4, level) AS INTEGER) AS blk, CASE WHEN x <= 1 THEN 1 ELSE CAST(greatest(1, least(4, floor(x / power(4, level) + 0.5))) AS INTEGER) END AS taps
    FROM (SELECT event_id, value AS x, CASE WHEN value <= 1 THEN 0 ELSE CAST(greatest(0, least(2, floor(ln(value) / ln(4.0)))) AS INTEGER) END AS level FROM events)"""
)
def level_of_detail(spark, sf_dir):
    """Which level of the pyramid a zoom needs."""
    return sa.table(spark, sf_dir, "events").select("event_id", on.level_of_detail(F.col("value"), 2).alias("x")).select("event_id", "x.level", "x.blk", "x.taps")


# Scales


@query(
    """SELECT event_id, round(CASE WHEN p < 84 THEN 20 * (1 + ln(p / 84) / ln(84 / 40.0::DOUBLE)) WHEN p <= 116 THEN 20 + (p - 84) / 0.5 ELSE 84 + 44 * (ln(p / 116) / ln(250 / 116.0::DOUBLE)) END, 6) AS row
    FROM (SELECT event_id, 30.0::DOUBLE + value * 2 AS p FROM events)"""
)
def price_to_row_hybrid(spark, sf_dir):
    """Rows of prices on a hybrid scale."""
    return sa.table(spark, sf_dir, "events").select("event_id", F.round(hybrid().price_to_row(30.0 + F.col("value") * 2), 6).alias("row"))


@query(
    """SELECT event_id, round(p(r), 6) AS price, round(p(r + 0.5) - p(r - 0.5), 6) AS step FROM (SELECT event_id, (event_id % 160 - 16)::DOUBLE AS r FROM events)""".replace(
        "p(r + 0.5)", "(CASE WHEN r + 0.5 < 20 THEN 84 * exp((r + 0.5 - 20) / 20 * ln(84 / 40.0::DOUBLE)) WHEN r + 0.5 <= 84 THEN 84 + (r + 0.5 - 20) * 0.5 ELSE 116 * exp((r + 0.5 - 84) / 44 * ln(250 / 116.0::DOUBLE)) END)"
    ).replace("p(r - 0.5)", "(CASE WHEN r - 0.5 < 20 THEN 84 * exp((r - 0.5 - 20) / 20 * ln(84 / 40.0::DOUBLE)) WHEN r - 0.5 <= 84 THEN 84 + (r - 0.5 - 20) * 0.5 ELSE 116 * exp((r - 0.5 - 84) / 44 * ln(250 / 116.0::DOUBLE)) END)")
    .replace("p(r)", "(CASE WHEN r < 20 THEN 84 * exp((r - 20) / 20 * ln(84 / 40.0::DOUBLE)) WHEN r <= 84 THEN 84 + (r - 20) * 0.5 ELSE 116 * exp((r - 84) / 44 * ln(250 / 116.0::DOUBLE)) END)")
)
def row_to_price_hybrid(spark, sf_dir):
    """Prices and heights of rows on a hybrid scale."""
    row = (F.col("event_id") % 160 - 16).cast("double")
    return sa.table(spark, sf_dir, "events").select("event_id", F.round(hybrid().row_to_price(row), 6).alias("price"), F.round(hybrid().step_at_row(row), 6).alias("step"))


@query("SELECT event_id, round((p - 70) / 0.5, 6) AS row, CASE WHEN round_even((p - 70) / 0.5, 0) BETWEEN 0 AND 127 THEN CAST(round_even((p - 70) / 0.5, 0) AS INTEGER) END AS bin FROM (SELECT event_id, 60.0::DOUBLE + value AS p FROM events)")
def price_to_row_linear(spark, sf_dir):
    """Rows of prices on a linear scale, and their bins."""
    p = 60.0 + F.col("value")
    return sa.table(spark, sf_dir, "events").select("event_id", F.round(linear().price_to_row(p), 6).alias("row"), fs.bin_row(linear(), p).alias("bin"))


@query(
    """SELECT event_id, dn_rows, round(core_p0, 6) AS core_p0, round(lo_price, 6) AS lo_price, round(hi_price, 6) AS hi_price FROM (
      SELECT event_id, mid - 16 AS core_p0, mid * 0.1 AS lo_price, mid * 3.0 AS hi_price,
        CAST(least(63, greatest(1, round_even(64 * ln((mid - 16) / (mid * 0.1)) / (ln((mid - 16) / (mid * 0.1)) + ln(mid * 3.0 / (mid + 16))), 0))) AS INTEGER) AS dn_rows
      FROM (SELECT event_id, 100.0::DOUBLE + value AS mid FROM events))"""
)
def hybrid_scale_build(spark, sf_dir):
    """A hybrid scale around a price."""
    made = fs.make_hybrid(100.0 + F.col("value"), rows=128, core_rows=64, core_step=0.5, up_mult=3.0, dn_floor=0.1)
    return sa.table(spark, sf_dir, "events").select("event_id", made.alias("s")).select("event_id", "s.dn_rows", *(F.round(f"s.{c}", 6).alias(c) for c in ("core_p0", "lo_price", "hi_price")))


@query(
    """SELECT event_id, round(p0, 6) AS p0, tick_multiple FROM (SELECT event_id, tm AS tick_multiple, round_even((mid - span / 2) / (0.5 * tm), 0) * (0.5 * tm) AS p0, mid, 0.5 * tm AS step
      FROM (SELECT event_id, mid, span, CAST(greatest(1, ceil(span / 64)) + j AS INTEGER) AS tm FROM (SELECT event_id, mid, (mid * 1.5::DOUBLE - mid * 0.5::DOUBLE) * 1.25::DOUBLE AS span, unnest(range(0, 17)) AS j FROM (SELECT event_id, 50.0::DOUBLE + value AS mid FROM events))))
    WHERE p0 + 128 * step >= mid * 1.5 QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY tick_multiple) = 1"""
)
def band_frames(spark, sf_dir):
    """Linear frames that cover half up and down."""
    made = fs.band_frame(50.0 + F.col("value"), up=0.5, down=0.5, tick=0.5, rows=128)
    return sa.table(spark, sf_dir, "events").select("event_id", made.alias("f")).select("event_id", F.round("f.p0", 6).alias("p0"), "f.tick_multiple")


@query("SELECT event_id, round((r * 0.5 + 70 - 60) / 1.5, 6) AS row, round(8 * 0.5 / 1.5, 6) AS span FROM (SELECT event_id, (event_id % 128)::DOUBLE AS r FROM events)")
def epoch_remap(spark, sf_dir):
    """A row and a span in the frame of another epoch."""
    target, row = fs.Scale.linear(60.0, 1.5, 128), (F.col("event_id") % 128).cast("double")
    return sa.table(spark, sf_dir, "events").select("event_id", F.round(fs.remap_row(row, linear(), target), 6).alias("row"), F.round(fs.remap_span(F.lit(8.0), linear(), target, row), 6).alias("span"))


# Ladder and history


@query(
    """SELECT l.stream, r AS row, 70 + 0.5::DOUBLE * r AS price, round(coalesce(bid, 0), 6) AS bid, round(coalesce(ask, 0), 6) AS ask,
      round(CASE WHEN bid > 0 THEN greatest(2, bid / most * 100) ELSE 0 END, 6) AS bid_pct, round(CASE WHEN ask > 0 THEN greatest(2, ask / most * 100) ELSE 0 END, 6) AS ask_pct, r = bb AS is_best_bid, r = ba AS is_best_ask
    FROM (SELECT l.*, n.bid, n.ask, greatest(max(n.bid) OVER (PARTITION BY l.stream), max(n.ask) OVER (PARTITION BY l.stream)) AS most
      FROM (SELECT stream, bb, ba, unnest(range(CAST(floor((bb + ba) / 2.0 + 0.5) AS INTEGER) - 10, CAST(floor((bb + ba) / 2.0 + 0.5) AS INTEGER) + 11))::INTEGER AS r
        FROM (SELECT stream, coalesce(b, a - 1) AS bb, greatest(coalesce(a, b + 1), coalesce(b, a - 1) + 1) AS ba FROM (SELECT stream, max(row) FILTER (bid > 0) AS b, min(row) FILTER (ask > 0) AS a FROM newest GROUP BY stream))) l
      LEFT JOIN newest n ON n.stream = l.stream AND n.row = l.r) l""",
    "newest",
)
def dom_ladder(spark, sf_dir):
    """The ladder around the middle of the newest column."""
    return ol.dom_ladder(cells(spark, sf_dir), linear(), 128).select("stream", "row", "price", *r6("bid", "ask", "bid_pct", "ask_pct"), "is_best_bid", "is_best_ask")


@query("SELECT stream, price, side, CAST(rank AS INTEGER) AS rank FROM (SELECT stream, price, side, row_number() OVER (PARTITION BY stream, side ORDER BY CASE WHEN side = 0 THEN -price ELSE price END) AS rank FROM intervals JOIN (SELECT stream, max(till_ns) AS last FROM intervals GROUP BY stream) USING (stream) WHERE till_ns = last AND from_ns < last) WHERE rank <= 15", "intervals")
def book_top_n(spark, sf_dir):
    """best levels of each side of the books that stand at the end."""
    spans = closed_intervals(spark, sf_dir)
    last = spans.groupBy("stream").agg(F.max("till_ns").alias("last"))
    standing = spans.join(last, "stream").where("till_ns = last AND from_ns < last").select("stream", F.lit(0).alias("seq"), "side", "price")
    return ol.book_top(standing, 15).select("stream", "price", "side", "rank")


PAGE_NS = 1_704_585_600_000_000_000  # a week into the data


@query(f"SELECT stream, t0_ns, CAST(row_number() OVER (PARTITION BY stream ORDER BY t0_ns) - 1 AS INTEGER) AS pos FROM (SELECT * FROM bars WHERE t0_ns < {PAGE_NS} QUALIFY row_number() OVER (PARTITION BY stream ORDER BY t0_ns DESC) <= 64)", "bars")
def history_page(spark, sf_dir):
    """A page of columns before a time."""
    return ol.history_page(bars_hourly(spark, sf_dir), PAGE_NS, 64).select("stream", "t0_ns", "pos")


@query("SELECT stream, col_seq, part FROM (SELECT stream, col_seq, max(part) AS part FROM (SELECT stream, col_seq, 1 AS part FROM bars UNION ALL SELECT stream, col_seq, 2 FROM bars WHERE col_seq % 3 = 0) GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY stream ORDER BY col_seq DESC) <= 50", "bars")
def tail_dedup(spark, sf_dir):
    """The last columns, the newest file first."""
    b = bars_hourly(spark, sf_dir).select("stream", "col_seq")
    both = b.withColumn("part", F.lit(1)).unionByName(b.where("col_seq % 3 = 0").withColumn("part", F.lit(2)))
    return ol.tail(both, 50, "part")


def traded(spark, sf_dir):
    """Columns with trades only, numbered by time."""
    b = ob.trade_bars(sa.trades(spark, sf_dir), HOUR)
    return b.select("stream", F.col("col_idx").alias("col_seq"), (F.col("col_idx") * HOUR).alias("t0_ns"))


@query("SELECT stream, col_seq + 1 AS from_seq, nx - 1 AS till_seq, nx - 1 - col_seq AS n FROM (SELECT stream, col_idx AS col_seq, lead(col_idx) OVER (PARTITION BY stream ORDER BY col_idx) AS nx FROM hours) WHERE nx > col_seq + 1", "hours")
def gap_runs(spark, sf_dir):
    """Runs of hours without a trade."""
    return ol.gap_runs(traded(spark, sf_dir))


@query("SELECT stream, min(col_idx) AS from_seq, max(col_idx) AS till_seq, count(*) AS n FROM (SELECT *, col_idx - row_number() OVER (PARTITION BY stream ORDER BY col_idx) AS run FROM hours WHERE col_idx % 5 < 3) GROUP BY stream, run", "hours")
def dropped_runs(spark, sf_dir):
    """Dropped columns as one gap a run."""
    return ol.dropped_runs(traded(spark, sf_dir).where("col_seq % 5 < 3"))


@query("SELECT stream, bool_and(coalesce(ok, true)) AS contiguous FROM (SELECT stream, col_idx = lag(col_idx) OVER (PARTITION BY stream ORDER BY col_idx) + 1 AS ok FROM hours) GROUP BY stream", "hours")
def contiguity(spark, sf_dir):
    """Whether columns follow one another."""
    return ol.contiguous(traded(spark, sf_dir))


@query(f"SELECT t.stream, t.seq FROM trades t JOIN (SELECT stream, min(t0_ns) AS lo, max(t0_ns) AS hi FROM (SELECT * FROM bars WHERE t0_ns < {PAGE_NS} QUALIFY row_number() OVER (PARTITION BY stream ORDER BY t0_ns DESC) <= 64) GROUP BY stream) p ON t.stream = p.stream AND t.ts_ns >= lo AND t.ts_ns < hi + 3600000000000", "trades", "bars")
def trades_in_page(spark, sf_dir):
    """The trades within a page of columns."""
    page = ol.history_page(bars_hourly(spark, sf_dir), PAGE_NS, 64)
    return ol.in_range_of(sa.trades(spark, sf_dir), page, HOUR).select("stream", "seq")


@query("SELECT b.stream, b.col_seq, b.epoch, 70.0::DOUBLE + 5 * b.epoch AS p0 FROM (SELECT stream, col_seq, CAST(col_seq // 100 AS INTEGER) AS epoch FROM bars) b WHERE stream <> '3' OR (SELECT max(col_seq) FROM bars x WHERE x.stream = '3') < 200", "bars")
def columns_with_epochs(spark, sf_dir):
    """Columns with their epochs; a stream that lacks one is left out."""
    columns = bars_hourly(spark, sf_dir).select("stream", "col_seq", F.floor(F.col("col_seq") / 100).cast("int").alias("epoch"))
    epochs = columns.select("stream", "epoch").distinct().where("stream != '3' OR epoch != 2").withColumn("p0", (70.0 + 5 * F.col("epoch")))
    return ol.with_epochs(columns, epochs).select("stream", "col_seq", "epoch", "p0")


# Profiles and candles


@query(
    """SELECT stream, b * 0.01::DOUBLE AS px, round(v * (1000 / max(v) OVER (PARTITION BY stream)), 6) AS size, CASE WHEN b * 0.01::DOUBLE <= ref THEN 0 ELSE 1 END AS side
    FROM (SELECT stream, CAST(round_even((h + l + c) / 3 / 0.01, 0) AS BIGINT) AS b, sum(volume) AS v FROM candles GROUP BY 1, 2) JOIN (SELECT stream, arg_max(c, t0_ns) AS ref FROM candles GROUP BY stream) USING (stream)""".replace("b * 0.01::DOUBLE AS px", "round(b * 0.01::DOUBLE, 6) AS px"),
    "candles",
)
def vap_split(spark, sf_dir):
    """Volume at price, split at the last close."""
    return op.volume_at_price(sa.candles(spark, sf_dir)).select("stream", *r6("px", "size"), "side")


@query(
    """SELECT stream, col_seq, t0_ns, row, round(CASE WHEN row <= cr THEN z ELSE 0 END, 6) AS bid, round(CASE WHEN row > cr THEN z ELSE 0 END, 6) AS ask
    FROM (SELECT *, """ + HALF.format(x="y") + """ AS z FROM (SELECT *, per * (1000 / max(per) OVER (PARTITION BY stream)) AS y
      FROM (SELECT stream, col_seq, t0_ns, cr, volume / (least(hr, 127) - greatest(lr, 0) + 1) AS per, unnest(range(greatest(lr, 0), least(hr, 127) + 1))::INTEGER AS row
        FROM (SELECT c.stream, n AS col_seq, t0 AS t0_ns, volume, CAST(round_even((l - p0) / 5.0, 0) AS BIGINT) AS lr, CAST(round_even((h - p0) / 5.0, 0) AS BIGINT) AS hr, CAST(round_even((c - p0) / 5.0, 0) AS BIGINT) AS cr
          FROM gridded c JOIN (SELECT stream, round_even((arg_max(c, n) - 320.0) / 5.0, 0) * 5.0 AS p0 FROM gridded GROUP BY stream) USING (stream))
        WHERE greatest(lr, 0) <= least(hr, 127))))""",
    "gridded",
)
def candle_columns(spark, sf_dir):
    """Columns rebuilt from candles."""
    out = op.columns_from_candles(sa.candles(spark, sf_dir), tick=5.0, rows=128, dt_ns=WEEKS2)
    return out.select("stream", "col_seq", "t0_ns", "row", *r6("bid", "ask"))


WEEKS2 = 14 * 86_400_000_000_000


@query(
    f"""SELECT stream, n AS col_seq, t0 AS t0_ns, {s6('o', 'h', 'l', 'c')}, round(sum((h + l + c) / 3 * volume) OVER w, 6) AS vwap_num_cum, sum(volume) OVER w AS vwap_den_cum
    FROM gridded WINDOW w AS (PARTITION BY stream ORDER BY n ROWS UNBOUNDED PRECEDING)""",
    "gridded",
)
def candle_bars(spark, sf_dir):
    """Bars of rebuilt columns."""
    return op.bars_from_candles(sa.candles(spark, sf_dir), WEEKS2).select("stream", "col_seq", "t0_ns", *r6("o", "h", "l", "c", "vwap_num_cum"), "vwap_den_cum")


@query("SELECT stream, t0_ns, CAST(round_even((h + l + c) / 3 / 0.01, 0) AS BIGINT) AS bucket, sum(volume) OVER (PARTITION BY stream, round_even((h + l + c) / 3 / 0.01, 0) ORDER BY t0_ns ROWS UNBOUNDED PRECEDING) AS volume FROM candles", "candles")
def running_profile(spark, sf_dir):
    """The profile after each bar."""
    return op.running_profile(sa.candles(spark, sf_dir))


@query("SELECT stream, count(*) AS n, max(d) AS session FROM (SELECT stream, CAST(timezone('America/New_York', timezone('UTC', make_timestamp(t0_ns // 1000))) AS DATE) AS d FROM bars) QUALIFY false".replace(" QUALIFY false", "").replace("SELECT stream, count(*) AS n, max(d) AS session FROM (", "SELECT stream, count(*) AS n, d AS session FROM (SELECT *, max(d) OVER (PARTITION BY stream) AS last FROM (") + ") WHERE d = last GROUP BY stream, d", "bars")
def session_dates(spark, sf_dir):
    """What belongs to the latest session date of New York."""
    out = op.latest_session(bars_hourly(spark, sf_dir).select("stream", "t0_ns"))
    return out.groupBy("stream", "session").agg(F.count("*").alias("n")).select("stream", "n", "session")


# Discovery


@query("SELECT stream, round(price, 6) AS price, round(first, 6) AS first, round(change_pct, 6) AS change_pct, points FROM quoted", "quoted")
def quote_spark(spark, sf_dir):
    """Quotes with their spark lines; of the line, its number of points."""
    return oq.quotes(sa.candles(spark, sf_dir)).select("stream", *r6("price", "first", "change_pct"), F.size("spark").cast("long").alias("points"))


@query("SELECT stream, round(change_pct, 6) AS change_pct FROM quoted WHERE change_pct IS NOT NULL ORDER BY abs(change_pct) DESC, stream LIMIT 3", "quoted")
def movers(spark, sf_dir):
    """the largest changes."""
    return oq.movers(oq.quotes(sa.candles(spark, sf_dir)), 3).select("stream", *r6("change_pct"))


@query("SELECT id, symbol, market FROM directory WHERE grp = 'crypto' AND contains(lower(symbol), 'ring') ORDER BY id LIMIT 50", "directory")
def directory_filter(spark, sf_dir):
    """Part of the directory."""
    return oq.filter_directory(sa.directory(spark, sf_dir), "Ring", "crypto", 50)


@query("SELECT id, symbol FROM directory WHERE contains(lower(symbol), 'quit') OR contains(lower(market), 'quit') OR contains(grp, 'quit')", "directory")
def symbol_filter(spark, sf_dir):
    """Symbols by name, market or group."""
    return oq.filter_symbols(sa.directory(spark, sf_dir), "quit").select("id", "symbol")


def ranked_sql(q: str) -> str:
    return f"SELECT id, round(greatest(by_symbol, by_market - 60), 6) AS score FROM (SELECT id, symbol, {score_sql('symbol', q, 'by_symbol')}, {score_sql('market', q, 'by_market')} FROM directory) WHERE greatest(by_symbol, by_market - 60) >= 0 ORDER BY score DESC, length(symbol), id LIMIT 60"


@query(ranked_sql("quit"), "directory")
def fuzzy_rank(spark, sf_dir):
    """Best matches of a search."""
    return oq.fuzzy_rank(sa.directory(spark, sf_dir), "quit").select("id", *r6("score"))


@query(ranked_sql("ring"), "directory")
def fuzzy_rank_all(spark, sf_dir):
    """Best matches of a search, with loose ones and those by market."""
    return oq.fuzzy_rank(sa.directory(spark, sf_dir), "ring").select("id", *r6("score"))


@query(f"SELECT id, symbol, round(score, 6) AS score FROM (SELECT id, symbol, {score_sql('symbol', 'rdg', 'score')} FROM directory) WHERE score BETWEEN 0 AND 400", "directory")
def fuzzy_loose(spark, sf_dir):
    """Scores of loose matches, whose letters come in order with others between."""
    d = sa.directory(spark, sf_dir)
    return d.select("id", "symbol", F.round(oq.fuzzy_score("rdg", F.col("symbol")), 6).alias("score")).where("score BETWEEN 0 AND 400")


def venues_sql(q: str) -> str:
    return f"SELECT id, market, CAST(row_number() OVER (ORDER BY score DESC, length(market), market) AS INTEGER) AS pos FROM (SELECT id, market, {score_sql('market', q, 'score')} FROM (SELECT min(id) AS id, market FROM directory GROUP BY market)) WHERE score >= 0"


def ranked_venues(spark: SparkSession, sf_dir: str, q: str) -> DataFrame:
    options = sa.directory(spark, sf_dir).groupBy("market").agg(F.min("id").alias("id")).withColumn("label", F.col("market"))
    place = F.row_number().over(Window.orderBy(F.desc("score"), F.length("market"), "market"))  # of at most 300 rows
    return oq.rank_venues(options, q).withColumn("pos", place).select("id", "market", "pos")


@query(venues_sql("vn2"), "directory")
def venue_rank(spark, sf_dir):
    """Venues by loose matches with their names."""
    return ranked_venues(spark, sf_dir, "vn2")


@query(venues_sql("venue1"), "directory")
def venue_rank_all(spark, sf_dir):
    """Venues by the score of their names, with loose matches."""
    return ranked_venues(spark, sf_dir, "venue1")


@query("SELECT id, grp, CAST(CASE grp WHEN 'crypto' THEN 1 WHEN 'equity' THEN 2 ELSE 3 END AS INTEGER) AS group_rank, CAST(row_number() OVER (PARTITION BY grp ORDER BY id) AS INTEGER) AS pos FROM directory", "directory")
def symbol_groups(spark, sf_dir):
    """Symbols in the order of their groups."""
    return oq.group_symbols(sa.directory(spark, sf_dir)).select("id", "grp", "group_rank", "pos")


@query("SELECT d.id, CASE WHEN d.id % 3 = 0 THEN 'X-' || d.symbol ELSE d.symbol END AS resolved FROM directory d", "directory")
def symbol_resolution(spark, sf_dir):
    """Spellings of venues."""
    d = sa.directory(spark, sf_dir)
    wanted = d.select(F.col("id"), F.concat_ws("#", "symbol", "id").alias("symbol"), "market")
    mapping = wanted.where("id % 3 = 0").withColumn("venue_symbol", F.concat(F.lit("X-"), "symbol"))
    return oq.resolve_symbols(wanted, mapping).select("id", F.regexp_replace("resolved", "#.*", "").alias("resolved"))


@query("SELECT id, grp, CASE grp WHEN 'crypto' THEN 'L2' WHEN 'equity' THEN 'SYNTH' END AS depth, CASE grp WHEN 'crypto' THEN 'cap cap--depth' WHEN 'equity' THEN 'cap cap--synth' END AS class FROM directory", "directory")
def directory_capability(spark, sf_dir):
    """What each class of markets offers, as chips."""
    tiers = spark.createDataFrame([("crypto", "l2"), ("equity", "synth")], "grp string, depth string")
    out = oq.with_capability(sa.directory(spark, sf_dir), tiers)
    chip = F.try_element_at(oq.capability_chips(F.col("depth"), F.lit(None).cast("string"), F.lit(None).cast("string")), F.lit(1))
    return out.select("id", "grp", chip.alias("depth"), F.when(chip.isNotNull(), oq.chip_class(chip)).alias("class"))


@query("SELECT d.id, round(q.change_pct, 6) AS change_pct FROM directory d LEFT JOIN quoted q ON q.stream = CASE WHEN d.id % 6 = 0 THEN '1-URGENT' WHEN d.id % 6 = 1 THEN '5-LOW' ELSE '-' END", "directory", "quoted")
def search_quotes(spark, sf_dir):
    """Rows of a search with quotes where there are any."""
    d = sa.directory(spark, sf_dir).withColumn("stream", F.when(F.col("id") % 6 == 0, "1-URGENT").when(F.col("id") % 6 == 1, "5-LOW").otherwise("-"))
    return d.join(oq.quotes(sa.candles(spark, sf_dir)), "stream", "left").select("id", *r6("change_pct"))


# Labels


@query(
    """SELECT event_id, strftime(make_timestamp(ns // 1000), '%Y%m%d-%H') AS hour_key, strftime(make_timestamp(ns // 1000), '%H:%M:%S') AS clock FROM (SELECT event_id, epoch_us(ts) * 1000 AS ns FROM events)"""
)
def time_labels(spark, sf_dir):
    """Hour keys and clocks."""
    e = sa.table(spark, sf_dir, "events").select("event_id", sa.nanos(F.col("ts")).alias("ns"))
    return e.select("event_id", ft.hour_key(F.col("ns")).alias("hour_key"), ft.clock(F.col("ns")).alias("clock"))


@query("SELECT event_id, round(n * power(10.0, floor(log10(value + 0.001))), 9) AS step, round(greatest(2.5, least(20, 4.5 * sqrt(value / 4))), 6) AS radius FROM (SELECT *, CASE WHEN f <= 1 THEN 1 WHEN f <= 2 THEN 2 WHEN f <= 5 THEN 5 ELSE 10 END AS n FROM (SELECT event_id, value, (value + 0.001) / power(10.0, floor(log10(value + 0.001))) AS f FROM events))")
def nice_steps(spark, sf_dir):
    """Nice steps of axes, and radii of prints."""
    e = sa.table(spark, sf_dir, "events")
    return e.select("event_id", F.round(ft.nice_step(F.col("value") + 0.001), 9).alias("step"), F.round(ft.bubble_radius(F.col("value")), 6).alias("radius"))


@query("SELECT s_suppkey, regexp_replace(s_name || '/x:y', '[/\\\\:]', '_', 'g') AS safe, CAST(split_part(s_name, '#', 2) AS VARCHAR) AS tail FROM supplier")
def safe_names(spark, sf_dir):
    """Names that are safe in paths."""
    s = sa.table(spark, sf_dir, "supplier")
    return s.select("s_suppkey", ft.safe_name(F.concat("s_name", F.lit("/x:y"))).alias("safe"), F.split_part("s_name", F.lit("#"), F.lit(2)).alias("tail"))


@query("SELECT event_id, round(100 + (ns - 1704067200000000000) / 3600000000000.0::DOUBLE, 6) AS col FROM (SELECT event_id, epoch_us(ts) * 1000 AS ns FROM events)")
def ts_to_column(spark, sf_dir):
    """Fractional columns of times."""
    e = sa.table(spark, sf_dir, "events")
    return e.select("event_id", F.round(ft.ts_to_col(sa.nanos(F.col("ts")), F.lit(1_704_067_200_000_000_000), F.lit(100), F.lit(HOUR)), 6).alias("col"))
