"""Queries of views, ladders, venues, candle sources and searches, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegrid.functions import text as ft
from tidegrid.operators import discovery as oq
from tidegrid.operators import ingest as oi
from tidegrid.operators import ladder as ol
from tidegrid.operators import views as ov
from tidegrid.plans.registry import HOUR, PAGE_NS, bars_hourly, cells, closed_intervals, linear, query, r6, s6
from tidegrid.plans.sql import score_sql
from tidegrid.sources import adapters as sa
from tidegrid.sources import catalog as sc

DAY = 24 * HOUR


# Columns on view


@query(
    """SELECT b.stream, col_seq, round(4 + (1 - (cvd_cum - lo) / (hi - lo)) * 92, 6) AS y, round((col_seq + 0.5 - 100) / 400 * 1200, 6) AS x FROM bars b
    JOIN (SELECT stream, a - (z - a) * 0.08 AS lo, z + (z - a) * 0.08 AS hi FROM (SELECT stream, least(0, min(cvd_cum)) AS a, greatest(0, max(cvd_cum)) AS z FROM bars GROUP BY stream)) USING (stream)""",
    "bars",
)
def cvd_strip(spark, sf_dir):
    """The strip of cumulative volume delta, in pixels."""
    b = bars_hourly(spark, sf_dir).withColumnRenamed("cvd_cum", "cvd")
    placed = b.join(ov.cvd_bounds(b), "stream")
    x = ov.strip_x(F.col("col_seq"), F.lit(100), F.lit(500), 1200.0)
    return placed.select("stream", "col_seq", F.round(ov.strip_y(F.col("cvd"), F.col("lo"), F.col("hi"), 100.0), 6).alias("y"), F.round(x, 6).alias("x"))


@query(
    """SELECT stream, CAST(place AS INTEGER) AS place, round(c, 6) AS price, CAST(sign(last - first) AS INTEGER) AS direction
    FROM (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY t0_ns) - 1 AS place, arg_min(c, t0_ns) OVER (PARTITION BY stream) AS first, arg_max(c, t0_ns) OVER (PARTITION BY stream) AS last
      FROM (SELECT * FROM candles QUALIFY row_number() OVER (PARTITION BY stream ORDER BY t0_ns DESC) <= 64))""",
    "candles",
)
def spark_lines(spark, sf_dir):
    """The points of each quote's spark line, and where it leads."""
    lines = oq.quotes(sa.candles(spark, sf_dir)).select("stream", "spark", ov.spark_direction(F.col("spark")).alias("direction"))
    return lines.select("stream", "direction", F.posexplode("spark").alias("place", "price")).select("stream", "place", *r6("price"), "direction")


@query(
    """SELECT stream, oldest, newest, n, round(greatest(0, least(1, (100 - oldest) / greatest(1, newest - oldest)::DOUBLE)) * 100, 6) AS left_pct,
      round(greatest(0, least(1, (180 - oldest) / greatest(1, newest - oldest)::DOUBLE)) * 100, 6) AS right_pct, greatest(0, newest + 1 - 180) AS behind_cols, CAST(greatest(0, newest + 1 - 180) * 3600000000000 AS BIGINT) AS behind_ns
    FROM (SELECT stream, min(col_seq) AS oldest, max(col_seq) AS newest, count(*) AS n FROM bars GROUP BY stream)""",
    "bars",
)
def session_minimap(spark, sf_dir):
    """The extent of a session, a view in it, and how far that trails."""
    out = ov.minimap(ov.session_extent(bars_hourly(spark, sf_dir)), F.lit(100), F.lit(180), HOUR)
    return out.select("stream", "oldest", "newest", "n", *r6("left_pct", "right_pct"), F.col("behind_cols").cast("long").alias("behind_cols"), "behind_ns")


@query("SELECT stream, max(col_seq) - least(267, count(*)) + 1 AS first, least(267, count(*)) AS visible FROM bars GROUP BY stream", "bars")
def default_view(spark, sf_dir):
    """The columns that a view of 800 pixels starts with."""
    return ov.default_window(ov.session_extent(bars_hourly(spark, sf_dir)), 800)


@query(f"SELECT stream, col_seq, {s6('cvd_cum')}, CAST(row_number() OVER (PARTITION BY stream ORDER BY col_seq) - 1 AS INTEGER) AS place FROM bars WHERE col_seq BETWEEN 11 AND 140", "bars")
def cvd_series(spark, sf_dir):
    """a series within a range of columns."""
    return ov.series(bars_hourly(spark, sf_dir), "cvd_cum", 10.4, 140.9).select("stream", "col_seq", *r6("cvd_cum"), "place")


@query("SELECT stream, col_seq FROM (SELECT *, max(col_seq) OVER (PARTITION BY stream) AS m FROM bars) WHERE col_seq > m - 100", "bars")
def ring_view(spark, sf_dir):
    """Columns that a ring of a hundred still holds."""
    return ov.within_ring(bars_hourly(spark, sf_dir), 100).select("stream", "col_seq")


def epoched(spark, sf_dir):
    """Columns with an epoch for every hundred of them."""
    return bars_hourly(spark, sf_dir).withColumn("epoch", F.floor(F.col("col_seq") / 100).cast("int"))


@query(
    """SELECT stream, CAST(row_number() OVER (PARTITION BY stream ORDER BY col_seq NULLS LAST, kind = 'column', epoch) AS INTEGER) AS place, kind, epoch, col_seq
    FROM (SELECT stream, 'column' AS kind, CAST(col_seq // 100 AS INTEGER) AS epoch, col_seq FROM bars
      UNION ALL SELECT stream, 'epoch', CAST(col_seq // 100 AS INTEGER), min(col_seq) FROM bars GROUP BY 1, 3 UNION ALL SELECT DISTINCT stream, 'epoch', 99, NULL::BIGINT FROM bars)""",
    "bars",
)
def epoch_announcements(spark, sf_dir):
    """An epoch comes before its first column; epoch 99 is current and has none yet."""
    c = epoched(spark, sf_dir)
    epochs = c.select("stream", "epoch").union(c.select("stream", F.lit(99))).distinct()
    return ov.announced(c, epochs)


@query(
    """SELECT stream, session, epoch, col_seq, CASE WHEN (session <> 'now' AND er IS NULL) OR n_rows <> coalesce(er, n_rows) THEN 'drop' WHEN ring IS NULL THEN 'create' WHEN ring <> coalesce(er, n_rows) THEN 'rebuild' ELSE 'write' END AS action
    FROM (SELECT stream, CASE WHEN col_seq % 7 = 0 THEN 'old' ELSE 'now' END AS session, CAST(col_seq // 100 AS INTEGER) AS epoch, col_seq, CASE WHEN col_seq % 5 = 0 THEN 64 ELSE 128 END AS n_rows,
      CASE WHEN col_seq // 100 % 2 = 0 AND col_seq % 7 <> 0 THEN 128 END AS er, CASE stream WHEN '0' THEN 128 WHEN '1' THEN 64 END AS ring FROM bars)""",
    "bars",
)
def gate_admission(spark, sf_dir):
    """What a view does with each column that arrives. Every seventh is of a former session, every fifth is short."""
    c = epoched(spark, sf_dir).select("stream", F.when(F.col("col_seq") % 7 == 0, "old").otherwise("now").alias("session"), "epoch", "col_seq", F.when(F.col("col_seq") % 5 == 0, 64).otherwise(128).alias("n_rows"))
    sessions = c.select("stream").distinct().select("stream", F.lit("now").alias("session"), F.when(F.col("stream") == "0", 128).when(F.col("stream") == "1", 64).alias("ring_rows"))
    epochs = c.where("session = 'now' AND epoch % 2 = 0").select("stream", "session", "epoch").distinct().withColumn("epoch_rows", F.lit(128))
    return ov.admitted(c, sessions, epochs).select("stream", "session", "epoch", "col_seq", "action")


def attached(spark, sf_dir):
    c, t = epoched(spark, sf_dir), sa.trades(spark, sf_dir)
    epochs = c.select("stream", "epoch").union(c.select("stream", F.lit(99))).distinct()
    return ov.attach_snapshot(c, epochs, epochs.where("epoch = 99"), t.where("side = 1"), t, t.where("seq % 7 = 0"), HOUR)


LAST_COLUMNS = "last AS (SELECT * FROM bars QUALIFY row_number() OVER (PARTITION BY stream ORDER BY t0_ns DESC) <= 512)"


@query(
    f"""SELECT 'columns' AS kind, stream, col_seq AS id FROM ({LAST_COLUMNS.removeprefix('last AS (')} UNION ALL SELECT DISTINCT 'epochs', stream, col_seq // 100 FROM ({LAST_COLUMNS.removeprefix('last AS (')} UNION ALL SELECT DISTINCT 'epochs', stream, 99 FROM bars
    UNION ALL SELECT 'markers', t.stream, seq FROM trades t JOIN (SELECT stream, min(t0_ns) AS lo, max(t0_ns) AS hi FROM ({LAST_COLUMNS.removeprefix('last AS (')} GROUP BY stream) w ON t.stream = w.stream AND side = 1 AND ts_ns >= lo AND ts_ns < hi + 3600000000000
    UNION ALL SELECT 'trades', stream, seq FROM (SELECT * FROM trades QUALIFY row_number() OVER (PARTITION BY stream ORDER BY ts_ns DESC, seq DESC) <= 500)
    UNION ALL SELECT 'quote', stream, max(seq) FROM trades WHERE seq % 7 = 0 GROUP BY stream""",
    "trades", "bars",
)
def attach_snapshot(spark, sf_dir):
    """What a client that joins is sent; errors stand for markers, every seventh trade for a quote."""
    parts = attached(spark, sf_dir)
    ids = {"columns": "col_seq", "epochs": "epoch", "markers": "seq", "trades": "seq", "quote": "seq"}
    out = None
    for kind, column in ids.items():
        part = parts[kind].select(F.lit(kind).alias("kind"), "stream", F.col(column).cast("long").alias("id"))
        out = part if out is None else out.unionByName(part)
    return out


@query(
    f"""SELECT stream, t0_ns, {s6('c')}, CASE WHEN t0_ns >= {PAGE_NS} THEN 'live' ELSE 'reconstructed' END AS provenance FROM bars""",
    "bars",
)
def seeded_columns(spark, sf_dir):
    """A stream that starts late is seeded with rebuilt columns, which are told apart."""
    b = bars_hourly(spark, sf_dir).select("stream", "t0_ns", *r6("c"))
    return ov.seeded(b.where(F.col("t0_ns") >= PAGE_NS), b)


# Books and ladders


def midnight_levels(spark, sf_dir):
    """Levels that stood at each midnight, as books: (stream, seq, side, price, size), ``seq`` being the day."""
    spans = closed_intervals(spark, sf_dir).where("till_ns > from_ns")
    first, last = -F.floor(-F.col("from_ns") / DAY).cast("long"), -F.floor(-F.col("till_ns") / DAY).cast("long") - 1
    inside = F.when(first <= last, F.sequence(first, F.greatest(first, last))).otherwise(F.array().cast("array<bigint>"))
    return spans.select("stream", F.explode(inside).alias("seq"), "side", "price", "size")


MIDNIGHT = "SELECT stream, unnest(range(CAST(-((-from_ns) // 86400000000000) AS BIGINT), CAST(-((-till_ns) // 86400000000000) AS BIGINT))) AS seq, side, price, size FROM intervals WHERE till_ns > from_ns".replace("-((-from_ns) // 86400000000000)", "(from_ns + 86399999999999) // 86400000000000").replace("-((-till_ns) // 86400000000000)", "(till_ns + 86399999999999) // 86400000000000")


@query(f"SELECT stream, seq, side, price, {s6('size')}, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY stream, seq, side ORDER BY CASE WHEN side = 0 THEN -price ELSE price END) AS rank FROM ({MIDNIGHT})) WHERE rank <= 15", "intervals")
def book_top_daily(spark, sf_dir):
    """best levels of each side of the books of every midnight."""
    return ol.book_top(midnight_levels(spark, sf_dir), 15).select("stream", "seq", "side", "price", *r6("size"), "rank")


@query(
    f"""SELECT stream, seq, coalesce((bb + ba) / 2, (bb + bl) / 2, (ba + ah) / 2) AS ref FROM (SELECT stream, seq, max(price) FILTER (side = 0) AS bb, min(price) FILTER (side = 0) AS bl, min(price) FILTER (side = 1) AS ba, max(price) FILTER (side = 1) AS ah
      FROM ({MIDNIGHT}) GROUP BY 1, 2)""",
    "intervals",
)
def anchor_references(spark, sf_dir):
    """The price that each midnight's book is anchored at."""
    return oi.anchor_reference(midnight_levels(spark, sf_dir))


SIZES = """SELECT stream, r AS row, 70 + 0.5::DOUBLE * r AS price, round({bid}, 6) AS bid, round({ask}, 6) AS ask, round({profile}, 6) AS profile, round(CASE WHEN {own} > 0 THEN greatest(2, {own} / most * 100) ELSE 0 END, 6) AS pct, {bb} AS is_best_bid, {ba} AS is_best_ask, round(middle, 6) AS middle, round(spread, 6) AS spread"""


@query(
    SIZES.format(bid="0.0::DOUBLE", ask="0.0::DOUBLE", profile="p", own="p", bb="false", ba="false")
    + """ FROM (SELECT *, max(p) OVER (PARTITION BY stream) AS most FROM (SELECT l.*, coalesce(n.bid, 0) AS p
      FROM (SELECT stream, middle, NULL::DOUBLE AS spread, unnest(range(CAST(middle AS INTEGER) - 10, CAST(middle AS INTEGER) + 11))::INTEGER AS r FROM (SELECT stream, arg_max(row, bid * 1e6 - row * 1e-6)::DOUBLE AS middle FROM newest WHERE bid > 1e-6 GROUP BY stream)) l
      LEFT JOIN newest n ON n.stream = l.stream AND n.row = l.r))""",
    "newest",
)
def ladder_profile(spark, sf_dir):
    """The ladder of a profile, around the row with most."""
    out = ol.dom_ladder(cells(spark, sf_dir), linear(), 128, shape="profile")
    return out.select("stream", "row", "price", *r6("bid", "ask", "profile"), F.round("profile_pct", 6).alias("pct"), "is_best_bid", "is_best_ask", *r6("middle", "spread"))


QUOTED = "SELECT stream, price - 0.25 AS bid_px, 3.0 AS bid_sz, price + 0.25 AS ask_px, 5.0 AS ask_sz FROM trades WHERE seq % 7 = 0 QUALIFY row_number() OVER (PARTITION BY stream ORDER BY seq DESC) = 1"


@query(
    SIZES.format(bid="CASE WHEN r = bb THEN 3.0 ELSE 0.0 END", ask="CASE WHEN r = ba THEN 5.0 ELSE 0.0 END", profile="0.0::DOUBLE", own="(CASE WHEN r = ba THEN 5.0::DOUBLE ELSE 0.0::DOUBLE END)", bb="r = bb", ba="r = ba").replace("/ most", "/ 5.0")
    + f""" FROM (SELECT *, unnest(range(c - 10, c + 11))::INTEGER AS r FROM (SELECT stream, CAST(floor((bid_px - 70) / 0.5 + 0.5) AS INTEGER) AS bb, CAST(floor((ask_px - 70) / 0.5 + 0.5) AS INTEGER) AS ba, ((bid_px + ask_px) / 2 - 70) / 0.5::DOUBLE AS middle,
      CAST(floor(((bid_px + ask_px) / 2 - 70) / 0.5 + 0.5) AS INTEGER) AS c, CAST(ask_px - bid_px AS DOUBLE) AS spread FROM ({QUOTED})))""",
    "trades",
)
def ladder_quote(spark, sf_dir):
    """The ladder of a quote alone; every seventh trade stands for one."""
    last = ol.newest_of(sa.trades(spark, sf_dir).where("seq % 7 = 0"), 1, ("seq",))
    quotes = last.select("stream", (F.col("price") - 0.25).alias("bid_px"), F.lit(3.0).alias("bid_sz"), (F.col("price") + 0.25).alias("ask_px"), F.lit(5.0).alias("ask_sz"))
    out = ol.dom_ladder(cells(spark, sf_dir), linear(), 128, shape="l1", quotes=quotes)
    return out.select("stream", "row", "price", *r6("bid", "ask", "profile"), F.round("ask_pct", 6).alias("pct"), "is_best_bid", "is_best_ask", *r6("middle", "spread"))


@query(
    """SELECT l.stream, l.r AS row, round(coalesce(n.bid, 0), 6) AS bid, round(coalesce(n.ask, 0), 6) AS ask, round((b + a) / 2.0, 6) AS middle, round((a - b) * 0.5, 6) AS spread
    FROM (SELECT stream, max(row) FILTER (bid > 1e-6) AS b, min(row) FILTER (ask > 1e-6) AS a, unnest(range(55, 66))::INTEGER AS r FROM newest GROUP BY stream) l LEFT JOIN newest n ON n.stream = l.stream AND n.row = l.r""",
    "newest",
)
def ladder_locked(spark, sf_dir):
    """A ladder that stays around row 60, with middle and spread."""
    out = ol.dom_ladder(cells(spark, sf_dir), linear(), 128, visible=10, locked=60)
    return out.select("stream", "row", *r6("bid", "ask", "middle", "spread"))


# Venues, candles, quotes


def venue_names(spark, sf_dir):
    """Nations stand for venues, in lower case, and two of the names that can't be streamed."""
    names = sa.table(spark, sf_dir, "nation").select(F.lower("n_name").alias("id"))
    return names.unionByName(spark.createDataFrame([("coingecko",), ("derive",)], "id string"))


@query(
    """SELECT lower(n_name) AS id, 'crypto' AS kind, n_nationkey % 4 = 0 AS native, CASE WHEN n_nationkey % 2 = 0 THEN 'linear,spot' ELSE '' END AS segments, 2 AS place FROM nation UNION ALL SELECT 'sim', 'sim', true, '', 0 UNION ALL SELECT 'equity', 'equity', true, '', 1"""
)
def venue_catalog(spark, sf_dir):
    """All venues that can be streamed."""
    n = sa.table(spark, sf_dir, "nation").select("n_nationkey", F.lower("n_name").alias("id"))
    segments = n.where("n_nationkey % 2 = 0").select("id", F.explode(F.array(F.lit("spot"), F.lit("linear"))).alias("segment"))
    out = sc.venue_catalog(venue_names(spark, sf_dir), n.where("n_nationkey % 4 = 0").select("id"), segments)
    return out.select("id", "kind", "native", F.array_join("segments", ",").alias("segments"), "place")


@query(
    """SELECT market, symbol, CASE WHEN kind = 1 THEN 'short list: choose a venue for all of its symbols' END AS note FROM (
      SELECT 'sim' AS market, 'DEMO' AS symbol, 0 AS kind UNION ALL SELECT 'crypto', n_name, 1 FROM nation UNION ALL SELECT 'equity', r_name, 2 FROM region)"""
)
def directory_build(spark, sf_dir):
    """The directory of three parts."""
    part = lambda name, column, market: sa.table(spark, sf_dir, name).select(F.lit(market).alias("market"), F.col(column).alias("symbol"))
    return sc.build_directory(spark.createDataFrame([("sim", "DEMO")], "market string, symbol string"), part("nation", "n_name", "crypto"), part("region", "r_name", "equity"))


@query("SELECT id, market, CASE WHEN market = 'sim' THEN 'sim' WHEN market = 'equity' THEN 'equity' WHEN id % 9 <> 0 THEN 'crypto' END AS kind FROM (SELECT id, CASE WHEN id % 9 = 0 THEN 'derive-spot' ELSE market END AS market FROM directory)", "directory")
def market_routes(spark, sf_dir):
    """Which kind of source serves a market."""
    d = sa.directory(spark, sf_dir).select("id", F.when(F.col("id") % 9 == 0, "derive-spot").otherwise(F.col("market")).alias("market"))
    return d.withColumn("kind", sc.route(F.col("market")))


RAW = "SELECT stream, t0_ns // 1000000 AS ts, CASE WHEN n % 5 = 0 THEN NULL ELSE o END AS o, h, l, c, CASE WHEN n % 3 = 0 THEN NULL ELSE volume END AS volume FROM (SELECT *, t0_ns // 604800000000000 AS n FROM candles)"


def raw_candles(spark, sf_dir):
    """Rows of a provider: milliseconds, some without an open, some without a volume."""
    n = F.floor(F.col("t0_ns") / 604_800_000_000_000)
    c = sa.candles(spark, sf_dir)
    return c.select("stream", F.floor(F.col("t0_ns") / 1_000_000).cast("long").alias("ts"), F.when(n % 5 != 0, F.col("o")).alias("o"), "h", "l", "c", F.when(n % 3 != 0, F.col("volume")).alias("volume"))


@query(f"SELECT stream, ts * 1000000 AS t0_ns, {s6('o', 'c')}, coalesce(volume, 0) AS volume FROM (SELECT * FROM ({RAW}) QUALIFY row_number() OVER (PARTITION BY stream ORDER BY ts DESC) <= 100) WHERE o IS NOT NULL", "candles")
def candle_reader(spark, sf_dir):
    """The newest hundred rows of a provider as candles."""
    return sc.candles_from(raw_candles(spark, sf_dir), 100).select("stream", "t0_ns", *r6("o", "c"), "volume")


NOW_NS = 852_076_800_000_000_000  # 1997-01-01


@query(
    f"SELECT stream, t0_ns, {s6('c')}, CASE WHEN stream < '3' THEN 'native' ELSE 'unified' END AS origin FROM candles WHERE t0_ns >= {NOW_NS} - 60 * 604800000000000 AND t0_ns < {NOW_NS}", "candles"
)
def candle_fallback(spark, sf_dir):
    """Native candles where a stream has any, else those of the unified reader."""
    c = sa.candles(spark, sf_dir)
    out = sc.candles_with_fallback(c.where("stream < '3'"), c, NOW_NS, 60, 604_800_000_000_000)
    return out.select("stream", "t0_ns", *r6("c"), "origin")


@query(
    """SELECT market, symbol, as_of, 12 - as_of > 3 AS stale FROM (SELECT market, symbol, as_of, max(as_of) OVER (PARTITION BY market) AS newest
      FROM (SELECT DISTINCT market, symbol, CAST(id % 15 AS INTEGER) AS as_of FROM directory WHERE id % 15 <= 12 AND id % 4 <> 0)) WHERE as_of = newest""",
    "directory",
)
def last_good_symbols(spark, sf_dir):
    """The last listing of each venue that worked, and whether it is stale."""
    d = sa.directory(spark, sf_dir).select("market", (F.col("id") % 15).cast("int").alias("as_of"), F.when(F.col("id") % 4 != 0, F.col("symbol")).alias("symbol"))
    return sc.last_good(d, 12, 3)


@query("SELECT stream, round(change_pct, 6) AS change_pct, CAST(row_number() OVER (ORDER BY abs(change_pct) DESC, stream) AS INTEGER) AS place FROM quoted WHERE change_pct IS NOT NULL", "quoted")
def movers_of_two(spark, sf_dir):
    """the largest changes of two markets as one list."""
    q = oq.quotes(sa.candles(spark, sf_dir)).where("change_pct IS NOT NULL")
    return oq.merged_movers(q.where("stream < '3'"), q.where("stream >= '3'")).select("stream", *r6("change_pct"), "place")


@query(
    """SELECT event_id, CASE WHEN value >= 100 THEN 1 WHEN value >= 50 THEN 100 WHEN value >= 10 THEN 50 WHEN value >= 5 THEN 10 WHEN value >= 2 THEN 5 ELSE 2 END AS speed, CAST(least(8, greatest(0, ceil(-log10(value / 1000 + 1e-9)))) AS INTEGER) AS digits,
      CAST(greatest(1, floor(value * 1e9 / 250000000 + 0.5)) AS BIGINT) AS columns, CASE WHEN event_type IN ('native', 'wide', 'full', 'deep') THEN event_type ELSE 'native' END AS band FROM events WHERE value > 0"""
)
def settings(spark, sf_dir):
    """The next speed, digits of prices, columns of a history, known bands."""
    e = sa.table(spark, sf_dir, "events").where("value > 0")
    v = F.col("value")
    columns = ft.history_columns(v * 1e9, F.lit(250_000_000))
    return e.select("event_id", ft.next_speed(v).alias("speed"), ft.price_decimals(v / 1000 + 1e-9).alias("digits"), columns.alias("columns"), ft.known_band(F.col("event_type")).alias("band"))


# Searches with every tier


@query(
    f"SELECT id, round(greatest(by_symbol, by_market - 60), 6) AS score FROM (SELECT id, symbol, {score_sql('symbol', 'rdg', 'by_symbol')}, {score_sql('market', 'rdg', 'by_market')} FROM directory) WHERE greatest(by_symbol, by_market - 60) >= 0 ORDER BY round(greatest(by_symbol, by_market - 60), 9) DESC, length(symbol), id LIMIT 60",
    "directory",
)
def fuzzy_rank_loose(spark, sf_dir):
    """Best matches of a search that only loose ones meet."""
    return oq.fuzzy_rank(sa.directory(spark, sf_dir), "rdg").select("id", *r6("score"))


@query(f"SELECT id, round(score, 6) AS score FROM (SELECT id, {score_sql('symbol', 'rdg', 'score')} FROM directory) WHERE score >= 0", "directory")
def fuzzy_scores(spark, sf_dir):
    """Scores of all tiers of matches."""
    return sa.directory(spark, sf_dir).select("id", F.round(oq.fuzzy_score("rdg", F.col("symbol")), 6).alias("score")).where("score >= 0")


@query(
    f"SELECT market, round(score, 6) AS score, CAST(row_number() OVER (ORDER BY score DESC, length(market), market) AS INTEGER) AS pos FROM (SELECT market, {score_sql('market', 've1sp', 'score')} FROM (SELECT DISTINCT market FROM directory)) WHERE score >= 0", "directory"
)
def venue_rank_loose(spark, sf_dir):
    """Venues by the score of their names, loose matches included."""
    options = sa.directory(spark, sf_dir).select("market").distinct().withColumn("label", F.col("market"))
    place = F.row_number().over(Window.orderBy(F.desc("score"), F.length("market"), "market"))  # of at most 300 rows
    return oq.rank_venues(options, "ve1sp").withColumn("pos", place).select("market", *r6("score"), "pos")
