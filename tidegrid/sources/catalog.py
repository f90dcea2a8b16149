"""Venues, the symbol directory, and where a market's events and candles come from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.operators.discovery import EQUITY_MARKETS
from tidegrid.operators.ladder import newest_of

#: Venues that can be read but not streamed.
NOT_STREAMABLE = ("coingecko", "base_onchain", "gmx_synthetix", "superchain", "derive")
MINUTE_NS = 60_000_000_000


def streamable(venues: DataFrame, excluded: tuple[str, ...] = NOT_STREAMABLE) -> DataFrame:
    """Venues (id) but those that can't be streamed."""
    return venues.where(~F.col("id").isin(*excluded))


def venue_catalog(venues: DataFrame, native: DataFrame, segments: DataFrame) -> DataFrame:
    """(id, kind, native, segments, place): the synthetic market, equities, then the streamable venues by name.

    ``venues`` and ``native`` are (id), ``segments`` (id, segment).
    """
    listed = segments.groupBy("id").agg(F.sort_array(F.collect_set("segment")).alias("segments"))  # a few words for each venue
    crypto = streamable(venues).distinct().join(native.select("id", F.lit(True).alias("n")).distinct(), "id", "left").join(listed, "id", "left")
    none = F.array().cast("array<string>")
    crypto = crypto.select("id", F.lit("crypto").alias("kind"), F.coalesce("n", F.lit(False)).alias("native"), F.coalesce("segments", none).alias("segments"), F.lit(2).alias("place"))
    own = venues.sparkSession.createDataFrame([("sim", "sim", True, [], 0), (EQUITY_MARKETS[0], "equity", True, [], 1)], "id string, kind string, native boolean, segments array<string>, place int")
    return own.unionByName(crypto)


def build_directory(sim: DataFrame, crypto: DataFrame, equity: DataFrame, note: str = "short list: choose a venue for all of its symbols") -> DataFrame:
    """(market, symbol, note) of the three parts, each (market, symbol); only the short list of crypto symbols has a note."""
    noted = lambda df, text: df.select("market", "symbol", F.lit(text).cast("string").alias("note"))
    return noted(sim, None).unionByName(noted(crypto, note)).unionByName(noted(equity, None))


def last_good(snapshots: DataFrame, now_ns: int, ttl_ns: int) -> DataFrame:
    """(market, symbol, as_of, stale) of each market's newest snapshot that lists any symbol; ``stale`` if it is older than ``ttl_ns``.

    ``snapshots`` are (market, as_of, symbol), one row with a null symbol for a listing that failed.
    """
    good = snapshots.where(F.col("symbol").isNotNull() & (F.col("as_of") <= now_ns))
    newest = good.groupBy("market").agg(F.max("as_of").alias("as_of"))
    return good.join(newest, ["market", "as_of"], "left_semi").select("market", "symbol", "as_of").distinct().withColumn("stale", F.lit(now_ns) - F.col("as_of") > ttl_ns)


def route(market: Column) -> Column:
    """Which kind of source serves a market: sim, equity or crypto; null for a name that none serves."""
    venue = F.lower(F.substring_index(market, "-", 1))
    named = F.coalesce(F.length(F.trim(market)), F.lit(0)) > 0
    return F.when(market == "sim", "sim").when(market.isin(*EQUITY_MARKETS), "equity").when(named & ~venue.isin(*NOT_STREAMABLE), "crypto")


def source_for(market: str, spark: SparkSession, builders: dict[str, Callable[[str], DataFrame]]) -> DataFrame:
    """The events of a market from the builder of its kind; a ValueError for a market that has none."""
    kind = spark.range(1).select(route(F.lit(market)).alias("k")).first()["k"]
    if kind not in builders:
        raise ValueError(f"market {market!r} has no source: expected sim, {', '.join(EQUITY_MARKETS)}, or exchange[-segment]")
    return builders[kind](market)


def candles_from(rows: DataFrame, most: int, unit_ns: int = 1_000_000) -> DataFrame:
    """Candles from provider rows (stream, ts, o, h, l, c, volume, and a taker split if there is one): the newest ``most`` of each stream.

    The cap comes first, as providers count rows; rows that lack a time or price then go, a missing volume is 0.
    """
    split = [F.col(c).cast("double").alias(c) if c in rows.columns else F.lit(None).cast("double").alias(c) for c in ("buy_volume", "sell_volume")]
    timed = rows.select("stream", (F.col("ts").cast("long") * unit_ns).alias("t0_ns"), *(F.col(c).cast("double").alias(c) for c in "ohlc"), F.coalesce(F.col("volume").cast("double"), F.lit(0.0)).alias("volume"), *split)
    return newest_of(timed, most, ("t0_ns",)).drop("rank").where("t0_ns IS NOT NULL AND o IS NOT NULL AND h IS NOT NULL AND l IS NOT NULL AND c IS NOT NULL")


def candles_with_fallback(native: DataFrame, unified: DataFrame, now_ns: int, most: int, span_ns: int = MINUTE_NS) -> DataFrame:
    """Native candles of the streams that have any in the time asked for, as only these know the taker split; the others' from ``unified``."""
    recent = lambda df: df.where((F.col("t0_ns") >= now_ns - most * span_ns) & (F.col("t0_ns") < now_ns))
    own = recent(native)
    rest = recent(unified).join(own.select("stream").distinct(), "stream", "left_anti")
    return own.withColumn("origin", F.lit("native")).unionByName(rest.withColumn("origin", F.lit("unified")), allowMissingColumns=True)
