"""Canonical streams made of general tables: events become trades and book updates, orders become candles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TICK, P0, ROWS = 0.5, 70.0, 128
HOUR_NS = 3_600_000_000_000
SNAPSHOT_EVERY = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nanos(ts: Column) -> Column:
    """Nanoseconds of a timestamp read as UTC; a timestamp without zone is taken as UTC, whatever the session's zone."""
    utc = F.make_timestamp_ltz(F.year(ts), F.month(ts), F.dayofmonth(ts), F.hour(ts), F.minute(ts), F.extract(F.lit("SECOND"), ts), F.lit("UTC"))
    return F.unix_micros(utc) * 1000


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    return e.select(
        (F.col("user_id") % 4).cast("string").alias("stream"), F.col("event_id").alias("seq"), nanos(F.col("ts")).alias("ts_ns"),
        (75.0 + 0.5 * k).alias("price"), F.col("value").alias("value"), F.col("event_type"), k.alias("k"),
    )


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stream, seq, ts_ns, price, size, side): purchases buy, errors sell, the rest is of unknown side."""
    side = F.when(F.col("event_type") == "purchase", 0).when(F.col("event_type") == "error", 1).otherwise(2)
    return _events(spark, sf_dir).select("stream", "seq", "ts_ns", "price", F.col("value").alias("size"), side.alias("side"))


def level_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stream, seq, ts_ns, side, price, amount, is_snapshot): an error removes its level, every 500th event starts the book anew."""
    amount = F.when(F.col("event_type") == "error", 0.0).otherwise(F.col("value"))
    side = F.when(F.col("k") < 50, 0).otherwise(1)
    snapshot = F.col("seq") % SNAPSHOT_EVERY == 0
    return _events(spark, sf_dir).select("stream", "seq", "ts_ns", side.alias("side"), "price", amount.alias("amount"), snapshot.alias("is_snapshot"))


def candles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stream, t0_ns, o, h, l, c, volume): a week of orders of one priority is a candle of total prices / 1000."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("stream"), "o_orderkey", (F.col("o_totalprice") / 1000).alias("price"), F.date_trunc("week", "o_orderdate").alias("t0"))
    return o.groupBy("stream", nanos(F.col("t0")).alias("t0_ns")).agg(
        F.min_by("price", "o_orderkey").alias("o"), F.max("price").alias("h"), F.min("price").alias("l"),
        F.max_by("price", "o_orderkey").alias("c"), F.count("*").cast("double").alias("volume"),
    )


def directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, symbol, market): parts as instruments; two brands stand for equities and the synthetic market."""
    market = F.when(F.col("p_brand") == "Brand#1", "equity").when(F.col("p_brand") == "Brand#2", "sim").otherwise(F.concat(F.lit("venue"), F.regexp_replace("p_brand", "Brand#", ""), F.lit("-spot")))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("symbol"), market.alias("market"))
