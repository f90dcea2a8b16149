"""Trades as they arrive: sides from the latest quote, and repeats of trade ids.

Both carry little from batch to batch: the last quote, price and assigned side of a stream, and the ids in the window.
What is carried comes before the rows of a batch, which then go through the batch operators, so results equal these
over all rows, however the rows are cut into batches.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegrid.operators.bars import quote_rule
from tidegrid.streaming.state import BEFORE_ALL, StateTables

#: Events: kind ``quote`` with bid_px and ask_px, kind ``trade`` with price and size; of one ``seq`` quotes come first.
EVENTS = "stream string, seq long, ts_ns long, kind string, price double, size double, bid_px double, ask_px double"
_SIDES = {"quotes": "stream string, bid_px double, ask_px double", "prints": "stream string, price double, side int"}
_IDS = {"ids": "stream string, trade_id string, place long", "counts": "stream string, places long"}


@dataclass(frozen=True)
class LiveSides:
    """For ``writeStream.foreachBatch``: trades with ``side`` by the quote rule, else the tick rule, in ``base``/trades."""

    base: str
    state: StateTables = field(init=False, hash=False)

    def __post_init__(self):
        object.__setattr__(self, "state", StateTables(f"{self.base}/state", _SIDES))

    def __call__(self, events: DataFrame, batch: int) -> None:
        spark = events.sparkSession
        before = F.lit(BEFORE_ALL).alias("seq")
        standing, last = (self.state.read(spark, kind, batch) for kind in _SIDES)
        quotes = events.where("kind = 'quote'").select("stream", "seq", "bid_px", "ask_px").unionByName(standing.withColumn("seq", before))
        trades = events.where("kind = 'trade'").select("stream", "seq", "ts_ns", "price", "size")
        sided = quote_rule(trades, quotes, last.withColumn("seq", before))
        sided.write.mode("overwrite").parquet(path := f"{self.base}/trades/batch={batch}")
        done = spark.read.schema(sided.schema).parquet(path)
        self.state.keep(quotes.groupBy("stream").agg(F.max_by(F.struct("bid_px", "ask_px"), "seq").alias("x")).select("stream", "x.*"), "quotes", batch)
        newest = done.groupBy("stream").agg(F.max_by("price", F.when(F.col("price").isNotNull(), F.col("seq"))).alias("price"), F.max_by("side", "seq").alias("side"))
        kept = newest.join(last.withColumnRenamed("price", "_former").drop("side"), "stream", "left").withColumn("price", F.coalesce("price", "_former"))
        self.state.keep(kept.unionByName(last.join(newest, "stream", "left_anti"), allowMissingColumns=True), "prints", batch)
        self.state.prune(spark, batch)

    def trades(self, spark) -> DataFrame:
        """Trades with their sides so far."""
        return spark.read.parquet(f"{self.base}/trades").drop("batch")


@dataclass(frozen=True)
class LiveIds:
    """For ``writeStream.foreachBatch``: trades without those whose id is among the last ``window`` ids accepted.

    An id that left the window is new again, so at most ``window`` ids a stream are kept. Whether a repeat is in the
    window depends on what was accepted before it; repeats are decided in rounds, each with the counts that follow from
    the one before, until nothing changes. Nearly always one round is enough, as few ids return after leaving.
    """

    base: str
    window: int = 4096
    state: StateTables = field(init=False, hash=False)

    def __post_init__(self):
        object.__setattr__(self, "state", StateTables(f"{self.base}/state", _IDS))

    def __call__(self, trades: DataFrame, batch: int) -> None:
        spark = trades.sparkSession
        held, counts = (self.state.read(spark, kind, batch) for kind in _IDS)
        named = F.coalesce(F.col("trade_id"), F.lit("")) != ""
        at = Window.partitionBy("stream", "trade_id").orderBy("seq")
        rows = trades.where(named).select("stream", "trade_id", "seq").withColumn("n", F.row_number().over(at))
        rows = rows.join(held, ["stream", "trade_id"], "left").join(counts, "stream", "left").withColumn("places", F.coalesce("places", F.lit(0)))
        # First guess: a repeat of what is held, or stands before it in the batch, is a repeat.
        decided = self._step(rows.withColumn("fresh", (F.col("n") == 1) & F.col("place").isNull()), batch, 0)
        number = 0
        while True:
            number += 1
            again = self._step(self._judged(decided), batch, number)
            changed = again.join(decided.select("stream", "seq", "trade_id", F.col("fresh").alias("_was")), ["stream", "seq", "trade_id"]).where("fresh <> _was")
            decided = again
            if changed.isEmpty():
                break
        keys = decided.where("fresh").select("stream", "seq", "trade_id")
        kept = trades.where(named).join(keys, ["stream", "seq", "trade_id"], "left_semi").unionByName(trades.where(~named))
        kept.write.mode("overwrite").parquet(f"{self.base}/trades/batch={batch}")
        placed = self._placed(decided).where("fresh").select("stream", "trade_id", F.col("_at").alias("place"))
        total = counts.unionByName(placed.groupBy("stream").agg(F.max("place").alias("places"))).groupBy("stream").agg(F.max("places").alias("places"))
        every = held.unionByName(placed).groupBy("stream", "trade_id").agg(F.max("place").alias("place"))
        self.state.keep(every.join(total, "stream").where(F.col("place") > F.col("places") - self.window), "ids", batch)
        self.state.keep(total, "counts", batch)
        self.state.prune(spark, batch)

    def _step(self, rows: DataFrame, batch: int, number: int) -> DataFrame:
        path = f"{self.base}/work/round={number}"
        rows.write.mode("overwrite").parquet(path)
        return rows.sparkSession.read.schema(rows.schema).parquet(path)

    def _placed(self, rows: DataFrame) -> DataFrame:
        """Rows with ``_at``: ids accepted by then, the row's own included if it is."""
        return rows.withColumn("_at", F.col("places") + F.sum(F.col("fresh").cast("long")).over(Window.partitionBy("stream").orderBy("seq", "trade_id")))

    def _judged(self, rows: DataFrame) -> DataFrame:
        """``fresh`` anew, with the places that follow from the former decisions."""
        placed = self._placed(rows).withColumn("_before", F.col("_at") - F.col("fresh").cast("long"))
        own = Window.partitionBy("stream", "trade_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
        last = F.coalesce(F.max(F.when(F.col("fresh"), F.col("_at"))).over(own), F.col("place"))
        judged = placed.withColumn("_last", last)
        return judged.withColumn("fresh", F.col("_last").isNull() | (F.col("_before") - F.col("_last") >= self.window)).select(*rows.columns)

    def trades(self, spark) -> DataFrame:
        """Accepted trades so far."""
        return spark.read.parquet(f"{self.base}/trades").drop("batch")
