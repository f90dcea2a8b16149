"""What views need of finished columns, kept up as they finish: log histograms of tiles, and two levels of block sums.

Histograms add up, so the counts so far are the state. Block sums are written when all columns of a block are finished,
those of the second level when all of sixteen are; until then the block's cells wait in the state.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.functions.ints import floor_div
from tidegrid.operators import density as od
from tidegrid.operators.normalize import log_histogram
from tidegrid.streaming.state import StateTables, children

_CELLS = "stream string, col_idx long, row int, bid double, ask double"
_STATE = {"last": "stream string, last_col long", "histogram": "stream string, tile long, bin int, n long", "waiting1": _CELLS, "waiting2": _CELLS}


def finished(bars: DataFrame, cells: DataFrame) -> DataFrame:
    """(stream, col_idx, row, bid, ask) of finished columns; one without cells has a row without a row number."""
    return bars.select("stream", "col_idx").join(cells.select("stream", "col_idx", "row", "bid", "ask"), ["stream", "col_idx"], "left")


@dataclass(frozen=True)
class LiveTiles:
    """For ``foreachBatch`` over rows as ``finished`` gives them; columns of a stream come once each, in any number a batch."""

    base: str
    state: StateTables = field(init=False, hash=False)

    def __post_init__(self):
        object.__setattr__(self, "state", StateTables(f"{self.base}/state", _STATE))

    def __call__(self, columns: DataFrame, batch: int) -> None:
        spark = columns.sparkSession
        former = {kind: self.state.read(spark, kind, batch) for kind in _STATE}
        own = columns.where("row IS NOT NULL").select("stream", "col_idx", "row", "bid", "ask")
        last = former["last"].unionByName(columns.groupBy("stream").agg(F.max("col_idx").alias("last_col"))).groupBy("stream").agg(F.max("last_col").alias("last_col"))
        self.state.keep(former["histogram"].unionByName(log_histogram(own)).groupBy("stream", "tile", "bin").agg(F.sum("n").alias("n")), "histogram", batch)
        level1 = self._level(own.unionByName(former["waiting1"]), last, 1, batch)
        self._level(level1.unionByName(former["waiting2"]), od.coarser(last), 2, batch)
        self.state.keep(last, "last", batch)
        self.state.prune(spark, batch)

    def _level(self, cells: DataFrame, last: DataFrame, level: int, batch: int) -> DataFrame:
        """Write the blocks that are whole now, and keep the cells of the others; the blocks written."""
        sums = od.pyramid(cells, last=last)
        sums.write.mode("overwrite").parquet(path := f"{self.base}/level{level}/batch={batch}")
        whole = (floor_div(F.col("col_idx"), 4) + 1) * 4 <= F.col("last_col") + 1
        self.state.keep(cells.join(last, "stream").where(~whole), f"waiting{level}", batch)
        return cells.sparkSession.read.schema(sums.schema).parquet(path)

    def level(self, spark: SparkSession, number: int) -> DataFrame:
        """Block sums of a level so far."""
        return spark.read.parquet(f"{self.base}/level{number}").drop("batch")

    def histogram(self, spark: SparkSession) -> DataFrame:
        """Counts by tile and bin after the last batch that ended."""
        folder = f"{self.base}/state/histogram"
        done = [int(n[3:]) for n in children(spark, folder) if "_SUCCESS" in children(spark, f"{folder}/{n}")]
        return self.state.read(spark, "histogram", max(done))
