"""Recording of the live grid by streaming queries of its own.

They read what the grid has finished and write it to the store, so a store that fails ends the recording alone, and
the grid's own query never waits for it. From its checkpoint a recording goes on where it ended.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidegrid.sources import store
from tidegrid.streaming.live import LiveGrid

#: Results of the grid, and the kinds of the store that hold them.
RECORDED = {"cells": "columns", "bars": "bars", "epochs": "epochs"}


def record(spark: SparkSession, grid: LiveGrid, base: str, key: dict[str, str], checkpoint: str, trigger: dict, sink: Callable[[str, str], Callable[[DataFrame, int], None]] = store.sink) -> dict[str, StreamingQuery]:
    """Start the recording of one instrument (``key`` has market, symbol and band): a query for each kind that there is.

    ``trigger`` are the arguments of ``DataStreamWriter.trigger``, such as the time between two flushes.
    """
    out = {}
    for own, kind in RECORDED.items():
        if own == "epochs" and grid.frame is None:
            continue
        schema = spark.read.parquet(f"{grid.base}/{own}").drop("batch").schema
        rows = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{grid.base}/{own}").withColumns({k: F.lit(v) for k, v in key.items()})
        out[kind] = rows.writeStream.foreachBatch(sink(base, kind)).option("checkpointLocation", f"{checkpoint}/{kind}").trigger(**trigger).start()
    return out
