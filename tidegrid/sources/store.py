"""The recorded store: columns, trades, markers and epochs in Parquet, by market, symbol, band and UTC hour.

Writes go through Spark's own commit protocol. Each batch has a folder of its own within the hour, and a batch that
is written again overwrites its folders, so nothing is stored twice. Reads prune hours by folder and push the rest
down.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tidegrid import schemas
from tidegrid.functions.text import hour_key, safe_name
from tidegrid.operators import ladder

KEYS = ("market", "symbol", "band")
KINDS = {"columns": schemas.CELL, "bars": schemas.BAR, "trades": schemas.TRADE, "markers": schemas.MARKER, "epochs": schemas.EPOCH}
_TIME = {"columns": "t0_ns", "bars": "t0_ns", "trades": "ts_ns", "markers": "ts_ns"}


def schema_of(kind: str) -> StructType:
    extra = [StructField(k, StringType()) for k in (*KEYS, "hour")] + [StructField("batch", LongType())]
    return StructType([*KINDS[kind].fields, *extra])


def write(rows: DataFrame, base: str, kind: str, batch: int = 0) -> None:
    """Write rows of one kind as batch ``batch``, in place of what that batch wrote before in the same hours.

    They need market, symbol and band besides their own columns.
    """
    time = F.col(_TIME[kind]) if kind in _TIME else F.lit(0)
    out = rows.select(
        *(F.col(f.name).cast(f.dataType).alias(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in KINDS[kind]),
        *(safe_name(F.col(k)).alias(k) for k in KEYS), (hour_key(time) if kind in _TIME else F.lit("all")).alias("hour"), F.lit(batch).cast("long").alias("batch"),
    )
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*KEYS, "hour", "batch").parquet(f"{base}/{kind}")


def sink(base: str, kind: str):
    """For ``writeStream.foreachBatch``: each batch under its own number, so a batch that is tried again adds no rows twice."""

    def each(rows: DataFrame, batch: int) -> None:
        write(rows, base, kind, batch)

    return each


def read(spark: SparkSession, base: str, kind: str) -> DataFrame:
    """Rows of one kind, none if there never were any; files that cannot be read are passed over."""
    reader = spark.read.schema(schema_of(kind)).option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true")
    try:
        return reader.parquet(f"{base}/{kind}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema_of(kind))


def in_hours(rows: DataFrame, kind: str, lo_ns: int, hi_ns: int) -> DataFrame:
    """Rows with lo <= time < hi; whole folders outside are never opened."""
    time = F.col(_TIME[kind])
    lo, hi = (hour_key(F.lit(t)) for t in (lo_ns, max(lo_ns, hi_ns - 1)))
    return rows.where((F.col("hour") >= lo) & (F.col("hour") <= hi) & (time >= lo_ns) & (time < hi_ns))


def tail(spark: SparkSession, base: str, market: str, symbol: str, band: str, now_ns: int, most_age_ns: int, n: int) -> dict[str, DataFrame]:
    """What a restart needs: the last ``n`` fresh bar columns, their cells and epochs, and the trades and markers in their time.

    Empty where an epoch of any of them is missing.
    """
    own = lambda kind: read(spark, base, kind).where((F.col("market") == market) & (F.col("symbol") == symbol) & (F.col("band") == band))
    recent = in_hours(own("bars"), "bars", max(0, now_ns - most_age_ns), now_ns + 1)
    bars = ladder.tail(recent, n, "batch")
    epochs = own("epochs").dropDuplicates(["stream", "epoch"]).drop(*KEYS, "hour", "batch")
    usable = ladder.with_epochs(bars.select("stream", "epoch", "col_seq", "t0_ns"), epochs.select("stream", "epoch", "dt_ns"))
    bars = bars.join(usable.select("stream", "col_seq"), ["stream", "col_seq"], "left_semi")
    span = usable.groupBy("stream").agg(F.min("t0_ns").alias("_lo"), F.max(F.col("t0_ns") + F.col("dt_ns")).alias("_hi"))
    inside = lambda df: df.join(F.broadcast(span), "stream").where("ts_ns >= _lo AND ts_ns < _hi").drop("_lo", "_hi")  # noqa: E731  one row a stream of one instrument
    cells = own("columns").join(bars.select("stream", "epoch", "col_seq", "batch"), ["stream", "epoch", "col_seq", "batch"], "left_semi")
    epochs = epochs.join(bars.select("stream", "epoch").distinct(), ["stream", "epoch"], "left_semi")
    return {"bars": bars, "columns": cells, "epochs": epochs, "trades": inside(own("trades")), "markers": inside(own("markers"))}


def files(spark: SparkSession, base: str) -> DataFrame:
    """(market, symbol, kind, name, size, path) of every file in the store."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(base).select("path", "length")
    part = lambda k: F.regexp_extract("path", rf"/{k}=([^/]*)/", 1)
    kind = F.regexp_extract("path", rf"/({'|'.join(KINDS)})/market=", 1)
    name = F.concat_ws("-", part("hour"), F.substring_index("path", "/", -1))
    return found.select(part("market").alias("market"), part("symbol").alias("symbol"), kind.alias("kind"), name.alias("name"), F.col("length").alias("size"), "path")


def enforce_retention(spark: SparkSession, base: str, most_bytes: int) -> list[str]:
    """Delete the files that ``operators.ladder.retained`` selects; returns their paths."""
    chosen = [r["path"] for r in ladder.retained(files(spark, base), most_bytes).toLocalIterator()]
    hadoop = spark._jsc.hadoopConfiguration()
    for p in chosen:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(hadoop).delete(path, False)
    return chosen


def book_columns(cells: DataFrame, rows: int) -> DataFrame:
    """Cells as dense arrays (stream, epoch, col_seq, t0_ns, bid, ask array<float>) for consumers of whole columns."""
    listed = cells.groupBy("stream", "epoch", "col_seq", "t0_ns").agg(F.map_from_entries(F.collect_list(F.struct("row", "bid"))).alias("b"), F.map_from_entries(F.collect_list(F.struct("row", "ask"))).alias("a"))
    dense = lambda m: F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), lambda r: F.coalesce(F.col(m)[r], F.lit(0.0)).cast("float"))
    return listed.select("stream", "epoch", "col_seq", "t0_ns", dense("b").alias("bid"), dense("a").alias("ask"))
