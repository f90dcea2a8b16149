"""Cells of the grid laid out for reading few of them: in tiles of columns, each sorted by stream, column and row.

A cell is found by the folder of its tile, then by the least and largest values that Parquet keeps of every file and
group of rows, so a read opens the files of one tile alone, and of these the groups that can hold it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.functions.ints import floor_div

TILE_COLUMNS = 1024
_ORDER = ("tile", "stream", "col_idx", "row")


def write_cells(cells: DataFrame, path: str, tile_columns: int = TILE_COLUMNS, mode: str = "overwrite") -> None:
    """Write cells (stream, col_idx, row, ...) by tile; a tile that many cells fall into takes several files, by ranges."""
    tiled = cells.withColumn("tile", floor_div(F.col("col_idx"), tile_columns))
    tiled.repartitionByRange(*_ORDER).sortWithinPartitions(*_ORDER).write.mode(mode).partitionBy("tile").parquet(path)


def cells_at(spark: SparkSession, path: str, stream: str, col_lo: int, col_hi: int, row_lo: int, row_hi: int, tile_columns: int = TILE_COLUMNS) -> DataFrame:
    """Cells of a stream in a block of columns and rows, ends included."""
    tiles = F.col("tile").between(col_lo // tile_columns, col_hi // tile_columns)
    inside = F.col("col_idx").between(col_lo, col_hi) & F.col("row").between(row_lo, row_hi)
    return spark.read.parquet(path).where(tiles & (F.col("stream") == stream) & inside).drop("tile")
