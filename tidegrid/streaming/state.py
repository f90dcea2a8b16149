"""State of micro-batches: small tables in a shared folder, under the number of the batch that reads them.

A batch reads the tables of its own number and writes those of the next, in place of what a former try left. Tables
of the last two numbers are kept, so the last batch can be tried again; older ones are deleted.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

#: Orders before all rows of a stream.
BEFORE_ALL = -(1 << 62)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, none where there is no such folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@dataclass(frozen=True)
class StateTables:
    """Tables by kind; ``base`` is a folder that all executors see."""

    base: str
    schemas: dict[str, str] = field(hash=False)

    def read(self, spark: SparkSession, kind: str, batch: int) -> DataFrame:
        """The table that ``batch`` starts from; only the first batch may have none."""
        try:
            return spark.read.schema(self.schemas[kind]).parquet(f"{self.base}/{kind}/at={batch}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            if batch:
                raise ValueError(f"batch {batch} has no state in {self.base}/{kind}: it was deleted, or batches before it went elsewhere") from e
            return spark.createDataFrame([], self.schemas[kind])

    def keep(self, rows: DataFrame, kind: str, batch: int) -> None:
        """What the batch after ``batch`` starts from."""
        rows.select(*(f.split(" ")[0] for f in self.schemas[kind].split(", "))).write.mode("overwrite").parquet(f"{self.base}/{kind}/at={batch + 1}")

    def prune(self, spark: SparkSession, batch: int) -> None:
        """Delete what neither ``batch``, tried again, nor the next one reads."""
        for kind in self.schemas:
            for name in children(spark, f"{self.base}/{kind}"):
                if name.startswith("at=") and int(name[3:]) < batch:
                    remove(spark, f"{self.base}/{kind}/{name}")
