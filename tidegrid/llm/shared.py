"""What the operators of this subpackage share: the cluster's shared folder, written tables, splits."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which all executors see.

    A local folder is set only where the session has no such setting and runs on one machine, as in tests.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tidegrid-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/tidegrid-{uuid.uuid4().hex}"


_CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def saved(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read again: cut lineage that outlives executors.

    Once it is written nothing needs the shuffle files of its plan, so Spark deletes them then.
    """
    spark = df.sparkSession
    path = shared_dir(spark)
    former = spark.conf.get(_CLEANUP_KEY)
    spark.conf.set(_CLEANUP_KEY, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP_KEY, former)
    return spark.read.schema(df.schema).parquet(path)


#: Rows that Spark hands to Python at a time: texts of some KB make batches of some MB.
BATCH_ROWS = 1000
_BATCH_KEY, _SPARKS_OWN = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"


def in_python(rows: DataFrame, run, schema: str) -> DataFrame:
    """``rows.mapInPandas(run, schema)`` in small batches, as a batch is held several times over, in and out of the JVM.

    The session's batch size is lowered to ``BATCH_ROWS`` where it is Spark's own; any other stays as it is.
    """
    conf = rows.sparkSession.conf
    if conf.get(_BATCH_KEY) == _SPARKS_OWN:
        conf.set(_BATCH_KEY, str(BATCH_ROWS))
    return rows.mapInPandas(run, schema)


def discard(df: DataFrame) -> None:
    """Delete the files of a table made by ``saved`` that nothing will read again."""
    spark = df.sparkSession
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/tidegrid-" in path:
            jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
            jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def crc_of_id(column: str = "doc_id") -> Column:
    """CRC-32 of the id as decimal text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def chosen_by_hash(key: Column, salt: int, share: Column) -> Column:
    """Whether a key is in a sample of this share, by all 63 bits of a hash, so that shares may be as small as tables are large."""
    return F.shiftrightunsigned(F.xxhash64(key, F.lit(salt)), 1).cast("double") < share * float(1 << 63)


def blocks(lengths, most: int):
    """Split row numbers 0..n-1 into consecutive (start, stop) whose lengths sum to about ``most``."""
    start = total = 0
    for i, n in enumerate(lengths):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)
