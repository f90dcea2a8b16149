"""Code that no query runs: files that can't be read, retention in a store, the quote in force."""

import os

from pyspark.sql import functions as F

from tests.test_store import bars
from tidegrid.operators import ladder
from tidegrid.sources import store


def parquet_files(base):
    return sorted(os.path.join(d, f) for d, _, names in os.walk(base) for f in names if f.endswith(".parquet"))


def test_files_that_cannot_be_read_are_passed_over(spark, tmp_path):
    store.write(bars(spark, 0, 4).coalesce(1), str(tmp_path), "bars", 0)
    first = parquet_files(tmp_path)
    store.write(bars(spark, 4, 8).coalesce(1), str(tmp_path), "bars", 1)
    broken = [f for f in parquet_files(tmp_path) if f not in first]
    for f in broken:
        with open(f, "wb") as out:
            out.write(b"not parquet at all")
    assert broken and sorted(r["col_seq"] for r in store.read(spark, str(tmp_path), "bars").collect()) == [0, 1, 2, 3]


def test_retention_deletes_the_oldest_files_of_a_store(spark, tmp_path):
    for n in range(4):
        store.write(bars(spark, 4 * n, 4 * n + 4).coalesce(1), str(tmp_path), "bars", n)
    every = parquet_files(tmp_path)
    size = sum(map(os.path.getsize, every))
    gone = store.enforce_retention(spark, f"file://{tmp_path}", size - 1)
    left = sorted(r["col_seq"] for r in store.read(spark, str(tmp_path), "bars").collect())
    assert len(gone) == 1 == len(every) - len(parquet_files(tmp_path)) and left == list(range(4, 16))
    assert store.enforce_retention(spark, f"file://{tmp_path}", size) == []


def test_the_quote_in_force(spark):
    quote = "stream string, bid_px double, ask_px double"
    feed = spark.createDataFrame([("a", 1.0, 2.0)], quote)
    derived = spark.createDataFrame([("a", 7.0, 8.0), ("b", 3.0, 4.0), ("c", 5.0, 6.0)], quote)
    depth = spark.createDataFrame([("a", "L2"), ("b", "L2"), ("c", "SYNTH"), ("d", None)], "stream string, depth string")
    got = sorted((r["stream"], r["bid_px"], r["source"]) for r in ladder.effective_bbo(feed, derived, depth).collect())
    assert got == [("a", 1.0, "feed"), ("b", 3.0, "derived"), ("c", None, "none"), ("d", None, "none")]
    assert ladder.effective_bbo(feed, derived, depth).where(F.col("ask_px") == 4).count() == 1
