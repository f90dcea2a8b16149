"""Times the headline queries once each, after one warm-up, and prints one line of JSON."""

import json
import os
import time

from pyspark.sql import SparkSession

from tidegrid.plans.registry import QUERIES

HEADLINE = ["bars_hourly", "trade_column_asof", "quote_rule_side", "book_levels_intervals", "density_tw", "sum_pyramid_l2", "profile_poc", "viewport_percentile", "dom_ladder", "candle_columns", "vap_split", "fuzzy_rank"]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.log.level", "ERROR").getOrCreate()
    )
    QUERIES["bars_hourly"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
