"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs once to warm up and then three times into a noop sink; the median counts.
"""

from __future__ import annotations

import json
import os
import time
from statistics import median

from pyspark.sql import SparkSession

from verbflow import f, left_join, mutate, quantile, read_parquet, reframe, row_number, select
from verbflow.catalog import QUERIES

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = ["pricing_summary", "segment_revenue", "running_value", "top3_orders_per_customer", "reframe_quartiles", "price_band_range", "last_order_before_event", "share_of_total", "distinct_brands", "nested_lines"]


def ungrouped_row_number(spark: SparkSession, sf: str):
    """The position of every row in file order: an ordered window over the whole table."""
    return (read_parquet(spark, f"{sf}/lineitem.parquet") >> mutate(r=row_number()) >> select(f.l_orderkey, f.r)).to_spark()


def grouped_quartiles(spark: SparkSession, sf: str):
    return (read_parquet(spark, f"{sf}/lineitem.parquet") >> reframe(q=quantile(f.l_extendedprice, [0.25, 0.5, 0.75]), _by=[f.l_returnflag, f.l_linestatus])).to_spark()


def null_safe_left_join(spark: SparkSession, sf: str):
    return (read_parquet(spark, f"{sf}/orders.parquet") >> left_join(read_parquet(spark, f"{sf}/customer.parquet"), by={"o_custkey": "c_custkey"})).to_spark()


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = {name: QUERIES[name] for name in HEADLINE} | {q.__name__: q for q in (ungrouped_row_number, grouped_quartiles, null_safe_left_join)}
    took = {}
    for name, query in queries.items():
        times = []
        for _ in range(4):
            began = time.perf_counter()
            query(spark, SF).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        took[name] = round(median(times[1:]), 3)
    print(json.dumps({"metric": "median seconds of the headline queries, summed", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(SF.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
