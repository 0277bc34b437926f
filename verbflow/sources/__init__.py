"""Tables from files.  The grammar itself works on any Spark DataFrame."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..table import Table, table


def read_parquet(spark: SparkSession, path: str) -> Table:
    """Rows are ordered by their position in the files, should a verb ask for an order."""
    return table(spark.read.parquet(path))


def write_parquet(data: Table, path: str, mode: str = "error", ordered: bool = False) -> None:
    table(data).to_spark(ordered=ordered).write.mode(mode).parquet(path)
