"""Input tables (parquet)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# When a list, the names of the tables read are appended (bench.py uses it
# to report the rows each query takes in).
READS: list | None = None


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if READS is not None:
        READS.append(name)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
