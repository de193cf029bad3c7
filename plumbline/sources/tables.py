"""Tables in parquet, one directory or file per table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def once(df: DataFrame, *keys: str) -> DataFrame:
    """Each record once. Stored repeats share their emission number and all values, so
    the keys decide; this is a shuffle on the keys, which leaves no group larger than the
    number of copies of one record."""
    return df.dropDuplicates(list(keys))
