"""Reading the test tables; a missing directory entry is an error, an empty table is not."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chronolith.session import prepare


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """``<sf_dir>/<name>.parquet`` (one file or a directory of files)."""
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")
