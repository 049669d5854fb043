"""What the operators share: work folders, table reading and label folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import shared_dir, stored, work_path

__all__ = ["fold", "shared_dir", "small_batches", "stored", "table", "work_path"]


def small_batches(spark: SparkSession, rows: int = 1500) -> None:
    """Hand texts to Python in batches of so many rows: whole texts make the default batch large."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The given columns of a test table."""
    small_batches(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def fold(key: str, n: int) -> Column:
    """crc32 of the key's text, modulo n."""
    return (F.crc32(F.col(key).cast("string").cast("binary")) % n).cast("int")
