"""Work folders that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where that is unset, as in tests on one machine, a new local one.

    On a cluster the setting is needed: other machines don't see a local folder.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = getattr(sc, "_surfacelens_dir", None) or tempfile.mkdtemp(prefix="spark-surfacelens-")
        sc._surfacelens_dir = base
    return base.rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder, as a URI."""
    base = shared_dir(spark)
    base = base if "://" in base or base.startswith("file:") else f"file://{base}"
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Writes within it delete their shuffle files at their end, not when the driver's memory is next cleared: what is written is read from its files, so disk holds one step's shuffles, not all."""
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors.

    Work tables are written once and take much of a query's disk, so they are compressed more than by default.
    """
    path = work_path(df.sparkSession, name)
    with tidy(df.sparkSession):
        df.write.parquet(path, compression="zstd")
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt out by ``keys`` over all cores, four tasks a core: for small rows from which much work follows.

    A small file is read by few tasks, however long its rows take; and a plain repartition would be merged again for its few bytes.
    """
    spark = df.sparkSession
    return df.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)
