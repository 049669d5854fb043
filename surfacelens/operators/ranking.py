"""Places in one order over whole tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..common import stored


def placed(rows: DataFrame, group: list[str], order: list[str | Column], limit: int | None = None, name: str = "place") -> DataFrame:
    """``rows`` with their place (from 1) in ``order`` within ``group``; with ``limit`` only the first ones.

    Groups may hold most of the table, so none is sorted in one task. Rows are shuffled once, by
    range, and stored in their order with a running number; a group's rows lie in consecutive
    parts, so its place is the number less the part's first one, raised by the group's counts in
    the parts before, which are a row a part and group. With a limit of up to a thousand every
    partition keeps its first rows before the places are given (Spark limits groups early up to
    there); a longer one takes the way by range. Rows equal in ``order`` take places in any order;
    a null in ``group`` is a group.
    """
    if limit is not None and limit <= 1000:
        turn = Window.partitionBy(*group).orderBy(*order)
        return rows.withColumn(name, F.row_number().over(turn)).where(F.col(name) <= limit)
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(n, *group, *order).sortWithinPartitions(*group, *order)
    # The upper bits of the number are the partition, the lower 33 count its rows from zero.
    ranged = stored(ranged.withColumn("__id", F.monotonically_increasing_id()), "ranked").withColumn("__part", F.shiftright("__id", 33))
    counts = ranged.groupBy(*group, "__part").agg(F.count("*").alias("__n"), F.min("__id").alias("__first"))
    before = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)], F.col("__part").alias("__at"), (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first") + 1).alias("__shift"))
    same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"__g{i}")) for i, g in enumerate(group)], F.col("__part") == F.col("__at"))
    out = ranged.join(shifts, same).withColumn(name, (F.col("__id") + F.col("__shift")).cast("long"))
    out = out.drop("__id", "__part", "__at", "__shift", *[f"__g{i}" for i in range(len(group))])
    return out if limit is None else out.where(F.col(name) <= limit)
