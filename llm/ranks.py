"""Places of rows in a total order, dealt by ranges: no group is sorted in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored


def ranked(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``df`` with ``idx``: the row's place from 0 among those of its ``group``, nulls first.

    Rows are dealt by ranges of (group, order), so a hot group spreads over many tasks. Only
    one row per task and group goes through a window, to add up how many rows lie before a
    task's first. Rows that tie in all of ``order`` get places in any order, so ``order``
    should name all columns in which rows can differ. ``group`` must not be null.
    """
    columns = [F.col(c).asc_nulls_first() for c in (group, *order)]
    dealt = df.repartitionByRange(*columns).sortWithinPartitions(*columns).withColumn("_at", F.monotonically_increasing_id())
    dealt = stored(dealt.withColumn("_part", F.shiftright("_at", 33)), "ranked")
    runs = dealt.groupBy(group, "_part").agg(F.min("_at").alias("_low"), F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = stored(runs.withColumn("_shift", F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_low")).drop("_low", "_n"), "runs")
    return dealt.join(runs, [group, "_part"]).withColumn("idx", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")
