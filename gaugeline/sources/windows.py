"""Training windows stored as runs of days.

Written out, every day is repeated in ``t_in`` windows. Here a run of consecutive days is stored once, as one array
per column, and windows are cut from it when they are read. A run serves ``block`` starts and carries the days that
its last window reaches beyond them, so the stored size hardly depends on the window's length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import DAY, STATION
from ..functions.numeric import ordered
from .tables import write_parquet

BLOCK = 4096


def window_runs(df: DataFrame, cols: list[str], reach: int, group: str = STATION, day: str = DAY, dtype: str = "float", block: int = BLOCK) -> DataFrame:
    """(group, block, days, one array per column) with all days that windows starting in the block need.

    ``reach`` is how far the last value of a window lies after its start: ``t_in + horizon - 1``. A group holds ``block + reach`` days at most.
    """
    at = F.col("_at")
    # the blocks whose last start still reaches this day
    first = F.greatest(F.ceil((at - reach + 1) / block) - 1, F.lit(0))
    numbered = (df.select(group, F.col(day).alias("_day"), *[F.col(c).cast(dtype).alias(c) for c in cols], (F.row_number().over(ordered(group, day)) - 1).alias("_at"))
                .withColumn("block", F.explode(F.sequence(first.cast("int"), F.floor(at / block).cast("int")))))
    rows = numbered.groupBy(group, "block").agg(F.sort_array(F.collect_list(F.struct("_at", "_day", *cols))).alias("_rows"))
    return rows.select(group, "block", F.col("_rows._day").alias("days"), *[F.col(f"_rows.{c}").alias(c) for c in cols])


def write_windows(df: DataFrame, path: str, cols: list[str], t_in: int = 256, horizon: int = 7, **options) -> str:
    """Store windows over ``cols``, the target first."""
    return write_parquet(window_runs(df, cols, t_in + horizon - 1, **options), path)


def read_windows(spark: SparkSession, path: str, t_in: int = 256, horizon: int = 7, group: str = STATION, block: int = BLOCK) -> DataFrame:
    """The windows (group, inicio, horizon, X, y) of a store, as ``build_windows_multi`` makes them.

    Windows may be shorter than those the store was written for, not longer. A filter on ``block`` before the read reaches the
    scan; each task cuts windows from the runs of its files, a run at a time.
    """
    runs = spark.read.parquet(path)
    cols = [c for c in runs.columns if c not in (group, "block", "days")]
    step = t_in + horizon - 1
    starts = F.least(F.lit(block), F.size("days") - step)
    inputs = F.transform(F.sequence(F.col("_i"), F.col("_i") + t_in - 1), lambda j: F.struct(*[F.get(c, j).alias(c) for c in cols]))
    return (runs.where(starts > 0).withColumn("_i", F.explode(F.sequence(F.lit(0), starts - 1)))
            .select(group, F.get("days", F.col("_i")).alias("inicio"), F.lit(horizon).alias("horizon"), inputs.alias("X"), F.get(cols[0], F.col("_i") + step).alias("y")))
