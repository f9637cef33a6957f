"""Lags, trailing means, standardising and sliding windows. All are positional."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import DAY, LAGS, ROLLING, STATION
from ..functions.numeric import ordered, zscore


def add_lags(df: DataFrame, col: str, group: str = STATION, lags=LAGS, day: str = DAY) -> DataFrame:
    w = ordered(group, day)
    return df.withColumns({f"{col}_lag{k}": F.lag(col, k).over(w) for k in lags})


def add_rolling(df: DataFrame, col: str, group: str = STATION, windows=ROLLING, day: str = DAY) -> DataFrame:
    """Trailing means that need max(2, half the window) valid values."""
    w = ordered(group, day)
    out = {}
    for n in windows:
        frame = w.rowsBetween(-(n - 1), 0)
        out[f"{col}_ma{n}"] = F.when(F.count(col).over(frame) >= max(2, n // 2), F.avg(col).over(frame))
    return df.withColumns(out)


def normalize_per_station(df: DataFrame, cols: list[str], group: str = STATION) -> DataFrame:
    part = Window.partitionBy(group)
    return df.withColumns({c: zscore(F.col(c), part) for c in cols})


def station_stats(df: DataFrame, cols: list[str], group: str = STATION) -> DataFrame:
    """Mean and sample deviation per station: what ``normalize_per_station`` removes."""
    aggs = [f(c).alias(f"{c}_{n}") for c in cols for n, f in (("mean", F.avg), ("std", F.stddev_samp))]
    return df.groupBy(group).agg(*aggs)


def feature_columns(df: DataFrame, target: str, extra: str = "precip_idw_mm") -> list[str]:
    return [c for c in df.columns if c.startswith(target + "_") or c == extra]


def pick_column(df: DataFrame, preferred: list[str]) -> str:
    """First preferred column the table has."""
    found = next((c for c in preferred if c in df.columns), None)
    if found is None:
        raise ValueError(f"none of {preferred} in {df.columns}")
    return found


def build_windows_multi(df: DataFrame, feature_cols: list[str], target: str, group: str = STATION,
                        t_in: int = 256, horizon: int = 7, day: str = DAY,
                        dtype: str = "float") -> DataFrame:
    """One row per window: inputs X (oldest first, target first), y and the start of the window.

    A window starts at each row that has a row ``t_in + horizon - 1`` further on. The
    output is ``t_in`` times the input, so keep it lazy or write it, never cache it.
    """
    cols = [target] + [c for c in feature_cols if c != target]
    w = ordered(group, day)
    step = t_in + horizon - 1
    # Structs, because collect_list leaves out NULLs.
    inputs = F.struct(*[F.col(c).cast(dtype).alias(c) for c in cols])
    return (df.withColumn("X", F.collect_list(inputs).over(w.rowsBetween(0, t_in - 1)))
            .withColumn("y", F.lead(F.col(target).cast(dtype), step).over(w))
            .withColumn("_full", F.lead(F.lit(True), step).over(w))
            .where("_full")
            .select(group, F.col(day).alias("inicio"), F.lit(horizon).alias("horizon"), "X", "y"))


def make_windows(df: DataFrame, cols: list[str], group: str = STATION, t_in: int = 256,
                 horizon: int = 7, day: str = DAY) -> DataFrame:
    """Windows over given columns in double precision; the first column is the target."""
    return build_windows_multi(df, cols[1:], cols[0], group, t_in, horizon, day, "double")


def window_cells(windows: DataFrame, group: str = STATION) -> DataFrame:
    """Long form for writing or comparing: one row per window and input step."""
    return windows.select(group, "inicio", "y", F.posexplode("X").alias("paso", "x")
                          ).select(group, "inicio", "y", "paso", "x.*")
