"""Drought indices and seasonal decomposition."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import DAY, STATION
from ..functions.gamma import gamma_cdf, normal_quantile
from ..functions.numeric import ordered
from ..functions.stl import stl


def _rolling_sum(df: DataFrame, value, scale: int, group: str, month: str) -> DataFrame:
    """Sum over ``scale`` rows, NULL unless all are known."""
    w = ordered(group, month).rowsBetween(-(scale - 1), 0)
    return df.withColumn("_v", value).withColumn(
        "_sum", F.when(F.count("_v").over(w) == scale, F.sum("_v").over(w)))


def _standard_sum(df: DataFrame, value, scale: int, group: str, month: str, name: str) -> DataFrame:
    summed = _rolling_sum(df, value, scale, group, month)
    return summed.withColumn(name, _plain_z(group)).drop("_v", "_sum")


def _plain_z(group: str):
    part = Window.partitionBy(group)
    return F.try_divide(F.col("_sum") - F.avg("_sum").over(part), F.stddev_samp("_sum").over(part))


def spi(df: DataFrame, precip: str = "precip_mm", scale: int = 3, group: str = STATION,
        month: str = "mes_inicio", method: str = "gamma") -> DataFrame:
    """Standardised precipitation index of monthly sums, as column ``spi{scale}``.

    ``gamma`` fits the rolling sums of each station and calendar month (Thom's
    estimate, zeros mixed in by their share, result kept within 3.09 deviations);
    ``zscore`` standardises the rolling sums of the whole station.
    """
    name = f"spi{scale}"
    if method == "zscore":
        return _standard_sum(df, F.col(precip), scale, group, month, name)
    if method != "gamma":
        raise ValueError(f"unknown method {method!r}")

    # The fit is aggregates over a window; only the two distribution functions need numpy.
    part = Window.partitionBy(group, F.month(month))
    s = F.col("_sum")
    positive = F.when(s > 0, s)
    mean = F.avg(positive).over(part)
    skew = F.ln(mean) - F.avg(F.ln(positive)).over(part)
    shape = F.when(skew > 0, (1 + F.sqrt(1 + 4 * skew / 3)) / (4 * skew))
    zeros = F.count(F.when(s == 0, 1)).over(part) / F.count(s).over(part)
    fitted = (_rolling_sum(df, F.col(precip), scale, group, month)
              .withColumn("_shape", shape)
              .withColumn("_x", F.try_divide(s * F.col("_shape"), mean))
              .withColumn("_zero", F.when(s.isNotNull(), zeros)))
    return (fitted.withColumn(name, _index(F.col("_x"), F.col("_shape"), F.col("_zero")))
            .drop("_v", "_sum", "_shape", "_x", "_zero"))


@F.pandas_udf(T.DoubleType())
def _index(x: pd.Series, shape: pd.Series, zero: pd.Series) -> pd.Series:
    p = gamma_cdf(shape.to_numpy(float), x.to_numpy(float))
    z = np.clip(normal_quantile(zero.to_numpy(float) + (1 - zero.to_numpy(float)) * p), -3.09, 3.09)
    return pd.Series(z).where(~np.isnan(z), None)


def spei(df: DataFrame, precip: str = "precip_mm", pet: str = "pet_mm", scale: int = 3,
         group: str = STATION, month: str = "mes_inicio") -> DataFrame:
    """Standardised rolling sum of precipitation less evaporation, as ``spei{scale}``."""
    return _standard_sum(df, F.col(precip) - F.col(pet), scale, group, month, f"spei{scale}")


def stl_components(df: DataFrame, value: str, period: int = 365, group: str = STATION, day: str = DAY,
                   robust: bool = True) -> DataFrame:
    """(group, day, trend, seasonal, resid) per station.

    Gaps are filled by straight lines first, trailing ones by the last value; rows before
    the first value keep NULL components. A station needs two full periods; shorter ones
    give NULL components. One group is one station with one row per day.
    """
    schema = T.StructType([*df.select(group, day).schema,
                           *[T.StructField(n, T.DoubleType()) for n in ("trend", "seasonal", "resid")]])

    def decompose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(day)
        y = pdf[value].astype(float).interpolate().to_numpy()
        keep = ~np.isnan(y)
        out = pdf[[group, day]].copy()
        parts = stl(y[keep], period, robust=robust) if keep.sum() >= 2 * period else (None, None, None)
        for name, part in zip(("trend", "seasonal", "resid"), parts, strict=True):
            out[name] = None
            if part is not None:
                out.loc[keep, name] = part
            out[name] = out[name].astype(float)
        return out

    return df.select(group, day, value).groupBy(group).applyInPandas(decompose, schema)
