"""Canonical series and selection to the feature table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import DAY, STATION
from ..operators.features import (
    add_lags, add_rolling, build_windows_multi, feature_columns, normalize_per_station,
)
from ..operators.neighbours import idw_to_station, neighbour_pairs
from ..sources.tables import write_parquet
from .selection import only_stations, read_selection


def build_features(hydro: DataFrame, target: str, climate: DataFrame | None = None,
                   hydro_stations: DataFrame | None = None, climate_stations: DataFrame | None = None,
                   normalize: bool = True) -> DataFrame:
    """Interpolated rain, lags and trailing means, standardised per station; rows without target drop out."""
    df = hydro
    if climate is not None and hydro_stations is not None and climate_stations is not None:
        pairs = neighbour_pairs(hydro_stations, climate_stations)
        rain = idw_to_station(pairs, climate, name="precip_idw_mm")
        df = df.join(rain, [STATION, DAY], "left")
    df = add_rolling(add_lags(df, target), target)
    if normalize:
        df = normalize_per_station(df, [target, *feature_columns(df, target)])
    return df.where(F.col(target).isNotNull())


def run(spark: SparkSession, hydro_table: str, climate_table: str, stations: str, out: str, target: str = "gasto_medio_m3s",
        t_in: int = 256, horizon: int = 7) -> str:
    """Canonical tables and station sets to ``features`` and ``windows`` under ``out``."""
    chosen = read_selection(spark, stations)
    hydro = only_stations(spark.read.parquet(hydro_table), chosen["hydro"])
    climate = spark.read.parquet(climate_table)
    write_parquet(build_features(hydro, target, climate, chosen["hydro"], chosen["climate"]), f"{out}/features")
    write_parquet(build_tensors(spark.read.parquet(f"{out}/features"), target, t_in, horizon), f"{out}/windows")
    return out


def build_tensors(features: DataFrame, target: str, t_in: int = 256, horizon: int = 7) -> DataFrame:
    """Windows over the feature table with missing inputs as zero, in single precision."""
    cols = feature_columns(features, target)
    return build_windows_multi(features.fillna(0.0, [target, *cols]), cols, target, t_in=t_in, horizon=horizon)
