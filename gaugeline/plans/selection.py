"""Stations by region and coverage, with their climate neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import (
    COVERAGE_CLIMATE, COVERAGE_EXTENDED, COVERAGE_HYDRO, DEFAULT_PERIOD, PILOT_REGIONS, STATION,
)
from ..operators.neighbours import nearest_stations, neighbour_lists
from ..operators.report import coverage_table
from ..session import cut_lineage
from ..sources.catalog_csv import read_catalog, read_station_set, write_csv


_FILES = (("hydro", "estaciones_seleccionadas_hidrometricas"), ("climate", "estaciones_seleccionadas_climatologicas"),
          ("extended", "estaciones_extendidas_hidrometricas"))


def candidates(catalog: DataFrame, regions=PILOT_REGIONS) -> DataFrame:
    return catalog.where(F.col("region_hidrologica").isin(*regions))


def only_stations(series: DataFrame, stations: DataFrame) -> DataFrame:
    """Series of the listed stations."""
    return series.join(stations.select(F.col("clave").alias(STATION)).distinct(), STATION, "left_semi")


def with_coverage(stations: DataFrame, series: DataFrame, value_col: str, period=DEFAULT_PERIOD) -> DataFrame:
    """Coverage of the period per candidate; stations without series get 0."""
    cov = coverage_table(series, value_col, start=period[0], end=period[1]).select(
        F.col(STATION).alias("clave"), "cobertura")
    return stations.join(cov, "clave", "left").withColumn("cobertura", F.coalesce("cobertura", F.lit(0.0)))


def with_neighbours(stations: DataFrame, climate: DataFrame, k: int = 3) -> DataFrame:
    return stations.join(neighbour_lists(nearest_stations(stations, climate, k)), "clave", "left")


def select_stations(hydro: DataFrame, climate: DataFrame, hydro_series: DataFrame, climate_series: DataFrame,
                    period=DEFAULT_PERIOD, hydro_min: float = COVERAGE_HYDRO,
                    climate_min: float = COVERAGE_CLIMATE, extended_min: float = COVERAGE_EXTENDED,
                    k: int = 3, regions=PILOT_REGIONS) -> dict[str, DataFrame]:
    """Selected hydro and climate stations and the extended hydro band."""
    c = F.col("cobertura")
    # One pass over each network's series; the station tables are used several times.
    hyd = with_coverage(candidates(hydro, regions), hydro_series, "gasto_medio_m3s", period)
    cli = with_coverage(candidates(climate, regions), climate_series, "precip_mm", period).where(c >= climate_min)
    both, cli = cut_lineage(hyd.where(c >= min(extended_min, hydro_min))), cut_lineage(cli)
    near = with_neighbours(both, cli, k)   # one search serves both bands
    return {
        "hydro": near.where(c >= hydro_min),
        "climate": cli,
        "extended": near.where((c >= extended_min) & (c < hydro_min))
        .withColumn("uso_recomendado", F.lit("sensibilidad_reconstruccion")),
    }


def run(spark: SparkSession, hydro_catalog: str, climate_catalog: str, hydro_table: str, climate_table: str, out: str, **options) -> str:
    """Catalogue files and canonical tables to the three station sets under ``out``."""
    write_selection(select_stations(read_catalog(spark, hydro_catalog), read_catalog(spark, climate_catalog),
                                    spark.read.parquet(hydro_table), spark.read.parquet(climate_table), **options), out)
    return out


def read_selection(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {name: read_station_set(spark, f"{folder}/{path}.csv") for name, path in _FILES}


def write_selection(selected: dict[str, DataFrame], folder: str) -> None:
    """The three station sets as CSV under ``folder``."""
    for name, path in _FILES:
        write_csv(selected[name], f"{folder}/{path}.csv")
