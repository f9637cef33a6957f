"""All report numbers as one tidy table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import DAY, DEFAULT_PERIOD, QUALITY, STATION
from ..operators import report as R
from ..session import cut_lineage
from ..sources.catalog_csv import read_catalog
from ..sources.tables import write_metrics


def run(spark: SparkSession, hydro_table: str, climate_table: str, catalog: str, out: str, **options) -> str:
    """Canonical tables and the catalogue file to the metrics file."""
    write_metrics(report_metrics(spark.read.parquet(hydro_table), spark.read.parquet(climate_table), read_catalog(spark, catalog), **options), out)
    return out


def report_metrics(hydro: DataFrame, climate: DataFrame, catalog: DataFrame, flow: str = "gasto_medio_m3s",
                   precip: str = "precip_mm", period=DEFAULT_PERIOD, basins: DataFrame | None = None) -> DataFrame:
    """(section, name, key, value) over inventory, coverage, distribution, quality, time and rain response.

    Both series are worked out once, with the columns that the sections read; ``basins`` adds
    the number of sub-basins by region.
    """
    hydro = cut_lineage(hydro.select(*[c for c in (STATION, DAY, flow, QUALITY) if c in hydro.columns]))
    climate = cut_lineage(climate.select(STATION, DAY, precip))
    hyd = R.attach_catalog(hydro, catalog)
    parts: list[DataFrame] = []

    def add(table: DataFrame, section: str, names: list[str], key: str | None = None) -> None:
        parts.append(R.metric_rows(table, section, names, key))

    for label, table in (("hidrometricas", hydro), ("climatologicas", climate)):
        add(R.dataset_summary(table).withColumn("_k", F.lit(label)), "dataset",
            ["n_estaciones", "n_filas", "fecha_min", "fecha_max"], "_k")
    add(R.station_inventory(hyd), "inventario", ["n_estaciones"], "region_hidrologica")
    coverage = R.coverage_table(hydro, flow, start=period[0], end=period[1])
    add(R.coverage_summary(coverage), "cobertura",
        ["n_estaciones_total", "cobertura_media_pct", "estaciones_ge_60pct", "estaciones_ge_80pct"])
    add(R.describe(hydro, flow), "describe", ["count", "mean", "std", "min", "p25", "p50", "p75", "max"])
    add(R.season_stats(hydro, flow), "temporada", ["mean", "median", "max"], "temporada")
    add(R.quality_summary(hydro), "calidad", ["n", "pct"], "etiqueta")
    add(R.located_stations(hyd).agg(F.count("*").alias("n_estaciones_geolocalizadas")), "mapa",
        ["n_estaciones_geolocalizadas"])
    add(R.monthly_climatology(hydro, flow), "climatologia_mensual", ["mean", "std", "count"], "mes")
    add(R.annual_means(hydro, flow), "media_anual", [flow], "anio")
    add(R.best_lag(R.national_lag_corr(climate, hydro, precip, flow)), "precip_gasto",
        ["lag_max_correlacion_dias", "correlacion_max", "n_fechas_comunes"])
    if basins is not None:
        counts = R.sub_basin_counts(basins, "region_hidrologica")
        add(counts.withColumn("region_hidrologica", F.coalesce("region_hidrologica", F.lit("total"))), "subcuencas", ["n_subcuencas"], "region_hidrologica")
    return reduce(DataFrame.unionByName, parts)
