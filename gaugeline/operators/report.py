"""Descriptive and validation tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import (
    COVERAGE_CLIMATE, COVERAGE_HYDRO, DAY, QUALITY, QUALITY_LABELS, STATION, WET_MONTHS,
)
from ..functions.numeric import ordered, pearson
from ..session import join_small
from .calendar import in_period
from .quantiles import quantile_columns


def attach_catalog(df: DataFrame, catalog: DataFrame) -> DataFrame:
    """Position, region and state of the station onto its series."""
    keep = ["latitud", "longitud", "region_hidrologica", "estado"]
    side = catalog.withColumnRenamed("clave", STATION).select(
        STATION, *[F.col(c) if c in catalog.columns else F.lit(None).cast("string").alias(c) for c in keep])
    return df.join(side, STATION, "left")


def station_inventory(df: DataFrame, by: str = "region_hidrologica") -> DataFrame:
    """Distinct stations per group, most first; over everything when there is no such column."""
    if by not in df.columns:
        return df.agg(F.countDistinct(STATION).alias("n_estaciones"))
    return (df.where(F.col(by).isNotNull()).groupBy(by).agg(F.countDistinct(STATION).alias("n_estaciones"))
            .orderBy(F.desc("n_estaciones"), by))


def coverage_table(df: DataFrame, value_col: str, group: str = STATION, start: str | None = None,
                   end: str | None = None, only_observed: bool = False, day: str = DAY) -> DataFrame:
    """Share of days with a value: of the period if both bounds are given, else of the station's span.

    The highest share comes first, equal ones by key. ``only_observed`` leaves out imputed values.
    """
    d = in_period(df, start, end, day)
    value = F.col(value_col) if value_col in df.columns else F.lit(None)
    if only_observed:
        value = F.when(F.col(QUALITY).isNull() | (F.col(QUALITY) != 1), value)
    counted = (d.where(F.col(group).isNotNull()).groupBy(group)
               .agg(F.count(value).alias("n_obs"), F.min(day).alias("inicio"), F.max(day).alias("fin")))
    first, last = F.col("inicio"), F.col("fin")
    if start and end:
        first, last = F.lit(start).cast("date"), F.lit(end).cast("date")
    days = F.datediff(last, first) + 1
    return counted.select(group, "n_obs", days.alias("dias_periodo"),
                          F.try_divide("n_obs", days).alias("cobertura"), "inicio", "fin").orderBy(F.desc_nulls_last("cobertura"), group)


def quality_summary(df: DataFrame) -> DataFrame:
    """Count and share of each quality flag, zero-filled."""
    counts = df.agg(*[F.count(F.when(F.col(QUALITY) == q, 1)).alias(f"n{q}") for q, _ in QUALITY_LABELS])
    total = F.greatest(sum((F.col(f"n{q}") for q, _ in QUALITY_LABELS), F.lit(0)), F.lit(1))
    rows = F.array(*[F.struct(F.lit(q).alias("calidad"), F.lit(name).alias("etiqueta"), F.col(f"n{q}").alias("n"),
                              (F.col(f"n{q}") / total * 100).alias("pct")) for q, name in QUALITY_LABELS])
    return counts.select(F.inline(rows))


def monthly_climatology(df: DataFrame, col: str, day: str = DAY) -> DataFrame:
    return (df.where(F.col(col).isNotNull()).groupBy(F.month(day).alias("mes"))
            .agg(F.avg(col).alias("mean"), F.stddev_samp(col).alias("std"), F.count(col).alias("count")))


def annual_means(df: DataFrame, col: str, day: str = DAY) -> DataFrame:
    return df.where(F.col(col).isNotNull()).groupBy(F.year(day).alias("anio")).agg(F.avg(col).alias(col))


def season(day: str = DAY) -> Column:
    return F.when(F.month(day).isin(*WET_MONTHS), "lluviosa").otherwise("seca")


def season_stats(df: DataFrame, col: str, day: str = DAY) -> DataFrame:
    """Mean, median and maximum of the wet and the dry season."""
    d = df.where(F.col(col).isNotNull()).select(season(day).alias("temporada"), F.col(col))
    basic = d.groupBy("temporada").agg(F.avg(col).alias("mean"), F.max(col).alias("max"))
    return (basic.join(quantile_columns(d, col, {"median": 0.5}, ("temporada",)), "temporada")
            .select("temporada", F.round("mean", 2).alias("mean"), F.round("median", 2).alias("median"),
                    F.round("max", 2).alias("max")))


def describe(df: DataFrame, col: str) -> DataFrame:
    """Count, mean, deviation, extremes and the 5/25/50/75/95 % quantiles of a column, as one row."""
    basic = df.agg(F.count(col).alias("count"), F.avg(col).alias("mean"), F.stddev_samp(col).alias("std"),
                   F.min(col).alias("min"), F.max(col).alias("max"))
    marks = quantile_columns(df, col, {"p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95})
    # Two one-row tables side by side, as a scalar subquery.
    row = marks.select(F.struct(*marks.columns)).scalar()
    return basic.withColumn("_m", row).select("*", "_m.*").drop("_m")


def boxplot_by(df: DataFrame, col: str, by: str = "region_hidrologica") -> DataFrame:
    """Quartiles per group, with whisker ends at 1.5 interquartile ranges that exist in the data."""
    q = quantile_columns(df, col, {"q1": 0.25, "median": 0.5, "q3": 0.75}, (by,))
    fence = (F.col("q3") - F.col("q1")) * 1.5
    marked = join_small(df.where(F.col(col).isNotNull()), q, by)
    v = F.col(col)
    return marked.groupBy(by).agg(
        F.max("q1").alias("q1"), F.max("median").alias("median"), F.max("q3").alias("q3"),
        F.min(F.when(v >= F.col("q1") - fence, v)).alias("whisker_low"),
        F.max(F.when(v <= F.col("q3") + fence, v)).alias("whisker_high"),
        F.count(v).alias("n"))


def coverage_histogram(coverage: DataFrame, bins: int = 20, col: str = "cobertura") -> DataFrame:
    """Equal-width bins over the observed range of coverage in percent; the last bin is closed."""
    pct = coverage.select((F.col(col) * 100).alias("_c")).where(F.col("_c").isNotNull())
    low, high = pct.select(F.min("_c")).scalar(), pct.select(F.max("_c")).scalar()
    bounded = pct.select("_c", low.alias("_low"), high.alias("_high"))
    # A single value gets the unit range around it.
    flat = F.col("_low") == F.col("_high")
    a = F.when(flat, F.col("_low") - 0.5).otherwise(F.col("_low"))
    b = F.when(flat, F.col("_high") + 0.5).otherwise(F.col("_high"))
    counted = (bounded.select(a.alias("a"), b.alias("b"),
                              F.least(F.floor((F.col("_c") - a) / (b - a) * bins), F.lit(bins - 1)).alias("bin"))
               .groupBy("bin").agg(F.count("*").alias("n"), F.max("a").alias("a"), F.max("b").alias("b")))
    width = (F.col("b") - F.col("a")) / bins
    return counted.select((F.col("bin") + 1).cast("int").alias("bin"), (F.col("a") + F.col("bin") * width).alias("desde"),
                          (F.col("a") + (F.col("bin") + 1) * width).alias("hasta"), "n")


def coverage_summary(coverage: DataFrame, col: str = "cobertura") -> DataFrame:
    c = F.col(col)
    return coverage.agg(F.count("*").alias("n_estaciones_total"), (F.avg(c) * 100).alias("cobertura_media_pct"),
                        F.count_if(c >= COVERAGE_HYDRO).alias("estaciones_ge_60pct"),
                        F.count_if(c >= COVERAGE_CLIMATE).alias("estaciones_ge_80pct"))


def _lag_pairs(df: DataFrame, a: str, b: str, max_lag: int, window, keep: list[str]) -> DataFrame:
    """One row per original row and lag: a moved by the lag against b. Narrow after the window."""
    moved = F.array(*[F.lag(a, k).over(window) for k in range(max_lag + 1)])
    return (df.withColumn("_moved", moved)
            .select(*keep, F.col(b).alias("_b"), F.posexplode("_moved").alias("lag", "_a")))


def lagged_corr(df: DataFrame, a: str, b: str, max_lag: int = 30, group: str = STATION, day: str = DAY) -> DataFrame:
    """(lag, corr): mean over stations of the correlation of a(t - lag) with b(t)."""
    pairs = _lag_pairs(df.select(group, day, *{a, b}), a, b, max_lag, ordered(group, day), [group])
    per_station = pairs.groupBy(group, "lag").agg(pearson(F.col("_a"), F.col("_b")).alias("r"))
    return per_station.groupBy("lag").agg(F.avg("r").alias("corr"))


def daily_mean(df: DataFrame, col: str, name: str, day: str = DAY) -> DataFrame:
    return df.where(F.col(col).isNotNull()).groupBy(day).agg(F.avg(col).alias(name))


def national_lag_corr(climate: DataFrame, hydro: DataFrame, precip: str = "precip_mm",
                      flow: str = "gasto_medio_m3s", max_lag: int = 15, min_dates: int = 30,
                      day: str = DAY) -> DataFrame:
    """(lag, corr, n_fechas) between two daily means over all stations; empty below ``min_dates``.

    The lag runs over one row per calendar date, so its single partition is as long
    as the calendar and does not grow with stations or records.
    """
    both = daily_mean(climate, precip, "_p", day).join(daily_mean(hydro, flow, "_q", day), day)
    counted = both.withColumn("_n", F.count("*").over(Window.partitionBy()))
    pairs = _lag_pairs(counted.where(F.col("_n") >= min_dates), "_p", "_q", max_lag,
                       Window.partitionBy().orderBy(day), ["_n"])
    return pairs.groupBy("lag").agg(pearson(F.col("_a"), F.col("_b")).alias("corr"), F.max("_n").alias("n_fechas"))


def best_lag(corr: DataFrame) -> DataFrame:
    """The lag with the highest correlation; the lowest lag wins a tie."""
    rank = F.struct(F.col("corr"), -F.col("lag"))
    return (corr.where(F.col("corr").isNotNull())
            .agg(F.max_by("lag", rank).alias("lag_max_correlacion_dias"), F.max("corr").alias("correlacion_max"),
                 F.max("n_fechas").alias("n_fechas_comunes")))


def cross_source_agreement(df_a: DataFrame, df_b: DataFrame, value_col: str, group: str = STATION,
                           min_days: int = 10, day: str = DAY) -> DataFrame:
    """Days in common, correlation and mean difference for stations both sources have."""
    a = df_a.select(group, day, F.col(value_col).alias("_a")).where(F.col("_a").isNotNull())
    b = df_b.select(group, day, F.col(value_col).alias("_b")).where(F.col("_b").isNotNull())
    return (a.join(b, [group, day]).groupBy(group)
            .agg(F.count("*").alias("n"), pearson(F.col("_a"), F.col("_b")).alias("corr"),
                 F.avg(F.col("_a") - F.col("_b")).alias("sesgo"))
            .where(F.col("n") >= min_days))


def common_stations(df_a: DataFrame, df_b: DataFrame, group: str = STATION) -> DataFrame:
    return df_a.select(group).intersect(df_b.select(group))


def dataset_summary(df: DataFrame, day: str = DAY) -> DataFrame:
    return df.agg(F.countDistinct(STATION).alias("n_estaciones"), F.count("*").alias("n_filas"),
                  F.min(day).alias("fecha_min"), F.max(day).alias("fecha_max"))


def first_per_station(df: DataFrame, group: str = STATION, day: str = DAY) -> DataFrame:
    """One row per station, the earliest day. Combines on the map side."""
    rest = [c for c in df.columns if c not in (group, day)]
    picked = df.groupBy(group).agg(F.min(F.struct(day, *rest)).alias("_row"))
    return picked.select(group, *[F.col("_row")[c].alias(c) for c in (day, *rest)])


def located_stations(df: DataFrame) -> DataFrame:
    """Stations with a position, one row each."""
    return first_per_station(df).where(F.col("latitud").isNotNull() & F.col("longitud").isNotNull())


def sub_basin_counts(basins: DataFrame, by: str = "cuenca") -> DataFrame:
    """Sub-basins per basin, and their total in the row without a basin."""
    per = basins.groupBy(by).agg(F.count("*").alias("n_subcuencas"))
    return per.unionByName(per.agg(F.sum("n_subcuencas").alias("n_subcuencas"))
                           .withColumn(by, F.lit(None).cast("string")))


def metric_rows(table: DataFrame, section: str, names: list[str], key: str | None = None) -> DataFrame:
    """Report columns as (section, name, key, value) rows, in one pass over the report."""
    k = F.col(key).cast("string") if key else F.lit(None).cast("string")
    cells = F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("string").alias("value")) for n in names])
    return (table.select(k.alias("key"), F.inline(cells))
            .select(F.lit(section).alias("section"), "name", "key", "value"))
