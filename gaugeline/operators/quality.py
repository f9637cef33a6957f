"""Sentinels, outlier flags and declared rules."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import (
    CATALOG_COLUMNS, CATALOG_RANGES, DAY, KEY_PATTERN, OUTLIER_FACTOR, OUTLIER_QUANTILE, QUALITY,
    SENTINELS, SERIES_RANGES, SOURCE, SOURCES, STATION,
)


def replace_sentinels(df: DataFrame, cols: list[str]) -> DataFrame:
    """Codes for "no value" become NULL; columns that do not exist are skipped."""
    present = [c for c in cols if c in df.columns]
    return df.withColumns({c: F.when(~F.col(c).isin(*SENTINELS) & ~F.isnan(c), F.col(c)) for c in present})


def with_quality(df: DataFrame) -> DataFrame:
    """Quality flag present, integer, and 0 where unknown."""
    flag = F.coalesce(F.col(QUALITY).cast("int"), F.lit(0)) if QUALITY in df.columns else F.lit(0)
    return df.withColumn(QUALITY, flag)


def flag_outliers(df: DataFrame, value_col: str, group: str = STATION) -> DataFrame:
    """Negative values and values above three times the station's 99.9 % quantile get flag 2.

    The quantile is taken over the station's partition, one row per day, so the
    exchange that serves the other station windows serves this one too.
    """
    if QUALITY not in df.columns:
        df = df.withColumn(QUALITY, F.lit(0))
    v = F.col(value_col)
    limit = F.percentile(v, OUTLIER_QUANTILE).over(Window.partitionBy(group)) * OUTLIER_FACTOR
    return (df.withColumn("_limit", limit)
            .withColumn(QUALITY, F.when((v < 0) | (v > F.col("_limit")), 2).otherwise(F.col(QUALITY)))
            .drop("_limit"))


def outlier_limits(df: DataFrame, value_col: str, group: str = STATION) -> DataFrame:
    """The 99.9 % quantile of each station."""
    return df.groupBy(group).agg(F.percentile(value_col, OUTLIER_QUANTILE).alias("q999"))


# --- declared rules -------------------------------------------------------------

def _as_text(c: Column) -> Column:
    return c.cast("string")


def _range_rule(name: str, low, high) -> tuple[str, Column]:
    v = F.col(name).try_cast("double")
    if low is not None and high is not None:
        return f"in_range({low:g}, {high:g})", ~v.between(low, high)
    return f"ge({low:g})", v < low


def _checks(df: DataFrame, required: dict, ranges: dict, typed: dict, patterns: dict,
            allowed: dict, optional_not_null: tuple = ()) -> list[tuple[str, str, Column]]:
    """(column, check, failed) for every rule whose column exists."""
    out = []
    for c in required:
        if c in df.columns:
            out.append((c, "not_null", F.col(c).isNull()))
    for c, pattern in patterns.items():
        if c in df.columns:
            out.append((c, "str_matches", ~_as_text(F.col(c)).rlike(pattern)))
    for c, kind in typed.items():
        if c in df.columns:
            out.append((c, f"coerce({kind})", F.col(c).isNotNull() & F.col(c).try_cast(kind).isNull()))
    for c, (low, high) in ranges.items():
        if c in df.columns and (low, high) != (None, None):
            out.append((c, *_range_rule(c, low, high)))
    for c, values in allowed.items():
        if c in df.columns:
            out.append((c, "isin", ~F.col(c).isin(*values)))
    return out


def _violations(df: DataFrame, keys: list[str], checks, required) -> DataFrame:
    """All failures at once: one narrow pass, no shuffle."""
    present = [F.when(F.coalesce(failed, F.lit(False)),
                      F.struct(F.lit(c).alias("column"), F.lit(name).alias("check"),
                               _as_text(F.col(c)).alias("value")))
               for c, name, failed in checks]
    key_cols = [(_as_text(F.col(k)) if k in df.columns else F.lit(None).cast("string")).alias(k)
                for k in keys]
    any_failed = reduce(or_, [F.coalesce(failed, F.lit(False)) for _, _, failed in checks])
    out = (df.where(any_failed).select(*key_cols, F.explode(F.array_compact(F.array(*present))).alias("v"))
           .select(*keys, "v.column", "v.check", "v.value"))
    missing = [c for c in required if c not in df.columns]
    if missing:
        spark = df.sparkSession
        lost = spark.range(1).select(
            *[F.lit(None).cast("string").alias(k) for k in keys],
            F.explode(F.array(*[F.lit(c) for c in missing])).alias("column"),
            F.lit("column_in_dataframe").alias("check"), F.lit(None).cast("string").alias("value"))
        out = out.unionByName(lost)
    return out


class ValidationError(ValueError):
    """Raised by strict validation."""


def _strict(found: DataFrame, strict: bool) -> DataFrame:
    if strict and (first := found.first()) is not None:
        raise ValidationError(f"first violation: {first.asDict()}")
    return found


def validate_series(df: DataFrame, strict: bool = False) -> DataFrame:
    """Violations of the series contract as (station, day, column, check, value)."""
    required = (STATION, DAY, SOURCE, QUALITY)
    checks = _checks(
        df, dict.fromkeys(required), SERIES_RANGES,
        {DAY: "timestamp", QUALITY: "int", **dict.fromkeys(SERIES_RANGES, "double")},
        {STATION: KEY_PATTERN}, {SOURCE: SOURCES})
    if QUALITY in df.columns:
        checks.append((QUALITY, "isin", ~F.col(QUALITY).try_cast("int").isin(0, 1, 2)))
    return _strict(_violations(df, [STATION, DAY], checks, required), strict)


def validate_catalog(df: DataFrame, strict: bool = False) -> DataFrame:
    """Violations of the catalogue contract as (clave, column, check, value)."""
    required = ("clave", "latitud", "longitud")
    checks = _checks(df, dict.fromkeys(required), CATALOG_RANGES,
                     dict.fromkeys(CATALOG_RANGES, "double"), {"clave": KEY_PATTERN}, {})
    found = _violations(df, ["clave"], checks, required)
    if "clave" in df.columns:
        # Counting combines on the map side: a key that holds a third of the rows is one row after it.
        repeated = (df.where(F.col("clave").isNotNull()).groupBy("clave").count().where("count > 1")
                    .select(_as_text(F.col("clave")).alias("clave"), F.lit("clave").alias("column"),
                            F.lit("unique").alias("check"), _as_text(F.col("count")).alias("value")))
        found = found.unionByName(repeated)
    return _strict(found, strict)


def canonical_columns(df: DataFrame) -> DataFrame:
    """Catalogue columns in their fixed order, as far as present."""
    return df.select(*[c for c in CATALOG_COLUMNS if c in df.columns])
