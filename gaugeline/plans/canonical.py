"""Raw series to the canonical station-day table."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import SOURCE
from ..operators.calendar import to_daily, with_year
from ..operators.gaps import impute_short_gaps
from ..operators.features import pick_column
from ..operators.quality import flag_outliers, replace_sentinels, validate_series, with_quality
from ..sources.series_csv import read_series_csv
from ..sources.tables import write_parquet


def build_canonical(raw: DataFrame, value_col: str, source: str = "SIH", sentinels: bool = True,
                    method: str = "cubic", unique: bool = False) -> DataFrame:
    """Sentinels out, calendar complete, outliers flagged, short gaps filled, year added.

    After the reduction to unique station-days every step windows over the station, so
    the chain shuffles once.
    """
    df = raw if SOURCE in raw.columns else raw.withColumn(SOURCE, F.lit(source))
    if sentinels:
        df = replace_sentinels(df, [value_col])
    df = to_daily(df, unique=unique)
    df = flag_outliers(df, value_col)
    df = impute_short_gaps(df, value_col, method=method)
    return with_year(with_quality(df))


def filled_column(raw: DataFrame, preferred: list[str]) -> str:
    """The first preferred column with any value, counted in one pass."""
    filled = raw.agg(*[F.count(c).alias(c) for c in preferred if c in raw.columns]).first().asDict()
    return pick_column(raw.select(*[c for c, n in filled.items() if n]), preferred)


def run(spark: SparkSession, raw_path: str, out_path: str, value_col: str | list[str]) -> str:
    """Raw files to the stored canonical table; of several value columns the first with a value is taken.

    Violations of the contract do not stop the stage; a warning names how many there are.
    """
    raw = read_series_csv(spark, raw_path)
    if not isinstance(value_col, str):
        value_col = filled_column(raw, value_col)
    path = write_parquet(build_canonical(raw, value_col), out_path, ["anio"])
    broken = validate_series(spark.read.parquet(path)).count()
    if broken:
        warnings.warn(f"{broken} violations of the series contract in {path}", stacklevel=2)
    return path
