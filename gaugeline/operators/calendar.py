"""Unique station-days, complete calendars and period filters.

A series with unique (station, day) rows has at most one row per calendar day, so a
window or grouped map over one station is bounded by the length of the calendar (a
century is 36,525 rows) however many stations or raw records there are. Raw records
with a hot station are reduced by ``unique_days`` first, whose aggregate combines on
the map side and shuffles on (station, day).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import DAY, SOURCE, STATION
from ..functions.numeric import ordered


def unique_days(df: DataFrame, order: list[str] | None = None, group: str = STATION,
                day: str = DAY) -> DataFrame:
    """Keep one row per (station, day): the lowest by ``order``, then by all columns."""
    rest = [c for c in df.columns if c not in (group, day)]
    if not rest:
        return df.distinct()
    lead = order or []
    key = F.struct(*[F.col(c) for c in lead], *[F.col(c) for c in rest if c not in lead])
    picked = df.where(F.col(group).isNotNull() & F.col(day).isNotNull()).groupBy(group, day).agg(
        F.min(key).alias("_row"))
    return picked.select(*[F.col(c) if c in (group, day) else F.col("_row")[c].alias(c)
                           for c in df.columns])


def to_daily(df: DataFrame, group: str = STATION, day: str = DAY, unique: bool = False,
             carry: tuple[str, ...] = (SOURCE,)) -> DataFrame:
    """Every day from the first to the last of each station; new days hold NULL.

    Each row is repeated up to the day before its successor, which needs one window
    over the station and no join with a generated calendar. ``unique=True`` skips
    the reduction to unique station-days. Columns in ``carry`` keep their value on
    inserted days.
    """
    base = df if unique else unique_days(df, group=group, day=day)
    nxt = F.lead(day).over(ordered(group, day))
    span = F.coalesce(F.datediff(nxt, F.col(day)), F.lit(1))
    steps = base.withColumn("_span", span).select(
        "*", F.explode(F.sequence(F.lit(0), F.col("_span") - 1)).alias("_step"))

    def column(c: str):
        if c == day:
            return F.date_add(day, F.col("_step")).alias(day)
        if c == group or c in carry:
            return F.col(c)
        return F.when(F.col("_step") == 0, F.col(c)).alias(c)

    return steps.select(*[column(c) for c in df.columns])


def in_period(df: DataFrame, start: str | None = None, end: str | None = None,
              day: str = DAY, year: str = "anio") -> DataFrame:
    """Rows from ``start`` to ``end``, both included.

    Where the table has a year column its bounds are added, which prunes partitions.
    """
    for bound, low in ((start, True), (end, False)):
        if bound is None:
            continue
        limit = F.lit(bound).cast("date")
        df = df.where(F.col(day) >= limit if low else F.col(day) <= limit)
        if year in df.columns:
            y = int(bound[:4])
            df = df.where(F.col(year) >= y if low else F.col(year) <= y)
    return df


def with_year(df: DataFrame, day: str = DAY) -> DataFrame:
    return df.withColumn("anio", F.year(day))
