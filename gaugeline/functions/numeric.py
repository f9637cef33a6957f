"""Column expressions for statistics and casts."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def to_number(text: Column) -> Column:
    """Trimmed text to DOUBLE; anything that is not a decimal number is NULL.

    Numbers end in a digit or a point, which keeps out "-", "NaN", "Infinity" and Java
    suffixes before the cast is tried; the only other form Java reads is hexadecimal.
    """
    return F.when(text.rlike("^[^xX]*[0-9.]$"), text.try_cast("double"))


def nan_to_null(col: Column) -> Column:
    return F.when(~F.isnan(col), col)


def pearson(a: Column, b: Column) -> Column:
    """Aggregate: correlation over rows with both values; NULL when undefined.

    ``corr`` raises on a constant column under ANSI mode, hence the guarded quotient.
    """
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a), F.when(both, b)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def zscore(col: Column, part) -> Column:
    """(x - mean) / sample deviation within a window; a zero deviation counts as one."""
    sd = F.stddev_samp(col).over(part)
    return (col - F.avg(col).over(part)) / F.when(sd == 0, F.lit(1.0)).otherwise(sd)


def ordered(group: str, day: str) -> Window:
    """The one window all sequence operators share, so that one exchange serves them."""
    return Window.partitionBy(group).orderBy(day)
