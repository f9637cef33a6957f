"""Date parsing for files that mix notations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Year first, eight digits, month first (day first where the first number is no month), English
# month names; a time part may follow where there are separators.
_YMD = r"^\d{4}-\d{1,2}-\d{1,2}($|[ T])"
_COMPACT = r"^\d{8}$"
_MDY = r"^(\d{1,2})-(\d{1,2})-(\d{4})($|[ T].*$)"
_DMY = r"^(1[3-9]|[23]\d)-"
_NAMED = r"^(\d{1,2})[- ]+([A-Za-z]{3,9})[-, ]+(\d{4})($|[ T].*$)"
_NAME_FIRST = r"^([A-Za-z]{3,9})[- ]+(\d{1,2})[-, ]+(\d{4})($|[ T].*$)"
_MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"   # three letters each


def _from_name(dashed: Column, pattern: str, day: int, name: int) -> Column:
    place = F.position(F.lower(F.substring(F.regexp_extract(dashed, pattern, name), 1, 3)), F.lit(_MONTHS))
    return F.when(place % 3 == 1, F.concat_ws("-", F.regexp_extract(dashed, pattern, 3), ((place + 2) / 3).cast("int").cast("string"),
                                              F.regexp_extract(dashed, pattern, day)).try_cast("date"))


def mixed_date(text: Column) -> Column:
    """Trimmed text to DATE; NULL where no notation fits or the day does not exist.

    Slashes and points count as dashes. The expression names its input few times, which
    keeps the generated code small enough to be compiled.
    """
    dashed = F.translate(text, "/.", "--")
    order = F.when(dashed.rlike(_DMY), F.lit("$3-$2-$1")).otherwise(F.lit("$3-$1-$2"))
    return (F.when(dashed.rlike(_YMD), dashed.try_cast("date"))
            .when(text.rlike(_COMPACT), F.try_to_date(text, "yyyyMMdd"))
            .when(dashed.rlike(_MDY), F.regexp_replace(dashed, F.lit(_MDY), order).try_cast("date"))
            .when(dashed.rlike(_NAMED), _from_name(dashed, _NAMED, 1, 2))
            .when(dashed.rlike(_NAME_FIRST), _from_name(dashed, _NAME_FIRST, 2, 1)))
