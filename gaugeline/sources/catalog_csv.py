"""Station catalogues and station sets as CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import CATALOG_COLUMNS, CATALOG_RANGES, CATALOG_RULES
from ..functions.numeric import to_number
from ..functions.text import map_headers


def canonical_catalog(raw: DataFrame) -> DataFrame:
    """Text columns with the publisher's headers to the canonical catalogue."""
    found = {target: name for name, target in map_headers(raw.columns, CATALOG_RULES).items()}

    def column(target: str):
        text = F.col(f"`{found[target]}`")
        if target in CATALOG_RANGES:
            return to_number(F.trim(text)).alias(target)
        return (F.trim(text) if target in ("clave", "region_hidrologica") else text).alias(target)

    return raw.select(*[column(c) for c in CATALOG_COLUMNS if c in found])


def read_catalog(spark: SparkSession, path, encoding: str = "ISO-8859-1") -> DataFrame:
    raw = (spark.read.option("header", True).option("encoding", encoding)
           .option("ignoreLeadingWhiteSpace", True).option("quote", '"').option("escape", '"')
           .option("multiLine", False).csv(path))
    return canonical_catalog(raw)


def catalog_keys(catalog: DataFrame, limit: int | None = None) -> DataFrame:
    """Known keys; with ``limit`` the first ones in key order."""
    keys = catalog.select("clave").where(F.col("clave").isNotNull())
    return keys if limit is None else keys.orderBy("clave").limit(limit)


def region_sample(catalog: DataFrame, n: int = 8) -> DataFrame:
    """The first region codes in order."""
    return (catalog.select("region_hidrologica").where(F.col("region_hidrologica").isNotNull())
            .distinct().orderBy("region_hidrologica").limit(n))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


_NUMERIC = {"latitud", "longitud", "altitud", "cobertura"}


def read_station_set(spark: SparkSession, path: str) -> DataFrame:
    """A written station set: keys stay text, so leading zeros survive."""
    raw = spark.read.option("header", True).csv(path)
    return raw.select(*[F.col(c).try_cast(T.DoubleType()).alias(c) if c in _NUMERIC else F.col(c)
                        for c in raw.columns])
