"""Parquet tables and the metrics sink."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import DAY, STATION


def write_parquet(df: DataFrame, path: str, partition_cols: list[str] | None = None) -> str:
    """Overwrite a table, rows grouped by partition value.

    The rebalance hint lets adaptive execution split a partition value that holds most
    of the rows over several writers and put small ones together.
    """
    if partition_cols:
        df = df.hint("rebalance", *[F.col(c) for c in partition_cols])
        df.write.mode("overwrite").partitionBy(*partition_cols).parquet(path)
    else:
        df.write.mode("overwrite").parquet(path)
    return path


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def _table_name(path: str) -> str:
    return f"stored_{hashlib.md5(path.encode()).hexdigest()}"


def write_by_station(df: DataFrame, path: str, buckets: int, key: str = STATION, order: tuple[str, ...] = (DAY,)) -> str:
    """Overwrite a table laid out by station: later stages that group, join or window by it need no exchange
    (joins on station and day only with ``spark.sql.requireAllClusterKeysForCoPartition=false``).

    A bucket is one file, written by one task and ordered, so choose ``buckets`` for some hundred megabytes each. Only the
    session's catalogue knows the layout; :func:`read_by_station` declares it in another session.
    """
    (df.repartition(buckets, key).sortWithinPartitions(key, *order).write.mode("overwrite").format("parquet")
     .bucketBy(buckets, key).sortBy(key, *order).option("path", path).saveAsTable(_table_name(path)))
    return path


def read_by_station(spark: SparkSession, path: str, buckets: int, key: str = STATION, order: tuple[str, ...] = (DAY,)) -> DataFrame:
    """A table of :func:`write_by_station`, with the same ``buckets``, ``key`` and ``order`` as it was written."""
    name = _table_name(path)
    if not spark.catalog.tableExists(name):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema)
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (`{key}`) SORTED BY (`{key}`, {', '.join(f'`{c}`' for c in order)}) "
                  f"INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def write_metrics(metrics: DataFrame, path: str) -> None:
    """(section, name, key, value) rows as JSON lines."""
    metrics.write.mode("overwrite").json(path)
