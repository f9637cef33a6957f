"""What the corpus operators share.

Conventions of all operators in this package:

* A null text is an empty text; a null id is kept and treated as one more value.
* Only the columns an operator names are read, so extra columns, whatever they are
  called, never clash; operators that return documents return them unchanged.
* A word is a maximal run of bytes other than space and 0x09-0x0D. ``bytes.split()``
  splits at exactly these bytes, and UTF-8 never uses them inside a longer character.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline.session import scratch_table


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(text: str | Column) -> Column:
    """The text as bytes, null as empty: spares decoding where a function works on bytes."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).cast("binary")


def per_text(function: Callable[[bytes], tuple], schema: str) -> Callable[[Column], Column]:
    """Arrow UDF from text bytes to one struct: ``function`` sees one text at a time.

    Nothing is gathered beyond the batch that Spark sends, so memory follows the longest text.
    """
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import DataType

    kind = to_arrow_type(DataType.fromDDL(schema))
    names = [f.name for f in kind]

    @F.arrow_udf(schema)
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([dict(zip(names, function(t.as_py()), strict=True)) for t in texts], type=kind)

    return run


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the folder that all executors share and read back: ends the lineage in files."""
    spark = df.sparkSession
    path = scratch_table(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# Most rows and list entries of a side that is broadcast: of some 25 bytes each, about 50 MB.
BROADCAST_ENTRIES = 2_000_000


def join_lists(df: DataFrame, side: DataFrame, on: str, lists: str, how: str = "inner") -> DataFrame:
    """Join with rows that carry a list of small structs; broadcast only after rows and entries were counted."""
    side = stored(side, "lists")
    n = side.agg(F.sum(F.size(lists) + 1)).first()[0] or 0
    return df.join(F.broadcast(side) if n <= BROADCAST_ENTRIES else side, on, how)


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI, on the driver or an executor."""
    if "://" in path or path.startswith("file:"):
        if path.startswith("file:") and not path.startswith("file://"):
            path = "file://" + path.removeprefix("file:")
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path
