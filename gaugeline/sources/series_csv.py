"""Per-station text files to canonical rows.

Files are read line by line, so one huge file is split over tasks like any text
file; nothing depends on a file fitting into one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import DAY, PUBLISHER_BASE, PUBLISHER_CATALOGS, PUBLISHER_DIRS, SERIES_RULES, STATION
from ..functions.dates import mixed_date
from ..functions.numeric import to_number
from ..functions.text import fold_col, map_headers_col
from ..session import join_small

# A comma outside double quotes.
_COMMA = r',(?=(?:[^"]*"[^"]*")*[^"]*$)'
# Lines that may name the date column, accents or not; the exact test follows.
_MAYBE_HEADER = "(?i)f[eèéêë][cç]h[aàáâãäå]"


def _fields(line: Column) -> Column:
    """Trimmed cells of a line; quotes are looked at only where there are any."""
    quoted = F.transform(F.split(line, _COMMA), lambda c: F.trim(F.regexp_replace(F.trim(c), '^"|"$', "")))
    return F.when(line.contains('"'), quoted).otherwise(F.split(F.trim(line), r"\s*,\s*"))


def file_stem(path: Column) -> Column:
    name = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    return F.trim(F.regexp_extract(name, r"([^/]+?)(\.[^./]*)?$", 1))


def read_lines(spark: SparkSession, path, encoding: str = "ISO-8859-1") -> DataFrame:
    """(file, pos, line): ``pos`` orders the lines of one file.

    A split holds consecutive lines, so (offset of the split, running id) is the
    line order without a pass over the whole file.
    """
    return (
        spark.read.text(path)
        .select(
            F.col("_metadata.file_path").alias("file"),
            F.struct(F.col("_metadata.file_block_start").alias("offset"),
                     F.monotonically_increasing_id().alias("id")).alias("pos"),
            F.decode(F.col("value").cast("binary"), encoding).alias("line"),
        )
    )


_MARK = "\x01"   # between the name of a bundled file and its line


def write_bundle(lines: DataFrame, path: str, encoding: str = "ISO-8859-1") -> str:
    """(file, pos, line) as text files that hold many series files each, every line after its file's name.

    A file per station costs a folder, a commit and a task's opening for some kilobytes; a bundle costs by its bytes.
    The lines of one file stay together, in the order of ``pos``.
    """
    (lines.repartition("file").sortWithinPartitions("file", "pos").select("file", "line")
     .write.option("encoding", encoding).option("quote", "").option("sep", _MARK).option("emptyValue", "")
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    return path


def read_bundle(spark: SparkSession, path, encoding: str = "ISO-8859-1") -> DataFrame:
    """(file, pos, line) of the series files in the bundles under ``path``, as ``read_lines`` gives them."""
    parts = F.split("line", _MARK, 2)
    return read_lines(spark, path, encoding).select(F.get(parts, F.lit(0)).alias("file"), "pos", F.get(parts, F.lit(1)).alias("line"))


def header_lines(lines: DataFrame) -> DataFrame:
    """First line of each file that has the date column as a whole field."""
    line = F.col("line")
    named = F.exists(F.split(line, ","), lambda c: fold_col(c) == "fecha")
    # Lines of numbers drop out at the first, cheap test.
    maybe = (line.contains("h") | line.contains("H")) & line.rlike(_MAYBE_HEADER)
    first = lines.where(maybe & named).groupBy("file").agg(F.min_by("line", "pos").alias("header"),
                                                           F.min("pos").alias("header_pos"))
    targets = map_headers_col(F.transform(_fields(F.col("header")), fold_col), SERIES_RULES)
    # Per file: where each target stands, -1 where the file has no such column.
    where = [(F.array_position("targets", t).cast("int") - 1).alias(f"at_{t}") for t, _ in SERIES_RULES]
    return (first.withColumn("targets", targets)
            .select("file", file_stem(F.col("file")).alias(STATION), "header_pos", *where))


def parse_series_lines(lines: DataFrame) -> DataFrame:
    """Canonical rows from (file, pos, line); files without a header give none.

    The header side has one row per file. It is worked out and counted first: up to the
    broadcast limit no line is shuffled, beyond it Spark splits the files that are hot.
    """
    # Lines are split below the join: expressions above it would be repeated per column.
    split = lines.select("file", "pos", _fields(F.col("line")).alias("cells"))
    data = join_small(split, header_lines(lines), "file").where(F.col("pos") > F.col("header_pos"))

    def cell(target: str) -> Column:
        return F.get("cells", F.col(f"at_{target}"))

    row = F.struct(mixed_date(cell(DAY)).alias(DAY), *[to_number(cell(t)).alias(t) for t, _ in SERIES_RULES if t != DAY])
    # A generator, so that the test for a date is not moved into the join and worked out twice.
    return data.select(STATION, F.inline(F.array(row))).where(F.col(DAY).isNotNull())


def read_series_csv(spark: SparkSession, path, encoding: str = "ISO-8859-1") -> DataFrame:
    """All series files under ``path``; the station key is the file stem."""
    return parse_series_lines(read_lines(spark, path, encoding))


def files_without_header(lines: DataFrame) -> DataFrame:
    """Files the parser skips because no line names the date column."""
    return lines.select("file").distinct().join(header_lines(lines), "file", "left_anti")


def series_url(tipo: str, key: Column) -> Column:
    return F.concat(F.lit(f"{PUBLISHER_BASE}{PUBLISHER_DIRS[tipo]}/"), key, F.lit(".csv"))


def catalog_url(tipo: str) -> str:
    return f"{PUBLISHER_BASE}{PUBLISHER_DIRS[tipo]}/{PUBLISHER_CATALOGS[tipo]}"
