"""Line dedup by the number of distinct sites that carry a line.

Lines are trimmed and hashed to 128 bits. Per hash a HyperLogLog sketch of the sites is
merged by aggregation, on the map side first, so a line on every page is no hot group. A
sketch is exact while few sites are in it and then errs by a known share: lines whose
estimate lies within ``margin`` standard errors of the threshold get an exact distinct
count, all others are decided by the estimate. Lines found on ``min_sites`` sites or more
are boilerplate and leave every document.
"""

from __future__ import annotations

from math import sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeline.session import join_small

from .common import stored

_SPACE = " \t\n\x0b\x0c\r"


def line_hash(line: Column) -> list[Column]:
    return [F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2")]


def _lines(docs: DataFrame, text_col: str) -> DataFrame:
    return (docs.withColumn("line", F.explode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")))
            .withColumn("line", F.btrim("line", F.lit(_SPACE))).where("line != ''"))


def boilerplate_lines(docs: DataFrame, min_sites: int, site_col: str = "source", text_col: str = "text", log2_size: int = 8, margin: float = 4.0) -> DataFrame:
    """(h1, h2) of the lines on at least ``min_sites`` distinct non-null sites."""
    # sites are hashed for the sketch: it takes no null and one type of value
    lines = _lines(docs.select(F.col(site_col).alias("site"), F.col(text_col).alias("text")).where("site IS NOT NULL"), "text").select(*line_hash(F.col("line")), "site")
    error = 1.04 / sqrt(1 << log2_size)
    spread = stored(lines.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.hll_sketch_agg(F.xxhash64("site"), F.lit(log2_size)).alias("sketch"))
                    # fewer lines than sites asked for: no need to look at the sketch
                    .where(F.col("n") >= min_sites).withColumn("sites", F.hll_sketch_estimate("sketch")).drop("sketch")
                    .where(F.col("sites") * (1 + margin * error) + 1 >= min_sites), "line-spread")
    sure = F.col("sites") * (1 - margin * error) - 1 >= min_sites
    near = spread.where(~sure).select("h1", "h2")
    exact = (join_small(lines, near, ["h1", "h2"]).groupBy("h1", "h2", "site").agg(F.lit(1).alias("one"))
             .groupBy("h1", "h2").agg(F.count("*").alias("sites")).where(F.col("sites") >= min_sites).select("h1", "h2"))
    return stored(spread.where(sure).select("h1", "h2").unionByName(exact), "boilerplate")


def remove_lines(docs: DataFrame, min_sites: int = 10, site_col: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``n_lines``, ``n_removed``, ``kept_text``; empty lines stay and count as lines.

    Defined results: a null text is one empty line; lines of documents without a site do not
    count for the spread but are removed like others; repeated rows of one site count once;
    lines are equal after trimming; an empty table gives no rows.
    """
    gone = boilerplate_lines(docs, min_sites, site_col, text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("t1"),
                       F.xxhash64(F.lit(1), F.col(id_col), F.col(text_col)).alias("t2"))
    # equal rows lose equal lines, so the hash of a row finds its lines again
    found = (join_small(_lines(rows, "text").select("t1", "t2", *line_hash(F.col("line"))), gone, ["h1", "h2"])
             .groupBy("t1", "t2").agg(F.collect_set(F.struct("h1", "h2")).alias("gone")))
    lines = F.split("text", "\n")

    def stays(line: Column) -> Column:
        trimmed = F.btrim(line, F.lit(_SPACE))
        return (trimmed == "") | ~F.array_contains(F.col("gone"), F.struct(*line_hash(trimmed)))

    kept = F.when(F.col("gone").isNull(), lines).otherwise(F.filter(lines, stays))
    return (rows.join(found, ["t1", "t2"], "left").select("id", lines.alias("lines"), kept.alias("kept"))
            .select(F.col("id").alias(id_col), F.size("lines").alias("n_lines"), (F.size("lines") - F.size("kept")).alias("n_removed"),
                    F.array_join("kept", "\n").alias("kept_text")))


def oracle_sql(min_sites: int = 10) -> str:
    """Exact counts for all lines."""
    trim = r"trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
    return f"""
        WITH l AS (SELECT doc_id, source, unnest(range(len(x))) AS i, unnest(x) AS line
                   FROM (SELECT doc_id, source, string_split(coalesce(text, ''), chr(10)) AS x FROM documents)),
        t AS (SELECT *, {trim} AS k FROM l),
        b AS (SELECT k FROM t WHERE k <> '' GROUP BY k HAVING count(DISTINCT source) >= {min_sites})
        SELECT doc_id, count(*)::INTEGER AS n_lines, (count(*) FILTER (k IN (SELECT k FROM b)))::INTEGER AS n_removed,
               md5(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (k NOT IN (SELECT k FROM b)), '')) AS kept_md5
        FROM t GROUP BY doc_id"""
