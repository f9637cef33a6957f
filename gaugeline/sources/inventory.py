"""File inventory, hashes and the storage guard.

``list_files`` leaves the listing to Spark; ``list_all_files`` also finds names that Spark hides. Digests and the latter
open the store through Arrow's file systems, where tasks run: credentials that were set for Spark alone do not reach them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import STORAGE_CAP_GB
from ..session import stored

ZONES = ("raw", "interim", "processed", "features")
_BLOCK = 8 << 20
VERSIONED = ("raw", "processed", "features")


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, modificationTime, length); no content is read.

    Spark's listing leaves out names that begin with an underscore or a dot; see :func:`list_all_files`.
    """
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).drop("content")


def _located(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI, where the caller runs."""
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri("file://" + path.removeprefix("file:") if path.startswith("file:") and not path.startswith("file://") else path)
    return pafs.LocalFileSystem(), path


def list_all_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, modificationTime, length) of every file under a folder, whatever its name; a file gives itself.

    Folders are listed by tasks, one level of the tree after the other, so nothing is listed on the driver and the rounds
    follow the depth of the tree. A path that does not exist gives no rows; links count as what they point at.
    """
    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder in batch.column("folder").to_pylist():
                fs, name = _located(folder)
                # the part of the path that only names the store
                store = "file:" if isinstance(fs, pafs.LocalFileSystem) else folder[:len(folder.rstrip("/")) - len(name.rstrip("/"))]
                here = fs.get_file_info(name)
                found = [here] if here.is_file else fs.get_file_info(pafs.FileSelector(name, recursive=False, allow_not_found=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([store + i.path for i in found], pa.string()), pa.array([i.mtime for i in found], pa.timestamp("us", "UTC")),
                     pa.array([i.size if i.is_file else None for i in found], pa.int64()), pa.array([i.type == pafs.FileType.Directory for i in found], pa.bool_())],
                    names=["path", "modificationTime", "length", "folder"])

    todo, files = spark.createDataFrame([(path,)], "folder string"), None
    while files is None or not todo.isEmpty():
        level = stored(todo.repartition("folder").mapInArrow(listed, "path string, modificationTime timestamp, length long, folder boolean"), "listing")
        found = level.where("NOT folder").drop("folder")
        files = found if files is None else files.unionByName(found)
        todo = level.where("folder").select(F.col("path").alias("folder"))
    return files


@F.arrow_udf(T.StringType())
def file_sha256(paths: pa.Array) -> pa.Array:
    """Digest of each file, read in blocks where the task runs, so no file has to fit into a row."""
    out = []
    for path in paths.to_pylist():
        fs, name = _located(path)
        digest = hashlib.sha256()
        with fs.open_input_file(name) as f:
            while block := f.read(_BLOCK):
                digest.update(block)
        out.append(digest.hexdigest())
    return pa.array(out, pa.string())


def bundle_files(files: DataFrame) -> DataFrame:
    """Drop tensor files and tool folders."""
    return files.where(~F.col("path").endswith(".npz")
                       & ~F.col("path").rlike(r"/(__pycache__|\.ipynb_checkpoints)/"))


def manifest(files: DataFrame, root: str = "", url_base: str | None = None) -> DataFrame:
    """One row per file: relative path, SHA-256, size and modification time."""
    relative = F.regexp_replace("path", F.lit(r"^(file:/*|[a-z0-9]+://[^/]*)"), F.lit("/"))
    if root:
        relative = F.regexp_replace(relative, F.lit("^.*?" + root.strip("/") + "/"), F.lit(""))
    out = files.select(
        relative.alias("path"),
        file_sha256("path").alias("sha256"),
        F.col("length").alias("bytes"),
        F.col("modificationTime").alias("recorded_at"))
    return out if url_base is None else out.withColumn("url", F.concat(F.lit(url_base), "path"))


def manifest_summary(records: DataFrame) -> DataFrame:
    return records.agg(F.count("*").alias("n_files"), F.sum("bytes").alias("total_bytes"))


def first_records(records: DataFrame, n: int = 5) -> DataFrame:
    return records.orderBy("path").limit(n)


def zone_of(path, zones=ZONES):
    return F.regexp_extract(path, "/(" + "|".join(zones) + ")/", 1)


def storage_report(files: DataFrame, zone=None, versioned=VERSIONED,
                   cap_gb: float = STORAGE_CAP_GB) -> DataFrame:
    """Bytes per zone with and without tensors, and the versioned total against the cap.

    The row with zone NULL is the total over the versioned zones.
    """
    zone = zone_of(F.col("path")) if zone is None else zone
    kept = F.when(~F.col("path").endswith(".npz"), F.col("length")).otherwise(0)
    sized = (files.select(zone.alias("zone"), "length", kept.alias("kept")).where(F.col("zone") != "")
             .groupBy("zone").agg(F.sum("length").alias("bytes"), F.sum("kept").alias("bytes_no_npz")))
    counted = F.when(F.col("zone").isin(*versioned), F.col("bytes_no_npz"))
    total = sized.agg(F.sum("bytes").alias("bytes"), F.coalesce(F.sum(counted), F.lit(0)).alias("bytes_no_npz"))
    return (sized.withColumn("over_cap", F.lit(None).cast("boolean"))
            .unionByName(total.withColumn("zone", F.lit(None).cast("string"))
                         .withColumn("over_cap", F.col("bytes_no_npz") / 1e9 > cap_gb)))


