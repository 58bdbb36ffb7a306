"""Source files from storage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkprint import fixed
from inkprint.operators import paths

LISTED = "path string, length bigint"
READ = "path string, length bigint, status string, content string"


def _binary(spark: SparkSession, root: str) -> DataFrame:
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("ignoreMissingFiles", "true")
        .load(root)
    )


def plain_path(path: Column) -> Column:
    """``file:/a/b`` as ``/a/b``; other schemes stay."""
    return F.regexp_replace(path, r"^file:/+", "/")


def list_files(
    spark: SparkSession, root: str, exclude: Sequence[str] = fixed.DEFAULT_EXCLUDES
) -> DataFrame:
    """The supported, not excluded files below ``root``; a missing root gives no row."""
    try:
        found = _binary(spark, root)
    except AnalysisException:
        return spark.createDataFrame([], LISTED)
    return paths.source_files(found.select(plain_path(F.col("path")).alias("path"), "length"), root, exclude)


def read_files(
    spark: SparkSession,
    root: str,
    exclude: Sequence[str] = fixed.DEFAULT_EXCLUDES,
    max_size: int = fixed.MAX_FILE_SIZE,
) -> DataFrame:
    """Files with content. The size filter sits on the scan, so large files are never read.

    Files above the limit come as rows without content, with the status ``skipped``.
    """
    try:
        found = _binary(spark, root)
    except AnalysisException:
        return spark.createDataFrame([], READ)
    place = plain_path(F.col("path")).alias("path")
    fit = found.filter(F.col("length") <= max_size).select(
        place, "length", F.lit("scanned").alias("status"),
        F.make_valid_utf8(F.col("content").cast("string")).alias("content"),
    )
    large = found.filter(F.col("length") > max_size).select(
        place, "length", F.lit("skipped").alias("status"), F.lit(None).cast("string").alias("content")
    )
    return paths.source_files(fit.unionByName(large), root, exclude)


def requested_files(requested: DataFrame, listed: DataFrame, max_size: int = fixed.MAX_FILE_SIZE) -> DataFrame:
    """Status of every requested path against the files that exist."""
    return paths.with_status(requested.join(listed, "path", "left"), max_size)
