"""Text lines with their file and line number, and file selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.session import materialize
from tidemill.sources.manifest import same_path


def select_files(df: DataFrame, pattern: str | None) -> DataFrame:
    """Keep the files whose path matches the unanchored ``pattern``; others are never opened."""
    return df if pattern is None else df.filter(F.col("_metadata.file_path").rlike(pattern))


def read_lines(spark: SparkSession, path: str | Sequence[str], pattern: str | None = None, extension: str | None = None) -> DataFrame:
    """(file, line_no, value): line numbers from 0 in each file.

    A line's number is its place within a file split plus the line counts of the file's earlier splits: a
    table with one row per split, counted once and written. Lines are neither sorted nor moved.
    """
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
        # how files are cut must not follow the number of executors that happen to be up
        spark.conf.set("spark.sql.files.minPartitionNum", str(spark.sparkContext.defaultParallelism))
    reader = spark.read.option("recursiveFileLookup", "true")
    if extension:
        reader = reader.option("pathGlobFilter", f"*{extension}")
    raw = select_files(reader.text(path if isinstance(path, str) else list(path)), pattern)
    raw = raw.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("__at"),
        F.monotonically_increasing_id().alias("__id"), "value",
    )
    splits = raw.groupBy("file", "__at").agg(F.min("__id").alias("__first"), F.count("*").alias("__n"))
    before = Window.partitionBy("file").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialize(
        splits.select("file", "__at", "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off")), "splits")
    numbered = raw.join(offsets, ["file", "__at"], "left")
    line_no = F.col("__id") - F.col("__first") + F.col("__off")
    return numbered.select(
        "file", F.coalesce(line_no, F.raise_error(F.lit("file splits changed while reading"))).alias("line_no"), "value")


def empty_files(spark: SparkSession, path: str | Sequence[str], lines: DataFrame, extension: str | None = None,
                pattern: str | None = None) -> DataFrame:
    """Listed files that have no line. Scans skip such files, so the listing the driver holds is compared with ``lines``."""
    reader = spark.read.option("recursiveFileLookup", "true")
    if extension:
        reader = reader.option("pathGlobFilter", f"*{extension}")
    names = reader.text(path if isinstance(path, str) else list(path)).inputFiles()
    listed = spark.createDataFrame([(n,) for n in names], "file string").select(same_path(F.col("file")).alias("file"))
    if pattern is not None:
        listed = listed.filter(F.col("file").rlike(pattern))
    seen = lines.select(same_path(F.col("file")).alias("file")).distinct()
    return listed.join(seen, "file", "left_anti")
