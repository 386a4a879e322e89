"""Tables of files: which there are, and how each begins. One row per file, worked out by tasks that read a file's head only."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HEAD_BYTES = 1 << 16  # read at once while the end of the first line is looked for
MAX_HEAD = 64 << 20  # a first line beyond this is an error


def same_path(column: Column) -> Column:
    """One spelling of ``scheme:/path``."""
    return F.regexp_replace(column, r"^(\w+):/+", "$1:/")


def files(spark: SparkSession, path: str | Sequence[str], extension: str | None = None, pattern: str | None = None) -> DataFrame:
    """(file, size) of every file below ``path`` that is not empty; contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if extension:
        reader = reader.option("pathGlobFilter", f"*{extension}")
    listed = reader.load(path if isinstance(path, str) else list(path)).select(F.col("path").alias("file"), F.col("length").alias("size"))
    return listed if pattern is None else listed.filter(F.col("file").rlike(pattern))


def _first_line(path: str) -> str | None:
    fs, inner = pafs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
    got = b""
    with fs.open_input_stream(inner) as f:
        while b"\n" not in got and len(got) < MAX_HEAD:
            more = f.read(HEAD_BYTES)
            if not more:
                break
            got += more
    if len(got) >= MAX_HEAD and b"\n" not in got:
        raise ValueError(f"the first line of {path} has more than {MAX_HEAD} bytes")
    return got.split(b"\n", 1)[0].rstrip(b"\r").decode("utf-8-sig") if got else None


def heads(listed: DataFrame) -> DataFrame:
    """(file, head): the first line of every file of ``listed`` (column file), without its end.

    Each file is opened once and read up to its first line's end, in tasks spread over the files.
    """
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0)
            yield pa.RecordBatch.from_arrays([names, pa.array([_first_line(n) for n in names.to_pylist()], pa.string())], names=["file", "head"])

    return listed.select("file").repartition("file").mapInArrow(read, "file string, head string")
