"""Helpers the text operators share: Arrow mapping, scratch tables, connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.session import fresh_path

SPACE = "\\x20\\x09-\\x0D"
BATCH_MB = 8  # text that a Python worker is handed at once, unless the session says less
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"
_SPARK_BATCH = "67108864b"  # fixed value: what Spark has where nobody sets it


def bucket_of(id_column: str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; null ids give null."""
    return F.crc32(F.col(id_column).cast("string")) % n


def bound_batches(spark: SparkSession) -> None:
    """Lower the bytes of an Arrow batch to ``BATCH_MB`` where the session still has Spark's own value."""
    if spark.conf.get(_BATCH_CONF) == _SPARK_BATCH:
        spark.conf.set(_BATCH_CONF, f"{BATCH_MB}MB")


def releasing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """The same function of batches; at a task's end Arrow gives back what it keeps in reserve, as workers outlive tasks."""
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()

    return wrapped


def map_text(
    df: DataFrame, keep: list[str], text: Column, make: Callable[[], Callable[[list[bytes | None]], list[pa.Array]]],
    out: list[T.StructField],
) -> DataFrame:
    """Columns ``keep`` of every row beside columns computed in Arrow batches from the text's UTF-8 bytes.

    ``make()`` runs once per task and returns the function of a batch. Batches are bounded by rows and by bytes
    (see ``bound_batches``), so long texts do not pile up in the executor, in Python or between them. Workers outlive a task, so what Arrow
    keeps in reserve is given back at its end.
    """
    bound_batches(df.sparkSession)
    schema = T.StructType([df.schema[c] for c in keep] + out)
    probe = "__text_bytes"
    narrow = df.select(*keep, F.encode(text, "UTF-8").alias(probe))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            if batch.num_rows:
                made = fn(batch.column(len(keep)).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(keep))] + made,
                                                 names=[f.name for f in schema.fields])
                del made, batch
        del fn
        pa.default_memory_pool().release_unused()

    return narrow.mapInArrow(run, schema)


class Scratch:
    """Tables written to the shared folder; the ones that are no longer read can be removed at once."""

    def __init__(self, spark):
        self.spark, self.paths = spark, {}

    def write(self, df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
        path = fresh_path(self.spark, name)
        df.write.parquet(path, compression=compression)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)
        return out

    def drop(self, df: DataFrame) -> None:
        _, path = self.paths.pop(id(df))
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node of ``links`` (columns a, b; bigint): the smallest node it is connected with.

    Alternating star contraction: each round joins every node's larger neighbours to its smallest neighbour, then the
    smaller ones likewise, until the edges are stars. Rounds grow with the logarithm of the number of nodes. A round
    is two partial aggregations and two joins that may be split where a node has very many neighbours.
    """
    edges = scratch.write(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            low.select("u", F.col("m").alias("v"))).distinct()
        after = scratch.write(small, "edges")
        scratch.drop(edges)
        edges = after
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003), F.sum(F.hash("v", "u").cast("long"))).first()
        if state == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = state
