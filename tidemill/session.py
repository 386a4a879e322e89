"""Session helpers: the shared folder for tables that cut lineage, and table loading."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_CONF = "spark.checkpoint.dir"
_LOCAL = "tidemill.scratch.dir"
_WRITTEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by the cluster in ``spark.checkpoint.dir``.

    Only where a session on one machine (master ``local`` or ``local[n]``) names none, a temporary folder is chosen, remembered in
    the session and removed when Python ends. On a cluster it must be named: a folder of the driver's machine would be
    another one on each executor.
    """
    base = spark.conf.get(_CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(_CHECKPOINT_CONF)
    if not base:
        base = spark.conf.get(_LOCAL, None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError(f"set {_CHECKPOINT_CONF} to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tidemill-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.conf.set(_LOCAL, base)
    return base.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; ``clear_scratch`` removes what is there."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def clear_scratch(spark: SparkSession) -> None:
    """Remove everything written through this module so far. Call it once the results that read it are stored."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _WRITTEN:
        target = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        target.getFileSystem(conf).delete(target, True)


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` once into the shared folder and continue from the written table.

    One pass, survives the loss of executors, and later readers still prune columns. Small summary tables are
    written too before they meet all rows: their size is then known when the join is planned, so they are
    broadcast only if they really are small, and the rows are not shuffled just to find that out.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
