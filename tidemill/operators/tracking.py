"""Run records as tables: metrics, predictions, splits, durations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

METRIC_COLUMNS = ("run_id", "split", "epoch", "metric", "value")


def log_metrics(metrics: DataFrame, path: str) -> None:
    """Append rows (run_id, split, epoch, metric, value)."""
    metrics.select(*METRIC_COLUMNS).write.mode("append").parquet(path)


def metrics_sheet(metrics: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row per (run, split, epoch), one column per metric."""
    return metrics.groupBy("run_id", "split", "epoch").pivot("metric", list(names)).agg(F.first("value"))


def register_run(metrics: DataFrame, best: DataFrame, names: Sequence[str], comment: str = "") -> DataFrame:
    """Record per (run, split): every metric at the best epoch and at the last epoch."""
    last = metrics.groupBy("run_id", "split").agg(F.max("epoch").alias("epoch"))

    def at(epochs: DataFrame, prefix: str) -> DataFrame:
        rows = metrics.join(epochs.select("run_id", "split", "epoch"), ["run_id", "split", "epoch"])
        wide = rows.groupBy("run_id", "split").agg(
            F.max("epoch").alias(f"{prefix}_epoch"),
            *[F.max(F.when(F.col("metric") == m, F.col("value"))).alias(f"{prefix}_{m}") for m in names],
        )
        return wide

    return at(best, "best").join(at(last, "final"), ["run_id", "split"]).withColumn("comment", F.lit(comment))


def console_view(metrics: DataFrame) -> DataFrame:
    """Latest values per split as one JSON text."""
    latest = metrics.groupBy("run_id", "split", "metric").agg(F.max_by("value", "epoch").alias("value"))
    entries = F.array_sort(F.collect_list(F.struct("metric", "value")))
    return latest.groupBy("run_id", "split").agg(F.to_json(F.map_from_entries(entries)).alias("values"))


def running_mean(metrics: DataFrame, metric: str) -> DataFrame:
    """Mean of a metric (a duration) over all epochs so far, per run and split; a run has few epochs."""
    w = Window.partitionBy("run_id", "split").orderBy("epoch").rowsBetween(Window.unboundedPreceding, 0)
    return metrics.filter(F.col("metric") == metric).withColumn("mean_so_far", F.avg("value").over(w))


def save_splits(splits: DataFrame, path: str) -> None:
    """Split membership, laid out so that reading one fold or split touches only its files."""
    splits.write.mode("overwrite").partitionBy("fold", "split").parquet(path)


def split_indices_json(splits: DataFrame, sample: str, path: str) -> None:
    """JSON lines (fold, split, id)."""
    splits.select("fold", "split", sample).write.mode("overwrite").json(path)


def save_predictions(predictions: DataFrame, path: str) -> None:
    predictions.write.mode("overwrite").parquet(path)


def save_kernels(kernels: DataFrame, path: str) -> None:
    kernels.coalesce(1).write.mode("overwrite").parquet(path)


def durations(spark, run_id: str, train_seconds: float, test_seconds: float) -> DataFrame:
    return spark.createDataFrame(
        [(run_id, "train", 0, "seconds", float(train_seconds)), (run_id, "test", 0, "seconds", float(test_seconds))],
        "run_id string, split string, epoch int, metric string, value double",
    )


def save_durations(rows: DataFrame, path: str) -> None:
    rows.select(*METRIC_COLUMNS).write.mode("append").option("header", True).csv(path)
