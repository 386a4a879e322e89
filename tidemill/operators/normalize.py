"""Feature statistics and normalisation: fit once on the training rows, apply to any rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = 2.220446049250313e-16
GLOBAL_MODES = ("standardization", "minmax")
SAMPLE_MODES = ("per_sample_std", "per_sample_minmax")


def fit_stats(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """One row per feature: (feature, mean, std, min, max), from a single pass with partial aggregation."""
    per_feature = [
        F.struct(
            F.lit(c).alias("feature"),
            F.avg(c).alias("mean"),
            F.stddev_samp(c).alias("std"),
            F.min(c).cast("double").alias("min"),
            F.max(c).cast("double").alias("max"),
        )
        for c in features
    ]
    return df.agg(F.array(*per_feature).alias("s")).select(F.inline("s"))


def _lookup(stats: DataFrame, features: Sequence[str]) -> Column:
    """All statistics as one struct value: a scalar subquery, so no join is planned."""
    picked = [
        F.struct(*[F.max(F.when(F.col("feature") == c, F.col(s))).alias(s) for s in ("mean", "std", "min", "max")]).alias(c)
        for c in features
    ]
    return stats.agg(F.struct(*picked).alias("s")).scalar()


def normalize(
    df: DataFrame,
    features: Sequence[str],
    mode: str = "standardization",
    stats: DataFrame | None = None,
    sample: str | None = None,
) -> DataFrame:
    """Normalise ``features`` in place.

    Global modes use ``stats`` (a fitted table, possibly read back from disk) or the frame's own.
    Per-sample modes aggregate per ``sample`` first and join the small result back, so that one long sample
    is pre-aggregated everywhere instead of being gathered in one window task.
    """
    if mode in GLOBAL_MODES:
        known = _lookup(stats if stats is not None else fit_stats(df, features), features)
        with_stats = df.withColumn("__st", known)
        scaled = {c: _scaled(F.col(c), F.col(f"__st.{c}"), mode) for c in features}
        return with_stats.withColumns(scaled).drop("__st")
    if mode not in SAMPLE_MODES:
        raise ValueError(f"unknown mode {mode!r}")
    if sample is None:
        raise ValueError("per-sample modes need the sample column")
    per = df.groupBy(sample).agg(*[
        F.struct(F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max")).alias(f"__st_{c}")
        for c in features
    ])
    joined = df.join(per, sample)
    scaled = {c: _scaled(F.col(c), F.col(f"__st_{c}"), mode) for c in features}
    return joined.withColumns(scaled).select(*df.columns)


def _scaled(value: Column, stat: Column, mode: str) -> Column:
    if mode == "standardization":
        return (value - stat["mean"]) / (stat["std"] + F.lit(EPS))
    if mode == "per_sample_std":
        return F.try_divide(value - stat["mean"], stat["std"])
    return (value - stat["min"]) / (stat["max"] - stat["min"] + F.lit(EPS))


def save_stats(stats: DataFrame, path: str) -> None:
    stats.coalesce(1).write.mode("overwrite").parquet(path)


def load_stats(spark, path: str) -> DataFrame:
    return spark.read.parquet(path)
