"""Fixed-length samples: converters between array, long and tidy forms, padding, and length repair."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions import arrays as A


def long_to_nested(df: DataFrame, case: str, dim: str, reading: str, value: str) -> DataFrame:
    """(case, dim, reading, value) rows to one row per case with ``dims: array<array<double>>``.

    Series are ordered by ``reading``; a series is one sample's worth of steps.
    """
    series = df.groupBy(case, dim).agg(
        F.array_sort(F.collect_list(F.struct(F.col(reading).alias("r"), F.col(value).alias("v")))).alias("s")
    )
    return series.groupBy(case).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct(F.col(dim).alias("d"), F.col("s").alias("s")))),
            lambda x: F.transform(x["s"], lambda y: y["v"]),
        ).alias("dims")
    )


def nested_to_long(df: DataFrame, case: str, dims: str = "dims") -> DataFrame:
    """Inverse of ``long_to_nested``: (case, dim_id, reading_id, value)."""
    # outer explodes: a plain one makes the optimizer repeat the expression behind ``dims`` in a size filter
    return (
        df.select(case, F.posexplode_outer(dims).alias("dim_id", "__s"))
        .select(case, "dim_id", F.posexplode_outer("__s").alias("reading_id", "value"))
        .filter("reading_id IS NOT NULL")
    )


def nested_to_steps(df: DataFrame, sample: str, dims: str = "dims", names: Sequence[str] = ()) -> DataFrame:
    """One row per (sample, t) with one column per dimension; shorter dimensions give nulls."""
    parts = [F.get(dims, F.lit(i)).alias(n) for i, n in enumerate(names)]
    return df.select(sample, F.posexplode(F.arrays_zip(*parts)).alias("t", "__z")).select(sample, "t", "__z.*")


def steps_to_nested(df: DataFrame, sample: str, t: str, features: Sequence[str]) -> DataFrame:
    steps = F.array_sort(F.collect_list(F.struct(F.col(t).alias("__t"), *features)))
    grouped = df.groupBy(sample).agg(steps.alias("__s"))
    return grouped.select(sample, F.array(*[F.col(f"__s.{c}") for c in features]).alias("dims"))


def flatten_row_major(dims: Column) -> Column:
    """``dims`` (F series of T steps) to one vector ordered by step, then feature."""
    return F.flatten(A.transpose(dims))


def pad(df: DataFrame, dims: str, max_len: int, fill: float = 0.0) -> DataFrame:
    """Clip or pad every series to ``max_len``; adds ``padding_mask`` (true = real step)."""
    n = F.size(F.get(dims, F.lit(0)))
    # two steps: inside a lambda, the name would be taken for the padded column of the same projection
    masked = df.withColumn("padding_mask", A.padding_mask(n, max_len))
    return masked.withColumn(dims, F.transform(dims, lambda s: A.pad(s, max_len, fill)))


def repair_lengths(df: DataFrame, dims: str, limit: int = 256, factor: int = 2) -> DataFrame:
    """Where a sample's dimensions differ in length, thin the long ones (only when the data need it)."""
    thinned = F.transform(dims, lambda s: A.decimate(s, factor, limit))
    sizes = F.transform(dims, lambda s: F.size(s))
    return df.withColumn(dims, F.when(F.array_min(sizes) != F.array_max(sizes), thinned).otherwise(F.col(dims)))


def fix_length(df: DataFrame, dims: str, min_len: int, scale: str | None = None) -> DataFrame:
    """Interpolate, stretch to the longest dimension, cut to ``min_len``, scale per sample and dimension."""
    longest = F.array_max(F.transform("__filled", lambda s: F.size(s)))
    filled = df.select(*df.columns, F.posexplode(dims).alias("__d", "__s")).withColumn("__s", A.interpolate(F.col("__s")))
    rest = [c for c in df.columns if c != dims]
    regrouped = filled.groupBy(*rest).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("__d", "__s"))), lambda x: x["__s"]).alias("__filled")
    )
    cut = F.transform("__filled", lambda s: F.slice(A.uniform_scale(s, F.col("__n")), 1, min_len))
    fixed = regrouped.withColumn("__n", longest).withColumn(dims, cut)
    if scale == "standard":
        fixed = fixed.withColumn(dims, F.transform(dims, lambda s: A.standardize(s, 0, 1.0)))
    elif scale == "minmax":
        fixed = fixed.withColumn(dims, F.transform(dims, lambda s: A.minmax(s, constant_divisor=1.0)))
    elif scale is not None:
        raise ValueError(f"unknown scale {scale!r}")
    return fixed.select(*df.columns)


def keep_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose id is in ``ids``."""
    return df.join(ids.select(key), key, "left_semi")


def attach(features: DataFrame, labels: DataFrame, key: str, groups: DataFrame | None = None) -> DataFrame:
    """Features with labels (and groups) of the same sample."""
    joined = features.join(labels, key)
    return joined if groups is None else joined.join(groups, key)


def example_long(spark, cases: int = 50, length: int = 20, dims: int = 2, seed: int = 0) -> DataFrame:
    """Seeded tidy table: one value per (case, dim, reading)."""
    from tidemill.functions.hashing import uniform

    index = F.col("id")
    keyed = spark.range(cases * dims * length).select(
        F.expr(f"id div {dims * length}").cast("int").alias("case_id"),
        (F.expr(f"id div {length}") % dims).cast("int").alias("dim_id"),
        (index % length).cast("int").alias("reading_id"),
    )
    return keyed.withColumn("value", uniform(seed, F.col("case_id"), F.col("dim_id"), F.col("reading_id")))


def position_value(t: Column, d: Column, dim: int) -> Column:
    """Positional encoding of step ``t`` in column ``d``, of any length: even columns sine, odd columns cosine of
    t * 10000^(-2i/dim)."""
    angle = t * F.exp((d - d % 2) * F.lit(-9.210340371976184 / dim))
    return F.when(d % 2 == 0, F.sin(angle)).otherwise(F.cos(angle))


def positional_encoding(spark, max_len: int, dim: int) -> DataFrame:
    """The same as a table (t, d, value) of ``max_len`` steps."""
    grid = spark.range(max_len).select(F.col("id").alias("t")).withColumn(
        "d", F.explode(F.sequence(F.lit(0), F.lit(dim - 1)))
    )
    return grid.select("t", "d", position_value(F.col("t"), F.col("d"), dim).alias("value"))
