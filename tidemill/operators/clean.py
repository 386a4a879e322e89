"""Column rules, filters and joins of the file-based data sets."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions.scalars import repaired_power
from tidemill.operators.quantiles import order_statistics
from tidemill.session import materialize


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """Drop columns without a single value; one aggregation decides."""
    seen = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(df.columns)]).first()
    return df.select(*[F.col(f"`{c}`") for i, c in enumerate(df.columns) if seen[i] > 0])


def drop_columns_like(df: DataFrame, part: str) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in df.columns if part not in c])


def rename_by_position(df: DataFrame, per: int = 3, skip: Sequence[str] = ()) -> DataFrame:
    """Digits in the name of column i become ``i // per``."""
    names, i = [], 0
    for c in df.columns:
        if c in skip:
            names.append(c)
            continue
        names.append(re.sub(r"\d+", str(i // per), c))
        i += 1
    return df.toDF(*names)


def median_per_file(df: DataFrame, file: str, value: str, out: str = "median") -> DataFrame:
    """Exact median per file; a file without values has no row. Files of any size are narrowed before anything is ordered."""
    middle = {"__low": lambda n: F.floor((n + 1) / 2), "__high": lambda n: F.floor(n / 2) + 1}
    found = order_statistics(df, [file], value, middle)
    return found.select(file, ((F.col("__low") + F.col("__high")) / 2).alias(out))


def repair_power(df: DataFrame, file: str, power: str, energy: str, interval: str, ceiling: float = 1e16) -> DataFrame:
    """Rename ``power`` to ``power`` proper and replace broken readings by energy over the file's median interval."""
    medians = materialize(median_per_file(df, file, interval, "__median").withColumnRenamed(file, "__file"), "medians")
    joined = df.join(medians, F.col(file).eqNullSafe(F.col("__file")), "left")
    return joined.withColumn(power, repaired_power(F.col(power), F.col(energy), F.col("__median"), ceiling)).drop("__median", "__file")


def null_counts(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns], F.count("*").alias("rows"))


def class_frequency(df: DataFrame, label: str) -> DataFrame:
    """(label, n, share); the total is a scalar subquery over the same small table."""
    counted = df.groupBy(label).agg(F.count("*").alias("n"))
    return counted.withColumn("share", F.col("n") / counted.agg(F.sum("n")).scalar())


def encode_classes(df: DataFrame, label: str, out: str = "code") -> tuple[DataFrame, DataFrame]:
    """Codes are positions in the sorted distinct labels; returns (encoded rows, dictionary)."""
    from tidemill.operators.ordered import dense_index

    distinct = df.filter(F.col(label).isNotNull()).select(label).distinct()
    dictionary = dense_index(distinct, [label], out=out, unique=True).withColumn(out, F.col(out).cast("int"))
    dictionary = materialize(dictionary, "classes")
    return df.join(dictionary, label, "left"), dictionary


def drop_unlabelled(features: DataFrame, labels: DataFrame, key: str, label: str) -> tuple[DataFrame, DataFrame]:
    kept = labels.filter(F.col(label).isNotNull())
    return features.join(kept.select(key), key, "left_semi"), kept


def merge_measurements(first: DataFrame, second: DataFrame, value: str, first_key: str = "Proc_cj_id",
                       second_key: str = "Control_job_id", wafer: str = "Wafer_id") -> DataFrame:
    """Full outer merge of two measurement kinds, one common value column, and where a row came from."""
    l = first.select(F.col(first_key), F.col(wafer).alias("__lw"), F.col(value).alias("__lv"), F.lit(True).alias("__l"))
    r = second.select(F.col(second_key), F.col(wafer).alias("__rw"), F.col(value).alias("__rv"), F.lit(True).alias("__r"))
    joined = l.join(r, F.col(first_key).eqNullSafe(F.col(second_key)) & F.col("__lw").eqNullSafe(F.col("__rw")), "full_outer")
    origin = F.when(F.col("__l").isNull(), "right_only").when(F.col("__r").isNull(), "left_only").otherwise("both")
    return joined.select(
        first_key, F.coalesce("__lw", "__rw").alias(wafer), second_key,
        F.coalesce("__lv", "__rv").alias(value), origin.alias("_merge"),
    )


def join_measurements(thickness: DataFrame, roughness: DataFrame, job: str = "Proc_cj_id", wafer: str = "Wafer_id") -> DataFrame:
    """Inner merge where null job ids match each other."""
    r = roughness.select(F.col(job).alias("__job"), F.col(wafer).alias("__wafer"),
                         *[c for c in roughness.columns if c not in (job, wafer) and c not in thickness.columns])
    on = F.col(job).eqNullSafe(F.col("__job")) & F.col(wafer).eqNullSafe(F.col("__wafer"))
    return thickness.join(r, on).drop("__job", "__wafer")


def health_check(df: DataFrame, columns: Sequence[str], bins: int = 20, tiny: float = 1e-8, huge: float = 1e6) -> tuple[DataFrame, DataFrame]:
    """Per feature: nulls, near-zero and huge values, min, exact median, max; and an even-width histogram."""
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in columns])))
    summary = long.groupBy("feature").agg(
        F.count_if(F.col("x").isNull() | F.isnan("x")).alias("missing"),
        F.count_if(F.abs("x") < tiny).alias("near_zero"),
        F.count_if(F.abs("x") > huge).alias("huge"),
        F.min("x").alias("min"), F.max("x").alias("max"),
    )
    medians = materialize(median_per_file(long.filter(~F.isnan("x")), "feature", "x").withColumnRenamed("feature", "__feature"), "medians")
    summary = summary.join(medians, F.col("feature") == F.col("__feature"), "left").select(
        "feature", "missing", "near_zero", "huge", "min", "median", "max")
    limits = summary.agg(F.map_from_entries(F.collect_list(F.struct("feature", F.struct("min", "max")))).alias("m")).scalar()
    b = F.element_at(F.col("__m"), F.col("feature"))
    width = F.nullif((b["max"] - b["min"]) / bins, F.lit(0.0))
    slot = F.least(F.floor((F.col("x") - b["min"]) / width), F.lit(bins - 1))
    histogram = (
        long.filter(F.col("x").isNotNull()).withColumn("__m", limits)
        .groupBy("feature", F.coalesce(slot, F.lit(0)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    )
    return summary, histogram


def union_tolerant(*frames: DataFrame) -> DataFrame:
    """Bag union by name; columns a frame lacks are null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def fill_zero(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.na.fill(0, subset=list(columns))
