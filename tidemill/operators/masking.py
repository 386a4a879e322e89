"""Reproducible masks over samples (true = keep, false = hide) and the rules that apply them."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions.arrays import bind
from tidemill.functions.hashing import uniform


def bernoulli_keep(
    ratio: float, seed: int, sample: Column, t: Column, f: Column, mode: str = "separate", exclude: Sequence[int] = ()
) -> Column:
    """Keep flag of one cell: each cell (``separate``) or each step (``concurrent``) is hidden with ``ratio``."""
    parts = (sample, f, t) if mode == "separate" else (sample, t)
    keep = uniform(seed, *parts) >= ratio
    return F.when(f.isin(list(exclude)), F.lit(True)).otherwise(keep) if exclude else keep


def markov_keep(dims: Column, ratio: float, mean_len: float, seed: int, key: Column, apart: bool = True) -> Column:
    """``array<array<boolean>>`` of the shape of ``dims``, a two-state chain for each series: hidden runs of ``mean_len`` steps on
    average, ``ratio`` hidden overall.

    The chain is drawn by its runs, which are geometric: run i is 1 + floor(ln(1 - u) / ln(1 - p)) steps long, where p is the chance
    to leave its state and u the ``uniform`` of the key, the series if ``apart``, and i; the draw of -1 gives the first run's state.
    Runs are drawn until they cover the series, then written out, so there is one hash a run and not one a step. A null series gives
    a null row of the mask, a series without steps an empty one.
    """
    if ratio >= 1:
        return F.transform(dims, lambda s: F.transform(s, lambda _: F.lit(False)))
    stop_hidden = 1.0 / mean_len
    stop_kept = stop_hidden * ratio / (1 - ratio)

    def row(series: Column, f: Column) -> Column:
        steps = F.size(series)
        parts = (key, f) if apart else (key,)

        def length(i: Column, kept: Column) -> Column:
            left = F.log(1 - uniform(seed, *parts, i))
            runs = [steps if p <= 0 else F.lit(1) if p >= 1 else F.least(1 + F.floor(left / F.lit(math.log1p(-p))), steps.cast("bigint"))
                    for p in (stop_kept, stop_hidden)]
            return F.when(kept, runs[0].cast("int")).otherwise(runs[1].cast("int"))

        def written(first: Column) -> Column:
            def state(i: Column) -> Column:
                return first == (i % 2 == 0)

            # the sum of run lengths stands still once the series is covered; the draws beyond are never made
            none = F.struct(F.lit(0).alias("n"), F.lit(0).alias("covered"))
            drawn = F.aggregate(series, none, lambda a, _: F.when(a["covered"] >= steps, a).otherwise(
                F.struct((a["n"] + 1).alias("n"), (a["covered"] + length(a["n"], state(a["n"]))).alias("covered"))), lambda a: a["n"])
            runs = F.transform(F.sequence(F.lit(0), drawn - 1), lambda i: F.array_repeat(state(i), length(i, state(i))))
            return F.slice(F.flatten(runs), F.lit(1), steps)

        flags = bind(uniform(seed, *parts, F.lit(-1)) > ratio, written)
        return F.when(steps > 0, flags).when(series.isNotNull(), F.array().cast("array<boolean>"))

    return F.transform(dims, row)


def noise_mask(
    df: DataFrame,
    sample: str,
    dims: str,
    ratio: float,
    mean_len: float = 3,
    mode: str = "separate",
    distribution: str = "geometric",
    exclude: Sequence[int] = (),
    seed: int = 1337,
    out: str = "mask",
) -> DataFrame:
    """Add ``out: array<array<boolean>>`` of the shape of ``dims`` (features x steps)."""
    if mode not in ("separate", "concurrent") or distribution not in ("geometric", "bernoulli"):
        raise ValueError("unknown mask mode or distribution")
    key = F.col(sample)
    if distribution == "geometric":
        df = df.withColumn(out, markov_keep(F.col(dims), ratio, mean_len, seed, key, mode == "separate"))
        if exclude:
            df = df.withColumn(out, F.transform(out, lambda row, f: F.when(
                f.isin(list(exclude)), F.transform(row, lambda _: F.lit(True))).otherwise(row)))
        return df

    def row(series: Column, f: Column) -> Column:
        keep = F.transform(F.sequence(F.lit(0), F.size(series) - 1), lambda t: bernoulli_keep(ratio, seed, key, t, f, mode))
        if exclude:
            keep = F.when(f.isin(list(exclude)), F.transform(series, lambda _: F.lit(True))).otherwise(keep)
        return F.when(F.size(series) > 0, keep).otherwise(F.array().cast("array<boolean>"))

    return df.withColumn(out, F.transform(dims, row))


def transduct_keep(t: Column, f: Column, length: Column, features: Sequence[int], start: float = 0.0, end: float = 0.0) -> Column:
    """Keep flag: listed features are hidden between ``int(start * L)`` and ``max(start, int((1 - end) * L))``."""
    first = F.floor(F.lit(start) * length)
    last = F.greatest(first, F.floor(F.lit(1 - end) * length))
    return ~(f.isin(list(features)) & (t >= first) & (t < last))


def transduct_mask(df: DataFrame, dims: str, features: Sequence[int], start: float = 0.0, end: float = 0.0, out: str = "mask") -> DataFrame:
    def row(series: Column, f: Column) -> Column:
        return F.transform(series, lambda _, t: transduct_keep(t, f, F.size(series), features, start, end))

    return df.withColumn(out, F.transform(dims, row))


def apply_mask(df: DataFrame, dims: str, mask: str, compensate: bool = False) -> DataFrame:
    """Hidden inputs become 0; ``targets`` keeps the values, ``target_mask`` is true where to predict.

    ``compensate`` scales the visible inputs of a step by (number of features) / max(1, visible).
    """
    pairs = F.transform(F.arrays_zip(F.col(dims).alias("x"), F.col(mask).alias("m")),
                        lambda z: F.arrays_zip(z["x"].alias("v"), z["m"].alias("k")))
    kept = F.transform(pairs, lambda s: F.transform(s, lambda z: F.when(z["k"], z["v"]).otherwise(F.lit(0.0))))
    if compensate:
        # visible features of each step, counted once: the masks are added up series by series
        none = F.transform(F.get(mask, F.lit(0)), lambda _: F.lit(0))
        visible = F.aggregate(mask, none, lambda a, r: F.zip_with(a, r, lambda n, k: F.coalesce(n, F.lit(0)) + F.coalesce(k.cast("int"), F.lit(0))))
        width = F.size(dims)
        plain = kept
        kept = bind(visible, lambda v: F.transform(plain, lambda s: F.transform(
            s, lambda x, t: x * width / F.greatest(F.lit(1), F.get(v, t)))))
    return df.withColumns({
        "targets": F.col(dims),
        dims: kept,
        "target_mask": F.transform(mask, lambda r: F.transform(r, lambda k: ~k)),
    })


def difficulty_schedule(spark, epochs: int, mean_len: float = 3, ratio: float = 0.15, hint: float = 0.5) -> DataFrame:
    """Mask settings per step of the schedule: run length +1 up to 20, ratio +0.05 up to 1, hints -0.1 down to 0."""
    step = F.col("id").cast("double")
    return spark.range(epochs).select(
        F.col("id").alias("step"),
        F.least(F.lit(20.0), F.lit(float(mean_len)) + step).alias("mean_len"),
        F.least(F.lit(1.0), F.lit(ratio) + step * 0.05).alias("ratio"),
        F.greatest(F.lit(0.0), F.lit(hint) - step * 0.1).alias("hint"),
    )
