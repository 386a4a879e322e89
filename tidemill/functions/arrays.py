"""Expressions over one series per row (``array<double>``); no shuffle, no Python workers."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType


def decimate(series: Column, factor: int = 2, limit: int = 256) -> Column:
    """Keep every ``factor``-th step when the series is longer than ``limit`` (0 = always)."""
    thinned = F.filter(series, lambda _, i: i % factor == 0)
    return F.when(F.size(series) > limit, thinned).otherwise(series)


def uniform_scale(series: Column, length: Column | int) -> Column:
    """Stretch or shrink to ``length`` steps by index scaling: step j reads ``int(j * n / length)``."""
    m = F.lit(length).cast("bigint") if isinstance(length, int) else length.cast("bigint")
    n = F.size(series).cast("bigint")
    steps = F.transform(
        F.sequence(F.lit(0).cast("bigint"), m - 1),
        lambda j: F.get(series, F.floor(j * n / m).cast("int")),
    )
    return F.when((m > 0) & (n > 0), steps).otherwise(F.slice(series, 1, 0))


def pad(series: Column, length: int, fill: float = 0.0) -> Column:
    """Clip to ``length`` steps, or pad at the end with ``fill``."""
    missing = F.greatest(F.lit(length) - F.size(series), F.lit(0))
    return F.concat(F.slice(series, 1, length), F.array_repeat(F.lit(fill), missing))


def padding_mask(n: Column, length: int) -> Column:
    """``length`` booleans, true where a real step exists."""
    return F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda t: t < n)


@F.pandas_udf(ArrayType(DoubleType()))
def _interpolate(series: pd.Series) -> pd.Series:
    def fill(values):
        if values is None:
            return None
        y = np.asarray(values, dtype="float64")
        known = np.flatnonzero(~np.isnan(y))
        if known.size in (0, y.size):
            return [None] * y.size if known.size == 0 else y
        return np.interp(np.arange(y.size), known, y[known])

    return series.map(fill)


def interpolate(series: Column) -> Column:
    """Fill nulls linearly between neighbours, ends with the nearest value; all-null stays null.

    Linear time per row in Arrow batches; the same fold written with array functions copies the array
    at every step. Series too long for one row use ``operators.resample.interpolate`` instead.
    """
    return _interpolate(series.cast("array<double>"))


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once, though ``use`` may read it for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def total(series: Column) -> Column:
    return F.aggregate(series, F.lit(0.0), lambda a, x: a + x)


def mean(series: Column) -> Column:
    return F.try_divide(total(series), F.size(series))


def spread(series: Column, ddof: int = 1) -> Column:
    """Standard deviation of one array; null when fewer than ``ddof + 1`` values."""
    squares = bind(mean(series), lambda m: F.aggregate(series, F.lit(0.0), lambda a, x: a + (x - m) * (x - m)))
    return F.sqrt(F.try_divide(squares, F.size(series) - ddof))


def standardize(series: Column, ddof: int = 1, constant_divisor: float | None = None) -> Column:
    """(x - mean) / std of the row's own series; a constant series gives nulls, or divides by the given value."""
    s = spread(series, ddof)
    divisor = s if constant_divisor is None else F.coalesce(F.nullif(s, F.lit(0.0)), F.lit(constant_divisor))
    return bind(F.struct(mean(series).alias("m"), divisor.alias("d")), lambda v: F.transform(series, lambda x: F.try_divide(x - v["m"], v["d"])))


def minmax(series: Column, eps: float = 2.220446049250313e-16, constant_divisor: float | None = None) -> Column:
    lo, hi = F.array_min(series), F.array_max(series)
    if constant_divisor is None:
        divisor = hi - lo + F.lit(eps)
    else:
        divisor = F.coalesce(F.nullif(hi - lo, F.lit(0.0)), F.lit(constant_divisor))
    return bind(F.struct(lo.alias("lo"), divisor.alias("d")), lambda v: F.transform(series, lambda x: F.try_divide(x - v["lo"], v["d"])))


def transpose(rows: Column) -> Column:
    """``array<array<T>>`` of shape (a, b) to (b, a)."""
    width = F.size(F.get(rows, F.lit(0)))
    return F.transform(
        F.sequence(F.lit(0), width - 1), lambda j: F.transform(rows, lambda r: F.get(r, j))
    )


def take(series: Column, indexes: Column) -> Column:
    return F.transform(indexes, lambda i: F.get(series, i.cast("int")))


def softmax(scores: Column) -> Column:
    raised = bind(F.array_max(scores), lambda top: F.transform(scores, lambda s: F.exp(s - top)))
    return bind(raised, lambda r: bind(total(r), lambda norm: F.transform(r, lambda e: e / norm)))


def log_softmax_at(scores: Column, index: Column) -> Column:
    """Logarithm of one entry of ``softmax``, without making the others."""
    return bind(F.array_max(scores), lambda top: F.get(scores, index.cast("int")) - top - F.log(
        F.aggregate(scores, F.lit(0.0), lambda a, s: a + F.exp(s - top))))


def logistic_pair(score: Column) -> Column:
    """Decision score of a two-class model to [P(0), P(1)]."""
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-score))
    return F.array(F.lit(1.0) - p, p)


def argmax(scores: Column) -> Column:
    """Index of the largest score; the first one on ties."""
    return F.array_position(scores, F.array_max(scores)).cast("int") - 1


def rank_of(scores: Column, index: Column) -> Column:
    """1-based rank of ``scores[index]`` in descending order, earlier classes first on ties."""
    mine = F.get(scores, index.cast("int"))
    ahead = F.filter(scores, lambda s, i: (s > mine) | ((s == mine) & (i < index)))
    return F.size(ahead) + 1


def mode_first_seen(labels: Column) -> Column:
    """Most frequent non-null value; the one seen first wins a tie."""
    kept = F.filter(labels, lambda x: x.isNotNull())
    counted = F.transform(
        F.array_distinct(kept),
        lambda v: F.struct(
            F.size(F.filter(kept, lambda x: x == v)).alias("n"),
            (-F.array_position(kept, v)).alias("seen"),
            v.alias("v"),
        ),
    )
    return F.array_max(counted)["v"]


LABEL_AGGREGATES = {
    "mode": mode_first_seen,
    "mean": lambda a: F.try_divide(
        F.aggregate(F.filter(a, lambda x: x.isNotNull()), F.lit(0.0), lambda s, x: s + x.cast("double")),
        F.size(F.filter(a, lambda x: x.isNotNull())),
    ),
    "max": F.array_max,
    "min": F.array_min,
    "sum": lambda a: F.aggregate(
        F.filter(a, lambda x: x.isNotNull()), F.lit(0.0), lambda s, x: s + x.cast("double")
    ),
    "all": lambda a: a,
}
