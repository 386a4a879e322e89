"""Exact order statistics of many groups at once: ranges of values are narrowed until what is left of a group is small.

A quantile sketch names two values around each rank wanted; one counting pass tells exactly on which side of them, or between
them, the rank lies, whatever the sketch's error. Every round leaves about 4/``bins`` of a group, and only that is written and
read by the next one, so no group is ever sorted as a whole and a value that fills a third of the rows costs no more than others.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.session import materialize

_STATE = "struct<rank:bigint,inside:bigint,low:double,high:double,found:double>"


def _open(t: str) -> Column:
    return F.col(t)["found"].isNull()


def _within(t: str) -> Column:
    """Whether a row's value lies in the open range where ``t`` is still searched; a null end is none."""
    low, high = F.col(t)["low"], F.col(t)["high"]
    return _open(t) & (low.isNull() | (F.col("__v") > low)) & (high.isNull() | (F.col("__v") < high))


def _any(conditions: Sequence[Column]) -> Column:
    return reduce(or_, conditions)


def _meet(rows: DataFrame, groups: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join by keys, null ones too; the keys of ``rows`` stay."""
    other = groups.withColumnsRenamed({k: f"{k}_" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys]
    return rows.join(other, reduce(lambda a, b: a & b, same), how).drop(*[f"{k}_" for k in keys])


def _narrowed(t: str) -> Column:
    """The range of ``t`` after a round: counts below and up to both values around it say where its rank is."""
    s, lo, hi = F.col(t), F.col(f"{t}_lo"), F.col(f"{t}_hi")
    below, upto, before, through = (F.col(f"{t}_{c}") for c in ("below", "upto", "before", "through"))

    def state(rank: Column, inside: Column, low: Column, high: Column, found: Column | None = None) -> Column:
        value = F.lit(None).cast("double") if found is None else found
        return F.struct(rank.alias("rank"), inside.alias("inside"), low.alias("low"), high.alias("high"), value.alias("found")).cast(_STATE)

    return (
        F.when(lo.isNull(), s)
        .when(s["rank"] <= below, state(s["rank"], below, s["low"], lo))
        .when(s["rank"] <= upto, state(s["rank"], s["inside"], s["low"], s["high"], lo))
        .when(s["rank"] <= before, state(s["rank"] - upto, before - upto, lo, hi))
        .when(s["rank"] <= through, state(s["rank"], s["inside"], s["low"], s["high"], hi))
        .otherwise(state(s["rank"] - through, s["inside"] - through, hi, s["high"]))
    )


def _round(rows: DataFrame, state: DataFrame, keys: Sequence[str], targets: Sequence[str], small: int, bins: int, first: bool) -> DataFrame:
    """State after every target that is still wide has been narrowed once."""
    def wide(t: str) -> Column:
        return _open(t) & (F.col(t)["inside"] > small)

    groups = state.filter(_any([wide(t) for t in targets]))
    grid = [i / bins for i in range(bins + 1)]
    # at first all targets share a range, and equal aggregates are worked out once
    sketched = _meet(rows, groups, keys).groupBy(*keys).agg(*[
        F.percentile_approx(F.col("__v") if first else F.when(_within(t), F.col("__v")), grid, 8 * bins).alias(f"{t}_grid") for t in targets])
    ends = {}
    for t in targets:
        share = F.col(t)["rank"] * bins / F.col(t)["inside"]
        left, right = F.greatest(F.floor(share) - 1, F.lit(1)).cast("int"), F.least(F.ceil(share) + 2, F.lit(bins + 1)).cast("int")
        ends[f"{t}_lo"] = F.when(wide(t), F.element_at(f"{t}_grid", left))
        ends[f"{t}_hi"] = F.when(wide(t), F.element_at(f"{t}_grid", right))
    placed = materialize(_meet(groups, sketched, keys).withColumns(ends).drop(*[f"{t}_grid" for t in targets]), "rank-ends")
    counts = []
    for t in targets:
        v, lo, hi = F.col("__v"), F.col(f"{t}_lo"), F.col(f"{t}_hi")
        counts += [F.count_if(_within(t) & held).alias(f"{t}_{name}")
                   for name, held in (("below", v < lo), ("upto", v <= lo), ("before", v < hi), ("through", v <= hi))]
    counted = _meet(_meet(rows, placed, keys).groupBy(*keys).agg(*counts), placed.select(*keys, *ends), keys)
    return _meet(state, counted, keys, "left").select(*keys, "__n", *[_narrowed(t).alias(t) for t in targets])


def order_statistics(df: DataFrame, keys: Sequence[str], value: str, ranks: dict[str, Callable[[Column], Column]],
                     size: str | None = None, small: int = 1_000_000, bins: int = 1024) -> DataFrame:
    """One row per group: for each of ``ranks`` the value of that rank (from 1) in ascending order, as double.

    A rank is given as a function of the number of the group's values, which ``size`` may name as a column of its own. Nulls are no
    values, and a group without values has no row; NaN is the largest value; null keys are groups. Ranks outside 1..n are
    moved to the nearest end. Without ``keys`` there is one row (none for a table without values).

    Groups of at most ``small`` rows, and what narrowing leaves of larger ones, are counted by value and ordered in windows.
    """
    inner, targets = [f"__k{i}" for i in range(max(len(keys), 1))], [f"__t{i}" for i in range(len(ranks))]
    named = [F.col(k).alias(i) for k, i in zip(keys, inner)] or [F.lit(0).alias(inner[0])]
    rows = df.filter(F.col(value).isNotNull()).select(*named, F.col(value).cast("double").alias("__v"))
    none = F.lit(None).cast("double")
    state = rows.groupBy(*inner).agg(F.count("*").alias("__n")).select(*inner, "__n", *[
        F.struct(F.greatest(F.least(rank(F.col("__n")).cast("bigint"), F.col("__n")), F.lit(1)).alias("rank"), F.col("__n").alias("inside"),
                 none.alias("low"), none.alias("high"), none.alias("found")).cast(_STATE).alias(t)
        for t, rank in zip(targets, ranks.values())])
    state = materialize(state, "ranks")
    large = F.col("__n") > small
    left = rows  # of large groups: the rows that can still be the ones wanted
    first = True
    while not state.filter(_any([_open(t) & (F.col(t)["inside"] > small) for t in targets])).isEmpty():
        state = materialize(_round(left, state, inner, targets, small, bins, first), "ranks")
        open_groups = state.filter(large & _any([_open(t) for t in targets]))
        left = materialize(_meet(left, open_groups, inner).filter(_any([_within(t) for t in targets])).select(*inner, "__v"), "rank-rows")
        first = False

    searched = _meet(rows, state.filter(~large), inner)
    if not first:
        searched = searched.unionByName(_meet(left, state.filter(large), inner))
    ranges = F.array_distinct(F.array(*[F.when(_within(t), F.struct(F.col(t)["low"].alias("low"), F.col(t)["high"].alias("high"))) for t in targets]))
    by_value = searched.select(*inner, "__v", F.explode(F.filter(ranges, lambda r: r.isNotNull())).alias("__r")).groupBy(
        *inner, "__r", "__v").agg(F.count("*").alias("__c"))
    here = [*inner, "__r"]
    from_start = "sum(__c) OVER (PARTITION BY {} ORDER BY __v ROWS UNBOUNDED PRECEDING)".format(", ".join(here))
    summed = _meet(by_value.withColumn("__cum", F.expr(from_start)), state, inner)
    hit = {t: _open(t) & F.col("__r")["low"].eqNullSafe(F.col(t)["low"]) & F.col("__r")["high"].eqNullSafe(F.col(t)["high"])
           & (F.col("__cum") >= F.col(t)["rank"]) & (F.col("__cum") - F.col("__c") < F.col(t)["rank"]) for t in targets}
    ordered = summed.groupBy(*inner).agg(*[F.max(F.when(hit[t], F.col("__v"))).alias(f"{t}_v") for t in targets])
    return _meet(state, ordered, inner, "left").select(
        *[F.col(i).alias(k) for k, i in zip(keys, inner)], *([F.col("__n").alias(size)] if size else []),
        *[F.coalesce(F.col(t)["found"], F.col(f"{t}_v")).alias(name) for t, name in zip(targets, ranks)])


def quantiles(df: DataFrame, keys: Sequence[str], value: str, shares: dict[str, float], small: int = 1_000_000, bins: int = 1024) -> DataFrame:
    """One row per group: the exact quantile of each share (0 to 1), linear between the two values around it. Otherwise as ``order_statistics``."""
    bad = {name: q for name, q in shares.items() if not 0 <= q <= 1}
    if bad:
        raise ValueError(f"shares must lie between 0 and 1: {bad}")
    ranks = {}
    for i, q in enumerate(shares.values()):
        ranks[f"__low{i}"] = lambda n, q=q: F.floor(q * (n - 1)) + 1
        ranks[f"__high{i}"] = lambda n, q=q: F.ceil(q * (n - 1)) + 1
    found = order_statistics(df, keys, value, ranks, "__size", small, bins)

    def between(i: int, q: float) -> Column:
        low, high, at = F.col(f"__low{i}"), F.col(f"__high{i}"), q * (F.col("__size") - 1)
        return F.when(low == high, low).otherwise(low + (high - low) * (at - F.floor(at)))

    return found.select(*keys, *[between(i, q).alias(name) for i, (name, q) in enumerate(shares.items())])
