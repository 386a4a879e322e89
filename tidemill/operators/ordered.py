"""Running aggregates and dense positions over a total order, without one task seeing a whole group.

The rows are sorted globally (range partitions, so a group of any size spreads over many of them) and
written once; each partition is then scanned on its own, and what earlier partitions pass on is a table
with at most one row per partition.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from tidemill.functions.scalars import floor_div
from tidemill.session import materialize

_COMBINE = {
    "sum": (F.sum, lambda carry, local: F.coalesce(carry + local, local, carry)),
    "max": (F.max, F.greatest),
    "min": (F.min, F.least),
    "last": (
        lambda c: F.last(c, ignorenulls=True),
        lambda carry, local: F.coalesce(local, carry),
    ),
}


def running(
    df: DataFrame,
    order: Sequence[Column | str],
    aggs: dict[str, tuple[str, Column]],
    keys: Sequence[str] = (),
    unique: bool = False,
) -> DataFrame:
    """Add columns of running ``sum``/``max``/``min``/``last`` (first to current row) along ``order``.

    Unless ``order`` is known to be ``unique`` within ``keys``, a hash of the row breaks ties, so that many
    rows of equal order still spread over partitions and come out in the same order every time.
    """
    keys = list(keys)
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    if not unique:
        order.append(F.xxhash64(*[F.col(c.name) for c in df.schema if not isinstance(c.dataType, (MapType, VariantType))]))
    inputs = {f"__in_{name}": expr for name, (_, expr) in aggs.items()}
    ordered = (
        df.withColumns(inputs)
        .orderBy(*keys, *order)
        .withColumns({"__part": F.spark_partition_id(), "__row": F.monotonically_increasing_id()})
    )
    ordered = materialize(ordered, "ordered")

    totals = ordered.groupBy("__part", *keys).agg(
        *[
            (F.max_by(f"__in_{name}", F.when(F.col(f"__in_{name}").isNotNull(), F.col("__row"))) if kind == "last"
             else _COMBINE[kind][0](f"__in_{name}")).alias(f"__tot_{name}")
            for name, (kind, _) in aggs.items()
        ]
    )
    # rows of one key over partitions: as many as partitions the key touches
    earlier = Window.partitionBy(*keys).orderBy("__part") if keys else Window.partitionBy(F.lit(0)).orderBy("__part")
    before = earlier.rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.withColumns(
        {
            **{f"__carry_{name}": _COMBINE[kind][0](F.col(f"__tot_{name}")).over(before)
               for name, (kind, _) in aggs.items()},
            "__nth": F.row_number().over(earlier),
        }
    ).filter("__nth > 1")
    # the sort leaves at most one key per partition that began in an earlier one
    carry = carry.select(
        F.col("__part").alias("__cpart"),
        F.struct(*[F.col(k) for k in keys], F.lit(0).alias("__z")).alias("__ckey"),
        *[f"__carry_{name}" for name in aggs],
    )
    here = Window.partitionBy("__part", *keys).orderBy("__row").rowsBetween(Window.unboundedPreceding, 0)
    local = ordered.withColumns(
        {f"__loc_{name}": _COMBINE[kind][0](F.col(f"__in_{name}")).over(here) for name, (kind, _) in aggs.items()}
    )
    joined = local.join(
        F.broadcast(carry),
        (F.col("__part") == F.col("__cpart"))
        & F.struct(*[F.col(k) for k in keys], F.lit(0).alias("__z")).eqNullSafe(F.col("__ckey")),
        "left",
    )
    return joined.select(
        *df.columns,
        *[
            _COMBINE[kind][1](F.col(f"__carry_{name}"), F.col(f"__loc_{name}")).alias(name)
            for name, (kind, _) in aggs.items()
        ],
    )


def dense_index(df: DataFrame, order: Sequence[Column | str], keys: Sequence[str] = (), out: str = "idx",
                unique: bool = False) -> DataFrame:
    """0-based dense position along ``order`` (within ``keys``)."""
    return running(df, order, {out: ("sum", F.lit(1).cast("bigint"))}, keys, unique).withColumn(out, F.col(out) - 1)


def first_by_hash(
    df: DataFrame,
    hashed: Column,
    tie: str,
    keys: Sequence[str],
    wanted: Callable[[Column], Column],
    out: str = "chosen",
    buckets: int = 4096,
) -> DataFrame:
    """Flag exactly the first ``wanted(n)`` of the n rows of each key, in order of a uniform 32-bit hash.

    A histogram of the hash's high bits tells, per key, which bucket holds the cut; only that bucket (about
    1/``buckets`` of the key) is ordered, to find the last row chosen. That row's (hash, tie) is the key's
    threshold, a table with one row per key, written once; all rows are then decided where they stand.
    """
    keys = list(keys)
    width = 4294967296 // buckets
    rows = df.withColumn("__h", hashed).withColumn("__b", floor_div(F.col("__h"), width))
    histogram = rows.groupBy(*keys, "__b").agg(F.count("*").alias("__c"))
    by_bucket = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("__c").over(Window.partitionBy(*keys))
    cut = (
        histogram.withColumns({"__cum": F.sum("__c").over(by_bucket), "__n": wanted(total).cast("bigint")})
        .filter((F.col("__cum") >= F.col("__n")) & (F.col("__cum") - F.col("__c") < F.col("__n")))
        .select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col("__b").alias("__cut"),
                (F.col("__n") - F.col("__cum") + F.col("__c")).alias("__need"))
    )

    def same_key(columns: Sequence[str]) -> Column:
        on = F.lit(True)
        for k in columns:
            on = on & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
        return on

    at_cut = rows.join(materialize(cut, "cut"), same_key(keys) & (F.col("__b") == F.col("__cut")))
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("__h", tie))
    last = at_cut.withColumn("__rn", nth).filter("__rn = __need").select(
        *[F.col(k).alias(f"__k_{k}") for k in keys], F.struct(F.col("__h").alias("h"), F.col(tie).alias("t")).alias("__last")
    )
    marked = rows.join(materialize(last, "thresholds"), same_key(keys), "left")
    chosen = F.struct(F.col("__h").alias("h"), F.col(tie).alias("t")) <= F.col("__last")
    return marked.select(*df.columns, F.coalesce(chosen, F.lit(False)).alias(out))
