"""Sliding windows by row offsets, tumbling count windows, and class caps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions.arrays import LABEL_AGGREGATES
from tidemill.functions.scalars import floor_div
from tidemill.operators.ordered import dense_index
from tidemill.operators.resample import SEGMENT
from tidemill.schema import require
from tidemill.session import materialize

PADDINGS = ("extrapolate", "skip", "zeros")


def sample_windows(
    grid: DataFrame,
    group: str,
    features: Sequence[str],
    label: str,
    stamps: Sequence[int],
    label_stamps: Sequence[int] = (0,),
    jump: int = 1,
    padding: str = "extrapolate",
    start: int = 0,
    label_agg: str = "mode",
    method: str = "auto",
    segment: int = SEGMENT,
) -> DataFrame:
    """One row per window centre: (group, center, steps, labels, label).

    ``grid`` has dense ``pos`` from 0 and the group's ``length``. A window reads the rows ``center + stamp``.
    ``steps`` is an array of feature structs in stamp order, ``labels`` the label readings, ``label`` their
    aggregate. ``extrapolate`` clips indexes to the group, ``skip`` keeps centres whose window lies inside,
    ``zeros`` reads feature zeros outside (labels are clipped).

    Two exact ways, chosen by the work they make: ``frame`` shuffles each row about once, by segment of the
    group, and reads windows from a bounded row frame; ``scatter`` sends each row to the centres that read
    it, better for long jumps and for few stamps far apart.
    """
    require(grid, group, label, "pos", "length", *features)
    stamps, label_stamps = list(stamps), list(label_stamps)
    if not stamps or not label_stamps or jump < 1 or padding not in PADDINGS:
        raise ValueError("stamps, label_stamps, jump >= 1 and a known padding are needed")
    reach = [0, *stamps, *label_stamps]
    width = max(reach) - min(reach) + 1
    if method == "auto":
        reads = len(stamps) + len(label_stamps)
        method = "scatter" if jump >= 2 * reads or width > 8 * reads else "frame"
    build = {"frame": _by_frame, "scatter": _by_scatter}[method]
    rows = grid.select(group, "pos", "length", F.struct(*features).alias("__f"), F.col(label).alias("__l"))
    read = build(rows, group, stamps, label_stamps, jump, padding, start, segment)
    if padding == "zeros":
        zero = F.struct(*[F.lit(0.0).cast(grid.schema[c].dataType).alias(c) for c in features])
        outside = F.array(*[
            (F.col("center") + s < 0) | (F.col("center") + s >= F.col("length")) for s in stamps
        ])
        steps = F.transform(F.arrays_zip(F.col("steps").alias("v"), outside.alias("out")),
                            lambda z: F.when(z["out"], zero).otherwise(z["v"]))
        read = read.withColumn("steps", steps)
    return read.select(group, "center", "steps", "labels", LABEL_AGGREGATES[label_agg](F.col("labels")).alias("label"))


def _centre_ok(stamps: list[int], jump: int, padding: str, start: int) -> Column:
    c, n = F.col("center"), F.col("length")
    ok = (c >= start) & ((c - start) % jump == 0)
    if padding == "skip":
        ok = ok & (c + min(stamps) >= 0) & (c + max(stamps) < n)
    return ok


def _by_frame(rows, group, stamps, label_stamps, jump, padding, start, segment):
    reach = [0, *stamps, *label_stamps]
    low, high = min(reach), max(reach)
    first = floor_div(F.greatest(F.col("pos") - high, F.lit(0)), segment)
    last = floor_div(F.least(F.col("pos") - low, F.col("length") - 1), segment)
    spread = rows.withColumn("__seg", F.explode(F.sequence(first, last)))
    frame = Window.partitionBy(group, "__seg").orderBy("pos").rowsBetween(low, high)
    collected = spread.select(
        group, F.col("pos").alias("center"), "length", "__seg",
        F.collect_list(F.struct("pos", "__f", "__l")).over(frame).alias("__w"),
    ).filter((floor_div(F.col("center"), segment) == F.col("__seg")) & _centre_ok(stamps + label_stamps, jump, padding, start))

    def at(stamp: int) -> Column:
        index = F.greatest(F.lit(0), F.least(F.col("center") + stamp, F.col("length") - 1))
        return F.get("__w", (index - F.col("__w")[0]["pos"]).cast("int"))

    return collected.select(
        group, "center", "length",
        F.array(*[at(s)["__f"] for s in stamps]).alias("steps"),
        F.array(*[at(s)["__l"] for s in label_stamps]).alias("labels"),
    )


def _by_scatter(rows, group, stamps, label_stamps, jump, padding, start, segment):
    pos, end = F.col("pos"), F.col("length") - 1

    def centres(stamp: int, slot: int) -> Column:
        low = F.when(pos == 0, F.lit(0)).otherwise(pos - stamp)
        high = F.when(pos == end, end).otherwise(pos - stamp)
        low = F.greatest(low, F.lit(start).cast("bigint"))
        low = low + F.pmod(F.lit(start) - low, F.lit(jump))
        high = F.least(high, end)
        reads = F.sequence(low.cast("bigint"), high.cast("bigint"), F.lit(jump).cast("bigint"))
        none = F.array().cast("array<bigint>")
        return F.transform(F.when(low <= high, reads).otherwise(none),
                           lambda c: F.struct(c.alias("center"), F.lit(slot).alias("slot")))

    every = list(enumerate(stamps + label_stamps))
    sent = rows.withColumn("__to", F.explode(F.concat(*[centres(s, i) for i, s in every])))
    sent = sent.select(
        group, "length", F.col("__to.center").alias("center"), F.col("__to.slot").alias("slot"),
        F.when(F.col("__to.slot") < len(stamps), F.col("__f")).alias("__f"),
        F.when(F.col("__to.slot") >= len(stamps), F.col("__l")).alias("__l"),
    ).filter(_centre_ok(stamps + label_stamps, jump, padding, start))
    # a centre receives exactly one row per stamp, so the arrays are of fixed size
    packed = sent.groupBy(group, "center", "length").agg(
        F.array_sort(F.collect_list(F.struct("slot", "__f", "__l"))).alias("__w")
    )
    return packed.select(
        group, "center", "length",
        F.transform(F.slice("__w", 1, len(stamps)), lambda x: x["__f"]).alias("steps"),
        F.transform(F.slice("__w", len(stamps) + 1, len(label_stamps)), lambda x: x["__l"]).alias("labels"),
    )


def explode_steps(windows: DataFrame, group: str) -> DataFrame:
    """Long form: (group, center, t, <features>)."""
    return windows.select(group, "center", "label", F.posexplode("steps").alias("t", "__s")).select(
        group, "center", "label", "t", "__s.*"
    )


def positioned(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``pos`` and ``length`` for rows that are not on a time grid."""
    ranked = dense_index(df, order, keys, "pos")
    sizes = df.groupBy(*keys).agg(F.count("*").alias("length"))
    return ranked.join(sizes, list(keys))


def count_windows(df: DataFrame, order: Sequence[str], length: int, out: str = "sample_id") -> DataFrame:
    """Tumbling windows of ``length`` rows over the whole frame's order: ``out`` and the step ``t``."""
    indexed = dense_index(df, order, out="__i")
    return indexed.withColumns(
        {out: floor_div(F.col("__i"), length), "t": F.col("__i") % length}
    ).drop("__i")


def cap_per_class(df: DataFrame, label: str, order: Sequence[str], max_rows: int) -> DataFrame:
    """At most ``max_rows`` rows per label, the surplus deleted at an even stride along ``order``.

    With m = n - max surplus rows, rank r goes iff some k < m has floor(k * n / m) = r.
    """
    ranked = dense_index(df, order, [label], "__r")
    sizes = df.groupBy(label).agg(F.count("*").alias("__n")).withColumn("__m", F.col("__n") - max_rows)
    sizes = materialize(sizes.withColumnRenamed(label, "__label"), "sizes")
    m = F.col("__m")
    # products of two counts outgrow 64 bits
    k = "((CAST(__r AS DECIMAL(19, 0)) * CAST(__m AS DECIMAL(18, 0)) + __n - 1) div __n)"
    drop = (m > 0) & F.expr(f"{k} < __m AND CAST({k} AS DECIMAL(19, 0)) * CAST(__n AS DECIMAL(18, 0)) div __m = __r")
    joined = ranked.join(sizes, F.col(label).eqNullSafe(F.col("__label")))
    return joined.filter((m <= 0) | ~drop).select(*df.columns)


def length_stats(samples: DataFrame, sample: str, dims: Sequence[Column]) -> DataFrame:
    """Per sample: longest and shortest dimension and whether all are of one length."""
    sizes = F.array(*[F.size(d) for d in dims])
    return samples.select(
        sample, F.array_max(sizes).alias("max_len"), F.array_min(sizes).alias("min_len"),
        (F.array_max(sizes) == F.array_min(sizes)).alias("equal_dims"),
    )


def length_summary(stats: DataFrame) -> DataFrame:
    return stats.agg(
        F.count("*").alias("samples"), F.max("max_len").alias("max_len"), F.min("max_len").alias("shortest"),
        F.min("equal_dims").alias("equal_dims"), (F.min("max_len") == F.max("max_len")).alias("equal_samples"),
    )
