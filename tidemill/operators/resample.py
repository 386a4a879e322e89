"""Clamp, regular grid and gap-limited fills of a continuous labelled frame.

Positions on the grid are arithmetic (slot number since the group's first slot), so a long group is cut
into segments of ``segment`` slots: every window below is partitioned by (group, segment) and never holds
more rows than that. What a segment needs from its neighbours is one summary row per segment.
Gaps stay implicit until the fill has been worked out; only then are the slots written out.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions.scalars import epoch_us, floor_div
from tidemill.operators.ordered import running
from tidemill.schema import Columns
from tidemill.session import materialize

DAY_US = 86_400_000_000
SEGMENT = 1 << 16


def group_ranges(df: DataFrame, cols: Columns, clamp_start: bool = True, clamp_end: bool = True) -> DataFrame:
    """Per group with at least one label: first/last microsecond to keep, by label or by row."""
    us = epoch_us(F.col(cols.ts))
    labelled = F.when(F.col(cols.label).isNotNull(), us)
    return (
        df.filter(F.col(cols.group).isNotNull())
        .groupBy(cols.group)
        .agg(
            F.min(labelled if clamp_start else us).alias("lo"),
            F.max(labelled if clamp_end else us).alias("hi"),
            F.count(cols.label).alias("n_labels"),
            F.count("*").alias("n_rows"),
        )
        .filter("n_labels > 0")
        .drop("n_labels")
    )


def clamp(
    df: DataFrame, cols: Columns, clamp_start: bool = True, clamp_end: bool = True, bounds: str = "exclusive"
) -> DataFrame:
    """A group's own rows between its first and last label; both ends are left out by default."""
    if bounds not in ("exclusive", "inclusive"):
        raise ValueError(f"unknown bounds {bounds!r}")
    ranges = materialize(group_ranges(df, cols, clamp_start, clamp_end).select(cols.group, "lo", "hi"), "ranges")
    us = epoch_us(F.col(cols.ts))
    inside = (
        (us > F.col("lo")) & (us < F.col("hi")) if bounds == "exclusive" else us.between(F.col("lo"), F.col("hi"))
    )
    return df.join(ranges, cols.group).filter(inside).drop("lo", "hi")


def adopt_rows(df: DataFrame, cols: Columns, clamp_start: bool = True, clamp_end: bool = True) -> DataFrame:
    """Rows of null group that lie strictly inside a group's time range take that group.

    Ranges and rows are merged in time order and the range started last is carried forward; ranges of
    different groups must not overlap (see ``overlapping_groups``).
    """
    ranges = group_ranges(df, cols, clamp_start, clamp_end)
    group_type = df.schema[cols.group].dataType
    starts = ranges.select(
        F.col("lo").alias("__us"), F.lit(0).alias("__kind"),
        F.struct("lo", "hi", F.col(cols.group).alias("g")).alias("__range"),
        F.lit(None).cast("bigint").alias("__tie"),
    )
    loose = df.filter(F.col(cols.group).isNull()).withColumn("__us", epoch_us(F.col(cols.ts)))
    order_tie = F.col(cols.tie).cast("bigint") if cols.tie else F.lit(None).cast("bigint")
    loose = loose.withColumns({"__kind": F.lit(1), "__tie": order_tie})
    merged = starts.unionByName(loose, allowMissingColumns=True)
    seen = running(merged, ["__us", "__kind", "__tie"], {"__r": ("max", F.col("__range"))}).filter("__kind = 1")
    inside = (F.col("__us") > F.col("__r.lo")) & (F.col("__us") < F.col("__r.hi"))
    adopted = seen.filter(inside).withColumn(cols.group, F.col("__r.g").cast(group_type))
    return df.filter(F.col(cols.group).isNotNull()).unionByName(adopted.select(*df.columns))


def overlapping_groups(df: DataFrame, cols: Columns, clamp_start: bool = True, clamp_end: bool = True) -> DataFrame:
    """Groups with rows of other groups strictly inside their time range: (group, foreign_rows).

    Counted by a running row count over time read at both ends of each range, so no pair of row and
    range is ever formed.
    """
    ranges = group_ranges(df, cols, clamp_start, clamp_end)
    own = clamp(df, cols, clamp_start, clamp_end).groupBy(cols.group).agg(F.count("*").alias("own"))
    us = epoch_us(F.col(cols.ts))
    per_instant = df.filter(F.col(cols.group).isNotNull()).groupBy(us.alias("__us")).agg(F.count("*").alias("__n"))
    none = F.lit(0).cast("bigint")
    # at equal instants: the upper end is read before the rows, the lower end after them
    points = (
        per_instant.select("__us", F.lit(1).alias("__kind"), "__n", F.lit(None).cast(df.schema[cols.group].dataType).alias(cols.group))
        .unionByName(ranges.select(F.col("lo").alias("__us"), F.lit(2).alias("__kind"), none.alias("__n"), cols.group))
        .unionByName(ranges.select(F.col("hi").alias("__us"), F.lit(0).alias("__kind"), none.alias("__n"), cols.group))
    )
    counted = running(points, ["__us", "__kind", cols.group], {"__cum": ("sum", F.col("__n"))}, unique=True)
    inside = (
        counted.filter("__kind <> 1")
        .groupBy(cols.group)
        .agg(F.sum(F.when(F.col("__kind") == 0, F.col("__cum")).otherwise(-F.col("__cum"))).alias("inside"))
    )
    return (
        inside.join(own, cols.group, "left")
        .select(cols.group, (F.greatest(F.col("inside"), F.lit(0)) - F.coalesce("own", F.lit(0))).alias("foreign_rows"))
        .filter("foreign_rows > 0")
    )


def _last_valid(column: str, order: Column) -> Column:
    return F.max_by(F.col(column), F.when(F.col(column).isNotNull(), order))


def bucket_last(df: DataFrame, cols: Columns, freq_ms: int) -> DataFrame:
    """Last non-null value of each column per group and slot: (group, anchor, bucket, values, n_rows).

    Slots are anchored at midnight of the group's first day. Where the step divides a day that anchor
    is the same for all groups and no per-group lookup is needed. With numeric labels (class codes) and no
    ``tie`` column every buffer is fixed-width, and Spark aggregates by hash before and after the shuffle;
    text labels or a tie-break make it sort.
    """
    freq = freq_ms * 1000
    us = epoch_us(F.col(cols.ts))
    order = F.struct(us, F.col(cols.tie)) if cols.tie else us
    if DAY_US % freq == 0:
        anchored = df.withColumn("anchor", F.lit(0).cast("bigint"))
    else:
        first = df.groupBy(cols.group).agg(F.min(us).alias("__first"))
        first = first.select(cols.group, (F.col("__first") - F.pmod(F.col("__first"), F.lit(DAY_US))).alias("anchor"))
        anchored = df.join(first, cols.group)
    return (
        anchored.withColumn("bucket", floor_div(us - F.col("anchor"), freq))
        .groupBy(cols.group, "anchor", "bucket")
        .agg(*[_last_valid(c, order).alias(c) for c in cols.values], F.count("*").alias("n_rows"))
    )


def positions(buckets: DataFrame, group: str, values: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(slot rows with ``pos`` counted from the group's first slot, one row per group with its span).

    The slot table is read several times from here on (spans, segment summaries, fill), so it is written
    once instead of scanning the raw rows each time. Group constants stay out of the slot rows.
    """
    buckets = materialize(buckets, "slots")
    span = buckets.groupBy(group).agg(
        F.max("anchor").alias("anchor"), F.min("bucket").alias("base"),
        (F.max("bucket") - F.min("bucket") + 1).alias("length"), F.sum("n_rows").alias("n_rows"),
    )
    span = materialize(span, "span")
    rows = buckets.join(span.select(group, "base"), group)
    return rows.select(group, (F.col("bucket") - F.col("base")).alias("pos"), *values), span


@dataclass(frozen=True)
class Fill:
    """How one column is filled: ``linear`` (both sides), or ``carry`` (forward, then back at the start only)."""

    column: str
    method: str
    limit: int | None = None


def _valid(column: str) -> Column:
    return F.when(F.col(column).isNotNull(), F.struct(F.col("pos").alias("p"), F.col(column).alias("v")))


def _edge_gap(fill: Fill, low: Column, high: Column, length: Column) -> Column:
    """Does the stretch between two valid slots (either may be absent) keep a null after the fill?"""
    if fill.limit is None:
        return F.lit(False)
    return (
        F.when(low.isNotNull() & high.isNotNull(), _inner_gap(fill, low, high))
        .when(low.isNull() & high.isNotNull(), high["p"] > fill.limit)
        .when(low.isNotNull(), length - 1 - low["p"] > fill.limit)
        .otherwise(length > 0)
    )


def _inner_gap(fill: Fill, low: Column, high: Column) -> Column:
    if fill.limit is None:
        return F.lit(False)
    return high["p"] - low["p"] - 1 > (2 * fill.limit if fill.method == "linear" else fill.limit)


def fill_slots(
    sparse: DataFrame,
    span: DataFrame,
    keys: Sequence[str],
    fills: Sequence[Fill],
    segment: int = SEGMENT,
    reject_gaps: bool = False,
    min_rows: int = 0,
    spread_gaps: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Materialise and fill every slot between a key's first and last one.

    ``sparse`` holds one row per observed slot (``pos``, 0 = first), ``span`` one row per key with its
    ``length`` and whatever else is constant. Returns the filled grid, with the columns of ``span``, and the
    per-segment summaries, whose ``gap`` flag says that the key keeps a null after the fill. ``reject_gaps``
    leaves such keys out of the grid, ``min_rows`` those with fewer ``n_rows``. ``spread_gaps`` is for data whose
    gaps have no bound: the segments of a gap are shuffled before their slots are written out.

    Rows are shuffled once by (key, segment); the summaries are built on the same exchange.
    """
    keys = list(keys)
    # the filter is what the join below implies; stated here, both uses of the rows share one exchange
    rows = sparse.withColumn("seg", floor_div(F.col("pos"), segment)).filter("seg IS NOT NULL")
    by_pos = Window.partitionBy(*keys, "seg").orderBy("pos")
    behind = by_pos.rowsBetween(Window.unboundedPreceding, 0)
    # looking ahead by walking backwards: a frame up to "unbounded following" would rescan the rest for every row
    ahead = Window.partitionBy(*keys, "seg").orderBy(F.col("pos").desc()).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns(
        {"__next": F.last("pos").over(ahead)}
        | {f"__succ_{f.column}": F.last(_valid(f.column), ignorenulls=True).over(ahead) for f in fills}
    ).withColumns({f"__prev_{f.column}": F.last(_valid(f.column), ignorenulls=True).over(behind) for f in fills})

    def gap_inside(f: Fill) -> Column:
        here = F.col(f.column).isNotNull() & F.col(f"__succ_{f.column}").isNotNull()
        long = _inner_gap(f, F.col(f"__prev_{f.column}"), F.col(f"__succ_{f.column}"))
        return F.max(F.when(here, long).otherwise(False))

    summary = rows.groupBy(*keys, "seg").agg(
        F.min("pos").alias("__start"),
        F.count("*").alias("__rows"),
        *[F.min(_valid(f.column)).alias(f"__first_{f.column}") for f in fills],
        *[F.max(_valid(f.column)).alias(f"__last_{f.column}") for f in fills],
        *[gap_inside(f).alias(f"__gap_{f.column}") for f in fills],
    )
    by_seg = Window.partitionBy(*keys).orderBy("seg")
    earlier = by_seg.rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy(*keys).orderBy(F.col("seg").desc()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    summary = summary.join(span, keys).withColumns(
        {"__nextstart": F.last("__start").over(later)}
        | {f"__after_{f.column}": F.last(f"__first_{f.column}", ignorenulls=True).over(later) for f in fills}
    ).withColumns({f"__before_{f.column}": F.last(f"__last_{f.column}", ignorenulls=True).over(earlier) for f in fills})
    edge = F.lit(False)
    for f in fills:
        first, last = F.col(f"__first_{f.column}"), F.col(f"__last_{f.column}")
        before, after = F.col(f"__before_{f.column}"), F.col(f"__after_{f.column}")
        edge = edge | F.col(f"__gap_{f.column}")
        edge = edge | _edge_gap(f, before, F.coalesce(first, after), F.col("length"))
        edge = edge | _edge_gap(f, F.coalesce(last, before), after, F.col("length"))
    if any(f.limit is not None for f in fills):
        summary = summary.withColumn("gap", F.max(edge).over(whole))
    else:
        summary = summary.withColumn("gap", F.lit(False))

    carried = summary.filter(~F.col("gap")) if reject_gaps else summary
    if min_rows:
        carried = carried.filter(F.col("n_rows") >= min_rows)
    constant = [c for c in span.columns if c not in keys]
    carried = carried.select(
        *[F.col(k).alias(f"__k_{k}") for k in keys], F.col("seg").alias("__seg"), "__nextstart", *constant,
        *[c for f in fills for c in (f"__before_{f.column}", f"__after_{f.column}")],
    )
    same = F.col("seg") == F.col("__seg")
    for k in keys:
        same = same & (F.col(k) == F.col(f"__k_{k}"))
    rows = rows.join(carried, same)
    end = F.coalesce("__next", "__nextstart", F.col("pos") + 1) - 1
    # a long gap is written out segment by segment, so no array exceeds ``segment`` slots
    pieces = rows.withColumn("__end", end).withColumn(
        "seg", F.explode(F.sequence(F.col("seg"), floor_div(F.col("__end"), segment)))
    )
    if spread_gaps:
        pieces = pieces.repartition(*keys, "seg")
    first_slot = F.greatest(F.col("pos"), F.col("seg") * segment)
    last_slot = F.least(F.col("__end"), F.col("seg") * segment + segment - 1)
    slots = pieces.withColumn("slot", F.explode(F.sequence(first_slot, last_slot)))
    filled = {}
    for f in fills:
        prev = F.coalesce(f"__prev_{f.column}", f"__before_{f.column}")
        succ = F.coalesce(f"__succ_{f.column}", f"__after_{f.column}")
        filled[f.column] = _filled_value(f, F.col("slot"), prev, succ)
    kept = [c for c in sparse.columns if c not in filled and c != "pos"]
    grid = slots.select(
        *kept, *constant, F.col("slot").alias("pos"), *[v.alias(c) for c, v in filled.items()],
        (F.col("slot") == F.col("pos")).alias("observed"),
    )
    return grid, summary


def _filled_value(fill: Fill, slot: Column, prev: Column, succ: Column) -> Column:
    back, ahead = slot - prev["p"], succ["p"] - slot
    near_back = F.lit(True) if fill.limit is None else back <= fill.limit
    near_ahead = F.lit(True) if fill.limit is None else ahead <= fill.limit
    exact = F.when(prev["p"] == slot, prev["v"])
    if fill.method == "none":
        return exact
    if fill.method == "carry":
        return (
            exact.when(prev.isNotNull() & near_back, prev["v"])
            .when(prev.isNull() & succ.isNotNull() & near_ahead, succ["v"])
        )
    line = prev["v"] + (succ["v"] - prev["v"]) * back / (succ["p"] - prev["p"])
    return (
        exact.when(prev.isNotNull() & succ.isNotNull() & (near_back | near_ahead), line)
        .when(succ.isNull() & near_back, prev["v"])
        .when(prev.isNull() & near_ahead, succ["v"])
    )


def slots_of_gap(max_gap_s: float, freq_ms: int) -> int | None:
    """Largest number of consecutive slots a fill may reach; None = no limit (-1 seconds)."""
    return None if max_gap_s == -1 else int(max_gap_s * 1000 / freq_ms)


def resample(df: DataFrame, cols: Columns, freq_ms: int, segment: int = SEGMENT) -> DataFrame:
    """Regular grid with the last non-null value per slot; empty slots become rows of nulls."""
    cols.check(df)
    sparse, span = positions(bucket_last(df, cols, freq_ms), cols.group, cols.values)
    grid, _ = fill_slots(sparse, span, [cols.group], [Fill(c, "none") for c in cols.values], segment, spread_gaps=True)
    return _with_time(grid, cols, freq_ms)


def _with_time(grid: DataFrame, cols: Columns, freq_ms: int) -> DataFrame:
    us = F.col("anchor") + (F.col("base") + F.col("pos")) * (freq_ms * 1000)
    return grid.select(cols.group, "pos", "length", us.alias("slot_us"), "observed", *cols.values)


def regularize(
    df: DataFrame,
    cols: Columns,
    freq_ms: int,
    max_gap_s: float,
    clamp_start: bool = True,
    clamp_end: bool = True,
    bounds: str = "exclusive",
    overlap: str = "reject",
    on_gap: str = "skip",
    segment: int = SEGMENT,
) -> tuple[DataFrame, DataFrame]:
    """Clamp, resample and fill; returns (clean grid, audit).

    ``overlap='reject'`` treats the frame as one timeline: unowned rows inside a group's range are adopted,
    and a group that holds rows of another one is left out and audited. ``overlap='ignore'`` takes every
    group's own rows only. ``on_gap='skip'`` drops groups that keep nulls, ``'keep'`` leaves them in,
    ``'fail'`` makes the job fail on the first such group.
    """
    cols.check(df)
    if overlap not in ("reject", "ignore"):
        raise ValueError(f"unknown overlap {overlap!r}")
    if on_gap not in ("skip", "keep", "fail"):
        raise ValueError(f"unknown on_gap {on_gap!r}")
    limit = slots_of_gap(max_gap_s, freq_ms)
    rows = adopt_rows(df, cols, clamp_start, clamp_end) if overlap == "reject" else df
    ranges = materialize(group_ranges(df, cols, clamp_start, clamp_end).select(cols.group, "lo", "hi"), "ranges")
    us = epoch_us(F.col(cols.ts))
    inside = (us > F.col("lo")) & (us < F.col("hi")) if bounds == "exclusive" else us.between(F.col("lo"), F.col("hi"))
    clamped = rows.join(ranges, cols.group).filter(inside).drop("lo", "hi")

    as_text = F.col(cols.group).cast("string").alias("group")
    audits = []
    if overlap == "reject":
        clashing = overlapping_groups(df, cols, clamp_start, clamp_end)
        clamped = clamped.join(clashing.select(cols.group), cols.group, "left_anti")
        audits.append(clashing.select(as_text, F.lit("overlap").alias("rule"), F.col("foreign_rows").alias("rows")))

    if limit == 0:
        fills = [Fill(c, "carry", 0) for c in cols.values]
    else:
        fills = [Fill(cols.label, "carry", limit)] + [Fill(c, "linear", limit) for c in cols.features]
    sparse, span = positions(bucket_last(clamped, cols, freq_ms), cols.group, cols.values)
    # a group that survives ``skip`` has no gap longer than the fills reach
    skipping = on_gap == "skip"
    grid, summary = fill_slots(
        sparse, span, [cols.group], fills, segment, skipping, min_rows=2, spread_gaps=limit is None or not skipping)
    gaps = summary.filter("gap").groupBy(cols.group).agg(F.sum("__rows").alias("rows"))
    if on_gap == "fail":
        ok = F.assert_true(~F.col("__bad"), F.lit("a group keeps nulls after the fill"))
        bad = gaps.select(cols.group, F.lit(True).alias("__bad"))
        grid = grid.join(bad, cols.group, "left").withColumn("__bad", F.coalesce("__bad", F.lit(False)))
        grid = grid.filter(ok.isNull()).drop("__bad")

    all_rows = df.filter(F.col(cols.group).isNotNull()).groupBy(cols.group).agg(
        F.count(cols.label).alias("__labels"), F.count("*").alias("rows")
    )
    audits.append(all_rows.filter("__labels = 0").select(as_text, F.lit("no_labels").alias("rule"), "rows"))
    short = (
        all_rows.filter("__labels > 0").select(cols.group)
        .join(span.select(cols.group, F.col("n_rows").alias("rows")), cols.group, "left")
        .withColumn("rows", F.coalesce("rows", F.lit(0)))
        .filter("rows < 2")
    )
    audits.append(short.select(as_text, F.lit("too_short").alias("rule"), "rows"))
    audits.append(gaps.select(as_text, F.lit("gap").alias("rule"), "rows"))
    audit = audits[0]
    for extra in audits[1:]:
        audit = audit.unionByName(extra)
    return _with_time(grid, cols, freq_ms), audit


def interpolate(
    df: DataFrame, keys: Sequence[str], position: str, columns: Sequence[str], limit: int | None = None,
    segment: int = SEGMENT,
) -> DataFrame:
    """Linear interpolation, both directions, over rows whose ``position`` counts 0, 1, 2, ... within ``keys``."""
    keys = list(keys)
    sizes = df.groupBy(*keys).agg((F.max(position) + 1).alias("length"))
    sparse = df.withColumn("pos", F.col(position).cast("bigint"))
    if position != "pos":
        sparse = sparse.drop(position)
    grid, _ = fill_slots(sparse, sizes, keys, [Fill(c, "linear", limit) for c in columns], segment)
    return grid.select(*[F.col("pos").alias(position) if c == position else F.col(c) for c in df.columns])
