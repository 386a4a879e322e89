"""Random convolution kernels as features (Dempster, Petitjean, Webb 2019, arXiv:1910.13051).

A kernel set is a table, one row per kernel, drawn from hashes in column expressions. Where all kernels fit a bound of bytes they travel
with the tasks and the samples stay where they are; a larger bank is cut into blocks of that size, which are joined with
buckets of samples.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.functions.hashing import uniform
from tidemill.operators.ordered import dense_index
from tidemill.session import materialize

# fixed values: candidate kernel lengths of the published method
LENGTHS = (7, 9, 11)
BANK_BYTES = 8 << 20  # of kernels that a task holds at once
CELLS = 4 << 20  # features that are worked out at once
BLOCK_KERNELS = 2048  # kernels of a block, where there are blocks

KERNEL_SCHEMA = T.StructType([
    T.StructField("kernel_id", T.IntegerType()),
    T.StructField("length", T.IntegerType()),
    T.StructField("bias", T.DoubleType()),
    T.StructField("dilation", T.IntegerType()),
    T.StructField("padding", T.IntegerType()),
    T.StructField("channels", T.ArrayType(T.IntegerType())),
    T.StructField("weights", T.ArrayType(T.ArrayType(T.DoubleType()))),
])


def make_kernels(spark: SparkSession, length: int, n: int, channels: int = 1, seed: int = 0) -> DataFrame:
    """Draw ``n`` kernels for series of ``length`` steps; kernel i depends on (seed, i) only.

    Every draw is a uniform number from a hash of the seed, the draw's name, the kernel and, for weights, channel and tap. Normal weights
    come from two of them (Box and Muller). The channels of a kernel are those of the smallest hashes.
    """
    if n < 1 or channels < 1:
        raise ValueError("at least one kernel and one channel")
    usable = [m for m in LENGTHS if m < length]
    if not usable:
        raise ValueError(f"series of {length} steps are too short for kernels of {LENGTHS}")
    i = F.col("kernel_id")

    def draw(name: str, *more: Column) -> Column:
        return uniform(f"{seed}-{name}", i, *more)

    def power(u: Column, most: Column) -> Column:
        """2 to a uniform power below log2(most), rounded down."""
        return F.floor(F.pow(F.lit(2.0), u * F.log2(most))).cast("int")

    def weight(c: Column, j: Column) -> Column:
        radius = F.sqrt(-2 * F.log(1 - draw("radius", c, j)))
        return radius * F.cos(F.lit(2 * np.pi) * draw("angle", c, j))

    def centred(c: Column) -> Column:
        drawn = F.transform(F.sequence(F.lit(0), F.col("length") - 1), lambda j: weight(c, j))
        return F.transform(drawn, lambda w: w - F.aggregate(drawn, F.lit(0.0), lambda s, v: s + v) / F.col("length"))

    ranked = F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(channels - 1)), lambda c: F.struct(draw("channel", c).alias("u"), c.alias("c"))))
    kernels = spark.range(n).select(F.col("id").cast("int").alias("kernel_id"))
    kernels = kernels.withColumn("length", F.get(F.array(*map(F.lit, usable)), F.floor(draw("length") * len(usable)).cast("int")))
    kernels = kernels.withColumns({
        "bias": draw("bias") * 2 - 1,
        "dilation": power(draw("dilation"), F.floor((length - 1) / (F.col("length") - 1)).cast("double")),
        "channels": F.array_sort(F.transform(F.slice(ranked, F.lit(1), power(draw("width"), F.lit(channels + 1.0))), lambda x: x["c"]))})
    padded = F.when(draw("padding") < 0.5, F.floor((F.col("length") - 1) * F.col("dilation") / 2)).otherwise(0)
    return kernels.select("kernel_id", "length", "bias", "dilation", padded.cast("int").alias("padding"), "channels",
                          F.transform("channels", centred).alias("weights"))


def _bank(rows: list[dict]) -> list[tuple]:
    return [(np.asarray(r["weights"], dtype="float64"), np.asarray(r["channels"]), r["bias"], r["dilation"], r["padding"]) for r in rows]


def _features(dims: pa.Array, bank: list[tuple]) -> pa.Array:
    """(share positive, maximum) of every kernel for each sample; null for a null or empty sample, and where a kernel does not fit."""
    n = len(dims)
    outer, inner = dims.offsets.to_numpy(), dims.values.offsets.to_numpy()
    values = dims.values.values.fill_null(0.0).to_numpy(zero_copy_only=False).astype(float)
    held = dims.is_valid().to_numpy(zero_copy_only=False) & (np.diff(outer) > 0)
    steps = np.diff(inner)
    out = np.full((n, 2 * len(bank)), np.nan)
    length = np.where(held, steps[np.minimum(outer[:-1], max(0, len(steps) - 1))] if len(steps) else 0, 0)
    for width, size in {(int(w), int(s)) for w, s in zip(np.diff(outer)[held], length[held])}:
        at = np.flatnonzero(held & (np.diff(outer) == width) & (length == size))
        lists = outer[at][:, None] + np.arange(width)
        if (steps[lists] != size).any():
            raise ValueError("channels of a sample differ in length")
        if size:
            block = values[inner[lists][:, :, None] + np.arange(size)]
            out[at] = _responses(block, bank)
    flat = pa.array(out.ravel(), mask=np.isnan(out).ravel())
    made = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * (2 * len(bank))), flat)
    return pa.array([x if h else None for x, h in zip(made.to_pylist(), held)], made.type) if not held.all() else made


def apply_kernels(df: DataFrame, dims: str, kernels: DataFrame, out: str = "kernel_features") -> DataFrame:
    """Add ``out: array<double>`` with, per kernel in order of its id, the share of positive outputs and the largest output.

    Null steps count as 0, as padding does. A null or empty sample gives null; so do the two features of a kernel that is longer than the
    padded sample. Channels of unequal length are refused.
    """
    size = F.lit(64) + 8 * F.aggregate("weights", F.lit(0), lambda a, w: a + F.size(w))
    total, largest = kernels.agg(F.sum(size), F.max(size)).first()
    if not total:
        raise ValueError("no kernels")
    if total > BANK_BYTES:
        return _apply_in_blocks(df, dims, kernels, out, max(1, min(BLOCK_KERNELS, BANK_BYTES // largest)))
    bank = _bank([r.asDict() for r in kernels.orderBy("kernel_id").collect()])
    place = df.columns.index(dims)
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, CELLS // (2 * len(bank)))
        for batch in batches:
            for begin in range(0, batch.num_rows, step):
                part = batch.slice(begin, step)
                yield pa.RecordBatch.from_arrays([*part.columns, _features(part.column(place), bank)], names=[*batch.schema.names, out])

    return df.mapInArrow(run, schema)


def _apply_in_blocks(df: DataFrame, dims: str, kernels: DataFrame, out: str, per_block: int) -> DataFrame:
    """The same by a join of buckets of samples with blocks of kernels; neither the driver nor a task holds the bank."""
    rows = materialize(df.withColumn("__row", F.monotonically_increasing_id()), "kernel-samples")
    blocks = materialize(dense_index(kernels, ["kernel_id"], out="at").withColumn("block", F.expr(f"int(at div {per_block})")), "kernel-blocks")
    n_blocks = blocks.agg(F.max("block")).first()[0] + 1
    n_buckets = -(-rows.count() // max(1, CELLS // (2 * per_block))) or 1
    left = rows.select("__row", F.col(dims).alias("x"), F.pmod(F.xxhash64("__row"), F.lit(n_buckets)).cast("int").alias("bucket"),
                       F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"))
    right = blocks.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(n_buckets - 1))))

    def meet(samples: pa.Table, bank: pa.Table) -> pa.Table:
        if not samples.num_rows or not bank.num_rows:
            return pa.table({"__row": pa.array([], pa.int64()), "block": pa.array([], pa.int32()), "f": pa.array([], pa.list_(pa.float64()))})
        made = _features(samples.column("x").combine_chunks(), _bank(sorted(bank.to_pylist(), key=lambda r: r["at"])))
        return pa.table({"__row": samples.column("__row"), "block": samples.column("block"), "f": made})

    parts = left.groupBy("bucket", "block").cogroup(right.groupBy("bucket", "block")).applyInArrow(meet, "__row long, block int, f array<double>")
    whole = parts.groupBy("__row").agg(F.array_sort(F.collect_list(F.struct("block", "f"))).alias("p"))
    features = F.when(F.exists("p", lambda x: x["f"].isNull()), None).otherwise(F.flatten(F.transform("p", lambda x: x["f"])))
    return rows.join(whole.select("__row", features.alias(out)), "__row").select(*df.columns, out)


def _responses(block: np.ndarray, bank) -> np.ndarray:
    """(samples, 2 * kernels) from (samples, channels, steps); NaN where a kernel does not fit."""
    out = np.full((block.shape[0], 2 * len(bank)), np.nan)
    for k, (weights, channels, bias, dilation, padding) in enumerate(bank):
        x = np.pad(block[:, channels, :], ((0, 0), (0, 0), (padding, padding)))
        reach = (weights.shape[1] - 1) * dilation
        n = x.shape[2] - reach
        if n < 1:
            continue
        y = np.full((x.shape[0], n), bias)
        for tap in range(weights.shape[1]):
            y += np.einsum("sct,c->st", x[:, :, tap * dilation: tap * dilation + n], weights[:, tap])
        out[:, 2 * k] = (y > 0).mean(axis=1)
        out[:, 2 * k + 1] = y.max(axis=1)
    return out


def apply_kernels_sql(df: DataFrame, sample: str, dims: str, kernels: DataFrame) -> DataFrame:
    """The same features as rows (sample, kernel_id, ppv, top) from column expressions only; for small sets.

    Kernels are folded into the row as an array, so that no join between samples and kernels is planned.
    """
    packed = kernels.agg(
        F.array_sort(F.collect_list(F.struct("kernel_id", "bias", "dilation", "padding", "channels", "weights"))).alias("b")
    ).scalar()
    each = df.select(sample, F.col(dims).alias("x"), F.explode(packed).alias("k"))
    steps = F.size(F.get("x", F.lit(0)))
    taps = F.size(F.get("k.weights", F.lit(0)))
    count = steps + 2 * F.col("k.padding") - (taps - 1) * F.col("k.dilation")

    def output(p):
        def channel(c, w):
            series = F.get("x", c)
            return F.aggregate(
                F.transform(w, lambda v, j: v * F.coalesce(
                    F.when(p + j * F.col("k.dilation") - F.col("k.padding") >= 0,
                           F.get(series, p + j * F.col("k.dilation") - F.col("k.padding"))), F.lit(0.0))),
                F.lit(0.0), lambda a, v: a + v)

        sums = F.zip_with("k.channels", "k.weights", channel)
        return F.aggregate(sums, F.col("k.bias"), lambda a, v: a + v)

    conv = each.select(sample, F.col("k.kernel_id").alias("kernel_id"),
                       F.transform(F.sequence(F.lit(0), count - 1), output).alias("y"))
    return conv.select(
        sample, "kernel_id", (F.size(F.filter("y", lambda v: v > 0)) / F.size("y")).alias("ppv"), F.array_max("y").alias("top")
    )
