"""Reproducible pseudo-randomness: uniforms derived from a hash of a seed and the row's key."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCALE = 4294967296  # 2**32


def hash32(seed: object, *parts: Column) -> Column:
    """First 32 bits of md5('seed-part-part...') as a bigint."""
    text = F.concat_ws("-", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def uniform(seed: object, *parts: Column) -> Column:
    """Uniform double in [0, 1), the same on every run and every cluster size."""
    return hash32(seed, *parts) / F.lit(float(SCALE))
