"""Stream form of the slot aggregation: last non-null value per column, group and slot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.functions.scalars import epoch_us
from tidemill.schema import Columns


def bucket_stream(df: DataFrame, cols: Columns, freq_ms: int, lateness: str = "10 minutes") -> DataFrame:
    """Slots of a stream, emitted once the watermark has passed them; rows later than ``lateness`` are dropped.

    Steps that divide a day give the same slots as the batch operator. State per open slot is one value and
    one time per column.
    """
    cols.check(df)
    order = epoch_us(F.col(cols.ts))
    slot = F.window(cols.ts, f"{freq_ms} milliseconds")
    last = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), order)).alias(c) for c in cols.values]
    slots = df.withWatermark(cols.ts, lateness).groupBy(cols.group, slot.alias("slot")).agg(*last)
    return slots.select(cols.group, epoch_us(F.col("slot.start")).alias("slot_us"), *cols.values)
