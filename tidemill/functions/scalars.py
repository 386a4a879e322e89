"""Small scalar column rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch_us(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp, with or without zone (read in the session's zone)."""
    return F.unix_micros(ts.cast("timestamp"))


def from_epoch_us(us: Column) -> Column:
    return F.timestamp_micros(us)


def floor_div(x: Column, n) -> Column:
    """Integer floor division, exact for values and divisors below 2**53."""
    divisor = n if isinstance(n, Column) else F.lit(n)
    return ((x - F.pmod(x, divisor)) / divisor).cast("bigint")


def pass_key(tool: Column, job: Column) -> Column:
    """'tool-job' with the job cut at its first dot."""
    return F.concat(tool, F.lit("-"), F.split(job, r"\.").getItem(0))


def flat_csv_name(path: Column) -> Column:
    """Last part of a path (either slash), its extension replaced by .csv."""
    base = F.regexp_extract(path, r"([^/\\]+)$", 1)
    return F.concat(F.regexp_replace(base, r"\.[^.]*$", ""), F.lit(".csv"))


def hours_minutes_seconds(seconds: Column) -> Column:
    whole = F.floor(seconds / 3600)
    rest = seconds - whole * 3600
    minutes = F.floor(rest / 60)
    return F.struct(
        whole.cast("bigint").alias("hours"),
        minutes.cast("bigint").alias("minutes"),
        (rest - minutes * 60).cast("double").alias("seconds"),
    )


def repaired_power(power: Column, true_energy: Column, interval: Column, ceiling: float = 1e16) -> Column:
    """Readings above ``ceiling`` are replaced by energy over the typical interval."""
    return F.when(power > ceiling, F.try_divide(true_energy, interval)).otherwise(power)
