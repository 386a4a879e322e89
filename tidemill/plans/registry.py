"""Query registry and the table helpers the queries share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions.scalars import epoch_us

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under ``name``; without ``sql`` it is checked by properties in the tests."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a labelled two-feature series: ``us``, ``value`` and ``k`` (from the JSON properties)."""
    raw = table(spark, sf_dir, "events")
    return raw.select(
        "event_id", "ts", epoch_us(F.col("ts")).alias("us"), "user_id", "event_type", "value",
        F.from_json("props", "k int")["k"].cast("double").alias("k"),
    )


def patchy_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with missing labels (every 5th id) and features (every 7th and 9th id)."""
    def without(column: str, every: int):
        return F.when(F.col("event_id") % every != 0, F.col(column)).alias(column)

    return events(spark, sf_dir).select(
        "event_id", "ts", "us", "user_id", without("event_type", 5), without("value", 7), without("k", 9)
    )


def r6(column, digits: int = 6):
    return F.round(column, digits)
