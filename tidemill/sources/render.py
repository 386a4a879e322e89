"""Write samples out as archive text: one file per value of ``part``, header first, cases in order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def series_text(series: Column) -> Column:
    return F.array_join(F.transform(series, lambda x: F.coalesce(x.cast("string"), F.lit("?"))), ",")


def write_lines(cases: DataFrame, part: str, order: str, header: Sequence[str], path: str) -> None:
    """``cases`` has ``line``. Files are laid out by ``part``, so choose parts of bounded size."""
    body = cases.select(F.col(part).alias("part"), F.lit(1).alias("__kind"), F.col(order).cast("bigint").alias("__o"), "line")
    top = cases.select(F.col(part).alias("part")).distinct().select(
        "part", F.lit(0).alias("__kind"), F.posexplode(F.array(*[F.lit(h) for h in header])).alias("__o", "line")
    ) if header else None
    rows = body if top is None else body.unionByName(top.withColumn("__o", F.col("__o").cast("bigint")))
    named = rows.repartition("part").sortWithinPartitions("part", "__kind", "__o").select("line", "part")
    named.write.partitionBy("part").text(path)


def ts_header(name: str, univariate: bool, classes: Sequence[str] | None = None, timestamps: bool = False, target: bool = False) -> list[str]:
    flag = {True: "true", False: "false"}
    label = "@classLabel true " + " ".join(classes) if classes else "@classLabel false"
    lines = [f"@problemName {name}", f"@timeStamps {flag[timestamps]}", f"@univariate {flag[univariate]}"]
    lines.append("@targetLabel true" if target else label)
    return [*lines, "@data"]
