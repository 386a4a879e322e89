"""Exact order statistics against sorted lists, with groups that are narrowed in several rounds."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.operators.clean import median_per_file
from tidemill.operators.quantiles import order_statistics, quantiles

SCHEMA = "g string, h int, x double"
RANKS = {"least": lambda n: F.lit(1), "third": lambda n: F.floor((n + 2) / 3), "middle": lambda n: F.floor((n + 1) / 2), "most": lambda n: n}


def sample():
    draw = random.Random(5)
    rows = [("even", 1, draw.random()) for _ in range(3000)]
    rows += [("tails", 1, math.exp(draw.uniform(-700, 700)) * draw.choice([-1, 1])) for _ in range(3000)]
    rows += [("hot", 2, 7.0 if i % 3 else float(i)) for i in range(3000)]  # most rows are one value
    rows += [("same", 2, 1.5)] * 1500
    rows += [(None, None, float(i % 11)) for i in range(400)] + [("tiny", None, 3.0), ("one", 0, None), ("ends", 0, math.inf), ("ends", 0, -math.inf)]
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("small,bins", [(10, 8), (60, 16), (1_000_000, 1024)])
def test_ranks_as_in_sorted_lists(spark, small, bins):
    rows = sample()
    got = order_statistics(spark.createDataFrame(rows, SCHEMA), ["g", "h"], "x", RANKS, "n", small, bins).collect()
    groups = {}
    for g, h, x in rows:
        if x is not None:
            groups.setdefault((g, h), []).append(x)
    want = {}
    for key, xs in groups.items():
        xs.sort()
        n = len(xs)
        want[key] = (n, xs[0], xs[(n + 2) // 3 - 1], xs[(n + 1) // 2 - 1], xs[-1])
    assert {(r.g, r.h): tuple(r)[2:] for r in got} == want
    assert len(got) == len(want)


def test_narrowing_reads_less_each_round(spark, monkeypatch):
    """What a round leaves to the next one is a small part of the group, not the group."""
    from tidemill.operators import quantiles as module

    written = []
    plain = module.materialize

    def counting(df, name="stage"):
        out = plain(df, name)
        if name == "rank-rows":
            written.append(out.count())
        return out

    monkeypatch.setattr(module, "materialize", counting)
    df = spark.range(200_000).select(F.lit("a").alias("g"), F.xxhash64("id").cast("double").alias("x"))
    got = order_statistics(df, ["g"], "x", {"m": lambda n: F.floor((n + 1) / 2)}, small=100, bins=64).first().m
    assert got == sorted(r.x for r in df.collect())[99_999]
    assert 1 < len(written) <= 4 and written[0] < 200_000 * 6 / 64 and written[-1] <= 100


def test_quantiles_are_linear_between_values(spark):
    rows = [(g, h, x) for g, h, x in sample() if g in ("even", "hot", "tiny")]
    shares = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.999, "e": 1.0}
    got = quantiles(spark.createDataFrame(rows, SCHEMA), ["g"], "x", shares, small=50, bins=16).collect()
    assert len(got) == 3
    for r in got:
        xs = [x for g, _, x in rows if g == r.g]
        assert list(r)[1:] == pytest.approx([float(np.quantile(xs, q)) for q in shares.values()], rel=1e-12)
    with pytest.raises(ValueError):
        quantiles(spark.createDataFrame(rows, SCHEMA), ["g"], "x", {"a": 1.5})


def test_whole_table_nan_and_empty(spark):
    df = spark.createDataFrame([("a", 1, x) for x in [2.0, math.nan, 1.0, None, 3.0]], SCHEMA)
    r = order_statistics(df, [], "x", {"low": lambda n: F.lit(0), "second": lambda n: F.lit(2), "most": lambda n: n + 5}).collect()
    assert len(r) == 1 and tuple(r[0])[:2] == (1.0, 2.0) and math.isnan(r[0].most)
    assert order_statistics(df.limit(0), ["g"], "x", RANKS).collect() == []
    assert quantiles(df.filter("x IS NULL"), [], "x", {"q": 0.5}).collect() == []


def test_integers_and_clashing_names(spark):
    df = spark.createDataFrame([(1, 10), (1, 20), (1, 40), (None, 5)], "__n long, __v long")
    got = {r[0]: r[1] for r in median_per_file(df, "__n", "__v").collect()}
    assert got == {1: 20.0, None: 5.0}
