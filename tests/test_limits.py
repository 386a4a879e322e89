"""Null groups, long rows and compensated masks against the long way."""

import math

import numpy as np
from pyspark.sql import functions as F

from tidemill.functions import arrays as A
from tidemill.operators import masking as K
from tidemill.operators import metrics as M
from tidemill.operators import samples as S
from tidemill.operators import splits as X


def test_rows_without_group_are_split_as_a_group(spark):
    rows = [(i, None if i % 4 == 0 else f"g{i % 4}", "ab"[i % 2]) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, grp string, label string")
    for split in (X.group_split(df, "id", "grp", 0.25, 0.25), X.group_stratified_split(df, "id", "grp", "label", 0.25, 0.25)):
        got = split.where("fold = 0").collect()
        assert sorted(r["id"] for r in got) == list(range(40))
        group_of = {r[0]: r[1] for r in rows}
        parts = {}
        for r in got:
            parts.setdefault(group_of[r["id"]], set()).add(r["split"])
        assert all(len(p) == 1 for p in parts.values())


def test_softmax_and_loss_of_long_rows(spark):
    scores = np.random.default_rng(1).normal(0, 30, 3000)
    df = spark.createDataFrame([(scores.tolist(), 17)], "s array<double>, y int")
    got = df.select(A.softmax(F.col("s")).alias("p"), M.cross_entropy(F.col("s"), F.col("y")).alias("loss")).first()
    e = np.exp(scores - scores.max())
    assert np.allclose(got["p"], e / e.sum(), atol=1e-12)
    assert math.isclose(got["loss"], -math.log(max(e[17] / e.sum(), 1e-300)), rel_tol=1e-9)


def test_row_statistics_of_long_rows(spark):
    x = np.random.default_rng(2).normal(5, 2, 3000)
    df = spark.createDataFrame([(x.tolist(),), ([],), ([1.0],), ([2.0, 2.0],)], "s array<double>")
    got = df.select(A.spread(F.col("s")).alias("sd"), A.standardize(F.col("s")).alias("z"), A.minmax(F.col("s")).alias("m")).collect()
    assert math.isclose(got[0]["sd"], x.std(ddof=1), rel_tol=1e-9)
    assert np.allclose(got[0]["z"], (x - x.mean()) / x.std(ddof=1))
    assert np.allclose(got[0]["m"], (x - x.min()) / (x.max() - x.min()), atol=1e-9)
    assert got[1]["z"] == [] and got[2]["sd"] is None and got[3]["z"] == [None, None]


def test_compensated_mask(spark):
    dims = [[1.0, 2.0, 3.0], [4.0, 5.0, 6.0], [7.0, 8.0, 9.0]]
    mask = [[True, False, False], [True, True, False], [False, True, False]]
    df = spark.createDataFrame([(dims, mask)], "dims array<array<double>>, mask array<array<boolean>>")
    got = K.apply_mask(df, "dims", "mask", compensate=True).first()
    kept = np.where(mask, dims, 0.0)
    assert np.allclose(got["dims"], kept * 3 / np.maximum(1, np.sum(mask, axis=0)))
    assert got["targets"] == dims


def test_positions_beyond_any_table(spark):
    got = spark.range(100, 103).select(S.position_value(F.col("id"), F.lit(3), 8).alias("v")).collect()
    assert np.allclose([r["v"] for r in got], [math.cos(t * 10000 ** (-2 / 8)) for t in range(100, 103)])
