"""Kernel banks of any size, drawn from hashes, and awkward samples."""

import pytest

from tidemill.operators import kernels as E
from tidemill.plans.samples import vectors


def test_draws_look_like_the_method(spark):
    rows = E.make_kernels(spark, 200, 4000, 4, seed=2).collect()
    assert {r.length for r in rows} == {7, 9, 11} and {len(r.channels) for r in rows} == {1, 2, 3, 4}
    assert 0.45 < sum(r.padding > 0 for r in rows) / 4000 < 0.55
    assert {min(r.dilation for r in rows), max(r.dilation for r in rows) > 25} == {1, True}
    raw = [w for r in rows for c in r.weights for w in c]
    assert abs(sum(raw) / len(raw)) < 1e-9 and 0.8 < sum(w * w for w in raw) / len(raw) < 0.95  # a share of 1/length goes with the mean
    assert abs(sum(r.bias for r in rows) / 4000) < 0.05
    assert all(r.channels == sorted(set(r.channels)) for r in rows)
    other = E.make_kernels(spark, 200, 4000, 4, seed=3).collect()
    assert sum(a.bias == b.bias for a, b in zip(rows, other)) == 0


def test_blocks_give_the_same_as_one_bank(spark, sf, monkeypatch):
    v = vectors(spark, sf).filter("sample_id < 60")
    k = E.make_kernels(spark, 32, 50, 2, seed=1)
    one = {r.sample_id: r.kernel_features for r in E.apply_kernels(v, "dims", k).collect()}
    monkeypatch.setattr(E, "BANK_BYTES", 2000)
    monkeypatch.setattr(E, "CELLS", 200)
    assert {r.sample_id: r.kernel_features for r in E.apply_kernels(v, "dims", k).collect()} == one


def test_more_than_a_hundred_thousand_kernels(spark, sf, monkeypatch):
    v = vectors(spark, sf).filter("sample_id < 2").select("sample_id", "dims")
    k = E.make_kernels(spark, 32, 100_500, 2, seed=6)
    rows = E.apply_kernels(v, "dims", k).selectExpr("sample_id", "size(kernel_features) AS n", "slice(kernel_features, 200001, 4) AS x").collect()
    assert [r.n for r in rows] == [201_000] * 2
    some = {r.sample_id: r.kernel_features for r in E.apply_kernels(v, "dims", k.filter("kernel_id IN (100000, 100001)")).collect()}
    assert {r.sample_id: r.x for r in rows} == some


@pytest.mark.parametrize("bank", [8 << 20, 100])
def test_awkward_samples(spark, monkeypatch, bank):
    monkeypatch.setattr(E, "BANK_BYTES", bank)
    k = spark.createDataFrame([(0, 3, -1.0, 1, 0, [0], [[-1.0, 0.0, 1.0]]), (1, 3, 0.0, 4, 0, [0], [[1.0, 1.0, 1.0]])], E.KERNEL_SCHEMA)
    rows = [(1, [[0.0, 1.0, 3.0, 2.0, 5.0]]), (2, None), (3, []), (4, [[None, 1.0, 3.0, 2.0, 5.0]]), (5, [[1.0]]), (6, [[float(i) for i in range(9)]]), (6, [[0.0] * 9])]
    x = spark.createDataFrame(rows, "sample_id bigint, dims array<array<double>>").withColumn("block", E.F.lit("mine")).withColumn("at", E.F.lit(1))
    got = sorted(((r.sample_id, r.kernel_features) for r in E.apply_kernels(x, "dims", k).collect()), key=str)
    short = [pytest.approx(2 / 3), 2.0, None, None]
    assert got == [(1, short), (2, None), (3, None), (4, short), (5, [None] * 4), (6, [0.0, -1.0, 0.0, 0.0]), (6, [1.0, 1.0, 1.0, 12.0])]
    assert E.apply_kernels(x.limit(0), "dims", k).count() == 0
    with pytest.raises(ValueError):
        E.apply_kernels(x, "dims", k.limit(0))
    with pytest.raises(Exception, match="differ in length"):
        E.apply_kernels(spark.createDataFrame([(1, [[1.0, 2.0], [1.0]])], "sample_id bigint, dims array<array<double>>"), "dims", k).collect()
