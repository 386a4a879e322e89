import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemill.functions.scalars import epoch_us
from tidemill.operators import resample as R
from tidemill.operators import windows as W
from tidemill.schema import Columns

COLS = Columns("ts", "g", "label", ("a",))
GAPS = [None] * 3 + [1.0] + [None] * 5 + [7.0] + [None] * 3


def at(seconds):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=seconds)


def frame(spark, rows):
    return spark.createDataFrame(rows, "ts timestamp, g string, label string, a double")


@pytest.mark.parametrize("segment", [2, 3, 5, 1000])
def test_gap_limited_interpolation(spark, segment):
    d = spark.createDataFrame([(1, i, v) for i, v in enumerate(GAPS)], "g int, pos int, v double")
    limited = [r.v for r in R.interpolate(d, ["g"], "pos", ["v"], 2, segment).orderBy("pos").collect()]
    assert limited == [None, 1, 1, 1, 2, 3, None, 5, 6, 7, 7, 7, None]
    free = [r.v for r in R.interpolate(d, ["g"], "pos", ["v"], None, segment).orderBy("pos").collect()]
    assert free == [1, 1, 1, 1, 2, 3, 4, 5, 6, 7, 7, 7, 7]


def test_interpolation_equals_pandas(spark):
    rng = np.random.default_rng(0)
    rows, want = [], {}
    for g in range(40):
        x = pd.Series(rng.normal(size=int(rng.integers(1, 30))))
        x[rng.random(len(x)) < 0.6] = np.nan
        want[g] = x.interpolate("linear", limit_direction="both", limit=2)
        rows += [(g, i, None if np.isnan(v) else float(v)) for i, v in enumerate(x)]
    d = spark.createDataFrame(rows, "g int, pos int, v double")
    got = R.interpolate(d, ["g"], "pos", ["v"], 2, segment=4).toPandas()
    for g, s in want.items():
        mine = got[got.g == g].sort_values("pos").v.to_numpy(dtype=float)
        np.testing.assert_allclose(mine, s.to_numpy(), rtol=1e-12)


def test_resample_last_non_null_and_empty_slots(spark):
    rows = [(at(0.5), "x", "l", 1.0), (at(0.9), "x", None, 2.0), (at(1.1), "x", None, None), (at(4), "x", "m", 4.0)]
    out = R.resample(frame(spark, rows), COLS, 1000).orderBy("pos").collect()
    assert [r.a for r in out] == [2.0, None, None, None, 4.0]
    assert [r.label for r in out] == ["l", None, None, None, "m"]


def test_grid_starts_at_midnight_of_the_first_day(spark):
    out = R.resample(frame(spark, [(at(3), "x", "l", 1.0), (at(15), "x", "l", 2.0)]), COLS, 7000).orderBy("pos").collect()
    first = int(at(0).replace(tzinfo=dt.timezone.utc).timestamp()) * 1_000_000
    assert [r.slot_us - first for r in out] == [0, 7_000_000, 14_000_000]


def test_long_gap_crosses_segments(spark):
    rows = [(at(0), "x", "l", 0.0), (at(1000), "x", "l", 1000.0)]
    grid, _ = R.regularize(frame(spark, rows), COLS, 1000, -1, bounds="inclusive", overlap="ignore", segment=64)
    out = grid.orderBy("pos").collect()
    assert [r.a for r in out] == [float(i) for i in range(1001)]
    assert {r.label for r in out} == {"l"}


@pytest.mark.parametrize("segment", [7, 1 << 16])
def test_hot_group_equals_pandas_rules(spark, segment):
    """One group holds almost all rows: the result must not depend on how it is cut."""
    rng = np.random.default_rng(1)
    rows = [(at(i * 2 + int(rng.integers(0, 2))), "hot", None if rng.random() < 0.5 else "l%d" % rng.integers(3), None if rng.random() < 0.4 else float(i)) for i in range(400)]
    rows += [(at(i), "cold", "l", float(i)) for i in range(5)]
    grid, audit = R.regularize(frame(spark, rows), COLS, 1000, 4, overlap="ignore", on_gap="keep", segment=segment)
    got = grid.filter("g = 'hot'").orderBy("pos").toPandas()
    df = pd.DataFrame(rows, columns=["ts", "g", "label", "a"])
    hot = df[df.g == "hot"]
    lo, hi = hot.ts[hot.label.notna()].min(), hot.ts[hot.label.notna()].max()
    p = hot[(hot.ts > lo) & (hot.ts < hi)].set_index("ts").drop(columns="g").groupby(pd.Grouper(freq="1000ms")).last()
    a = p.a.astype(float).interpolate("linear", limit_direction="both", limit=4)
    np.testing.assert_allclose(got.a.to_numpy(dtype=float), a.to_numpy(), rtol=1e-12)
    label = p.label.ffill(limit=4)
    first = label.first_valid_index()
    label[label.index <= first] = label[label.index <= first].bfill(limit=4)
    assert [x if isinstance(x, str) else None for x in got.label] == [x if isinstance(x, str) else None for x in label]
    kept_null = bool(a.isna().any() or label.isna().any())
    assert (audit.filter("group = 'hot' AND rule = 'gap'").count() == 1) == kept_null


def test_audit_rules(spark):
    rows = [(at(i), "ok", "l", 1.0) for i in range(5)]
    rows += [(at(100 + i), "nolabel", None, 1.0) for i in range(3)] + [(at(200), "short", "l", 1.0), (at(201), "short", "l", 1.0)]
    rows += [(at(300), "gappy", "l", 1.0), (at(301), "gappy", "l", 1.0), (at(350), "gappy", "l", 1.0), (at(351), "gappy", "l", 1.0)]
    rows += [(at(400 + i), "p", "l", 1.0) for i in range(5)] + [(at(402) + dt.timedelta(milliseconds=5), "q", "l", 1.0), (at(404.5), "q", "l", 1.0)]
    grid, audit = R.regularize(frame(spark, rows), COLS, 1000, 3)
    found = {(r.group, r.rule) for r in audit.collect()}
    assert {("nolabel", "no_labels"), ("short", "too_short"), ("gappy", "gap"), ("p", "overlap"), ("q", "overlap")} <= found
    assert {r.g for r in grid.select("g").distinct().collect()} == {"ok"}
    with pytest.raises(Exception, match="keeps nulls"):
        R.regularize(frame(spark, rows), COLS, 1000, 3, on_gap="fail")[0].collect()


def test_limit_zero_fills_nothing(spark):
    rows = [(at(i), "x", "l", float(i)) for i in (0, 1, 2, 3)] + [(at(i), "y", "l", 1.0) for i in (10, 11, 13, 14)]
    grid, _ = R.regularize(frame(spark, rows), COLS, 1000, 0, bounds="inclusive", overlap="ignore")
    assert {r.g for r in grid.collect()} == {"x"}


@pytest.fixture(scope="module")
def five(spark):
    return spark.createDataFrame([("g", i, 5, f"x{i}", float(i), "l") for i in range(5)], "g string, pos bigint, length bigint, v string, n double, l string")


@pytest.mark.parametrize("method", ["frame", "scatter"])
def test_window_paddings(five, method):
    def read(padding, column="v"):
        w = W.sample_windows(five, "g", ["v", "n"], "l", (-1, 0), (0,), 2, padding, method=method)
        return [[s[column] for s in r.steps] for r in w.orderBy("center").collect()]

    assert read("extrapolate") == [["x0", "x0"], ["x1", "x2"], ["x3", "x4"]]
    assert read("skip") == [["x1", "x2"], ["x3", "x4"]]
    assert read("zeros", "n") == [[0.0, 0.0], [1.0, 2.0], [3.0, 4.0]]


@pytest.mark.parametrize("padding", W.PADDINGS)
@pytest.mark.parametrize("stamps,labels,jump,start", [((-3, 0, 2), (0,), 2, 0), ((-40, 7), (1,), 3, 2), ((5,), (-2, -1), 1, 0), ((0,), (0,), 50, 1)])
def test_both_window_methods_agree(spark, padding, stamps, labels, jump, start):
    g = spark.range(300).selectExpr("id % 3 AS g", "id div 3 AS pos", "100L AS length", "CAST(id AS DOUBLE) AS v", "CAST(id % 7 AS STRING) AS l")
    outs = []
    for method, segment in (("frame", 1 << 16), ("frame", 9), ("scatter", 0)):
        w = W.sample_windows(g, "g", ["v"], "l", stamps, labels, jump, padding, start, method=method, segment=segment)
        outs.append(sorted(map(str, w.collect())))
    assert outs[0] == outs[1] == outs[2] and outs[0]


def test_mode_takes_first_seen_on_ties(spark):
    from tidemill.functions.arrays import mode_first_seen

    d = spark.createDataFrame([(["2", "1", "1", "2"],), ([None, "b", "a", "a"],), ([None],)], "x array<string>")
    assert [r[0] for r in d.select(mode_first_seen(F.col("x"))).collect()] == ["2", "a", None]


def test_cap_lands_on_the_cap(spark):
    d = spark.range(1000).selectExpr("id", "CASE WHEN id < 10 THEN 'a' WHEN id < 43 THEN 'b' ELSE 'c' END AS l")
    kept = W.cap_per_class(d, "l", ["id"], 7)
    assert {r.l: r["count"] for r in kept.groupBy("l").count().collect()} == {"a": 7, "b": 7, "c": 7}
    assert sorted(r.id for r in kept.filter("l = 'a'").collect()) == [1, 2, 4, 5, 7, 8, 9]


def test_missing_columns_fail_early(spark):
    with pytest.raises(ValueError, match="not found"):
        R.resample(frame(spark, [(at(0), "x", "l", 1.0)]), Columns("ts", "g", "label", ("nope",)), 1000)
    assert epoch_us(F.lit("2024-01-01").cast("timestamp")) is not None
