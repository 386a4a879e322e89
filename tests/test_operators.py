import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.functions import arrays as A
from tidemill.operators import kernels as E
from tidemill.operators import masking as K
from tidemill.operators import metrics as M
from tidemill.operators import models as L
from tidemill.operators import neighbours as NB
from tidemill.operators import normalize as N
from tidemill.operators import ordered as O
from tidemill.operators import samples as P
from tidemill.operators import splits as X
from tidemill.operators import tracking as T
from tidemill.plans.registry import events
from tidemill.plans.samples import vectors


def test_running_over_partitions_and_keys(spark):
    d = spark.range(5000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN NULL WHEN id < 4000 THEN 'hot' ELSE 'k' || id % 5 END AS k", "id % 7 AS x", "IF(id % 4 = 0, id, NULL) AS y")
    out = O.running(d, ["id"], {"s": ("sum", F.col("x")), "m": ("max", F.col("y")), "l": ("last", F.col("y"))}, ["k"]).toPandas()
    want = d.toPandas().sort_values("id")
    g = want.groupby("k", dropna=False)
    want["s"], want["m"], want["l"] = g.x.cumsum(), g.y.cummax().groupby(want.k, dropna=False).ffill(), g.y.ffill()
    out = out.sort_values("id").reset_index(drop=True)
    for c in ("s", "m", "l"):
        np.testing.assert_array_equal(out[c].to_numpy(dtype=float), want[c].to_numpy(dtype=float))


def test_dense_index_is_dense(spark):
    idx = sorted(r.i for r in O.dense_index(spark.range(1000), [F.col("id").desc()], out="i").collect())
    assert idx == list(range(1000))


@pytest.mark.parametrize("buckets", [4, 4096])
def test_first_by_hash_takes_exact_counts(spark, buckets):
    from tidemill.functions.hashing import hash32

    d = spark.range(3000).selectExpr("id", "IF(id % 3 = 0, 'a', 'b') AS k")
    got = O.first_by_hash(d, hash32(1, F.col("id")), "id", ["k"], lambda n: F.when(F.col("k") == "a", 137).otherwise(0), buckets=buckets)
    assert {(r.k, r.chosen): r["count"] for r in got.groupBy("k", "chosen").count().collect()} == {
        ("a", True): 137, ("a", False): 863, ("b", False): 2000}


@pytest.mark.parametrize("buckets,test", [(2, 0.3), (16, 0.01), (4096, 0.25), (8, 0.0)])
def test_split_takes_what_a_sort_takes(spark, buckets, test):
    from hashlib import md5
    from math import ceil

    def hashed(*parts):
        return int(md5("-".join(map(str, parts)).encode()).hexdigest()[:8], 16)

    d = spark.range(700).selectExpr("id", "CASE WHEN id % 10 = 0 THEN NULL WHEN id = 5 THEN 'one' WHEN id % 3 = 0 THEN 'a' ELSE 'b' END AS k")
    got = {(r.fold, r.id): r.split for r in X.ratio_split(d, "id", 0.2, test, folds=4, strata="k", first_fold=1, buckets=buckets).collect()}
    strata, want = collections.defaultdict(list), {}
    for r in d.collect():
        strata[r.k].append(r.id)
    for ids in strata.values():
        ids.sort(key=lambda i: (hashed("1337-test", i), i))
        n = ceil(len(ids) * test)
        for fold in range(1, 4):
            rest = sorted(ids[n:], key=lambda i: (hashed("1337-val", fold, i), i))
            val = ceil(len(rest) * 0.2)
            want |= {(fold, i): "test" for i in ids[:n]} | {(fold, i): "val" for i in rest[:val]} | {(fold, i): "train" for i in rest[val:]}
    assert got == want
    assert X.ratio_split(d.limit(0), "id", 0.2, test, strata="k", buckets=buckets).count() == 0


def test_thieves_of_sparse_cells_are_those_of_the_grid(spark):
    rng = np.random.default_rng(4)
    truth = rng.integers(0, 30, 400)
    pairs = [(int(t), int(p)) for t, p in zip(truth, np.where(rng.random(400) < 0.8, truth, rng.integers(5, 35, 400)))]
    d = spark.createDataFrame(pairs + [(None, 3), (3, None)], "truth int, pred int")
    sparse, grid = M.confusion(d), M.confusion(d, classes=range(35))
    assert sparse.count() == len(set(pairs)) and grid.count() == 35 * 35
    seen = sorted({c for pair in pairs for c in pair})
    n, support = collections.Counter(pairs), collections.Counter(t for t, _ in pairs)
    want = set()
    for t in seen:
        ranked = sorted(seen, key=lambda p: (-n[t, p], -p))[:4]
        want |= {(t, k + 1, p, n[t, p] / max(1, support[t])) for k, p in enumerate(ranked) if p != t}
    assert {tuple(r) for r in M.thieves(sparse, 3).collect()} == want


def test_array_rules(spark):
    d = spark.createDataFrame([([10.0, 20.0, 30.0],)], "x array<double>")
    row = d.select(A.uniform_scale(F.col("x"), 5), A.pad(F.col("x"), 5), A.pad(F.col("x"), 2), A.decimate(F.col("x"), 2, 2), A.decimate(F.col("x"), 2, 3)).first()
    assert list(row) == [[10, 10, 20, 20, 30], [10, 20, 30, 0, 0], [10, 20], [10, 30], [10, 20, 30]]


def test_constant_series(spark):
    d = spark.createDataFrame([(1, [2.0, 2.0])], "sample_id int, x array<double>")
    assert d.select(A.standardize(F.col("x"))).first()[0] == [None, None]
    assert d.select(A.standardize(F.col("x"), 0, 1.0)).first()[0] == [0.0, 0.0]


def test_length_repair_and_interpolation(spark):
    d = spark.createDataFrame([(1, [[1.0, None, 3.0], [5.0]])], "sample_id int, dims array<array<double>>")
    assert P.fix_length(d, "dims", 3).first().dims == [[1.0, 2.0, 3.0], [5.0, 5.0, 5.0]]


def test_transduction_mask_golden(spark):
    d = spark.createDataFrame([(1, [[0.0] * 10])], "sample_id int, dims array<array<double>>")
    keep = K.transduct_mask(d, "dims", (0,), 0.2, 0.3).first().mask[0]
    assert [i for i, k in enumerate(keep) if not k] in ([2, 3, 4, 5, 6], [2, 3, 4, 5])


def test_markov_mask_ratio_and_run_length(spark):
    d = spark.range(400).selectExpr("id AS sample_id", "array(array_repeat(0D, 100)) AS dims")
    keep = [r.mask[0] for r in K.noise_mask(d, "sample_id", "dims", 0.15, 3).collect()]
    hidden = np.mean([not k for row in keep for k in row])
    assert abs(hidden - 0.15) < 0.02
    runs = [len(r) for row in keep for r in "".join("1" if k else "0" for k in row).replace("1", " ").split()]
    assert 2.5 < np.mean(runs) < 3.5
    again = [r.mask[0] for r in K.noise_mask(d, "sample_id", "dims", 0.15, 3).collect()]
    assert keep == again
    everything = K.noise_mask(d, "sample_id", "dims", 1.0, 3).first().mask[0]
    assert not any(everything)


def test_markov_mask_at_its_edges(spark):
    rows = [(1, [[0.0] * 50, None, [], [0.0]]), (2, None), (None, [[0.0] * 3])]
    d = spark.createDataFrame(rows, "sample_id int, dims array<array<double>>")
    got = [r.mask for r in K.noise_mask(d, "sample_id", "dims", 0.4, 1).collect()]
    assert [len(x) if x is not None else None for x in got[0]] == [50, None, 0, 1] and got[1] is None and len(got[2][0]) == 3
    assert "00" not in "".join("1" if k else "0" for k in got[0][0])  # runs of one step each
    assert all(K.noise_mask(d.limit(1), "sample_id", "dims", 0.0, 3).first().mask[0])
    both = K.noise_mask(spark.createDataFrame([(1, [[0.0] * 40] * 2)], d.schema), "sample_id", "dims", 0.5, 4, mode="concurrent").first().mask
    assert both[0] == both[1]


def test_top_k_golden(spark):
    d = spark.createDataFrame([(1, [1, 5, 4]), (0, [2, 0, 3])], "truth int, ranked array<int>")
    assert [r.accuracy for r in M.top_k_from_ranked(d, "ranked", "truth", 3).orderBy("k").collect()] == [0.5, 1, 1]


def test_weighted_average_golden(spark):
    rows = [(0, 0)] * 3 + [(0, 1)] + [(1, 0)] * 2 + [(1, 1)] * 4
    t = M.per_class(spark.createDataFrame(rows, "truth int, pred int"))
    a = M.average_precision_recall(t).first()
    assert a.prec_avg == pytest.approx(0.72) and a.rec_avg == pytest.approx(0.7)


def test_perfect_ranking(spark):
    d = spark.createDataFrame([(1, 0.9), (1, 0.8), (0, 0.2), (0, 0.1)], "truth int, score double")
    r = M.ranking_areas(d).first()
    assert r.auroc == 1.0 and r.auprc == 1.0


def test_threshold_sweep_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(int(rng.integers(3)), int(rng.integers(3)), float(rng.integers(1, 20)) / 20) for _ in range(300)]
    got = M.threshold_sweep(spark.createDataFrame(rows, "truth int, pred int, score double"), 1, 17).orderBy("point").collect()
    s = [x[2] for x in rows if x[1] == 1]
    lo, hi = 0.99 * min(s), 1.01 * max(s)
    for r in got:
        thr = lo + (hi - lo) / 16 * r.point
        kept = [x for x in rows if x[1] == 1 and x[2] >= thr]
        tp = sum(x[0] == 1 for x in kept)
        assert r.precision == pytest.approx(tp / len(kept) if kept else 0)
        assert r.recall == pytest.approx(tp / sum(x[0] == 1 for x in rows))


def check_split(splits, sample, n, folds):
    rows = splits.collect()
    per = collections.defaultdict(list)
    for r in rows:
        per[r.fold].append(r[sample])
    assert len(per) == folds and all(len(v) == n == len(set(v)) for v in per.values())


@pytest.mark.parametrize("kind", ["random", "stratified", "group_stratified", "group", "train_on_all"])
def test_splits_are_complete_and_disjoint(spark, sf, kind):
    df = events(spark, sf)
    s = X.split(df, kind, "event_id", 0.25, 0.2 if kind != "train_on_all" else 0, folds=2, label="event_type", group="user_id")
    check_split(s, "event_id", df.count(), 2)
    assert X.overlaps(s, "event_id").count() == 0
    if kind.startswith("group"):
        crossing = s.join(df, "event_id").groupBy("fold", "user_id").agg(F.countDistinct("split").alias("n")).filter("n > 1")
        assert crossing.count() == 0


def test_split_conflicts(spark, sf):
    df = events(spark, sf)
    with pytest.raises(ValueError):
        X.check_parameters("random", 0.2, 0.2, test_pattern="x")
    with pytest.raises(ValueError):
        X.split(df, "by_group_list", "event_id", group="user_id", test_groups=(1,), val_groups=(1,))
    with pytest.raises(ValueError, match="not in the data"):
        X.split(df, "by_group_list", "event_id", group="user_id", test_groups=(10**9,))
    with pytest.raises(ValueError, match="only"):
        X.group_stratified_split(df, "event_id", "user_id", "event_type", 0.5, folds=3)


def test_kernels_reproducible_and_valid(spark):
    a = E.make_kernels(spark, 32, 40, 3, seed=4).orderBy("kernel_id").collect()
    b = E.make_kernels(spark, 32, 40, 3, seed=4).repartition(3).orderBy("kernel_id").collect()
    assert a == b
    for k in a:
        assert k.length in E.LENGTHS and (k.length - 1) * k.dilation < 32 and -1 <= k.bias <= 1
        assert all(abs(sum(w)) < 1e-9 for w in k.weights) and len(k.weights) == len(k.channels) <= 3
    with pytest.raises(ValueError):
        E.make_kernels(spark, 6, 1)


def test_kernel_golden_and_both_forms(spark):
    x = spark.createDataFrame([(1, [[0.0, 1.0, 3.0, 2.0, 5.0]])], "sample_id bigint, dims array<array<double>>")
    k = spark.createDataFrame([(0, 3, -1.0, 1, 0, [0], [[-1.0, 0.0, 1.0]])], E.KERNEL_SCHEMA)
    assert E.apply_kernels(x, "dims", k).first().kernel_features == pytest.approx([2 / 3, 2.0])
    r = E.apply_kernels_sql(x, "sample_id", "dims", k).first()
    assert (r.ppv, r.top) == (pytest.approx(2 / 3), 2.0)


def test_random_kernels_both_forms_agree(spark, sf):
    v = vectors(spark, sf).filter("sample_id < 20")
    k = E.make_kernels(spark, 32, 8, 2, seed=1)
    fast = {r.sample_id: r.kernel_features for r in E.apply_kernels(v, "dims", k).collect()}
    for r in E.apply_kernels_sql(v, "sample_id", "dims", k).collect():
        assert fast[r.sample_id][2 * r.kernel_id: 2 * r.kernel_id + 2] == pytest.approx([r.ppv, r.top])


@pytest.mark.parametrize("block", [7, 10_000])
def test_neighbours_do_not_depend_on_blocks(spark, sf, block):
    v = vectors(spark, sf)
    got = NB.nearest(v.filter("sample_id < 30"), v.filter("sample_id >= 30"), "sample_id", "series", "label", 3, block).toPandas()
    data = v.toPandas()
    refs = data[data.sample_id >= 30]
    m = np.stack(refs.series.to_numpy())
    for q, s in data[data.sample_id < 30][["sample_id", "series"]].itertuples(index=False):
        d = np.sqrt(((m - s) ** 2).sum(axis=1))
        want = refs.sample_id.to_numpy()[np.lexsort((refs.sample_id, d))[:3]]
        assert list(got[got.qid == q].sort_values("rank").rid) == list(want)


def separable(spark):
    d = spark.range(300).selectExpr("id AS sample_id", "CAST(id % 3 AS INT) AS label", "array(id % 3 + pmod(hash(id), 100) / 500D, pmod(hash(id + 7), 100) / 100D) AS x")
    return L.with_vector(d, "x").select("sample_id", "label", "features")


@pytest.mark.parametrize("model,params", [
    ("decision_tree", {}), ("random_forest", {"numTrees": 5}), ("gradient_boosting", {"maxIter": 2}), ("naive_bayes", {}),
    ("mlp", {"layers": [2, 8, 3], "maxIter": 60}), ("ridge_classifier", {"alphas": (0.001,), "folds": 2}), ("ada_boost", {"rounds": 4, "depth": 2}),
    ("linear_svm", {"maxIter": 20}), ("hist_gradient_boosting", {"rounds": 3, "max_leaves": 4}), ("xgboost", {"rounds": 3, "max_depth": 3}),
])
def test_models_beat_the_majority_class(spark, model, params):
    d = separable(spark)
    pred = L.classify(d.filter("sample_id % 4 <> 0"), d.filter("sample_id % 4 = 0"), model, "sample_id", "label", **params)
    assert M.accuracy(pred).first().accuracy > 0.6


def test_ridge_finds_a_line(spark):
    d = spark.range(200).selectExpr("id AS sample_id", "id * 2D + 1 AS y", "array(CAST(id AS DOUBLE)) AS x")
    d = L.with_vector(d, "x")
    out = L.regress(d, d, "sample_id", "y", alphas=(1e-6, 10.0), folds=2)
    assert out.filter("abs(target - prediction) > 0.1").count() == 0


def test_configuration_fills_the_signature(spark):
    model = L.configured(L.RidgeClassifier, {"folds": 5, "label": "y", "unrelated": 1})
    assert (model.folds, model.label) == (5, "y")


def test_registries_refuse_unknown_names(spark):
    from tidemill.sources.datasets import load_dataset

    with pytest.raises(ValueError):
        L.make_model("nope")
    with pytest.raises(ValueError):
        load_dataset(spark, "nope", "/x")


def test_normalize_is_centred_and_saved_stats_apply(spark, sf, tmp_path):
    df = events(spark, sf)
    r = N.normalize(df, ["value"]).agg(F.avg("value"), F.stddev("value")).first()
    assert abs(r[0]) < 1e-9 and abs(r[1] - 1) < 1e-9
    N.save_stats(N.fit_stats(df, ["value"]), str(tmp_path / "s"))
    again = N.normalize(df, ["value"], stats=N.load_stats(spark, str(tmp_path / "s")))
    assert abs(again.agg(F.avg("value")).first()[0]) < 1e-9


def test_example_table_and_nesting_round_trip(spark):
    long = P.example_long(spark, 6, 5, 2, seed=1)
    assert long.count() == 60
    back = P.nested_to_long(P.long_to_nested(long, "case_id", "dim_id", "reading_id", "value"), "case_id")
    assert back.select("case_id", "dim_id", "reading_id", "value").exceptAll(long.selectExpr("case_id", "dim_id", "reading_id", "value")).count() == 0


def test_durations_are_appended(spark, tmp_path):
    path = str(tmp_path / "d")
    for i in range(2):
        T.save_durations(T.durations(spark, f"r{i}", 1.5, 0.5), path)
    assert spark.read.option("header", True).csv(path).count() == 4
