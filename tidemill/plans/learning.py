"""Kernel features, models and tasks."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tidemill.functions import arrays as A
from tidemill.operators import kernels as E
from tidemill.operators.boosting import Boosting
from tidemill.operators.ridge import Ridge
from tidemill.operators import masking as K
from tidemill.operators import metrics as M
from tidemill.operators import models as L
from tidemill.operators import neighbours as NB
from tidemill.operators import splits as X
from tidemill.operators import tracking as T
from tidemill.functions.hashing import uniform
from tidemill.plans.registry import events, query, r6, table
from tidemill.plans.samples import KEEP, VEC, cells, exploded, uniform_sql, vectors
from tidemill.plans.series import EV
from tidemill.session import fresh_path, materialize


def fixed_kernels(spark):
    """Three hand-written kernels over two channels, so that SQL can state them too."""
    rows = [
        (0, 3, -0.05, 1, 0, [0], [[-1.0, 0.0, 1.0]]),
        (1, 3, 0.1, 2, 2, [1], [[0.5, -1.0, 0.5]]),
        (2, 3, 0.0, 4, 4, [0, 1], [[1.0, -2.0, 1.0], [-0.5, 0.0, 0.5]]),
    ]
    return spark.createDataFrame(rows, E.KERNEL_SCHEMA)


KSQL = f"""WITH {VEC}, d AS (SELECT sample_id, t // 32 AS c, t % 32 AS t, x FROM v),
kn AS (SELECT * FROM (VALUES (0, -0.05::DOUBLE, 1, 0, 0, -1.0::DOUBLE, 0), (0, -0.05, 1, 0, 0, 0.0, 1), (0, -0.05, 1, 0, 0, 1.0, 2),
 (1, 0.1, 2, 2, 1, 0.5, 0), (1, 0.1, 2, 2, 1, -1.0, 1), (1, 0.1, 2, 2, 1, 0.5, 2),
 (2, 0.0, 4, 4, 0, 1.0, 0), (2, 0.0, 4, 4, 0, -2.0, 1), (2, 0.0, 4, 4, 0, 1.0, 2), (2, 0.0, 4, 4, 1, -0.5, 0), (2, 0.0, 4, 4, 1, 0.0, 1), (2, 0.0, 4, 4, 1, 0.5, 2))
 k(kernel_id, bias, dil, pad, c, w, tap)),
o AS (SELECT s.sample_id, kn.kernel_id, p, any_value(bias) + sum(w * coalesce(d.x, 0) ORDER BY kn.c, tap) AS y
 FROM (SELECT DISTINCT sample_id FROM d) s CROSS JOIN kn CROSS JOIN (SELECT unnest(generate_series(0, 31)) AS p)
 LEFT JOIN d ON d.sample_id = s.sample_id AND d.c = kn.c AND d.t = p + tap * dil - pad WHERE p < 32 + 2 * pad - 2 * dil GROUP BY 1, 2, 3)
SELECT sample_id, CAST(kernel_id AS INTEGER) AS kernel_id, round(avg(CAST(y > 0 AS INTEGER)), 6) AS ppv, round(max(y), 6) AS top FROM o GROUP BY 1, 2"""


@query("kernel_features", KSQL)
def kernel_features(spark, sf):
    feats = E.apply_kernels(vectors(spark, sf), "dims", fixed_kernels(spark)).select("sample_id", "kernel_features")
    pairs = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: F.struct(
        k.alias("kernel_id"), r6(F.get("kernel_features", 2 * k)).alias("ppv"), r6(F.get("kernel_features", 2 * k + 1)).alias("top")))
    return feats.select("sample_id", F.inline(pairs))


@query("kernel_features_by_expressions", KSQL)
def kernel_features_sql(spark, sf):
    k = E.apply_kernels_sql(vectors(spark, sf), "sample_id", "dims", fixed_kernels(spark))
    return k.withColumns({"ppv": r6("ppv"), "top": r6("top")})


def drawn_kernels_sql(length: int, n: int, channels: int, seed: int) -> str:
    """The kernels of ``make_kernels`` as a table of taps: kernel_id, bias, dil, pad, c, w, tap."""
    def u(name, *parts):
        return uniform_sql(f"'{seed}-{name}'", *[f"CAST({p} AS VARCHAR)" for p in parts])

    lengths = [m for m in E.LENGTHS if m < length]
    return f"""k0 AS (SELECT i AS kernel_id, {lengths}[1 + CAST(floor({u('length', 'i')} * {len(lengths)}) AS INTEGER)] AS len FROM (SELECT unnest(generate_series(0, {n - 1})) AS i)),
k1 AS (SELECT *, {u('bias', 'kernel_id')} * 2 - 1 AS bias, CAST(floor(pow(2.0, {u('dilation', 'kernel_id')} * log2(floor({length - 1} / CAST(len - 1 AS DOUBLE))))) AS INTEGER) AS dil,
 CAST(floor(pow(2.0, {u('width', 'kernel_id')} * log2({channels + 1}.0))) AS INTEGER) AS width FROM k0),
k2 AS (SELECT *, CASE WHEN {u('padding', 'kernel_id')} < 0.5 THEN ((len - 1) * dil) // 2 ELSE 0 END AS pad FROM k1),
k3 AS (SELECT k2.*, c, row_number() OVER (PARTITION BY kernel_id ORDER BY {u('channel', 'kernel_id', 'c')}, c) AS place FROM k2, (SELECT unnest(generate_series(0, {channels - 1})) AS c)),
k4 AS (SELECT k3.*, unnest(generate_series(0, len - 1)) AS tap FROM k3 WHERE place <= width),
k5 AS (SELECT *, sqrt(-2 * ln(1 - {u('radius', 'kernel_id', 'c', 'tap')})) * cos(2 * pi() * {u('angle', 'kernel_id', 'c', 'tap')}) AS raw FROM k4),
kn AS (SELECT kernel_id, len, bias, dil, pad, c, tap, raw - avg(raw) OVER (PARTITION BY kernel_id, c) AS w FROM k5)"""


@query("random_kernels_saved_and_applied", f"""WITH {VEC}, d AS (SELECT sample_id, t // 32 AS c, t % 32 AS t, x FROM v), {drawn_kernels_sql(32, 64, 2, 5)},
o AS (SELECT s.sample_id, kn.kernel_id, p, any_value(bias) + sum(w * coalesce(d.x, 0)) AS y
 FROM (SELECT DISTINCT sample_id FROM d) s CROSS JOIN kn CROSS JOIN (SELECT unnest(generate_series(0, 63)) AS p)
 LEFT JOIN d ON d.sample_id = s.sample_id AND d.c = kn.c AND d.t = p + tap * dil - pad WHERE p < 32 + 2 * pad - (len - 1) * dil GROUP BY 1, 2, 3),
f AS (SELECT sample_id, kernel_id, avg(CAST(y > 0 AS INTEGER)) AS ppv, max(y) AS top FROM o GROUP BY 1, 2)
SELECT sample_id, CAST(2 * kernel_id + j AS INTEGER) AS i, round(CASE WHEN j = 0 THEN ppv ELSE top END, 6) AS x FROM f, (SELECT unnest([0, 1]) AS j)""")
def random_kernels(spark, sf):
    path = fresh_path(spark, "kernels")
    T.save_kernels(E.make_kernels(spark, 32, 64, 2, seed=5), path)
    feats = E.apply_kernels(vectors(spark, sf), "dims", spark.read.parquet(path))
    return feats.select("sample_id", F.posexplode("kernel_features").alias("i", "x")).withColumn("x", r6("x"))


NN = """tr AS (SELECT vec_id AS id, embedding AS v, label FROM embeddings WHERE vec_id % 5 <> 0), te AS (SELECT vec_id AS id, embedding AS v, label FROM embeddings WHERE vec_id % 5 = 0),
ds AS (SELECT te.id AS qid, tr.id AS rid, tr.label, list_distance(CAST(te.v AS DOUBLE[]), CAST(tr.v AS DOUBLE[])) AS distance FROM te, tr),
nn AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, rid) AS rank FROM ds)"""


def split_vectors(spark, sf):
    v = vectors(spark, sf)
    return v.filter("sample_id % 5 <> 0"), v.filter("sample_id % 5 = 0")


@query("nearest_neighbours", f"WITH {NN} SELECT qid, CAST(rank AS INTEGER) AS rank, rid, round(distance, 6) AS distance, label FROM nn WHERE rank <= 5")
def nearest(spark, sf):
    train, test = split_vectors(spark, sf)
    return NB.nearest(test, train, "sample_id", "series", "label", 5).withColumn("distance", r6("distance"))


@query("nearest_neighbour_votes", f"""WITH {NN}, c AS (SELECT qid, label, count(*) AS n FROM nn WHERE rank <= 5 GROUP BY 1, 2)
SELECT qid, arg_max(label, {{'n': n, 'm': -label}}) AS pred FROM c GROUP BY 1""")
def votes(spark, sf):
    train, test = split_vectors(spark, sf)
    return NB.vote(NB.nearest(test, train, "sample_id", "series", "label", 5, block_rows=128))


FEATS = tuple(f"x{i}" for i in range(64))


@query("gaussian_naive_bayes", """WITH l AS (SELECT vec_id, label, i, CAST(embedding[i] AS DOUBLE) AS x FROM embeddings, (SELECT unnest(generate_series(1, 64)) AS i)),
m AS (SELECT label, i, count(*) AS n, avg(x) AS mu, var_pop(x) + 1e-9 AS v FROM l WHERE vec_id % 5 <> 0 GROUP BY 1, 2),
s AS (SELECT l.vec_id, m.label, ln(any_value(n)) + sum(-ln(v) / 2 - (x - mu) * (x - mu) / (2 * v)) AS score FROM l JOIN m ON m.i = l.i WHERE vec_id % 5 = 0 GROUP BY 1, 2)
SELECT vec_id AS sample_id, arg_max(label, score) AS pred, round(max(score), 5) AS score FROM s GROUP BY 1""")
def naive_bayes(spark, sf):
    train, test = [d.select("sample_id", "label", *[F.col("series")[i].alias(c) for i, c in enumerate(FEATS)]) for d in split_vectors(spark, sf)]
    moments = L.gaussian_moments(train, "label", FEATS)
    return L.gaussian_predict(test, "sample_id", FEATS, moments, "label").withColumn("score", r6("score", 5))


@query("gaussian_moments", """SELECT label, 'x' || (i - 1) AS feature, count(*) AS n, round(avg(CAST(embedding[i] AS DOUBLE)), 6) AS mean, round(var_pop(CAST(embedding[i] AS DOUBLE)), 8) AS var
FROM embeddings, (SELECT unnest(generate_series(1, 64)) AS i) GROUP BY 1, 2, i""")
def moments(spark, sf):
    v = vectors(spark, sf).select("label", *[F.col("series")[i].alias(c) for i, c in enumerate(FEATS)])
    return L.gaussian_moments(v, "label", FEATS).select("label", "feature", "n", r6("mean").alias("mean"), r6("var", 8).alias("var"))


@query("balanced_class_weights", """SELECT vec_id AS sample_id, round(count(*) OVER () / ((SELECT count(DISTINCT label) FROM embeddings) * CAST(count(*) OVER (PARTITION BY label) AS DOUBLE)), 6) AS weight FROM embeddings""")
def weights(spark, sf):
    return L.class_weights(vectors(spark, sf), "label").select("sample_id", r6("weight").alias("weight"))


def featured(spark, sf):
    train, test = split_vectors(spark, sf)
    return [L.with_vector(d, "series").select("sample_id", "label", "features") for d in (train, test)]


def _classifier(name, **params):
    def run(spark, sf):
        train, test = featured(spark, sf)
        return L.classify(train, test, name, "sample_id", "label", **params)

    query(f"classify_{name}")(run)


for _name, _params in {
    "decision_tree": {"maxDepth": 5},
    "random_forest": {"numTrees": 20, "maxDepth": 5},
    "gradient_boosting": {"maxIter": 3, "maxDepth": 3},
    "hist_gradient_boosting": {"rounds": 2, "max_leaves": 4},
    "xgboost": {"rounds": 2, "max_depth": 3},
    "naive_bayes": {},
    "linear_svm": {"maxIter": 8},
    "mlp": {"layers": [64, 16, 10], "maxIter": 30},
    "ridge_classifier": {"alphas": (0.1, 10.0), "folds": 2},
    "ada_boost": {"rounds": 5, "depth": 3},
}.items():
    _classifier(_name, **_params)


MIXED = f"""{EV}, d AS (SELECT event_id, value AS a, k AS b, value * 0.5 + k + {uniform_sql("'5'", 'CAST(event_id AS VARCHAR)')} * 20 AS y FROM ev)"""
# two features: the normal equations by hand, from sums over the rows that train
TWO = """avg(a) AS ma, avg(b) AS mb, avg(y) AS my, count(*) * var_pop(a) AS aa, count(*) * var_pop(b) AS bb, count(*) * covar_pop(a, b) AS ab,
 count(*) * covar_pop(a, y) AS ay, count(*) * covar_pop(b, y) AS by_"""
SOLVED = """*, (ay * (bb + alpha) - by_ * ab) / ((aa + alpha) * (bb + alpha) - ab * ab) AS wa, (by_ * (aa + alpha) - ay * ab) / ((aa + alpha) * (bb + alpha) - ab * ab) AS wb"""


def mixed(spark, sf):
    noise = uniform(5, F.col("event_id")) * 20
    return events(spark, sf).select("event_id", F.array("value", "k").alias("features"), (F.col("value") * 0.5 + F.col("k") + noise).alias("y"))


@query("transforms_and_registered_model", f"""WITH {MIXED}, u AS (SELECT * FROM d WHERE b < 90),
s AS (SELECT {TWO}, CAST(100000 AS DOUBLE) AS alpha FROM u), w AS (SELECT {SOLVED} FROM s)
SELECT event_id, round(my + wa * (a - ma) + wb * (b - mb), 5) AS prediction FROM u, w""")
def registered(spark, sf):
    """A list of transforms, and a model of the registry that takes what it knows from a flat configuration."""
    steps = [lambda d: d.filter(F.col("features")[1] < 90), lambda d: L.with_vector(d, "features"), lambda d: d.withColumnRenamed("y", "target")]
    d = L.apply_transforms(mixed(spark, sf), steps)
    config = {"alphas": (1e5,), "label": "target", "features": "features", "batch_size": 32}
    model = L.configured_model("ridge_regression", config)
    return model.fit(d).transform(d).select("event_id", r6("prediction", 5).alias("prediction"))


@query("ridge_penalties_by_fold", f"""WITH {MIXED}, f AS (SELECT unnest([0, 1, 2]) AS fold), al AS (SELECT unnest([1.0::DOUBLE, 100000, 10000000]) AS alpha),
s AS (SELECT fold, {TWO} FROM f JOIN d ON d.event_id % 3 <> fold GROUP BY fold), w AS (SELECT {SOLVED} FROM s, al)
SELECT alpha, round(avg(pow(y - (my + wa * (a - ma) + wb * (b - mb)), 2)), 5) AS mse FROM d JOIN w ON d.event_id % 3 = fold GROUP BY alpha""")
def penalties(spark, sf):
    """Error of each penalty on the folds left out, all from one aggregation."""
    d = mixed(spark, sf).withColumn("fold", F.col("event_id") % 3)
    model = Ridge("features", "y", [1.0, 1e5, 1e7], folds=3, fold="fold").fit(d)
    return spark.createDataFrame([(a, round(e, 5)) for a, e in model.errors.items()], "alpha double, mse double")


def _ridge_classes(weight):
    return f"""WITH v AS (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b FROM embeddings),
n AS (SELECT label, count(*) AS n, sum(count(*)) OVER () AS total, count(*) OVER () AS k FROM v WHERE vec_id % 5 <> 0 GROUP BY label),
t AS (SELECT v.*, {weight} AS w FROM v JOIN n USING (label) WHERE vec_id % 5 <> 0),
m AS (SELECT sum(w) AS sw, sum(w * a) / sum(w) AS ma, sum(w * b) / sum(w) AS mb FROM t),
q AS (SELECT sum(w * (a - ma) * (a - ma)) AS aa, sum(w * (b - mb) * (b - mb)) AS bb, sum(w * (a - ma) * (b - mb)) AS ab FROM t, m),
s AS (SELECT c.label, sum(w * CASE WHEN t.label = c.label THEN 1 ELSE -1 END) / any_value(sw) AS my, sum(w * (a - ma) * CASE WHEN t.label = c.label THEN 1 ELSE -1 END) AS ay,
  sum(w * (b - mb) * CASE WHEN t.label = c.label THEN 1 ELSE -1 END) AS by_, 0.5::DOUBLE AS alpha FROM t, m, (SELECT DISTINCT label FROM t) c GROUP BY c.label),
z AS (SELECT {SOLVED} FROM s, q),
p AS (SELECT vec_id, label, my + wa * (a - ma) + wb * (b - mb) AS score FROM (SELECT vec_id, a, b FROM v WHERE vec_id % 5 = 0), z, m)
SELECT vec_id AS sample_id, arg_max(label, score) AS pred, round(max(score), 6) AS score FROM p GROUP BY 1"""


def _ridge_query(spark, sf, weighted):
    train, test = [d.select("sample_id", "label", F.slice("series", 1, 2).alias("features")) for d in split_vectors(spark, sf)]
    if weighted:
        train = L.class_weights(train, "label")
    model = L.RidgeClassifier(alphas=(0.5,), weight="weight" if weighted else None).fit(train)
    return model.transform(test).select("sample_id", F.col("prediction").cast("int").alias("pred"), r6(F.array_max("scores")).alias("score"))


@query("ridge_classifier_two_features", _ridge_classes("1.0::DOUBLE"))
def ridge_classes(spark, sf):
    return _ridge_query(spark, sf, False)


@query("ridge_classifier_balanced", _ridge_classes("total / (k * CAST(n AS DOUBLE))"))
def ridge_balanced(spark, sf):
    """The same with balanced class weights in the fit."""
    return _ridge_query(spark, sf, True)


@query("boosting_two_leaves", f"""WITH {EV}, d AS (SELECT event_id, value AS y, CASE WHEN event_id % 9 <> 0 THEN k END AS f0, CAST(user_id % 7 AS DOUBLE) AS f1 FROM ev),
o AS (SELECT avg(y) AS base FROM d), r AS (SELECT d.*, base - y AS g FROM d, o),
l AS (SELECT event_id, g, 0 AS f, f0 AS x FROM r UNION ALL SELECT event_id, g, 1, f1 FROM r),
t AS (SELECT f, sum(g) AS gt, count(*) AS ht, coalesce(sum(g) FILTER (x IS NULL), 0) AS gm, count(*) FILTER (x IS NULL) AS hm FROM l GROUP BY f),
c AS (SELECT f, x AS cut, sum(sum(g)) OVER (PARTITION BY f ORDER BY x) AS g0, sum(count(*)) OVER (PARTITION BY f ORDER BY x) AS h0,
  row_number() OVER (PARTITION BY f ORDER BY x DESC) AS above FROM l WHERE x IS NOT NULL GROUP BY f, x),
s AS (SELECT f, cut, side, g0 + side * gm AS gl, h0 + side * hm AS hl, gt, ht FROM c JOIN t USING (f), (SELECT unnest([1, 0]) AS side) WHERE above > 1),
b AS (SELECT * FROM s ORDER BY round(gl * gl / (hl + 1) + (gt - gl) * (gt - gl) / (ht - hl + 1), 7) DESC, f, cut, side DESC LIMIT 1)
SELECT event_id, round(base + CASE WHEN x <= cut OR (x IS NULL AND side = 1) THEN -0.3 * gl / (hl + 1) ELSE -0.3 * (gt - gl) / (ht - hl + 1) END, 6) AS prediction
FROM o, b JOIN l USING (f)""")
def two_leaves(spark, sf):
    """One round of one split by second-order gain, missing values on the better side."""
    d = events(spark, sf).select("event_id", F.col("value").alias("y"), F.array(
        F.when(F.col("event_id") % 9 != 0, F.col("k")), (F.col("user_id") % 7).cast("double")).alias("features"))
    model = Boosting(label="y", loss="squared", rounds=1, max_depth=1, rate=0.3, l2=1.0, min_hessian=0).fit(d)
    return model.transform(d).select("event_id", r6("prediction").alias("prediction"))


@query("regress_ridge_on_kernels")
def regress_ridge(spark, sf):
    kernels = E.make_kernels(spark, 32, 32, 2, seed=9)
    v = E.apply_kernels(vectors(spark, sf), "dims", kernels).withColumn("target", A.mean(F.col("series")))
    v = materialize(L.with_vector(v, "kernel_features").select("sample_id", "target", "features"), "kernelfeatures")
    return L.regress(v.filter("sample_id % 5 <> 0"), v.filter("sample_id % 5 = 0"), "sample_id", "target", alphas=(0.01, 1.0), folds=2)


@query("regress_gradient_boosting")
def regress_gbt(spark, sf):
    v = L.with_vector(vectors(spark, sf), "series").withColumn("target", A.mean(F.col("series"))).select("sample_id", "target", "features")
    return L.regress(v.filter("sample_id % 5 <> 0"), v.filter("sample_id % 5 = 0"), "sample_id", "target", "gradient_boosting_regression", maxIter=3)


@query("classification_task_report")
def task(spark, sf):
    """Split, kernel features, fit, predict, report."""
    v = vectors(spark, sf)
    roles = X.split(v, "stratified", "sample_id", 0.25, label="label")
    v = E.apply_kernels(v, "dims", E.make_kernels(spark, 32, 64, 2, seed=3))
    v = L.apply_transforms(v, [lambda d: L.with_vector(d, "kernel_features"), lambda d: d.select("sample_id", "label", "features")])
    v = materialize(v.join(roles, "sample_id"), "task")
    pred = L.classify(v.filter("split = 'train'"), v.filter("split = 'val'"), "random_forest", "sample_id", "label", numTrees=20)
    return M.classification_report(pred).drop("thieves")


NEAR = """h AS (SELECT *, CASE WHEN keep THEN x END AS y FROM kp),
n AS (SELECT *, last_value(y IGNORE NULLS) OVER p AS pv, last_value(CASE WHEN y IS NOT NULL THEN t END IGNORE NULLS) OVER p AS pt,
 first_value(y IGNORE NULLS) OVER q AS nv, first_value(CASE WHEN y IS NOT NULL THEN t END IGNORE NULLS) OVER q AS nt FROM h
 WINDOW p AS (PARTITION BY sample_id, f ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), q AS (PARTITION BY sample_id, f ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
re AS (SELECT *, CASE WHEN y IS NOT NULL THEN y WHEN pv IS NOT NULL AND nv IS NOT NULL THEN pv + (nv - pv) * (t - pt) / (nt - pt) ELSE coalesce(pv, nv) END AS r FROM n)"""


@query("imputation_task", f"WITH {VEC}, {KEEP}, {NEAR} SELECT round(avg((x - r) * (x - r)) FILTER (NOT keep AND r IS NOT NULL), 8) AS mse, count(*) FILTER (NOT keep AND r IS NOT NULL) AS cells FROM re")
def imputation(spark, sf):
    keep = cells(K.noise_mask(vectors(spark, sf), "sample_id", "dims", 0.3, distribution="bernoulli", seed=7))
    x = cells(vectors(spark, sf), "dims", "x").join(keep, ["sample_id", "f", "t"])
    series = x.withColumn("series_id", F.concat_ws("-", "sample_id", "f"))
    return L.impute_and_score(series, "series_id", "t", "x", "keep").withColumn("mse", r6("mse", 8))


@query("transduction_task", f"""WITH {EV}, d AS (SELECT event_id % 64 AS t, value AS a, k AS b, value * 0.5 + k + {uniform_sql("'5'", 'CAST(event_id AS VARCHAR)')} * 20 AS y FROM ev),
m AS (SELECT *, t >= 12 AND t < 44 AS hidden FROM d), s AS (SELECT avg(a) AS ma, avg(b) AS mb, avg(y) AS my, var_pop(a) AS aa, var_pop(b) AS bb, covar_pop(a, b) AS ab,
  covar_pop(a, y) AS ay, covar_pop(b, y) AS by_ FROM m WHERE NOT hidden),
w AS (SELECT *, (ay * bb - by_ * ab) / (aa * bb - ab * ab) AS wa, (by_ * aa - ay * ab) / (aa * bb - ab * ab) AS wb FROM s)
SELECT round(avg(pow(y - (my + wa * (a - ma) + wb * (b - mb)), 2)), 5) AS mse, count(*) AS cells FROM m, w WHERE hidden""")
def transduction(spark, sf):
    """A third feature, noisy and hidden in the middle of each block of events, from the two visible ones."""
    noise = uniform(5, F.col("event_id")) * 20
    df = events(spark, sf).withColumn("mixed", F.col("value") * 0.5 + F.col("k") + noise)
    keep = K.transduct_keep(F.col("event_id") % 64, F.lit(2), F.lit(64), (2,), 0.2, 0.3)
    out = L.transduce(df.withColumn("keep", keep), ["mixed"], ["value", "k"], "keep", solver="normal")
    cells_ = out.select("mixed", F.col("mixed_pred").alias("p"), (~F.col("keep")).alias("predict"))
    return M.masked_mse(cells_, "mixed", "p", F.col("predict"), F.lit(True)).withColumn("mse", r6("mse", 5))


@query("transforms_and_registry", """WITH t AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS DOUBLE) AS x, CAST(l_extendedprice AS DOUBLE) * (1 - CAST(l_discount AS DOUBLE)) AS y FROM lineitem WHERE l_returnflag <> 'R'),
m AS (SELECT regr_slope(y, x) AS a, regr_intercept(y, x) AS b FROM t WHERE l_orderkey % 4 <> 0)
SELECT l_orderkey, l_linenumber, round(y, 4) AS target, round(a * x + b, 4) AS prediction FROM t, m WHERE l_orderkey % 4 = 0""")
def transforms_and_registry(spark, sf):
    """A list of transforms, then a model by name with what its constructor knows of a flat configuration."""
    keep = ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag"]
    rows = L.apply_transforms(table(spark, sf, "lineitem"), [
        lambda d: d.select(*keep),
        lambda d: d.filter("l_returnflag <> 'R'"),
        lambda d: d.withColumn("y", F.col("l_extendedprice").cast("double") * (1 - F.col("l_discount").cast("double"))),
        lambda d: d.withColumn("features", array_to_vector(F.array(F.col("l_quantity").cast("double")))),
    ])
    config = {"featuresCol": "features", "labelCol": "y", "regParam": 0.0, "solver": "normal", "batch_size": 64, "epochs": 3}
    fitted = L.configured_model("linear_regression", config).fit(rows.filter("l_orderkey % 4 <> 0"))
    return fitted.transform(rows.filter("l_orderkey % 4 = 0")).select(
        "l_orderkey", "l_linenumber", r6("y", 4).alias("target"), r6("prediction", 4).alias("prediction"))
