"""Fixed-length samples: normalisation, masks, padding, reshaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.functions import arrays as A
from tidemill.functions import scalars as S
from tidemill.operators import masking as M
from tidemill.operators import normalize as N
from tidemill.operators import samples as P
from tidemill.operators import windows as W
from tidemill.plans.registry import events, query, r6, table
from tidemill.plans.series import EV
from tidemill.session import fresh_path, materialize


def vectors(spark, sf):
    """Embeddings as samples with two dimensions of 32 steps."""
    v = F.col("embedding").cast("array<double>")
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("sample_id"), "label", v.alias("series"),
        F.array(F.slice(v, 1, 32), F.slice(v, 33, 32)).alias("dims"))


def talks(spark, sf):
    """Conversations as samples of varying length: the length of each turn's text."""
    turns = table(spark, sf, "conversations").select("conv_id", "turn", F.length("text").cast("double").alias("x"))
    ordered = F.array_sort(F.collect_list(F.struct("turn", "x")))
    return turns.groupBy(F.col("conv_id").alias("sample_id")).agg(F.transform(ordered, lambda t: t["x"]).alias("series"))


def exploded(df, column="series", out="x"):
    return df.select("sample_id", F.posexplode(column).alias("t", out))


VEC = """v AS (SELECT vec_id AS sample_id, label, i - 1 AS t, CAST(embedding[i] AS DOUBLE) AS x
  FROM embeddings, (SELECT unnest(generate_series(1, 64)) AS i))"""
TALK = """tk AS (SELECT conv_id AS sample_id, CAST(length(text) AS DOUBLE) AS x, count(*) OVER (PARTITION BY conv_id) AS n,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS t FROM conversations)"""
BLOCK = 64  # events that make a sample of bounded size
EPS = "2.220446049250313e-16"
STATS = "st AS (SELECT avg(value) AS m, stddev_samp(value) AS s, min(value) AS lo, max(value) AS hi, avg(k) AS km, stddev_samp(k) AS ks, min(k) AS klo, max(k) AS khi FROM {})"


@query("feature_mean_std", f"""WITH {EV} SELECT 'value' AS feature, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std FROM ev
UNION ALL SELECT 'k', round(avg(k), 6), round(stddev_samp(k), 6) FROM ev""")
def mean_std(spark, sf):
    return N.fit_stats(events(spark, sf), ["value", "k"]).select("feature", r6("mean").alias("mean"), r6("std").alias("std"))


@query("feature_min_max", f"""WITH {EV} SELECT 'value' AS feature, min(value) AS min, max(value) AS max FROM ev
UNION ALL SELECT 'k', min(k), max(k) FROM ev""")
def min_max(spark, sf):
    return N.fit_stats(events(spark, sf), ["value", "k"]).select("feature", "min", "max")


@query("normalize_standard", f"""WITH {EV}, {STATS.format('ev')} SELECT event_id, round((value - m) / (s + {EPS}), 6) AS value, round((k - km) / (ks + {EPS}), 6) AS k FROM ev, st""")
def standard(spark, sf):
    return N.normalize(events(spark, sf), ["value", "k"]).select("event_id", r6("value").alias("value"), r6("k").alias("k"))


@query("normalize_minmax", f"""WITH {EV}, {STATS.format('ev')} SELECT event_id, round((value - lo) / (hi - lo + {EPS}), 6) AS value, round((k - klo) / (khi - klo + {EPS}), 6) AS k FROM ev, st""")
def minmax(spark, sf):
    return N.normalize(events(spark, sf), ["value", "k"], "minmax").select("event_id", r6("value").alias("value"), r6("k").alias("k"))


@query("normalize_per_sample_std", f"""WITH {EV} SELECT event_id, round((value - avg(value) OVER w) / nullif(stddev_samp(value) OVER w, 0), 6) AS value FROM ev WINDOW w AS (PARTITION BY user_id)""")
def sample_std(spark, sf):
    return N.normalize(events(spark, sf), ["value"], "per_sample_std", sample="user_id").select("event_id", r6("value").alias("value"))


@query("normalize_per_sample_minmax", f"""WITH {EV} SELECT event_id, round((value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w + {EPS}), 6) AS value FROM ev WINDOW w AS (PARTITION BY user_id)""")
def sample_minmax(spark, sf):
    return N.normalize(events(spark, sf), ["value"], "per_sample_minmax", sample="user_id").select("event_id", r6("value").alias("value"))


@query("sample_mean_std", f"""WITH {VEC} SELECT sample_id, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std FROM v GROUP BY 1""")
def array_mean_std(spark, sf):
    return vectors(spark, sf).select("sample_id", r6(A.mean(F.col("series"))).alias("mean"), r6(A.spread(F.col("series"))).alias("std"))


@query("sample_min_max", f"""WITH {VEC} SELECT sample_id, round(min(x), 6) AS min, round(max(x), 6) AS max FROM v GROUP BY 1""")
def array_min_max(spark, sf):
    return vectors(spark, sf).select("sample_id", r6(F.array_min("series")).alias("min"), r6(F.array_max("series")).alias("max"))


TRAIN = "hashed"


@query("train_stats_applied_to_all", f"""WITH {EV}, {STATS.format('ev WHERE user_id % 3 <> 0')}
SELECT event_id, round((value - m) / (s + {EPS}), 6) AS value, round((k - km) / (ks + {EPS}), 6) AS k FROM ev, st""")
def train_stats(spark, sf):
    df = events(spark, sf)
    train = df.select("user_id").distinct().filter("user_id % 3 <> 0")
    stats = N.fit_stats(P.keep_ids(df, train, "user_id"), ["value", "k"])
    return N.normalize(df, ["value", "k"], stats=stats).select("event_id", r6("value").alias("value"), r6("k").alias("k"))


@query("saved_stats_round_trip", f"""WITH {EV}, {STATS.format('ev')} SELECT 'value' AS feature, round(m, 6) AS mean, round(s, 6) AS std, lo AS min, hi AS max FROM st
UNION ALL SELECT 'k', round(km, 6), round(ks, 6), klo, khi FROM st""")
def stats_round_trip(spark, sf):
    path = fresh_path(spark, "stats")
    N.save_stats(N.fit_stats(events(spark, sf), ["value", "k"]), path)
    return N.load_stats(spark, path).select("feature", r6("mean").alias("mean"), r6("std").alias("std"), "min", "max")


@query("saved_stats_normalize", f"""WITH {EV}, {STATS.format('ev WHERE event_id % 2 = 0')} SELECT event_id, round((value - lo) / (hi - lo + {EPS}), 6) AS value FROM ev, st""")
def stats_reused(spark, sf):
    path = fresh_path(spark, "stats")
    df = events(spark, sf)
    N.save_stats(N.fit_stats(df.filter("event_id % 2 = 0"), ["value"]), path)
    return N.normalize(df, ["value"], "minmax", stats=N.load_stats(spark, path)).select("event_id", r6("value").alias("value"))


@query("null_to_zero", f"""WITH {EV} SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN value ELSE 0 END AS value, k FROM ev""")
def null_to_zero(spark, sf):
    from tidemill.operators.clean import fill_zero

    df = events(spark, sf).withColumn("value", F.when(F.col("event_id") % 7 != 0, F.col("value")))
    return fill_zero(df, ["value", "k"]).select("event_id", "value", "k")


# ---- shapes --------------------------------------------------------------------------------------------

@query("decimate_long_series", f"""WITH {VEC} SELECT sample_id, CAST(t // 2 AS INTEGER) AS t, round(x, 6) AS x FROM v WHERE t % 2 = 0""")
def decimate(spark, sf):
    df = vectors(spark, sf).withColumn("series", A.decimate(F.col("series"), 2, 40))
    return exploded(df).withColumn("x", r6("x"))


@query("uniform_scaling", f"""WITH {TALK} SELECT DISTINCT a.sample_id, CAST(j AS INTEGER) AS t, b.x FROM tk a, (SELECT unnest(generate_series(0, 11)) AS j)
JOIN tk b ON b.sample_id = a.sample_id AND b.t = j * a.n // 12""")
def scaling(spark, sf):
    return exploded(talks(spark, sf).withColumn("series", A.uniform_scale(F.col("series"), 12)))


@query("clip_to_length", f"""WITH {TALK} SELECT sample_id, CAST(t AS INTEGER) AS t, x FROM tk WHERE t < 3""")
def clip(spark, sf):
    return exploded(talks(spark, sf).withColumn("series", F.slice("series", 1, 3)))


@query("fixed_length_standard", f"""WITH {TALK}, h AS (SELECT *, CASE WHEN t % 2 = 1 THEN NULL ELSE x END AS y FROM tk),
f AS (SELECT sample_id, t, n, CASE WHEN y IS NOT NULL THEN y WHEN nt IS NULL THEN pv ELSE pv + (nv - pv) * (t - pt) / (nt - pt) END AS y FROM (
 SELECT *, last_value(y IGNORE NULLS) OVER p AS pv, last_value(CASE WHEN y IS NOT NULL THEN t END IGNORE NULLS) OVER p AS pt,
 first_value(y IGNORE NULLS) OVER q AS nv, first_value(CASE WHEN y IS NOT NULL THEN t END IGNORE NULLS) OVER q AS nt FROM h
 WINDOW p AS (PARTITION BY sample_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), q AS (PARTITION BY sample_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))),
c AS (SELECT * FROM f WHERE t < 4)
SELECT sample_id, CAST(t AS INTEGER) AS t, round((y - avg(y) OVER w) / coalesce(nullif(stddev_pop(y) OVER w, 0), 1), 6) AS x FROM c WINDOW w AS (PARTITION BY sample_id)""")
def fixed_standard(spark, sf):
    gaps = F.transform("series", lambda x, i: F.when(i % 2 == 0, x))
    df = talks(spark, sf).select("sample_id", F.array(gaps).alias("dims"))
    fixed = P.fix_length(df, "dims", 4, "standard")
    return exploded(fixed.select("sample_id", F.col("dims")[0].alias("series"))).withColumn("x", r6("x"))


@query("fixed_length_uneven_minmax", f"""WITH {TALK}, d AS (SELECT sample_id, t, x, n, ceil(n / 2.0) AS h FROM tk),
long1 AS (SELECT sample_id, 0 AS f, t, x FROM d WHERE t < 4),
j AS (SELECT DISTINCT sample_id, n, CAST(h AS BIGINT) AS h, t AS j FROM d),
long2 AS (SELECT j.sample_id, 1 AS f, j.j AS t, d.x FROM j JOIN d ON d.sample_id = j.sample_id AND d.t = j.j * j.h // j.n WHERE j.j < 4)
SELECT sample_id, CAST(f AS INTEGER) AS f, CAST(t AS INTEGER) AS t, round((x - min(x) OVER w) / coalesce(nullif(max(x) OVER w - min(x) OVER w, 0), 1), 6) AS x
FROM (SELECT * FROM long1 UNION ALL SELECT * FROM long2) WINDOW w AS (PARTITION BY sample_id, f)""")
def fixed_minmax(spark, sf):
    half = F.slice("series", F.lit(1), F.ceil(F.size("series") / 2).cast("int"))
    df = talks(spark, sf).select("sample_id", F.array(F.col("series"), half).alias("dims"))
    fixed = P.fix_length(df, "dims", 4, "minmax")
    long = P.nested_to_long(fixed, "sample_id")
    return long.select("sample_id", F.col("dim_id").alias("f"), F.col("reading_id").alias("t"), r6("value").alias("x"))


@query("uneven_dimensions_thinned", f"""WITH {TALK}, d AS (SELECT sample_id, 0 AS f, t, x, n FROM tk UNION ALL SELECT sample_id, 1, t, x, n FROM tk WHERE t < 4)
SELECT sample_id, CAST(f AS INTEGER) AS f, CAST(CASE WHEN n > 4 AND f = 0 THEN t // 2 ELSE t END AS INTEGER) AS t, x FROM d WHERE NOT (n > 4 AND f = 0 AND t % 2 = 1)""")
def thinned(spark, sf):
    df = talks(spark, sf).select("sample_id", F.array(F.col("series"), F.slice("series", 1, 4)).alias("dims"))
    long = P.nested_to_long(P.repair_lengths(df, "dims", 4), "sample_id")
    return long.select("sample_id", F.col("dim_id").alias("f"), F.col("reading_id").alias("t"), F.col("value").alias("x"))


@query("flatten_row_major", f"""WITH {VEC} SELECT sample_id, CAST((t % 32) * 2 + t // 32 AS INTEGER) AS i, round(x, 6) AS x FROM v""")
def flat(spark, sf):
    df = vectors(spark, sf).select("sample_id", P.flatten_row_major(F.col("dims")).alias("series"))
    return df.select("sample_id", F.posexplode("series").alias("i", "x")).withColumn("x", r6("x"))


@query("transpose_windows", f"""WITH {VEC} SELECT sample_id, CAST(t % 32 AS INTEGER) AS t, round(sum(x), 6) AS x, round(max(x) FILTER (t < 32), 6) AS first FROM v GROUP BY 1, 2""")
def transposed(spark, sf):
    df = vectors(spark, sf).select("sample_id", F.posexplode(A.transpose(F.col("dims"))).alias("t", "step"))
    return df.select("sample_id", "t", r6(A.total(F.col("step"))).alias("x"), r6(F.col("step")[0]).alias("first"))


@query("nested_to_long", f"""WITH {VEC} SELECT sample_id, CAST(t // 32 AS INTEGER) AS dim_id, CAST(t % 32 AS INTEGER) AS reading_id, round(x, 6) AS value FROM v""")
def nested_to_long(spark, sf):
    return P.nested_to_long(vectors(spark, sf), "sample_id").withColumn("value", r6("value"))


@query("nested_to_steps", f"""WITH {VEC} SELECT sample_id, CAST(t % 32 AS INTEGER) AS t, round(max(x) FILTER (t < 32), 6) AS a, round(max(x) FILTER (t >= 32), 6) AS b FROM v GROUP BY 1, 2""")
def nested_to_steps(spark, sf):
    return P.nested_to_steps(vectors(spark, sf), "sample_id", names=("a", "b")).select("sample_id", "t", r6("a").alias("a"), r6("b").alias("b"))


@query("long_to_nested", f"""SELECT event_id // {BLOCK} AS case_id, CAST(d AS INTEGER) AS dim_id, CAST(row_number() OVER (PARTITION BY event_id // {BLOCK}, d ORDER BY event_id) - 1 AS INTEGER) AS reading_id, value
FROM (SELECT *, event_id % 2 AS d FROM events)""")
def long_to_nested(spark, sf):
    """A case is a block of events, so its size does not depend on the number of events."""
    df = events(spark, sf).select(F.expr(f"event_id div {BLOCK}").alias("case_id"), (F.col("event_id") % 2).alias("dim"), F.col("event_id").alias("reading"), "value")
    return P.nested_to_long(P.long_to_nested(df, "case_id", "dim", "reading", "value"), "case_id")


@query("steps_to_nested", f"""WITH {EV} SELECT event_id // {BLOCK} AS block, CAST(row_number() OVER (PARTITION BY event_id // {BLOCK} ORDER BY event_id) - 1 AS INTEGER) AS t, value, k FROM ev""")
def steps_to_nested(spark, sf):
    nested = P.steps_to_nested(events(spark, sf).withColumn("block", F.expr(f"event_id div {BLOCK}")), "block", "event_id", ["value", "k"])
    return P.nested_to_steps(nested, "block", names=("value", "k"))


@query("length_statistics", f"""WITH {TALK}, l AS (SELECT sample_id, count(*) AS n, least(count(*), 4) AS m FROM tk GROUP BY 1)
SELECT sample_id, CAST(n AS INTEGER) AS max_len, CAST(m AS INTEGER) AS min_len, n = m AS equal_dims FROM l""")
def lengths(spark, sf):
    return W.length_stats(talks(spark, sf), "sample_id", [F.col("series"), F.slice("series", 1, 4)])


@query("length_summary", f"""WITH {TALK}, l AS (SELECT sample_id, count(*) AS n, least(count(*), 4) AS m FROM tk GROUP BY 1)
SELECT count(*) AS samples, CAST(max(n) AS INTEGER) AS max_len, CAST(min(n) AS INTEGER) AS shortest, bool_and(n = m) AS equal_dims, min(n) = max(n) AS equal_samples FROM l""")
def length_summary(spark, sf):
    return W.length_summary(W.length_stats(talks(spark, sf), "sample_id", [F.col("series"), F.slice("series", 1, 4)]))


@query("pad_and_clip", f"""WITH {TALK} SELECT a.sample_id, CAST(j AS INTEGER) AS t, coalesce(b.x, 0) AS x, b.x IS NOT NULL AS real
FROM (SELECT DISTINCT sample_id FROM tk) a CROSS JOIN (SELECT unnest(generate_series(0, 5)) AS j) LEFT JOIN tk b ON b.sample_id = a.sample_id AND b.t = j""")
def padded(spark, sf):
    df = P.pad(talks(spark, sf).select("sample_id", F.array("series").alias("dims")), "dims", 6)
    both = F.arrays_zip(F.col("dims")[0].alias("x"), F.col("padding_mask").alias("real"))
    return df.select("sample_id", F.posexplode(both).alias("t", "z")).select("sample_id", "t", "z.x", "z.real")


@query("padding_mask", f"""WITH {TALK} SELECT sample_id, CAST(least(count(*), 5) AS BIGINT) AS kept, CAST(greatest(5 - count(*), 0) AS BIGINT) AS padded FROM tk GROUP BY 1""")
def padding(spark, sf):
    mask = A.padding_mask(F.size("series"), 5)
    return talks(spark, sf).select(
        "sample_id", F.size(F.filter(mask, lambda m: m)).cast("bigint").alias("kept"), F.size(F.filter(mask, lambda m: ~m)).cast("bigint").alias("padded"))


@query("keep_listed_ids", f"""WITH {VEC} SELECT sample_id, count(*) AS n FROM v WHERE sample_id IN (SELECT doc_id FROM labels WHERE quality = 0) GROUP BY 1""")
def keep_listed(spark, sf):
    ids = table(spark, sf, "labels").filter("quality = 0").select(F.col("doc_id").alias("sample_id"))
    return P.keep_ids(exploded(vectors(spark, sf)), ids, "sample_id").groupBy("sample_id").agg(F.count("*").alias("n"))


@query("features_with_labels_and_groups", f"""WITH {VEC} SELECT sample_id, v.label, CAST(t AS INTEGER) AS t, l.quality, round(x, 6) AS x, d.lang AS grp
FROM v JOIN labels l ON l.doc_id = sample_id JOIN documents d ON d.doc_id = sample_id""")
def attached(spark, sf):
    v = vectors(spark, sf).select("sample_id", "label", F.posexplode("series").alias("t", "x")).withColumn("x", r6("x"))
    labels = table(spark, sf, "labels").select(F.col("doc_id").alias("sample_id"), "quality")
    groups = table(spark, sf, "documents").select(F.col("doc_id").alias("sample_id"), F.col("lang").alias("grp"))
    return P.attach(v, labels, "sample_id", groups)


@query("positional_encoding", """SELECT e.sample_id, t, CAST(d AS INTEGER) AS d, round(e.x + CASE WHEN d % 2 = 0 THEN sin(t * exp((d // 2) * 2 * (-9.210340371976184 / 4))) ELSE cos(t * exp((d // 2) * 2 * (-9.210340371976184 / 4))) END, 6) AS x
FROM (SELECT conv_id AS sample_id, CAST(length(text) AS DOUBLE) AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS t FROM conversations) e, (SELECT unnest(generate_series(0, 3)) AS d)""")
def encoded(spark, sf):
    steps = exploded(talks(spark, sf)).withColumn("t", F.col("t").cast("bigint"))
    every = steps.withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(3))))
    return every.select("sample_id", "t", "d", r6(F.col("x") + P.position_value(F.col("t"), F.col("d"), 4)).alias("x"))


# ---- masks ---------------------------------------------------------------------------------------------

def uniform_sql(*parts: str) -> str:
    text = " || '-' || ".join(parts)
    return f"(CAST(('0x' || substr(md5({text}), 1, 8)) AS BIGINT) / 4294967296.0)"


def cells(df, column="mask", out="keep"):
    """Nested (f, t) array to rows."""
    long = P.nested_to_long(df, "sample_id", column)
    return long.select("sample_id", F.col("dim_id").alias("f"), F.col("reading_id").alias("t"), F.col("value").alias(out))


CELL = "SELECT sample_id, CAST(t // 32 AS INTEGER) AS f, CAST(t % 32 AS INTEGER) AS t"


@query("bernoulli_mask_per_cell", f"""WITH {VEC} {CELL}, {uniform_sql("'7'", 'CAST(sample_id AS VARCHAR)', 'CAST(t // 32 AS VARCHAR)', 'CAST(t % 32 AS VARCHAR)')} >= 0.3 AS keep FROM v""")
def bernoulli(spark, sf):
    return cells(M.noise_mask(vectors(spark, sf), "sample_id", "dims", 0.3, distribution="bernoulli", seed=7))


@query("bernoulli_mask_per_step", f"""WITH {VEC} {CELL}, {uniform_sql("'7'", 'CAST(sample_id AS VARCHAR)', 'CAST(t % 32 AS VARCHAR)')} >= 0.3 AS keep FROM v""")
def bernoulli_concurrent(spark, sf):
    return cells(M.noise_mask(vectors(spark, sf), "sample_id", "dims", 0.3, mode="concurrent", distribution="bernoulli", seed=7))


@query("mask_excluded_features", f"""WITH {VEC} {CELL}, t // 32 = 0 OR {uniform_sql("'7'", 'CAST(sample_id AS VARCHAR)', 'CAST(t // 32 AS VARCHAR)', 'CAST(t % 32 AS VARCHAR)')} >= 0.3 AS keep FROM v""")
def excluded(spark, sf):
    return cells(M.noise_mask(vectors(spark, sf), "sample_id", "dims", 0.3, distribution="bernoulli", exclude=(0,), seed=7))


def _markov_sql(parts: tuple[str, ...]) -> str:
    start = uniform_sql("'11'", *parts, "'-1'")
    u = uniform_sql("'11'", *parts, "CAST(i AS VARCHAR)")
    return f"""WITH s AS (SELECT vec_id AS sample_id, f FROM embeddings, (SELECT unnest([0, 1]) AS f)),
r AS (SELECT sample_id, f, i, ({start} > 0.25) = (i % 2 = 0) AS keep, {u} AS u FROM s, (SELECT unnest(range(0, 32)) AS i)),
l AS (SELECT *, CAST(least(1 + floor(ln(1 - u) / CASE WHEN keep THEN ln(1 - 1.0::DOUBLE / 3 * 0.25 / 0.75) ELSE ln(1 - 1.0::DOUBLE / 3) END), 32) AS BIGINT) AS n FROM r),
c AS (SELECT *, sum(n) OVER (PARTITION BY sample_id, f ORDER BY i) AS stop FROM l)
SELECT sample_id, CAST(f AS INTEGER) AS f, CAST(t AS INTEGER) AS t, keep FROM (SELECT sample_id, f, keep, unnest(range(CAST(stop - n AS BIGINT), CAST(stop AS BIGINT))) AS t FROM c) WHERE t < 32"""


@query("markov_mask", _markov_sql(("CAST(sample_id AS VARCHAR)", "CAST(f AS VARCHAR)")))
def markov(spark, sf):
    return cells(M.noise_mask(vectors(spark, sf), "sample_id", "dims", 0.25, 3, seed=11))


@query("transduction_mask", f"""WITH {VEC} {CELL}, NOT (t // 32 = 1 AND t % 32 >= floor(0.2 * 32) AND t % 32 < greatest(floor(0.2 * 32), floor((1 - 0.3) * 32))) AS keep FROM v""")
def transduction(spark, sf):
    return cells(M.transduct_mask(vectors(spark, sf), "dims", (1,), 0.2, 0.3))


KEEP = f"""kp AS ({CELL}, x, {uniform_sql("'7'", 'CAST(sample_id AS VARCHAR)', 'CAST(t // 32 AS VARCHAR)', 'CAST(t % 32 AS VARCHAR)')} >= 0.3 AS keep FROM v)"""


@query("apply_mask", f"""WITH {VEC}, {KEEP} SELECT sample_id, f, t, round(CASE WHEN keep THEN x ELSE 0 END, 6) AS x, round(x, 6) AS target, NOT keep AS predict FROM kp""")
def masked(spark, sf):
    df = M.noise_mask(vectors(spark, sf), "sample_id", "dims", 0.3, distribution="bernoulli", seed=7)
    df = M.apply_mask(df, "dims", "mask")
    trio = F.zip_with(F.arrays_zip(F.col("dims").alias("x"), F.col("targets").alias("y")), "target_mask", lambda z, p: F.struct(z["x"].alias("x"), z["y"].alias("y"), p.alias("p")))
    rows = df.select("sample_id", F.posexplode(trio).alias("f", "z"))
    steps = F.arrays_zip(F.col("z.x").alias("x"), F.col("z.y").alias("target"), F.col("z.p").alias("predict"))
    out = rows.select("sample_id", "f", F.posexplode(steps).alias("t", "s")).select("sample_id", "f", "t", "s.*")
    return out.withColumns({"x": r6("x"), "target": r6("target")})


@query("mask_compensation", f"""WITH {VEC}, {KEEP} SELECT sample_id, f, t, round(CASE WHEN keep THEN x ELSE 0 END * 2 / greatest(1, sum(CAST(keep AS INTEGER)) OVER (PARTITION BY sample_id, t)), 6) AS x FROM kp""")
def compensated(spark, sf):
    df = M.noise_mask(vectors(spark, sf), "sample_id", "dims", 0.3, distribution="bernoulli", seed=7)
    return cells(M.apply_mask(df, "dims", "mask", compensate=True), "dims", "x").withColumn("x", r6("x"))


@query("mask_difficulty_schedule", f"""WITH {VEC}, s AS (SELECT i AS step, least(1, 0.15 + i * 0.05) AS ratio FROM (SELECT unnest(generate_series(0, 3)) AS i))
SELECT step, count(*) AS cells, count(*) FILTER ({uniform_sql("'7'", 'CAST(step AS VARCHAR)', 'CAST(sample_id AS VARCHAR)', 'CAST(t AS VARCHAR)')} < ratio) AS hidden FROM v, s GROUP BY 1""")
def schedule(spark, sf):
    from tidemill.functions.hashing import uniform

    settings = M.difficulty_schedule(spark, 4)
    plan = settings.agg(F.array_sort(F.collect_list(F.struct("step", "ratio"))).alias("s")).scalar()
    every = exploded(vectors(spark, sf)).withColumn("s", F.explode(plan))
    hidden = uniform(7, F.col("s.step"), F.col("sample_id"), F.col("t")) < F.col("s.ratio")
    return every.groupBy(F.col("s.step").alias("step")).agg(F.count("*").alias("cells"), F.count_if(hidden).alias("hidden"))


@query("softmax_scores", """SELECT sample_id, CAST(c AS INTEGER) AS c, round(exp(s - max(s) OVER w) / sum(exp(s)) OVER w * exp(max(s) OVER w), 6) AS p FROM
(SELECT vec_id AS sample_id, i - 1 AS c, CAST(embedding[i] AS DOUBLE) AS s FROM embeddings, (SELECT unnest(generate_series(1, 64)) AS i)) WINDOW w AS (PARTITION BY sample_id)""")
def softmax(spark, sf):
    df = vectors(spark, sf).select("sample_id", A.softmax(F.col("series")).alias("p"))
    return df.select("sample_id", F.posexplode("p").alias("c", "p")).withColumn("p", r6("p"))


@query("logistic_scores", f"""WITH {VEC} SELECT sample_id, CAST(t AS INTEGER) AS t, round(1 - 1 / (1 + exp(-x)), 6) AS p0, round(1 / (1 + exp(-x)), 6) AS p1 FROM v""")
def logistic(spark, sf):
    p = A.logistic_pair(F.col("x"))
    return exploded(vectors(spark, sf)).select("sample_id", "t", r6(p[0]).alias("p0"), r6(p[1]).alias("p1"))


@query("seconds_to_hms", f"""WITH {EV}, s AS (SELECT event_id, value * 100 AS v FROM ev) SELECT event_id, CAST(floor(v / 3600) AS BIGINT) AS hours,
CAST(floor((v - floor(v / 3600) * 3600) / 60) AS BIGINT) AS minutes, round(v - floor(v / 3600) * 3600 - floor((v - floor(v / 3600) * 3600) / 60) * 60, 6) AS seconds FROM s""")
def hms(spark, sf):
    df = events(spark, sf).select("event_id", S.hours_minutes_seconds(F.col("value") * 100).alias("h"))
    return df.select("event_id", "h.hours", "h.minutes", r6("h.seconds").alias("seconds"))


@query("array_functions", f"""WITH {VEC}, c AS (SELECT *, x - avg(x) OVER (PARTITION BY sample_id) AS y FROM v)
SELECT sample_id, CAST(count(*) AS INTEGER) AS n, round(sum(x) FILTER (t BETWEEN 4 AND 11), 6) AS sliced, round(sum(x) FILTER (t % 3 = 0), 6) AS strided,
round(sum(x) FILTER (t IN (5, 1, 9)), 6) AS taken, round(sum(y * y), 6) AS centred, round(sum(x) * 2, 6) AS tiled FROM c GROUP BY 1""")
def array_functions(spark, sf):
    s = F.col("series")
    centred = A.bind(A.mean(s), lambda m: F.transform(s, lambda x: x - m))
    return vectors(spark, sf).select(
        "sample_id", F.size(s).alias("n"), r6(A.total(F.slice(s, 5, 8))).alias("sliced"),
        r6(A.total(F.filter(s, lambda _, i: i % 3 == 0))).alias("strided"),
        r6(A.total(A.take(s, F.array(F.lit(5), F.lit(1), F.lit(9))))).alias("taken"),
        r6(A.total(F.transform(centred, lambda x: x * x))).alias("centred"),
        r6(A.total(F.concat(s, s))).alias("tiled"))


@query("example_long_table", f"""SELECT CAST(c AS INTEGER) AS case_id, CAST(d AS INTEGER) AS dim_id, CAST(r AS INTEGER) AS reading_id,
{uniform_sql("'3'", 'CAST(c AS VARCHAR)', 'CAST(d AS VARCHAR)', 'CAST(r AS VARCHAR)')} AS value
FROM (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS c FROM embeddings), (SELECT unnest([0, 1]) AS d), (SELECT unnest(generate_series(0, 19)) AS r)""")
def example(spark, sf):
    """One seeded case per embedding."""
    return P.example_long(spark, table(spark, sf, "embeddings").count(), 20, 2, seed=3)
