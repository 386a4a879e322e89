"""Evaluation tables over predictions derived from the events and labels tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.functions import arrays as A
from tidemill.operators import clean as C
from tidemill.operators import masking as K
from tidemill.operators import metrics as M
from tidemill.operators import tracking as T
from tidemill.plans.registry import events, query, r6, table
from tidemill.plans.samples import KEEP, VEC, vectors
from tidemill.plans.series import EV

CLASSES = ("click", "error", "purchase", "signup", "view")
CLASS_SQL = "[" + ", ".join(f"'{c}'" for c in CLASSES) + "]"


def predictions(spark, sf):
    """A deterministic imperfect classifier of event types; the last class is never predicted."""
    truth = F.array_position(F.array(*[F.lit(c) for c in CLASSES]), F.col("event_type")).cast("int") - 1
    e = F.col("event_id")
    pred = F.when(e % 3 == 0, (F.col("truth") + 1 + F.expr("event_id div 3") % 2) % 4).otherwise(F.col("truth") % 4)
    scores = F.array(*[((e * (c + 3) * 31) % 97) / 97.0 for c in range(5)])
    return events(spark, sf).select("event_id", "user_id", truth.alias("truth")).select(
        "event_id", "user_id", "truth", pred.cast("int").alias("pred"), ((e * 7919) % 1000 / 1000.0).alias("score"), scores.alias("scores"))


PRED = f"""pr AS (SELECT event_id, user_id, truth, CASE WHEN event_id % 3 = 0 THEN (truth + 1 + (event_id // 3) % 2) % 4 ELSE truth % 4 END AS pred,
  CAST((event_id * 7919) % 1000 AS DOUBLE) / 1000 AS score FROM (SELECT event_id, user_id, list_position({CLASS_SQL}, event_type) - 1 AS truth FROM events))"""
CLS = PRED + """, cl AS (SELECT DISTINCT c FROM (SELECT truth AS c FROM pr UNION ALL SELECT pred FROM pr)),
pc AS (SELECT c, (SELECT count(*) FROM pr WHERE truth = c AND pred = c) AS tp, (SELECT count(*) FROM pr WHERE truth = c) AS support,
  (SELECT count(*) FROM pr WHERE pred = c) AS predicted FROM cl),
pm AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS p, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS r FROM pc),
pf AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f FROM pm)"""
GRID = """cm AS (SELECT a.c AS truth, b.c AS pred, count(pr.event_id) AS n FROM cl a CROSS JOIN cl b LEFT JOIN pr ON pr.truth = a.c AND pr.pred = b.c GROUP BY 1, 2),
cs AS (SELECT *, coalesce(n / nullif(sum(n) OVER (PARTITION BY truth), 0), 0) AS share FROM cm)"""


@query("confusion_matrix", f"WITH {CLS}, {GRID} SELECT CAST(truth AS INTEGER) AS truth, CAST(pred AS INTEGER) AS pred, n FROM cm")
def confusion(spark, sf):
    return M.confusion(predictions(spark, sf), classes=range(5)).select("truth", "pred", "n")


@query("confusion_matrix_wide", f"""WITH {PRED} SELECT CAST(truth AS INTEGER) AS truth, {', '.join(f'count(*) FILTER (pred = {i}) AS "{i}"' for i in range(5))} FROM pr GROUP BY 1""")
def confusion_wide(spark, sf):
    return M.confusion_matrix(predictions(spark, sf), range(5))


@query("confusion_row_shares", f"WITH {CLS}, {GRID} SELECT CAST(truth AS INTEGER) AS truth, CAST(pred AS INTEGER) AS pred, round(share, 6) AS share FROM cs")
def row_shares(spark, sf):
    return M.confusion(predictions(spark, sf), classes=range(5)).select("truth", "pred", r6("share").alias("share"))


@query("accuracy", f"WITH {PRED} SELECT round(avg(CAST(truth = pred AS INTEGER)), 6) AS accuracy, count(*) AS n FROM pr")
def accuracy(spark, sf):
    return M.accuracy(predictions(spark, sf)).withColumn("accuracy", r6("accuracy"))


@query("accuracy_with_exclusions", f"WITH {PRED} SELECT round(avg(CAST(truth = pred AS INTEGER)), 6) AS accuracy, count(*) AS n FROM pr WHERE truth NOT IN (1, 4) AND pred NOT IN (1, 4)")
def accuracy_excluding(spark, sf):
    return M.accuracy(predictions(spark, sf), exclude=(1, 4)).withColumn("accuracy", r6("accuracy"))


@query("metric_without_labels", f"WITH {PRED} SELECT user_id, count(*) AS n, count(*) FILTER (truth = pred) AS hits FROM pr WHERE truth NOT IN (0) AND pred NOT IN (0) GROUP BY 1")
def without_labels(spark, sf):
    kept = M.without(predictions(spark, sf), (0,))
    return kept.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("truth") == F.col("pred")).alias("hits"))


@query("precision_recall_f1", f"""WITH {CLS} SELECT CAST(c AS INTEGER) AS class, tp, support, predicted, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1 FROM pf""")
def prf(spark, sf):
    t = M.per_class(predictions(spark, sf))
    return t.select("class", "tp", "support", "predicted", *[r6(c).alias(c) for c in ("precision", "recall", "f1")])


@query("weighted_averages", f"""WITH {CLS} SELECT round(sum(p * support) / sum(support), 6) AS precision, round(sum(r * support) / sum(support), 6) AS recall,
round(sum(f * support) / sum(support), 6) AS f1, CAST(sum(support) AS BIGINT) AS support FROM pf""")
def averages(spark, sf):
    a = M.weighted_averages(M.per_class(predictions(spark, sf)))
    return a.select(*[r6(c).alias(c) for c in ("precision", "recall", "f1")], "support")


@query("weighted_averages_with_exclusions", f"""WITH {CLS} SELECT round(sum(support * tp / predicted) FILTER (predicted > 0) / sum(support) FILTER (predicted > 0), 6) AS prec_avg,
round(sum(tp) / sum(support), 6) AS rec_avg FROM pf WHERE c <> 1""")
def averages_excluding(spark, sf):
    a = M.average_precision_recall(M.per_class(predictions(spark, sf)), (1,))
    return a.select(r6("prec_avg").alias("prec_avg"), r6("rec_avg").alias("rec_avg"))


USER_PRED = "WITH " + PRED + """, cl AS (SELECT DISTINCT user_id AS c FROM pr), up AS (SELECT user_id AS t, CASE WHEN event_id % 3 = 0 THEN user_id + 1 ELSE user_id END AS g FROM pr),
ua AS (SELECT DISTINCT t AS c FROM up UNION SELECT DISTINCT g FROM up),
tt AS (SELECT t AS c, count(*) AS support, count(*) FILTER (t = g) AS tp FROM up GROUP BY 1), gg AS (SELECT g AS c, count(*) AS predicted FROM up GROUP BY 1),
um AS (SELECT coalesce(tp / nullif(predicted, 0), 0) AS p, coalesce(tp / nullif(support, 0), 0) AS r FROM ua LEFT JOIN tt USING (c) LEFT JOIN gg USING (c))"""
EDGES = (0.0, 0.2, 0.4, 0.6, 0.7, 0.8, 0.9, 1.0)


def _bin_sql(c):
    return "CASE " + " ".join(f"WHEN {c} >= {e} THEN {i}" for i, e in reversed(list(enumerate(EDGES)))) + " END"


@query("class_histogram", f"""{USER_PRED}, b AS (SELECT unnest([{', '.join(map(str, EDGES))}]) AS low, unnest([0,1,2,3,4,5,6,7]) AS bin)
SELECT CAST(bin AS INTEGER) AS bin, CAST(low AS DOUBLE) AS low, (SELECT count(*) FROM um WHERE {_bin_sql('p')} = bin) AS precision_classes, (SELECT count(*) FROM um WHERE {_bin_sql('r')} = bin) AS recall_classes FROM b""")
def histogram(spark, sf):
    p = predictions(spark, sf).select(
        F.col("user_id").alias("truth"), F.when(F.col("event_id") % 3 == 0, F.col("user_id") + 1).otherwise(F.col("user_id")).alias("pred"))
    return M.class_histogram(M.per_class(p))


SWEEP = 41


@query("threshold_sweep", f"""WITH {PRED}, b AS (SELECT 0.99 * min(score) AS lo, 1.01 * max(score) AS hi FROM pr WHERE pred = 2),
g AS (SELECT i AS point, lo + (hi - lo) / {SWEEP - 1} * i AS thr FROM b, (SELECT unnest(generate_series(0, {SWEEP - 1})) AS i))
SELECT CAST(point AS INTEGER) AS point, round(thr, 6) AS threshold,
 round(coalesce(count(*) FILTER (pred = 2 AND score >= thr AND truth = 2) / nullif(count(*) FILTER (pred = 2 AND score >= thr), 0), 0), 6) AS precision,
 round(count(*) FILTER (pred = 2 AND score >= thr AND truth = 2) / count(*) FILTER (truth = 2), 6) AS recall FROM pr, g GROUP BY point, thr""")
def sweep(spark, sf):
    s = M.threshold_sweep(predictions(spark, sf), 2, SWEEP)
    return s.select("point", *[r6(c).alias(c) for c in ("threshold", "precision", "recall")])


@query("score_limited_predictions", f"""WITH {PRED} SELECT event_id, CAST(CASE WHEN pred = 2 AND score < 0.4 THEN -1 ELSE pred END AS INTEGER) AS pred FROM pr""")
def limited(spark, sf):
    return predictions(spark, sf).select("event_id", M.below_threshold_rejected(F.col("pred"), F.col("score"), 2, 0.4).alias("pred"))


BIN = """bn AS (SELECT l.doc_id, quality AS truth, ((l.doc_id * 37) % 101) / 101.0::DOUBLE + 0.3 * quality * (l.doc_id % 2) AS s, n_chars FROM labels l JOIN documents d ON d.doc_id = l.doc_id),
sc AS (SELECT doc_id, truth, round(s, 4) AS score FROM bn),
by_s AS (SELECT score, sum(truth) AS p, count(*) - sum(truth) AS n FROM sc GROUP BY 1),
cv AS (SELECT score, p, n, sum(p) OVER w AS tp, sum(n) OVER w AS fp FROM by_s WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
cu AS (SELECT *, lag(tp, 1, 0) OVER w AS tp0, lag(fp, 1, 0) OVER w AS fp0, sum(p) OVER () AS np, sum(n) OVER () AS nn FROM cv WINDOW w AS (ORDER BY score DESC))"""


def binary(spark, sf):
    labels = table(spark, sf, "labels")
    s = ((F.col("doc_id") * 37) % 101) / 101.0 + 0.3 * F.col("quality") * (F.col("doc_id") % 2)
    return labels.select("doc_id", F.col("quality").alias("truth"), F.round(s, 4).alias("score"))


@query("auroc", f"WITH {BIN} SELECT round(sum((fp - fp0) / nn * (tp + tp0) / 2 / np), 6) AS auroc FROM cu")
def auroc(spark, sf):
    return M.ranking_areas(binary(spark, sf)).select(r6("auroc").alias("auroc"))


@query("auprc", f"""WITH {BIN} SELECT round(sum((tp - tp0) / np * (tp / (tp + fp) + coalesce(tp0 / nullif(tp0 + fp0, 0), 1)) / 2), 6) AS auprc FROM cu""")
def auprc(spark, sf):
    return M.ranking_areas(binary(spark, sf)).select(r6("auprc").alias("auprc"))


SCORES = "[" + ", ".join(f"CAST((event_id * {c + 3} * 31) % 97 AS DOUBLE) / 97" for c in range(5)) + "]"
RANK = f"""{PRED}, sx AS (SELECT event_id, truth, c - 1 AS c, s FROM (SELECT event_id, truth, unnest({SCORES}) AS s, generate_subscripts({SCORES}, 1) AS c FROM pr)),
rk AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY s DESC, c) AS r FROM sx)"""


@query("top_k_accuracy", f"""WITH {RANK}, h AS (SELECT r FROM rk WHERE c = truth) SELECT CAST(k AS INTEGER) AS k, round(avg(CAST(r <= k AS INTEGER)), 6) AS accuracy
FROM h, (SELECT unnest(generate_series(1, 4)) AS k) GROUP BY 1""")
def top_k(spark, sf):
    return M.top_k_accuracy(predictions(spark, sf), "scores", "truth", 4).withColumn("accuracy", r6("accuracy"))


@query("class_rank_by_score", f"WITH {RANK} SELECT event_id, CAST(r AS INTEGER) AS rank FROM rk WHERE c = truth")
def class_rank(spark, sf):
    return predictions(spark, sf).select("event_id", A.rank_of(F.col("scores"), F.col("truth")).alias("rank"))


@query("cross_entropy_loss", f"""WITH {RANK} SELECT round(avg(loss), 6) AS loss, count(*) AS samples FROM (SELECT event_id, -ln(max(exp(s)) FILTER (c = truth) / sum(exp(s))) AS loss FROM rk GROUP BY 1)""")
def entropy(spark, sf):
    return M.mean_loss(predictions(spark, sf), M.cross_entropy(F.col("scores"), F.col("truth"))).withColumn("loss", r6("loss"))


@query("mse_loss", f"WITH {EV} SELECT round(avg((value - k) * (value - k)), 4) AS loss, count(*) AS samples FROM ev")
def mse(spark, sf):
    loss = F.pow(F.col("value") - F.col("k"), 2)
    return M.mean_loss(events(spark, sf), loss).withColumn("loss", r6("loss", 4))


@query("masked_mse", f"WITH {VEC}, {KEEP} SELECT round(avg(x * x) FILTER (NOT keep AND t < 28), 8) AS mse, count(*) FILTER (NOT keep AND t < 28) AS cells FROM kp")
def masked_mse(spark, sf):
    from tidemill.plans.samples import cells

    keep = cells(K.noise_mask(vectors(spark, sf), "sample_id", "dims", 0.3, distribution="bernoulli", seed=7))
    x = cells(vectors(spark, sf), "dims", "x")
    both = x.join(keep, ["sample_id", "f", "t"]).withColumn("zero", F.lit(0.0))
    return M.masked_mse(both, "x", "zero", ~F.col("keep"), F.col("t") < 28).withColumn("mse", r6("mse", 8))


@query("per_sample_error_sum", f"WITH {VEC} SELECT sample_id, round(sum(x * x), 6) AS total FROM v GROUP BY 1")
def per_sample(spark, sf):
    from tidemill.plans.samples import cells

    return M.per_sample(cells(vectors(spark, sf), "dims", "x"), "sample_id", F.pow("x", 2)).withColumn("total", r6("total"))


@query("biggest_thieves", f"""WITH {CLS}, {GRID}, r AS (SELECT *, row_number() OVER (PARTITION BY truth ORDER BY share DESC, pred DESC) AS rank FROM cs)
SELECT CAST(truth AS INTEGER) AS truth, CAST(rank AS INTEGER) AS rank, CAST(pred AS INTEGER) AS pred, round(share, 6) AS share FROM r WHERE rank <= 3 AND truth <> pred""")
def thieves(spark, sf):
    return M.thieves(M.confusion(predictions(spark, sf)), 2).withColumn("share", r6("share"))


@query("classes_by_frequency", """SELECT event_type, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, event_type LIMIT 3""")
def frequent(spark, sf):
    f = C.class_frequency(events(spark, sf), "event_type")
    return f.orderBy(F.col("n").desc(), "event_type").limit(3).select("event_type", "n")


@query("classification_report", f"""WITH {CLS}, {GRID}, r AS (SELECT *, row_number() OVER (PARTITION BY truth ORDER BY share DESC, pred DESC) AS rank FROM cs),
th AS (SELECT truth, string_agg(CAST(pred AS VARCHAR), ',' ORDER BY rank) AS thieves FROM r WHERE rank <= 3 AND truth <> pred GROUP BY 1)
SELECT CAST(c AS VARCHAR) AS class, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, round(support / sum(support) OVER (), 6) AS rel_freq, support AS abs_freq, thieves
FROM pf LEFT JOIN th ON th.truth = pf.c UNION ALL
SELECT 'avg / total', round(sum(p * support) / sum(support), 6), round(sum(r * support) / sum(support), 6), round(sum(f * support) / sum(support), 6), 1.0, CAST(sum(support) AS BIGINT), NULL FROM pf""")
def report(spark, sf):
    rep = M.classification_report(predictions(spark, sf))
    return rep.select("class", *[r6(c).alias(c) for c in ("precision", "recall", "f1", "rel_freq")], "abs_freq",
                      F.array_join(F.transform("thieves", lambda t: t["class"]), ",").alias("thieves"))


# ---- runs and records ----------------------------------------------------------------------------------

def run_metrics(spark, sf):
    """Three models scored per month of the order dates: (run_id, split, epoch, metric, value)."""
    o = table(spark, sf, "orders")
    epoch = F.month("o_orderdate")
    per = o.groupBy(F.col("o_orderpriority").alias("run_id"), F.col("o_orderstatus").alias("split"), epoch.alias("epoch")).agg(
        F.round(F.avg("o_totalprice"), 4).alias("loss"), F.count("*").cast("double").alias("accuracy"))
    return per.select("run_id", "split", "epoch", F.explode(F.array(
        F.struct(F.lit("loss").alias("metric"), F.col("loss").alias("value")),
        F.struct(F.lit("accuracy").alias("metric"), F.col("accuracy").alias("value")))).alias("m")).select("run_id", "split", "epoch", "m.*")


RUN = """per AS (SELECT o_orderpriority AS run_id, o_orderstatus AS split, month(o_orderdate) AS epoch, round(avg(o_totalprice), 4) AS loss, CAST(count(*) AS DOUBLE) AS accuracy FROM orders GROUP BY 1, 2, 3),
mt AS (SELECT run_id, split, epoch, 'loss' AS metric, loss AS value FROM per UNION ALL SELECT run_id, split, epoch, 'accuracy', accuracy FROM per)"""


def _best(metric):
    return f"""b_{metric} AS (SELECT run_id, split, epoch, value FROM (SELECT *, row_number() OVER (PARTITION BY run_id, split
 ORDER BY value {'ASC' if metric == 'loss' else 'DESC'}, epoch) AS r FROM mt WHERE metric = '{metric}') WHERE r = 1)"""


@query("best_epoch_by_metric", f"""WITH {RUN}, {_best('loss')}, {_best('accuracy')} SELECT 'loss' AS metric, run_id, split, CAST(epoch AS INTEGER) AS epoch, value FROM b_loss
UNION ALL SELECT 'accuracy', run_id, split, CAST(epoch AS INTEGER), value FROM b_accuracy""")
def best_epoch(spark, sf):
    m = run_metrics(spark, sf)
    both = [M.best_epoch(m, k).withColumn("metric", F.lit(k)) for k in ("loss", "accuracy")]
    return both[0].unionByName(both[1])


@query("metrics_sheet", f"WITH {RUN} SELECT run_id, split, CAST(epoch AS INTEGER) AS epoch, loss, accuracy FROM per")
def sheet(spark, sf):
    from tidemill.session import fresh_path

    path = fresh_path(spark, "metrics")
    T.log_metrics(run_metrics(spark, sf), path)
    return T.metrics_sheet(spark.read.parquet(path), ["loss", "accuracy"])


@query("run_record_best_and_final", f"""WITH {RUN}, {_best('loss')}, la AS (SELECT run_id, split, max(epoch) AS epoch FROM per GROUP BY 1, 2)
SELECT p.run_id, p.split, CAST(b.epoch AS INTEGER) AS best_epoch, p.loss AS best_loss, p.accuracy AS best_accuracy, CAST(q.epoch AS INTEGER) AS final_epoch, q.loss AS final_loss, q.accuracy AS final_accuracy, 'note' AS comment
FROM b_loss b JOIN per p ON p.run_id = b.run_id AND p.split = b.split AND p.epoch = b.epoch JOIN la ON la.run_id = p.run_id AND la.split = p.split
JOIN per q ON q.run_id = la.run_id AND q.split = la.split AND q.epoch = la.epoch""")
def record(spark, sf):
    m = run_metrics(spark, sf)
    return T.register_run(m, M.best_epoch(m, "loss"), ["loss", "accuracy"], "note")


@query("latest_metrics_view", f"""WITH {RUN} SELECT run_id, split, metric, arg_max(value, epoch) AS value FROM mt GROUP BY 1, 2, 3""")
def console(spark, sf):
    view = T.console_view(run_metrics(spark, sf))
    values = F.from_json("values", "map<string,double>")
    return view.select("run_id", "split", F.explode(values).alias("metric", "value"))


@query("running_mean_of_metric", f"""WITH {RUN} SELECT run_id, split, CAST(epoch AS INTEGER) AS epoch, round(avg(loss) OVER (PARTITION BY run_id, split ORDER BY epoch ROWS UNBOUNDED PRECEDING), 4) AS mean_so_far FROM per""")
def run_mean(spark, sf):
    return T.running_mean(run_metrics(spark, sf), "loss").select("run_id", "split", "epoch", r6("mean_so_far", 4).alias("mean_so_far"))


@query("leaderboard", """WITH m AS (SELECT l_returnflag AS dataset, l_linenumber AS model, avg(l_discount) AS mean FROM lineitem GROUP BY 1, 2),
b AS (SELECT dataset, model, mean FROM m UNION ALL SELECT 'mean', model, avg(mean) FROM m GROUP BY model)
SELECT dataset, model, round(mean, 8) AS mean, CAST(dense_rank() OVER (PARTITION BY dataset ORDER BY mean DESC) AS INTEGER) AS rank FROM b""")
def board(spark, sf):
    l = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("dataset"), F.col("l_linenumber").alias("model"), F.col("l_discount").alias("accuracy"))
    return M.leaderboard(l).withColumn("mean", r6("mean", 8))
