"""Evaluation tables from a prediction table with integer (or string) truth and prediction columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions import arrays as A
from tidemill.operators.ordered import running


def _zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0.0))


def label_grid(pred: DataFrame, truth: str = "truth", prediction: str = "pred") -> DataFrame:
    """Classes present in truth or prediction."""
    return pred.select(F.explode(F.array(truth, prediction)).alias("c")).distinct()


def counts(pred: DataFrame, truth: str = "truth", prediction: str = "pred") -> DataFrame:
    """Non-empty cells of the confusion matrix; everything below works on this small table."""
    return pred.groupBy(F.col(truth).alias("truth"), F.col(prediction).alias("pred")).agg(F.count("*").alias("n"))


def confusion(pred: DataFrame, truth: str = "truth", prediction: str = "pred", classes: Sequence | None = None) -> DataFrame:
    """Long confusion matrix: (truth, pred, n, share of the true class's rows).

    Only cells that occur, unless ``classes`` asks for the grid of these classes; cells of other classes are then left out. Rows without
    a truth or a prediction are not counted.
    """
    cells = counts(pred, truth, prediction).filter("truth IS NOT NULL AND pred IS NOT NULL")
    if classes is not None:
        kind = pred.schema[truth].dataType.simpleString()
        listed = F.array(*[F.lit(c) for c in classes]).cast(f"array<{kind}>")
        grid = pred.sparkSession.range(1).select(F.explode(listed).alias("truth")).select("truth", F.explode(listed).alias("pred"))
        cells = grid.join(cells, ["truth", "pred"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    support = F.sum("n").over(Window.partitionBy("truth"))
    return cells.select("truth", "pred", "n", _zero(F.try_divide("n", support)).alias("share"))


def confusion_matrix(pred: DataFrame, classes: Sequence, truth: str = "truth", prediction: str = "pred") -> DataFrame:
    """Wide view: one row per true class, one column per predicted class."""
    return (
        pred.groupBy(F.col(truth).alias("truth"))
        .pivot(prediction, list(classes))
        .agg(F.count(F.lit(1)))
        .na.fill(0)
    )


def accuracy(pred: DataFrame, truth: str = "truth", prediction: str = "pred", exclude: Sequence = ()) -> DataFrame:
    hit = F.avg((F.col(truth) == F.col(prediction)).cast("int")).alias("accuracy")
    return without(pred, exclude, truth, prediction).agg(hit, F.count("*").alias("n"))


def without(pred: DataFrame, exclude: Sequence, truth: str = "truth", prediction: str = "pred") -> DataFrame:
    if not exclude:
        return pred
    return pred.filter(~F.col(truth).isin(list(exclude)) & ~F.col(prediction).isin(list(exclude)))


def per_class(pred: DataFrame, truth: str = "truth", prediction: str = "pred") -> DataFrame:
    """(class, tp, support, predicted, precision, recall, f1); undefined ratios are 0."""
    cells = counts(pred, truth, prediction)
    by_truth = cells.select(F.col("truth").alias("class"), "n", F.lit(0).alias("p"), (F.col("truth") == F.col("pred")).alias("hit"))
    by_pred = cells.select(F.col("pred").alias("class"), F.lit(0).cast("bigint").alias("n"), F.col("n").alias("p"), F.lit(False).alias("hit"))
    sums = by_truth.withColumn("p", F.lit(0).cast("bigint")).unionByName(by_pred).groupBy("class").agg(
        F.sum(F.when(F.col("hit"), F.col("n")).otherwise(0)).alias("tp"),
        F.sum("n").alias("support"),
        F.sum("p").alias("predicted"),
    )
    precision = _zero(F.try_divide("tp", "predicted"))
    recall = _zero(F.try_divide("tp", "support"))
    f1 = _zero(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    return sums.withColumns({"precision": precision, "recall": recall}).withColumn("f1", f1)


def weighted_averages(table: DataFrame) -> DataFrame:
    """Support-weighted precision, recall and F1 of a ``per_class`` table."""
    weight = F.sum("support")
    return table.agg(*[
        F.try_divide(F.sum(F.col(c) * F.col("support")), weight).alias(c) for c in ("precision", "recall", "f1")
    ], weight.alias("support"))


def average_precision_recall(table: DataFrame, exclude: Sequence = ()) -> DataFrame:
    """Weighted averages over included classes; never-predicted classes leave the precision average only.

    A hit counts only inside the included classes, as rows and columns are both restricted.
    """
    kept = table.filter(~F.col("class").isin(list(exclude))) if exclude else table
    guessed = F.when(F.col("predicted") > 0, F.col("support"))
    return kept.agg(
        F.try_divide(F.sum(guessed * F.try_divide("tp", "predicted")), F.sum(guessed)).alias("prec_avg"),
        F.try_divide(F.sum("tp"), F.sum("support")).alias("rec_avg"),
    )


# fixed values: lower bin edges of the class histograms, the last bin is closed
HISTOGRAM_EDGES = (0.0, 0.2, 0.4, 0.6, 0.7, 0.8, 0.9, 1.0)
HISTOGRAM_END = 1.1


def class_histogram(table: DataFrame) -> DataFrame:
    """Number of classes per precision bin and per recall bin: (bin, low, precision_classes, recall_classes)."""
    edges = list(HISTOGRAM_EDGES)

    def bin_of(value: Column) -> Column:
        out = F.when(value > HISTOGRAM_END + 1e-9, None)
        for i in range(len(edges) - 1, -1, -1):
            out = out.when(value >= edges[i] - 1e-12, i)
        return out

    binned = table.select(F.explode(F.array(
        F.struct(bin_of(F.col("precision")).alias("bin"), F.lit(1).alias("p"), F.lit(0).alias("r")),
        F.struct(bin_of(F.col("recall")).alias("bin"), F.lit(0).alias("p"), F.lit(1).alias("r")),
    )).alias("x")).select("x.*")
    empty = F.transform(F.sequence(F.lit(0), F.lit(len(edges) - 1)),
                        lambda i: F.struct(i.alias("bin"), F.lit(0).alias("p"), F.lit(0).alias("r")))
    grid = table.sparkSession.range(1).select(F.inline(empty))
    return grid.unionByName(binned).groupBy("bin").agg(
        F.sum("p").alias("precision_classes"), F.sum("r").alias("recall_classes")
    ).withColumn("low", F.get(F.array(*[F.lit(e) for e in edges]), F.col("bin")))


def below_threshold_rejected(prediction: Column, score: Column, label, threshold) -> Column:
    """Predictions of ``label`` scored below ``threshold`` become -1."""
    return F.when((prediction == label) & (score < threshold), F.lit(-1)).otherwise(prediction)


def threshold_sweep(pred: DataFrame, label, points: int, truth: str = "truth", prediction: str = "pred", score: str = "score") -> DataFrame:
    """Precision and recall of one class at ``points`` thresholds from 0.99 * lowest to 1.01 * highest score.

    Each row falls between two grid points: one pass counts rows per grid cell, and the curve is a running
    sum over the ``points`` cells, instead of every row meeting every threshold.
    """
    hits = (F.col(prediction) == label)
    bounds = pred.filter(hits).agg(
        F.struct((F.min(score) * 0.99).alias("lo"), (F.max(score) * 1.01).alias("hi"), F.count("*").alias("n")).alias("b")
    ).scalar()
    lo, hi = F.col("__b.lo"), F.col("__b.hi")
    grid = _grid_points(lo, hi, points)
    # highest grid point that is <= score: thresholds 0..cell keep the row. Arithmetic proposes, the grid decides.
    guess = F.floor((F.col(score) - lo) / F.nullif(hi - lo, F.lit(0.0)) * (points - 1)).cast("int")
    guess = F.greatest(F.lit(0), F.least(guess, F.lit(points - 1)))
    cell = (
        F.when((guess < points - 1) & (F.col(score) >= _grid_point(lo, hi, guess + 1, points)), guess + 1)
        .when(F.col(score) < _grid_point(lo, hi, guess, points), guess - 1)
        .otherwise(guess)
    )
    cells = (
        pred.filter(hits).withColumn("__b", bounds)
        .groupBy(cell.alias("point"))
        .agg(F.count("*").alias("p"), F.sum((F.col(truth) == label).cast("bigint")).alias("tp"))
    )
    support = pred.agg(F.count(F.when(F.col(truth) == label, 1))).scalar()
    base = pred.sparkSession.range(points).select(F.col("id").cast("int").alias("point"))
    kept = Window.partitionBy(F.lit(0)).orderBy(F.col("point").desc()).rowsBetween(Window.unboundedPreceding, 0)
    curve = base.join(cells, "point", "left").withColumns({
        "kept": F.coalesce(F.sum("p").over(kept), F.lit(0)), "tp": F.coalesce(F.sum("tp").over(kept), F.lit(0)),
    }).withColumn("__b", bounds)
    return curve.select(
        "point", _grid_point(lo, hi, F.col("point"), points).alias("threshold"),
        _zero(F.try_divide("tp", "kept")).alias("precision"), _zero(F.try_divide("tp", support)).alias("recall"),
    )


def _grid_point(lo: Column, hi: Column, i: Column, points: int) -> Column:
    return lo + (hi - lo) / (points - 1) * i


def _grid_points(lo: Column, hi: Column, points: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: _grid_point(lo, hi, i, points))


def score_curve(pred: DataFrame, truth: str = "truth", score: str = "score") -> DataFrame:
    """Cumulative hits and false alarms at each distinct score, best first: (score, tp, fp).

    Ties are pre-aggregated, then the running sums go over range partitions of the distinct scores.
    """
    by_score = pred.groupBy(score).agg(
        F.sum(F.col(truth).cast("bigint")).alias("__p"), F.sum(1 - F.col(truth).cast("bigint")).alias("__n")
    )
    return running(by_score, [F.col(score).desc()], {"tp": ("sum", F.col("__p")), "fp": ("sum", F.col("__n"))}, unique=True).select(
        F.col(score).alias("score"), F.col("__p").alias("dtp"), F.col("__n").alias("dfp"), "tp", "fp"
    )


def ranking_areas(pred: DataFrame, truth: str = "truth", score: str = "score") -> DataFrame:
    """Area under the ROC curve and under the precision/recall curve, both by trapezoids over all thresholds.

    A point's predecessor is its own running sum less its own counts, so no ordering pass is needed here.
    The PR curve ends at (recall 0, precision 1) and stops once every positive has been found.
    """
    curve = score_curve(pred, truth, score)
    totals = curve.agg(F.struct(F.sum("dtp").alias("p"), F.sum("dfp").alias("n")).alias("t")).scalar()
    c = curve.withColumn("t", totals)
    before_tp, before_fp = F.col("tp") - F.col("dtp"), F.col("fp") - F.col("dfp")
    roc = F.col("dfp") * (F.col("tp") + before_tp) / 2
    precision = F.col("tp") / (F.col("tp") + F.col("fp"))
    previous = F.coalesce(F.try_divide(before_tp, before_tp + before_fp), F.lit(1.0))
    pr = F.col("dtp") * (precision + previous) / 2
    return c.agg(
        F.try_divide(F.sum(roc), F.max("t.p") * F.max("t.n")).alias("auroc"),
        F.try_divide(F.sum(pr), F.max("t.p")).alias("auprc"),
    )


def cross_entropy(scores: Column, target: Column, given: str = "logits") -> Column:
    """Loss of one sample: -log of the target's probability."""
    if given not in ("logits", "probabilities"):
        raise ValueError(f"unknown score kind {given!r}")
    least = F.lit(1e-300)
    if given == "logits":
        return -F.greatest(A.log_softmax_at(scores, target), F.log(least))
    return -F.log(F.greatest(F.get(scores, target.cast("int")), least))


def mean_loss(pred: DataFrame, loss: Column) -> DataFrame:
    return pred.agg(F.avg(loss).alias("loss"), F.count("*").alias("samples"))


def masked_mse(cells: DataFrame, target: str, prediction: str, predict: Column, real: Column) -> DataFrame:
    """Mean squared error over cells to predict that are not padding."""
    squared = F.when(predict & real, F.pow(F.col(target) - F.col(prediction), 2))
    return cells.agg(F.avg(squared).alias("mse"), F.count(squared).alias("cells"))


def per_sample(cells: DataFrame, sample: str, metric: Column, out: str = "total") -> DataFrame:
    return cells.groupBy(sample).agg(F.sum(metric).alias(out))


def top_k_accuracy(pred: DataFrame, scores: str, truth: str, k: int) -> DataFrame:
    """Share of samples whose true class is among the 1, 2, ... k best scored: (k, accuracy)."""
    rank = A.rank_of(F.col(scores), F.col(truth))
    return top_k_from_rank(pred, rank, k)


def top_k_from_ranked(pred: DataFrame, ranked: str, truth: str, k: int) -> DataFrame:
    """As above from an array of class codes already ordered by score."""
    found = F.array_position(F.col(ranked), F.col(truth))
    return top_k_from_rank(pred, F.when(found > 0, found), k)


def top_k_from_rank(pred: DataFrame, rank: Column, k: int) -> DataFrame:
    hits = [F.avg(F.coalesce((rank <= i), F.lit(False)).cast("int")) for i in range(1, k + 1)]
    wide = pred.agg(F.array(*hits).alias("a"))
    return wide.select(F.posexplode("a").alias("k", "accuracy")).withColumn("k", F.col("k") + 1)


def thieves(cells: DataFrame, top: int = 2) -> DataFrame:
    """Per class the other classes that take most of it: (truth, rank, pred, share), among the class's ``top`` + 1 largest cells.

    ``cells`` may leave out empty ones. Of those only the ``top`` + 1 last classes by name can get a rank, where a class has fewer cells
    than ranks: these alone are filled in, so work grows with the cells that occur and not with the classes squared.
    """
    classes = label_grid(cells).filter("c IS NOT NULL")
    last = classes.orderBy(F.col("c").desc()).limit(top + 1).agg(F.collect_list("c")).scalar()
    spare = classes.select(F.col("c").alias("truth"), F.explode(last).alias("pred")).join(cells, ["truth", "pred"], "left_anti")
    known = cells.select("truth", "pred", "share").unionByName(spare.withColumn("share", F.lit(0.0)))
    by_share = Window.partitionBy("truth").orderBy(F.col("share").desc(), F.col("pred").desc())
    ranked = known.withColumn("rank", F.row_number().over(by_share)).filter(F.col("rank") <= top + 1)
    return ranked.filter("truth <> pred").select("truth", "rank", "pred", "share")


def best_epoch(metrics: DataFrame, metric: str, keys: Sequence[str] = ("run_id", "split")) -> DataFrame:
    """Epoch with the best value of ``metric`` (lowest for a loss, else highest); the earliest one wins."""
    value = F.col("value") if metric == "loss" else -F.col("value")
    best = F.min_by("epoch", F.struct(value, F.col("epoch")))
    return metrics.filter(F.col("metric") == metric).groupBy(*keys).agg(
        best.alias("epoch"), F.min_by("value", F.struct(value, F.col("epoch"))).alias("value")
    )


def classification_report(pred: DataFrame, truth: str = "truth", prediction: str = "pred", top: int = 2) -> DataFrame:
    """One row per class by falling frequency, plus the weighted average row."""
    table = per_class(pred, truth, prediction)
    stolen = thieves(confusion(pred, truth, prediction), top).groupBy("truth").agg(
        F.array_sort(F.collect_list(F.struct("rank", "pred", "share"))).alias("s")
    )
    whole = F.sum("support").over(Window.partitionBy(F.lit(0)))  # one row per class
    rows = table.join(stolen, F.col("class") == F.col("truth"), "left").select(
        F.col("class").cast("string").alias("class"), "precision", "recall", "f1",
        F.try_divide("support", whole).alias("rel_freq"), F.col("support").alias("abs_freq"),
        F.transform("s", lambda x: F.struct(x["pred"].cast("string").alias("class"), x["share"].alias("share"))).alias("thieves"),
    )
    average = weighted_averages(table).select(
        F.lit("avg / total").alias("class"), "precision", "recall", "f1", F.lit(1.0).alias("rel_freq"),
        F.col("support").alias("abs_freq"), F.lit(None).cast("array<struct<class:string,share:double>>").alias("thieves"),
    )
    return rows.unionByName(average)


def leaderboard(results: DataFrame, dataset: str = "dataset", model: str = "model", value: str = "accuracy") -> DataFrame:
    """Mean over repeats per (dataset, model) with its rank, and the mean over datasets per model."""
    means = results.groupBy(dataset, model).agg(F.avg(value).alias("mean"))
    overall = means.groupBy(model).agg(F.avg("mean").alias("mean")).select(F.lit("mean").alias(dataset), model, "mean")
    both = means.withColumn(dataset, F.col(dataset).cast("string")).unionByName(overall)
    return both.withColumn("rank", F.dense_rank().over(Window.partitionBy(dataset).orderBy(F.col("mean").desc())))
