"""Model registry over pyspark.ml, closed-form models, and the four tasks."""

from __future__ import annotations

import inspect
import math
from collections.abc import Callable, Sequence

from pyspark.ml import Model, Pipeline
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LinearSVC,
    MultilayerPerceptronClassifier,
    NaiveBayes,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.functions import arrays as A
from tidemill.operators.boosting import Boosting
from tidemill.operators.metrics import masked_mse
from tidemill.operators.ridge import Ridge, RidgeModel, TooWide
from tidemill.session import materialize

# fixed values: penalties tried by the ridge models, 10 log-spaced from 1e-3 to 1e3
RIDGE_ALPHAS = tuple(10 ** (-3 + 6 * i / 9) for i in range(10))


def with_vector(df: DataFrame, array: str, out: str = "features") -> DataFrame:
    return df.withColumn(out, array_to_vector(F.col(array).cast("array<double>")))


def class_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """Weight n / (classes * n_label) per row, so that every class counts the same."""
    sizes = df.groupBy(label).agg(F.count("*").alias("__n"))
    total = sizes.agg(F.struct(F.sum("__n").alias("n"), F.count("*").alias("k")).alias("t")).scalar()
    weights = sizes.withColumn("__t", total).select(label, (F.col("__t.n") / (F.col("__t.k") * F.col("__n"))).alias(out))
    return df.join(materialize(weights, "weights"), label)


class RidgeRegression(Ridge):
    """Least squares with an L2 penalty chosen by cross-validation, all from one aggregation (``operators.ridge``).

    Where the matrices would be too wide for it, L-BFGS takes a pass per step, penalty and fold.
    """

    def __init__(self, features: str = "features", label: str = "label", alphas: Sequence[float] = RIDGE_ALPHAS, folds: int | None = 3,
                 weight: str | None = None):
        super().__init__(features, label, alphas, folds, False, weight)

    def fit(self, df: DataFrame) -> Model | RidgeModel:
        try:
            return super().fit(df)
        except TooWide:
            weighted = {"weightCol": self.weight} if self.weight else {}
            base = LinearRegression(featuresCol=self.features, labelCol=self.label, elasticNetParam=0.0, standardization=False, solver="l-bfgs", **weighted)
            rows = df.count()  # this solver's loss is a mean over rows
            grid = ParamGridBuilder().addGrid(base.regParam, [a / rows for a in self.alphas]).build()
            return CrossValidator(estimator=base, estimatorParamMaps=grid, numFolds=self.folds or 3, seed=1337, parallelism=2,
                                  evaluator=RegressionEvaluator(labelCol=self.label, metricName="mse")).fit(df).bestModel


class RidgeClassifier(Ridge):
    """One +-1 regression per class, all from one aggregation; the class with the highest score wins."""

    def __init__(self, features: str = "features", label: str = "label", alphas: Sequence[float] = RIDGE_ALPHAS, folds: int | None = 3,
                 weight: str | None = None):
        super().__init__(features, label, alphas, folds, True, weight)

    def fit(self, df: DataFrame) -> Model | RidgeModel:
        try:
            return super().fit(df)
        except TooWide:
            classes = sorted(r[0] for r in df.select(self.label).distinct().collect())
            models = []
            for c in classes:
                signed = df.withColumn("__sign", F.when(F.col(self.label) == c, 1.0).otherwise(-1.0))
                models.append(RidgeRegression(self.features, "__sign", self.alphas, self.folds, self.weight).fit(signed))
            return SeparateModels(classes, models)


class SeparateModels:
    """One regression per class; the class with the highest score wins."""

    def __init__(self, classes: Sequence[int], models: Sequence[Model]):
        self.classes, self.models = list(classes), list(models)

    def transform(self, df: DataFrame) -> DataFrame:
        scored = df
        for c, m in zip(self.classes, self.models):
            scored = m.transform(scored).withColumnRenamed("prediction", f"__score_{c}")
        scores = F.array(*[F.col(f"__score_{c}") for c in self.classes])
        best = F.get(F.array(*[F.lit(c) for c in self.classes]), A.argmax(F.col("scores")))
        return scored.withColumn("scores", scores).withColumn("prediction", best.cast("double")).select(
            *df.columns, "scores", "prediction"
        )


class AdaBoostModel:
    def __init__(self, classes: Sequence[int], trees: Sequence[tuple[float, Model]]):
        self.classes, self.trees = list(classes), list(trees)

    def transform(self, df: DataFrame) -> DataFrame:
        votes = df
        for i, (alpha, tree) in enumerate(self.trees):
            voted = tree.transform(votes).withColumn(f"__v{i}", F.struct(F.col("prediction").alias("c"), F.lit(alpha).alias("a")))
            votes = voted.select(*votes.columns, f"__v{i}")
        ballots = F.array(*[F.col(f"__v{i}") for i in range(len(self.trees))])

        def weight_for(c: float):
            return F.aggregate(F.filter(ballots, lambda v: v["c"] == c), F.lit(0.0), lambda s, v: s + v["a"])

        scores = F.array(*[weight_for(float(c)) for c in self.classes])
        best = F.get(F.array(*[F.lit(float(c)) for c in self.classes]), A.argmax(F.col("scores")))
        return votes.withColumn("scores", scores).withColumn("prediction", best).select(*df.columns, "scores", "prediction")


class AdaBoost:
    """Multi-class boosting of shallow trees: rows a tree gets wrong weigh more in the next round.

    Each round's weights are written to the shared folder, so the plan does not grow with the rounds.
    """

    def __init__(self, features: str = "features", label: str = "label", rounds: int = 10, depth: int = 1, weight: str | None = None):
        self.features, self.label, self.rounds, self.depth, self.weight = features, label, rounds, depth, weight

    def fit(self, df: DataFrame) -> AdaBoostModel:
        classes = sorted(r[0] for r in df.select(self.label).distinct().collect())
        k = len(classes)
        weighted = df.select(self.features, self.label, (F.col(self.weight) if self.weight else F.lit(1.0)).alias("__w"))
        trees = []
        for _ in range(self.rounds):
            tree = DecisionTreeClassifier(featuresCol=self.features, labelCol=self.label, weightCol="__w", maxDepth=self.depth, seed=7).fit(weighted)
            judged = tree.transform(weighted)
            wrong = F.col("prediction") != F.col(self.label)
            err = judged.agg(F.sum(F.when(wrong, F.col("__w")).otherwise(0.0)) / F.sum("__w")).first()[0]
            if err >= 1 - 1 / k:
                break
            err = max(err, 1e-10)
            alpha = math.log((1 - err) / err) + math.log(k - 1) if k > 1 else 1.0
            trees.append((alpha, tree))
            if err <= 1e-10:
                break
            scale = math.exp(alpha)
            updated = judged.withColumn("__w", F.when(wrong, F.col("__w") * scale).otherwise(F.col("__w")))
            mean = updated.agg(F.avg("__w")).first()[0]
            weighted = materialize(updated.select(self.features, self.label, (F.col("__w") / mean).alias("__w")), "boost")
        if not trees:
            raise ValueError("no tree beats chance")
        return AdaBoostModel(classes, trees)


REGISTRY: dict[str, Callable] = {
    "decision_tree": lambda **p: DecisionTreeClassifier(**p),
    "random_forest": lambda **p: RandomForestClassifier(**{"seed": 7, **p}),
    "gradient_boosting": lambda **p: OneVsRest(parallelism=4, classifier=GBTClassifier(**{"maxIter": 10, "seed": 7, **p})),
    # fixed values: the usual defaults of the two libraries' classifiers
    "hist_gradient_boosting": lambda **p: Boosting(**{"growth": "leaf", "rate": 0.1, "l2": 0.0, "min_rows": 20, "max_leaves": 31, **p}),
    "xgboost": lambda **p: Boosting(**{"growth": "depth", "rate": 0.3, "l2": 1.0, "min_hessian": 1.0, "max_depth": 6, **p}),
    "naive_bayes": lambda **p: NaiveBayes(modelType="gaussian", **p),
    "linear_svm": lambda **p: OneVsRest(parallelism=4, classifier=LinearSVC(**p)),
    "mlp": lambda **p: MultilayerPerceptronClassifier(**{"seed": 7, **p}),
    "ridge_classifier": lambda **p: RidgeClassifier(**p),
    "ridge_regression": lambda **p: RidgeRegression(**p),
    "ada_boost": lambda **p: AdaBoost(**p),
    "gradient_boosting_regression": lambda **p: GBTRegressor(**{"maxIter": 10, "seed": 7, **p}),
    "linear_regression": lambda **p: LinearRegression(**p),
}


def make_model(name: str, **params):
    """Estimator by name; only parameters the model knows are accepted by its constructor."""
    if name not in REGISTRY:
        raise ValueError(f"unknown model {name!r}; known: {sorted(REGISTRY)}")
    return REGISTRY[name](**params)


def configured(build: Callable, config: dict):
    """Call ``build`` with those entries of a flat configuration that its signature names."""
    known = inspect.signature(build).parameters
    return build(**{k: v for k, v in config.items() if k in known})


def configured_model(name: str, config: dict):
    """The registry's model of this name, filled with those entries of a flat configuration that its constructor names."""
    kind = type(make_model(name))
    known = set(inspect.signature(kind.__init__).parameters) - {"self"}
    return make_model(name, **{k: v for k, v in config.items() if k in known})


def apply_transforms(df: DataFrame, transforms: Sequence[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Frame-to-frame functions applied in order; the user's hook between loading and fitting."""
    for t in transforms:
        df = df.transform(t)
    return df


def classify(train: DataFrame, test: DataFrame, model: str, sample: str, label: str, class_weight: str | None = None, **params) -> DataFrame:
    """Fit on ``train``, predict ``test``: (sample, truth, pred). Both hold a ``features`` vector.

    ``class_weight="balanced"``: each row weighs n / (classes * rows of its class) in the fit, in any model that knows weights.
    """
    if class_weight not in (None, "balanced"):
        raise ValueError(f"class_weight is None or 'balanced', not {class_weight!r}")
    params = {"labelCol": label, **params} if model in ("decision_tree", "random_forest", "naive_bayes", "mlp") else params
    estimator = make_model(model, **params)
    if class_weight:
        train = class_weights(train, label, "__class_weight")
        if isinstance(estimator, (RidgeClassifier, AdaBoost, Boosting)):
            estimator.weight = "__class_weight"
        elif hasattr(estimator, "setWeightCol"):
            estimator = estimator.setWeightCol("__class_weight")
        else:
            raise ValueError(f"{model} knows no weights")
    if isinstance(estimator, OneVsRest):
        estimator = estimator.setLabelCol(label)
    if isinstance(estimator, (RidgeClassifier, AdaBoost, Boosting)):
        estimator.label = label
    fitted = estimator.fit(train)
    return fitted.transform(test).select(
        sample, F.col(label).cast("int").alias("truth"), F.col("prediction").cast("int").alias("pred")
    )


def regress(train: DataFrame, test: DataFrame, sample: str, label: str, model: str = "ridge_regression", **params) -> DataFrame:
    """(sample, target, prediction)."""
    if model == "ridge_regression":
        estimator = make_model(model, label=label, **params)
    else:
        estimator = make_model(model, labelCol=label, **params)
    return estimator.fit(train).transform(test).select(sample, F.col(label).alias("target"), "prediction")


def gaussian_moments(df: DataFrame, label: str, features: Sequence[str]) -> DataFrame:
    """(label, feature, mean, var, n): sufficient statistics of a Gaussian naive Bayes model."""
    parts = [
        F.struct(F.lit(c).alias("feature"), F.avg(c).alias("mean"), F.var_pop(c).alias("var")) for c in features
    ]
    return df.groupBy(label).agg(F.count("*").alias("n"), F.array(*parts).alias("s")).select(
        label, "n", F.inline("s")
    )


def gaussian_predict(df: DataFrame, sample: str, features: Sequence[str], moments: DataFrame, label: str, eps: float = 1e-9) -> DataFrame:
    """Most likely label of each row under the moments; the whole model is one array value, one entry per label."""
    def stat(name: str, c: str):
        return F.max(F.when(F.col("feature") == c, F.col(name)))

    per_label = moments.groupBy(label).agg(
        F.max("n").alias("n"), *[e for i, c in enumerate(features) for e in (stat("mean", c).alias(f"m{i}"), stat("var", c).alias(f"v{i}"))]
    )
    packed = per_label.agg(F.array_sort(F.collect_list(F.struct(
        label, "n", *[f"m{i}" for i in range(len(features))], *[f"v{i}" for i in range(len(features))]
    ))).alias("m")).scalar()

    def score(entry):
        s = F.log(entry["n"].cast("double"))
        for i, c in enumerate(features):
            var = entry[f"v{i}"] + F.lit(eps)
            s = s - F.log(var) / 2 - F.pow(F.col(c) - entry[f"m{i}"], 2) / (2 * var)
        return F.struct(s.alias("score"), (-entry[label]).alias("minus"), entry[label].alias("label"))

    best = F.array_max(F.transform(F.col("__model"), score))
    return df.withColumn("__model", packed).select(sample, best["label"].alias("pred"), best["score"].alias("score"))


def impute_and_score(cells: DataFrame, sample: str, t: str, value: str, keep: str) -> DataFrame:
    """Hide the cells whose ``keep`` is false, restore them by interpolation, score on the hidden cells."""
    from tidemill.operators.resample import interpolate

    hidden = cells.withColumn("restored", F.when(F.col(keep), F.col(value)))
    restored = interpolate(hidden, [sample], t, ["restored"])
    return masked_mse(restored, value, "restored", ~F.col(keep), F.col("restored").isNotNull())


def transduce(steps: DataFrame, targets: Sequence[str], visible: Sequence[str], keep: str, **params) -> DataFrame:
    """Predict masked features from the visible ones of the same step, trained on the steps left unmasked."""
    vector = steps.withColumn("features", array_to_vector(F.array(*[F.col(c).cast("double") for c in visible])))
    scored = vector
    for target in targets:
        model = LinearRegression(labelCol=target, predictionCol=f"{target}_pred", **params).fit(vector.filter(F.col(keep)))
        scored = model.transform(scored)
    return scored.drop("features")
