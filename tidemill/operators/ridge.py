"""Ridge regression and classification from one aggregation.

With z = (1, features, targets), the sums of z times its transpose, one matrix for each fold, hold all that least squares
needs: every penalty, every class and every fold is solved from them on the driver, and so is the error on the fold left out.
So the data are read once, however many penalties, classes and folds there are; leave-one-out errors take one more pass.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOMENT_BYTES = 128 << 20  # of the matrices of all folds; wider features need another solver
_PANEL = 64  # rows of a matrix that are added up together


class TooWide(ValueError):
    """The matrices of all folds would not fit the bound."""


def as_array(df: DataFrame, features: str) -> Column:
    is_vector = isinstance(df.schema[features].dataType, VectorUDT)
    return vector_to_array(F.col(features)) if is_vector else F.col(features).cast("array<double>")


def moments(df: DataFrame, folds: int) -> tuple[np.ndarray, np.ndarray]:
    """(matrices (folds, D, D), shift of the features) of the columns x, y (arrays), w and fold.

    Features are shifted by a row's own before they are multiplied, so that large offsets cost no digits. A task
    keeps the matrices of all folds, at most ``MOMENT_BYTES``; tasks' matrices are added up by panels of rows.
    """
    some = df.select("x", F.size("y").alias("targets")).first()
    if some is None:
        raise ValueError("no rows to fit")
    shift, size = np.array(some.x, dtype=float), 1 + len(some.x) + some.targets
    if 8 * folds * size * size > MOMENT_BYTES:
        raise TooWide(f"{size} columns in {folds} folds")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((folds, size, size))
        for batch in batches:
            n = batch.num_rows
            if n:
                x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(n, -1) - shift
                z = np.hstack([np.ones((n, 1)), x, batch.column("y").flatten().to_numpy(zero_copy_only=False).reshape(n, -1)])
                w, fold = batch.column("w").to_numpy(zero_copy_only=False), batch.column("fold").to_numpy(zero_copy_only=False)
                for f in np.unique(fold):
                    mine = z[fold == f]
                    total[f] += mine.T @ (mine * w[fold == f][:, None])
        for f in np.flatnonzero(total[:, 0, 0]):
            panels = [total[f, a:a + _PANEL].tobytes() for a in range(0, size, _PANEL)]
            yield pa.RecordBatch.from_arrays([pa.array([int(f)] * len(panels), pa.int32()), pa.array(range(len(panels)), pa.int32()), pa.array(panels, pa.binary())],
                                             names=["fold", "panel", "data"])

    def merge(key: tuple[pa.Scalar, ...], parts: pa.Table) -> pa.Table:
        data = sum(np.frombuffer(p, float) for p in parts.column("data").to_pylist())
        return pa.table({"fold": [key[0].as_py()], "panel": [key[1].as_py()], "data": [data.tobytes()]},
                        schema=pa.schema([("fold", pa.int32()), ("panel", pa.int32()), ("data", pa.binary())]))

    shape = "fold int, panel int, data binary"
    rows = df.select("x", "y", "w", "fold").mapInArrow(add, shape).groupBy("fold", "panel").applyInArrow(merge, shape).collect()
    out = np.zeros((folds, size, size))
    for r in rows:
        out[r.fold, r.panel * _PANEL:(r.panel + 1) * _PANEL] = np.frombuffer(r.data, float).reshape(-1, size)
    return out, shift


class _Solver:
    """Coefficients for any penalty from one matrix of moments; the intercept is not penalised."""

    def __init__(self, m: np.ndarray, width: int):
        n, self.x_mean, self.y_mean = m[0, 0], m[0, 1:1 + width] / m[0, 0], m[0, 1 + width:] / m[0, 0]
        gram = m[1:1 + width, 1:1 + width] - n * np.outer(self.x_mean, self.x_mean)
        self.cross = m[1:1 + width, 1 + width:] - n * np.outer(self.x_mean, self.y_mean)
        self.values, self.vectors = np.linalg.eigh(gram)
        self.n = n

    def shrunk(self, alpha: float) -> np.ndarray:
        """Inverse of each eigenvalue with the penalty; directions that hold nothing stay out."""
        least = self.values.max(initial=0) * 1e-12
        return np.where(self.values + alpha > least, 1 / np.where(self.values + alpha > least, self.values + alpha, 1), 0)

    def solve(self, alpha: float) -> tuple[np.ndarray, np.ndarray]:
        """(coefficients (features, targets), intercepts)."""
        w = self.vectors @ (self.shrunk(alpha)[:, None] * (self.vectors.T @ self.cross))
        return w, self.y_mean - self.x_mean @ w


def fold_errors(m: np.ndarray, width: int, alphas: Sequence[float]) -> np.ndarray:
    """(folds, penalties): sum of squared errors on each fold of the model that all others give, from moments alone."""
    total, out = m.sum(axis=0), np.zeros((len(m), len(alphas)))
    for f, held in enumerate(m):
        if not held[0, 0] or held[0, 0] == total[0, 0]:
            continue
        solver = _Solver(total - held, width)
        for i, alpha in enumerate(alphas):
            w, b = solver.solve(alpha)
            beta = np.vstack([b, w])
            zz, zy, yy = held[:1 + width, :1 + width], held[:1 + width, 1 + width:], np.diag(held[1 + width:, 1 + width:])
            out[f, i] = (yy - 2 * (beta * zy).sum(axis=0) + (beta * (zz @ beta)).sum(axis=0)).sum()
    return out


def _left_out(df: DataFrame, m: np.ndarray, shift: np.ndarray, alphas: Sequence[float]) -> np.ndarray:
    """Sum of squared leave-one-out errors of each penalty, in one pass over the rows."""
    solver, width = _Solver(m.sum(axis=0), len(shift)), len(shift)
    solved, shrunk = [solver.solve(a) for a in alphas], [solver.shrunk(a) for a in alphas]

    def errors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(alphas))
        for batch in batches:
            n = batch.num_rows
            if n:
                x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(n, width) - shift
                y = batch.column("y").flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
                w = batch.column("w").to_numpy(zero_copy_only=False)
                turned = ((x - solver.x_mean) @ solver.vectors) ** 2
                for i, ((coef, b), inverse) in enumerate(zip(solved, shrunk)):
                    own = w * (1 / solver.n + turned @ inverse)
                    total[i] += (w[:, None] * ((y - x @ coef - b) / np.maximum(1 - own, 1e-12)[:, None]) ** 2).sum()
        yield pa.RecordBatch.from_arrays([pa.array(range(len(alphas)), pa.int32()), pa.array(total)], names=["i", "e"])

    out = np.zeros(len(alphas))
    for r in df.select("x", "y", "w").mapInArrow(errors, "i int, e double").groupBy("i").agg(F.sum("e").alias("e")).collect():
        out[r.i] = r.e
    return out


class RidgeModel:
    """Scores are the features times ``coefficients`` plus ``intercepts``, a column for each target."""

    def __init__(self, features: str, coefficients: np.ndarray, intercepts: np.ndarray, alpha: float, errors: dict[float, float], classes: Sequence | None):
        self.features, self.coefficients, self.intercepts = features, coefficients, intercepts
        self.alpha, self.errors, self.classes = alpha, errors, classes

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``scores`` and ``prediction``: the score of a regression, the class of the (first) highest score otherwise."""
        w, b = self.coefficients, self.intercepts

        @F.pandas_udf("array<double>")
        def score(x: pd.Series) -> pd.Series:
            return pd.Series(list(np.stack(x.to_numpy()) @ w + b)) if len(x) else pd.Series([], dtype=object)

        scored = df.withColumn("scores", score(as_array(df, self.features)))
        if self.classes is None:
            return scored.withColumn("prediction", F.get("scores", F.lit(0)))
        best = F.array_position("scores", F.array_max("scores")).cast("int") - 1
        return scored.withColumn("prediction", F.get(F.array(*[F.lit(c) for c in self.classes]), best).cast("double"))


class Ridge:
    """Ridge regression, or, with ``classify``, one regression to +-1 for each class; one penalty for all, by least error.

    ``folds``: parts of the cross-validation (rows go to them by a hash, or by the column ``fold``); ``None``: leave one out.
    ``weight``: column of row weights. Rows with a null target are left out. Errors are weighted squares, summed over targets.
    """

    def __init__(self, features: str = "features", label: str = "label", alphas: Sequence[float] = (1.0,), folds: int | None = 3,
                 classify: bool = False, weight: str | None = None, fold: str | None = None):
        self.features, self.label, self.alphas, self.folds = features, label, list(alphas), folds
        self.classify, self.weight, self.fold = classify, weight, fold

    def fit(self, df: DataFrame) -> RidgeModel:
        known = df.filter(F.col(self.label).isNotNull())
        classes = sorted(r[0] for r in known.select(self.label).distinct().collect()) if self.classify else None
        if classes is not None and len(classes) < 2:
            raise ValueError("a classifier needs two classes at least")
        target = F.col(self.label)
        y = F.array(*[F.when(target == c, 1.0).otherwise(-1.0) for c in classes]) if self.classify else F.array(target.cast("double"))
        tried = self.folds if self.folds and len(self.alphas) > 1 else 1
        fold = F.col(self.fold) if self.fold else F.pmod(F.xxhash64(as_array(df, self.features), target), F.lit(tried))
        rows = known.select(as_array(df, self.features).alias("x"), y.alias("y"),
                            (F.col(self.weight).cast("double") if self.weight else F.lit(1.0)).alias("w"),
                            (fold if tried > 1 else F.lit(0)).cast("int").alias("fold"))
        m, shift = moments(rows, tried)
        if len(self.alphas) == 1:
            errors = np.zeros(1)
        elif self.folds:
            errors = fold_errors(m, len(shift), self.alphas).sum(axis=0)
        else:
            errors = _left_out(rows, m, shift, self.alphas)
        alpha = self.alphas[int(errors.argmin())]
        w, b = _Solver(m.sum(axis=0), len(shift)).solve(alpha)
        mean = errors / m[:, 0, 0].sum()
        return RidgeModel(self.features, w, b - shift @ w, alpha, dict(zip(self.alphas, mean.tolist())), classes)
